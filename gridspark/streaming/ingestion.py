"""Streams: packages as they arrive, and rates over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.sources.packages import package_entries

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_packages(spark: SparkSession, path: str, pattern: str = "*.accdt", once: str | None = None) -> DataFrame:
    """A stream of the entries of packages that arrive in a folder.

    With `once` (a time, such as "7 days") a package whose bytes came before, under any name, is
    left out; hashes are kept until the files' times are that much past.
    """
    files = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", pattern).load(path)
    if once is not None:
        files = files.withColumn("content_hash", F.sha2("content", 256)).withWatermark("modificationTime", once).dropDuplicatesWithinWatermark(["content_hash"])
    return package_entries(files)


def over_limit(events: DataFrame, key: str, at: str, limit: int, seconds: int = 60) -> DataFrame:
    """Events that exceed `limit` of their key within the last `seconds`, themselves included.

    Time is cut into spans; an event of the last `seconds` of a span counts in the next one, too. So a
    window holds one key in one span, however many events a key has.
    """
    second, span = F.unix_timestamp(at), max(3600, 10 * seconds)
    own = F.floor(second / span)
    spread = events.withColumn("__second", second).withColumn("__own", own)
    spread = spread.withColumn("__span", F.explode(F.when(second > (own + 1) * span - seconds, F.array(own, own + 1)).otherwise(F.array(own))))
    window = Window.partitionBy(key, "__span").orderBy("__second").rangeBetween(-(seconds - 1), 0)
    counted = spread.withColumn("in_window", F.count(F.lit(1)).over(window))
    return counted.filter((F.col("__span") == F.col("__own")) & (F.col("in_window") > limit)).drop("__second", "__own", "__span")


def over_limit_stream(events: DataFrame, key: str, at: str, limit: int, seconds: int = 60, late: str = "2 minutes") -> DataFrame:
    """(key, second, events, in_window) of the seconds in which a key of a stream exceeds `limit`, as `over_limit` counts.

    Events may come late by `late`, in any order and repeatedly. A second is judged when the
    watermark is past it, so all its events are there; a key's state is a count for each
    second not yet judged or still in a later window, however many events there are, and goes
    when the key has been quiet for that long.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(events.dtypes)[key]

    def judge(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, numbers, done = state.get if state.exists else ([], [], None)
        counts = dict(zip(times, numbers, strict=True))
        for frame in frames:
            for second, n in frame.groupby("second").size().items():
                counts[int(second)] = counts.get(int(second), 0) + int(n)
        mark = state.getCurrentWatermarkMs() // 1000
        rows = []
        for second in sorted(counts):
            if second < mark and (done is None or second > done):
                total = sum(n for t, n in counts.items() if second - seconds < t <= second)
                if total > limit:
                    rows.append((name[0], second, counts[second], total))
        kept = {t: n for t, n in counts.items() if t > mark - seconds}
        if kept:
            state.update((list(kept), list(kept.values()), mark - 1))
            # first when the next second can be judged, at last when none is left in a window
            waiting = [t for t in kept if t >= mark]
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, ((min(waiting) + 1) if waiting else max(kept) + seconds) * 1000))
        else:
            state.remove()
        yield pd.DataFrame(rows, columns=[key, "second", "events", "in_window"])

    timed = events.withWatermark(at, late).select(key, at, F.unix_timestamp(at).alias("second"))
    return timed.groupBy(key).applyInPandasWithState(judge, f"`{key}` {kind}, second long, events long, in_window long", "seconds array<long>, counts array<long>, done long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, at: str, key: str, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts by key and event-time window, with a watermark: works on streams and tables."""
    source = events.withWatermark(at, late) if events.isStreaming else events
    grouped = source.groupBy(F.window(at, length, slide) if slide else F.window(at, length), key)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
