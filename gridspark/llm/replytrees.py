"""Chat formatting of reply trees.

Messages name the message they reply to. Self-joins that double their reach give every
message its distance from the root and the scores on the way; leaves are ranked by them
within their tree, and the same doubled links, walked from the chosen leaves, list the
messages of each path. A path is formatted as one conversation, in parts of a bounded
number of turns, with the spans that a loss mask covers; `read_back` takes it apart again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import apart, remove, write_table

#: Turns of a part: a conversation of more turns is a sequence of parts.
TURNS = 256


@dataclass(frozen=True)
class Template:
    """Marks around a turn. Marks and the other control strings are escaped inside roles and texts.

    A control string gets one backslash more after its first character than it has, so
    reading takes one away; other backslashes stay as they are. A line break in a role
    is written as a control string of its own.
    """

    begin: str = "<|im_start|>"
    middle: str = "\n"
    end: str = "<|im_end|>\n"
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    break_: str = "<|line|>"

    def _pattern(self, least: str) -> re.Pattern[str]:
        both = sorted({*self.control, self.break_}, key=len, reverse=True)
        return re.compile("|".join(f"(?<={re.escape(c[0])}){least}(?={re.escape(c[1:])})" for c in both))

    def escape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._written.sub(lambda m: m[0][:-1], text)

    def __post_init__(self) -> None:
        object.__setattr__(self, "_escaped", self._pattern(r"\\*"))
        object.__setattr__(self, "_written", self._pattern(r"\\+"))

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """The formatted turn, and where its text begins and ends."""
        head = self.begin + self.escape(role).replace("\n", self.break_) + self.middle
        body = self.escape(text)
        return head + body + self.end, len(head), len(head) + len(body)

    def turns(self, text: str) -> Iterator[tuple[str, str, int, int]]:
        """(role, text, begin and end of the text) of formatted turns."""
        at = 0
        while at < len(text):
            if not text.startswith(self.begin, at):
                raise ValueError(f"no turn begins at {at}")
            head = text.index(self.middle, at) + len(self.middle)
            stop = text.index(self.end, head)
            role = text[at + len(self.begin) : head - len(self.middle)].replace(self.break_, "\n")
            yield self.unescape(role), self.unescape(text[head:stop]), head, stop
            at = stop + len(self.end)


def linear_threads(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> tuple[DataFrame, str]:
    """(tree, id, parent, role, text) of conversations whose rows follow each other, and its path.

    A row replies to the one before it by (turn, role, text), nulls first; rows equal in
    all of it follow each other. Rows are dealt by ranges of that order, so that a
    conversation of any length is spread; a range's first row finds its parent by the
    last row of a range before, of which there is one a range.
    """
    slim = rows.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["tree", "turn", "role", "text"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, dealt_path = write_table(slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "threads-dealt")
    dealt = dealt.withColumn("range", F.shiftright("id", 33))
    within = Window.partitionBy("range").orderBy("id")
    before = dealt.select("*", F.lag("id").over(within).alias("id_before"), F.lag("tree").over(within).alias("tree_before"))
    ends = dealt.groupBy("range").agg(F.max_by(F.struct("id", "tree"), "id").alias("last"))  # a row a range
    carried = ends.select(F.lead("range").over(Window.orderBy("range")).alias("range"), F.col("last.id").alias("last_id"), F.col("last.tree").alias("last_tree"))
    linked = before.join(F.broadcast(carried), "range", "left")
    first = F.col("id_before").isNull()
    parent, owner = F.when(first, F.col("last_id")).otherwise(F.col("id_before")), F.when(first, F.col("last_tree")).otherwise(F.col("tree_before"))
    out = linked.select("tree", "id", F.when(parent.isNotNull() & owner.eqNullSafe(F.col("tree")), parent).alias("parent"), "role", "text")
    table, path = write_table(out, "threads")
    remove(rows.sparkSession, dealt_path)
    return table, path



def reply_paths(messages: DataFrame, branches: int = 1) -> tuple[DataFrame, list[str]]:
    """(tree, leaf, place, id) of the messages on the chosen root-to-leaf paths, and the tables to delete.

    `messages` has tree, id, parent and, if wanted, score (else 0), with one row for each (tree,
    id) that is not null. A parent that is null or not there makes a root. Messages on or
    behind a cycle of replies reach no root and are on no path. Leaves are ranked within
    their tree by the mean score of their path, then by its length, then by the least id;
    `branches` of each tree stay. The number of rounds is the logarithm of the depth.
    """
    spark = messages.sparkSession
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in messages.columns else F.lit(0.0)
    own = messages.select("tree", "id", "parent", score.alias("total")).filter("id is not null")
    there = own.select(F.col("tree").alias("tree_of"), F.col("id").alias("parent_of"))
    rooted = own.join(apart(there), own["tree"].eqNullSafe(there["tree_of"]) & (own["parent"] == there["parent_of"]), "left")
    step, path = write_table(rooted.select("tree", "id", F.col("parent_of").alias("above"), "total", F.lit(1).cast("long").alias("depth")), "replies")
    steps, paths = [step], [path]
    rooted = step.filter("above is null")  # what has reached its root; each round moves on only what has not
    open_, open_before = step.filter("above is not null").count(), -1
    while open_ and open_ != open_before:
        left = step.filter("above is not null")
        right = rooted.unionByName(left).select(F.col("tree").alias("tree_of"), F.col("id").alias("id_of"), F.col("above").alias("above_of"), F.col("total").alias("total_of"), F.col("depth").alias("depth_of"))
        met = left.join(apart(right), left["tree"].eqNullSafe(right["tree_of"]) & (left["above"] == right["id_of"]))
        step, path = write_table(met.select("tree", "id", F.col("above_of").alias("above"), (F.col("total") + F.col("total_of")).alias("total"), (F.col("depth") + F.col("depth_of")).alias("depth")), "replies")
        steps.append(step)
        paths.append(path)
        rooted = rooted.unionByName(step.filter("above is null"))
        open_before, open_ = open_, step.filter("above is not null").count()
    parents = steps[0].select(F.col("tree").alias("tree_of"), F.col("above").alias("parent_of")).filter("parent_of is not null").distinct()
    leaves = rooted.join(apart(parents), rooted["tree"].eqNullSafe(parents["tree_of"]) & (rooted["id"] == parents["parent_of"]), "left_anti")
    best = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "id"))
    chosen = leaves.withColumn("place", best).filter(F.col("place") <= branches)
    listed, path = write_table(chosen.select("tree", F.col("id").alias("leaf"), F.col("depth").alias("place"), "id"), "reply-paths")
    paths.append(path)
    for k, reach in enumerate(steps[:-1]):
        up = reach.filter("above is not null").select(F.col("tree").alias("tree_of"), F.col("id").alias("id_of"), "above")
        more = listed.join(apart(up), listed["tree"].eqNullSafe(up["tree_of"]) & (listed["id"] == up["id_of"]))
        more, path = write_table(more.select("tree", "leaf", (F.col("place") - (1 << k)).alias("place"), F.col("above").alias("id")), "reply-paths")
        paths.append(path)
        listed = listed.unionByName(more)
    return listed, paths


_FORMATTED = "tree long, leaf long, part long, turns int, text string, loss array<struct<start:int,stop:int>>"


def format_paths(paths: DataFrame, messages: DataFrame, template: Template | None = None, learn: str = "assistant") -> DataFrame:
    """(tree, leaf, part, turns, text, loss): each path as one conversation, in parts of TURNS turns.

    `loss` has the spans of `text`, in code points, that the loss mask covers: the texts of
    the role `learn`. Null roles and texts count as empty.
    """
    template = template or Template()
    named = messages.select(F.col("tree").alias("tree_of"), F.col("id").alias("id_of"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = paths.join(named, paths["tree"].eqNullSafe(named["tree_of"]) & (paths["id"] == named["id_of"]))
    part = F.floor((F.col("place") - 1) / TURNS).cast("long")
    grouped = turns.groupBy(F.col("tree").cast("long").alias("tree"), F.col("leaf").cast("long").alias("leaf"), part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))  # TURNS turns at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                out, loss, at = [], [], 0
                for turn in batch.column(3)[i].as_py():
                    text, start, stop = template.turn(turn["role"], turn["text"])
                    if turn["role"] == learn:
                        loss.append({"start": at + start, "stop": at + stop})
                    out.append(text)
                    at += len(text)
                names = {c: batch.column(k)[i].as_py() for k, c in enumerate(("tree", "leaf", "part"))}
                yield names | {"turns": len(out), "text": "".join(out), "loss": loss}

    return grouped.mapInArrow(lambda batches: _gathered(rows(batches), _FORMATTED_ARROW, "text"), _FORMATTED)


def _gathered(rows: Iterator[dict], schema: pa.Schema, text: str | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches of some MB of text, and of 1000 rows, at most; a longer row is one of its own."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text]) if text else 0
        if len(held) >= 1000 or size > 1_000_000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_FORMATTED_ARROW = pa.schema([("tree", pa.int64()), ("leaf", pa.int64()), ("part", pa.int64()), ("turns", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
_READ_ARROW = pa.schema([("tree", pa.int64()), ("leaf", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_READ = "tree long, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    """What is read back from the parts of one conversation, one after the other."""

    def __init__(self) -> None:
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, text: str, loss: list[dict], template: Template) -> None:
        spans, found = [(s["start"], s["stop"]) for s in loss], set()
        for role, body, start, stop in template.turns(text):
            self.n += 1
            self.turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            found.add((start, stop))
        for start, stop in spans:
            if (start, stop) not in found:
                raise ValueError(f"the loss mask covers {start} to {stop}, which is no turn's text")
            learned = template.unescape(text[start:stop])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode("utf-8", "surrogatepass"))
        self.chars += len(text)

    def row(self, key: tuple) -> dict:
        values = (*key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)
        return dict(zip(_READ_ARROW.names, values, strict=True))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation, from its formatted parts: number of turns, digests, characters.

    Parts of one conversation are read in order by one task, which holds one of them at a time: a
    digest of all its text can't be computed otherwise.
    """
    template = template or Template()
    parts = formatted.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "part")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, digest = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                here = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if digest is None or here != key:
                    if digest is not None:
                        yield digest.row(key)
                    key, digest = here, _Digest()
                digest.add(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), template)
        if digest is not None:
            yield digest.row(key)

    return parts.select("tree", "leaf", "text", "loss").mapInArrow(lambda batches: _gathered(rows(batches), _READ_ARROW), _READ)


def format_trees(messages: DataFrame, branches: int = 1, template: Template | None = None, learn: str = "assistant") -> DataFrame:
    """The best `branches` paths of every reply tree, formatted: see `reply_paths` and `format_paths`.

    `messages` has tree (long), id (long), parent, role, text and perhaps score. Rows that repeat a
    (tree, id) count once, as the least by (parent, role, text); rows with a null id are on no
    path; a null tree is a tree of its own. Other columns are ignored; no rows give no row.
    """
    score = ["score"] if "score" in messages.columns else []
    least = F.min(F.struct("parent", "role", "text", *score)).alias("kept")
    once = messages.filter("id is not null").groupBy(F.col("tree").cast("long").alias("tree"), F.col("id").cast("long").alias("id")).agg(least)
    table, path = write_table(once.select("tree", "id", "kept.*"), "messages")
    paths, made = reply_paths(table, branches)
    out, _ = write_table(format_paths(paths, table, template, learn), "conversations")
    remove(messages.sparkSession, path, *made)
    return out


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """The op12 contract over conv_id, turn, role and text: all rows, each conversation one path.

    Rows of one conversation follow by turn, then role, then text, nulls first; repeated
    rows are turns each; null roles and texts count as empty; rows of a null conv_id are one
    conversation; very long conversations are parts of TURNS turns. Other columns are ignored.
    """
    spark = rows.sparkSession
    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    threads, path = linear_threads(slim)
    paths, made = reply_paths(threads)
    formatted, formatted_path = write_table(format_paths(paths, threads, template), "conversations")
    remove(spark, path, *made)
    out, _ = write_table(read_back(formatted, template).withColumnRenamed("tree", "conv_id").drop("leaf"), "conversations-read")
    remove(spark, formatted_path)
    return out
