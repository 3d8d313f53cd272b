"""Hard-negative mining by a two-dimensional block matrix product.

Rows and anchors are packed into blocks, each cut into layers of dimensions. Blocks of
anchors meet blocks of rows by (anchor block, row block, layer); each meeting gives a
partial tile of integer scores, tiles of one pair of blocks are shuffled together and
added, and the sum is reduced to the best few rows of each anchor before it leaves its
task. A first product, over blocks of one label group, gives the positives; a second,
over all blocks, gives the negatives within each positive's window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import remove, write_table

#: Rows and anchors of a block, on average; layers of dimensions; groups that labels fall into.
ROWS, ANCHORS, LAYERS, GROUPS = 2048, 1024, 2, 16

_BLOCK = "block long, layer int, ids binary, labels binary, matrix binary, width int"
_TILE = "anchor_block long, block long, layer int, tile binary, width int, anchor_ids binary, anchor_labels binary, wanted array<struct<anchor_id:long,positive_id:long,score:long>>, ids binary, labels binary"
_EXACT = 1 << 53
_TILE_SCHEMA = pa.schema(
    [
        ("anchor_block", pa.int64()),
        ("block", pa.int64()),
        ("layer", pa.int32()),
        ("tile", pa.binary()),
        ("width", pa.int32()),
        ("anchor_ids", pa.binary()),
        ("anchor_labels", pa.binary()),
        ("wanted", pa.list_(pa.struct([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())]))),
        ("ids", pa.binary()),
        ("labels", pa.binary()),
    ]
)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as longs; beyond 64 bits it saturates."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def _narrow(x: np.ndarray) -> np.ndarray:
    """`x` in the narrowest integer type that holds it."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _longs(body: bytes) -> np.ndarray:
    return np.frombuffer(body, dtype=np.int64)


def _matrix(body: bytes, width: int, rows: int) -> np.ndarray:
    x = np.frombuffer(body, dtype=f"i{width}")
    return x.reshape(rows, len(x) // rows if rows else 0)


def _packer(dims: int, layers: int) -> Callable[[pa.Table], pa.Table]:
    cuts = [dims * k // layers for k in range(layers + 1)]

    def pack(table: pa.Table) -> pa.Table:
        """One block: rows by id, a row of output for each layer; shorter vectors end in zeros."""
        table = table.sort_by("id")
        vectors = table.column("vector").combine_chunks()
        sizes = np.diff(vectors.offsets.to_numpy())
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        dense = np.zeros((len(sizes), dims), dtype=np.int64)
        dense[np.arange(dims) < sizes[:, None]] = values
        parts = [_narrow(dense[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        ids, labels = (table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("id", "label"))
        n = len(parts)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()] * n, pa.int64()), "layer": pa.array(range(n), pa.int32()), "ids": [ids] * n, "labels": [labels] * n, "matrix": [p.tobytes() for p in parts], "width": pa.array([p.itemsize for p in parts], pa.int32())})

    return pack


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in 64-bit integers; by floating point where that is exact."""
    top = [int(np.abs(x.astype(np.float64)).max()) if x.size else 0 for x in (a, b)]
    if top[0] * top[1] * max(a.shape[1], 1) < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _product(left: pa.Table, right: pa.Table) -> pa.Table:
    """The partial tile of one anchor block, row block and layer."""
    if not left.num_rows or not right.num_rows:
        return _TILE_SCHEMA.empty_table()
    a, b = left.to_pylist()[0], right.to_pylist()[0]
    n, m = len(a["ids"]) // 8, len(b["ids"]) // 8
    tile = _narrow(multiply(_matrix(a["matrix"], a["width"], n), _matrix(b["matrix"], b["width"], m)))
    row = {"anchor_block": a["anchor_block"], "block": b["block"], "layer": a["layer"], "tile": tile.tobytes(), "width": tile.itemsize}
    first = a["layer"] == 0  # names travel with one layer only
    row |= {"anchor_ids": a["ids"] if first else b"", "anchor_labels": a["labels"] if first else b"", "wanted": (a["wanted"] or []) if first else [], "ids": b["ids"] if first else b"", "labels": b["labels"] if first else b""}
    return pa.Table.from_pylist([row], schema=_TILE_SCHEMA)


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict], np.ndarray, np.ndarray]:
    """The sum of a pair's partial tiles, with the names of its rows and columns."""
    names = next(r for r in table.select(["layer", "anchor_ids", "anchor_labels", "wanted", "ids", "labels"]).to_pylist() if r["layer"] == 0)
    anchors, ids = _longs(names["anchor_ids"]), _longs(names["ids"])
    total = np.zeros((len(anchors), len(ids)), dtype=np.int64)
    for body, width in zip(table.column("tile").to_pylist(), table.column("width").to_pylist(), strict=True):
        total += np.frombuffer(body, dtype=f"i{width}").reshape(total.shape)
    return total, anchors, _longs(names["anchor_labels"]), names["wanted"], ids, _longs(names["labels"])


def _best(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` largest scores among the given places, which are by id; ties to the first."""
    found = scores[among]
    if len(found) > k:
        least = np.partition(found, -k)[-k]
        sure = found >= least
        among, found = among[sure], found[sure]
    return among[np.argsort(-found, kind="stable")[:k]]


def _positives(k: int) -> Callable[[pa.Table], pa.Table]:
    def reduce(table: pa.Table) -> pa.Table:
        total, anchors, own, _, ids, labels = _added(table)
        out: dict[str, list] = {"anchor_id": [], "anchor_block": [], "positive_id": [], "score": []}
        for i, anchor in enumerate(anchors):
            for j in _best(total[i], np.flatnonzero((labels == own[i]) & (ids != anchor)), k):
                out["anchor_id"].append(anchor)
                out["positive_id"].append(ids[j])
                out["score"].append(total[i, j])
        out["anchor_block"] = [table.column("anchor_block")[0].as_py()] * len(out["score"])
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return reduce


def _negatives(k: int, low: int, high: int) -> Callable[[pa.Table], pa.Table]:
    def reduce(table: pa.Table) -> pa.Table:
        total, anchors, own, wanted, ids, labels = _added(table)
        at = {int(a): i for i, a in enumerate(anchors)}
        out: dict[str, list] = {"anchor_id": [], "positive_id": [], "negative_id": [], "positive_score": [], "negative_score": []}
        for w in wanted:
            i, top = at[w["anchor_id"]], w["score"]
            least = -(-low * top // high)
            if least > top:
                continue
            row = total[i]
            for j in _best(row, np.flatnonzero((labels != own[i]) & (row <= top) & (row >= least)), k):
                for c, v in zip(out, (w["anchor_id"], w["positive_id"], ids[j], top, row[j]), strict=True):
                    out[c].append(v)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return reduce


def _blocks(rows: DataFrame, per_block: int, dims: int, layers: int) -> tuple[DataFrame, str, list[int], int]:
    """Packed blocks, their path, the first block of each label group, and the number of blocks."""
    counts = {r.group: r.n for r in rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}  # GROUPS rows at most
    each = [-(-counts.get(g, 0) // per_block) for g in range(GROUPS)]
    begins = [sum(each[:g]) for g in range(GROUPS)]
    spread = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("group") + 1)
    block = spread(begins) + F.pmod(F.xxhash64("id", F.lit("block")), F.greatest(spread(each), F.lit(1)))
    placed = rows.select(block.cast("long").alias("block"), "id", F.col("label").cast("long").alias("label"), "vector")
    table, path = write_table(placed.groupBy("block").applyInArrow(_packer(dims, layers), _BLOCK), "negatives-blocks")
    return table, path, [*begins, sum(each)], sum(each)


def _tiles(anchors: DataFrame, blocks: DataFrame, anchor_range: Callable[[Column], Column], block_range: Callable[[Column], Column]) -> DataFrame:
    """All partial tiles. Each anchor block is sent to the row blocks in its range, and the reverse."""
    keys = ["anchor_block", "block", "layer"]
    left = anchors.withColumnRenamed("block", "anchor_block").withColumn("block", F.explode(block_range(F.col("anchor_block"))))
    right = blocks.withColumn("anchor_block", F.explode(anchor_range(F.col("block"))))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_product, _TILE)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, layers: int = LAYERS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` has id (long), label (int) and vector (longs); `anchor` says which rows are
    anchors. A score is the inner product with the anchor; higher ones come first, ties
    by id. An anchor's positives are its first `positives` other rows of its label; each
    gets the first `negatives` rows of other labels with
    low * positive_score <= high * negative_score <= high * positive_score.

    Rows without id, label or vector take no part. Rows that repeat an id count once, as
    the one of the least (label, vector). Shorter vectors count as ending in zeros; an
    empty one has score 0 with all. Scores are exact up to 64 bits and wrap beyond. Other
    columns are ignored; no rows, or no anchors, give no row.
    """
    own = rows.select(F.col("id").cast("long").alias("id"), F.struct(F.col("label").cast("int").alias("label"), F.col("vector").cast("array<bigint>").alias("vector")).alias("kept"), anchor.alias("is_anchor"))
    own = own.filter("id is not null and kept.label is not null and kept.vector is not null and not exists(kept.vector, x -> x is null)")
    own = own.groupBy("id").agg(F.min("kept").alias("kept"), F.max("is_anchor").alias("is_anchor")).select("id", "kept.label", "kept.vector", "is_anchor")
    own, own_path = write_table(own.withColumn("group", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")), "negatives-rows")
    dims = own.agg(F.max(F.size("vector"))).first()[0] or 0
    layers = max(1, min(layers, dims))
    blocks, blocks_path, block_begins, n_blocks = _blocks(own, ROWS, dims, layers)
    anchors, anchors_path, anchor_begins, n_anchors = _blocks(own.filter("is_anchor"), ANCHORS, dims, layers)

    def of_group(begins: list[int], other: list[int]) -> Callable[[Column], Column]:
        """The other side's blocks of the label group that a block belongs to."""
        def choose(block: Column) -> Column:
            out = F.array().cast("array<bigint>")
            for g in range(GROUPS):
                if begins[g] < begins[g + 1] and other[g] < other[g + 1]:
                    out = F.when((block >= begins[g]) & (block < begins[g + 1]), F.sequence(F.lit(other[g]).cast("long"), F.lit(other[g + 1] - 1).cast("long"))).otherwise(out)
            return out

        return choose

    def everything(n: int) -> Callable[[Column], Column]:
        return lambda block: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")) if n else F.array().cast("array<bigint>")

    none = F.lit(None).cast("array<struct<anchor_id:bigint,positive_id:bigint,score:bigint>>")
    first = _tiles(anchors.withColumn("wanted", none), blocks, of_group(block_begins, anchor_begins), of_group(anchor_begins, block_begins))
    found = first.groupBy("anchor_block", "block").applyInArrow(_positives(positives), "anchor_id long, anchor_block long, positive_id long, score long")
    best = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    chosen = found.withColumn("place", best).filter(F.col("place") <= positives)
    wanted = chosen.groupBy("anchor_block").agg(F.collect_list(F.struct("anchor_id", "positive_id", "score")).alias("wanted"))  # a block's anchors times `positives`
    sought, sought_path = write_table(anchors.join(wanted.withColumnRenamed("anchor_block", "block"), "block").select(*anchors.columns, "wanted"), "negatives-sought")
    second = _tiles(sought, blocks, everything(n_anchors), everything(n_blocks))
    kept = second.groupBy("anchor_block", "block").applyInArrow(_negatives(negatives, low, high), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    out = kept.withColumn("rank", place).filter(F.col("rank") <= negatives)
    out, _ = write_table(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives")
    remove(rows.sparkSession, own_path, blocks_path, anchors_path, sought_path)
    return out


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """The op11 contract over vec_id, embedding and label; see `mine`.

    Rows with a null id, label or vector, or a component that is null or not finite, take no
    part. Labels of ids divisible by 7 become (label + 1) % 10 first.
    """
    good = embeddings.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")).cast("int")
    rows = good.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), quantised(F.col("embedding")).alias("vector"))
    return mine(rows, F.col("id") % 100 == 0)
