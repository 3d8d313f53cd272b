"""Exact Jaccard self-join of word-shingle sets, by tries of globally ordered sets.

1. Every document becomes its set of shingle hashes; equal sets are one class.
2. Hashes are dealt out by value and counted; each set gets back those that occur
   in other sets too. A hash that no other set has cannot be part of an overlap,
   so a set with over a quarter of such hashes has no partner and is done.
3. The rest are ordered by (class of frequency, hash), the same order for all. Sets whose
   sizes and order prefixes admit a link are chained into clusters.
4. A cluster's sets go into a trie. Each set walks it, sharing the overlap of
   common beginnings and leaving subtrees that their remaining lengths rule out.
   Clusters over `BLOCK` sets are joined in blocks, then what the blocks left apart
   by the prefix hashes that it shares.
5. The links give components.

Counts, sets and clusters cover all rows. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .textvec import Hasher, doc_starts, lower_ascii, mix, shingles, slices, space_words, string_buffers
from .workspace import apart, free_names, join_counted, remove, write_table, written

WORDS = 5
#: A link: NUMERATOR * intersection >= DENOMINATOR * (both sizes together); 7 and 3 are a similarity of 0.75.
NUMERATOR, DENOMINATOR = 7, 3
BUCKET_BYTES = 8_000_000
BLOCK = 512
#: Hashes that a task deals out at a time, about 4 MB of text.
ENTRIES = 750_000
#: Stands for a document where several of a chunk have the hash; above all document numbers.
SEVERAL = 0xFFFF
_ROWS = 60_000


def document_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, documents) of the distinct shingles, by document and hash, and per document its size and class key."""
    raw, offs = string_buffers(column)
    raw = lower_ascii(raw)
    start, end, doc = space_words(raw, offs)
    n = len(offs) - 1
    h, d = shingles(Hasher(raw).ranges(start, end), doc, n, WORDS)
    order = np.argsort(h)
    order = order[np.argsort(d[order].astype(np.uint16), kind="stable")]
    h, d = h[order], d[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        h, d = h[new], d[new]
    first = doc_starts(d, n)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h), dtype=np.uint64)])
    size = np.diff(first)
    keys = mix((total[first[1:]] - total[first[:-1]]) ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return h, d, size, keys.view(np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def document_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key of every row; rows of equal sets share the key, empty sets have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            _, _, size, keys = document_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(keys, pa.int64(), mask=size == 0)], names=["doc_id", "n_shingles", "set_key"])

    return docs.mapInArrow(work, "doc_id long, n_shingles long, set_key long")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """`document_sets` of some MB of text at a time, of one document of each class in a slice."""
    held, rows, entries = [], 0, 0
    for batch in _cut(batches):
        h, d, size, keys = document_sets(batch.column(1))
        keep = np.zeros(len(keys), dtype=bool)
        keep[np.unique(keys, return_index=True)[1]] = True
        keep &= size > 0
        if not keep.any():
            continue
        if rows + len(keys) > _ROWS or entries + len(h) > ENTRIES:
            if held:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, rows, entries = [], 0, 0
        at = keep[d]
        place = np.cumsum(keep) - 1 + rows
        held.append((h[at], place[d[at]], size[keep], keys[keep]))
        rows, entries = rows + int(keep.sum()), entries + int(at.sum())
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _deal(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, chunk, body): a chunk's distinct hashes that fall into a bucket, each with its
    document, or with SEVERAL and how many; and, for a bucket below 0, the chunk's classes and
    the documents of each hash that several have. So a hash has one entry a chunk, however many documents have it.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for number, (h, d, size, keys) in enumerate(_chunks(batches)):
            order = np.argsort(h)
            h, d = h[order], d[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.append(first, len(h)))
            token, doc = h[first], np.where(n > 1, SEVERAL, d[first]).astype(np.uint16)
            low = token.view(np.uint8).reshape(-1, 8)[:, :7]
            bucket = (token >> shift).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            bodies = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                many = n[a:b][n[a:b] > 1].astype(np.uint32)
                bodies.append(np.uint32(b - a).tobytes() + low[a:b].tobytes() + doc[a:b].tobytes() + many.tobytes())
            where = bucket[cuts[:-1]].tolist()
            several = np.repeat(n > 1, n)
            bodies.append(np.array([len(keys), several.sum()]).tobytes() + keys.tobytes() + size.astype(np.int64).tobytes() + h[several].tobytes() + d[several].astype(np.uint16).tobytes())
            where.append(-1 - (number % buckets))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array([base | number] * len(where), pa.int64()), pa.array(bodies, pa.binary())], names=["bucket", "chunk", "body"])

    return docs.mapInArrow(work, "bucket long, chunk long, body binary")


def _low_bytes(body: bytes, n: int, offset: int) -> np.ndarray:
    """n little-endian numbers of 7 bytes."""
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :7] = np.frombuffer(body, dtype=np.uint8, count=7 * n, offset=offset).reshape(n, 7)
    return wide.view(np.uint64).ravel()


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, the hashes that several sets have, with the class of their frequency."""
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        return table
    bodies = table.column("body").to_pylist()
    counts = [int(np.frombuffer(b, dtype=np.uint32, count=1)[0]) for b in bodies]
    low = np.concatenate([_low_bytes(b, n, 4) for b, n in zip(bodies, counts, strict=True)])
    docs = [np.frombuffer(b, dtype=np.uint16, count=n, offset=4 + 7 * n) for b, n in zip(bodies, counts, strict=True)]
    doc = np.concatenate(docs)
    number = np.ones(len(low), dtype=np.int64)
    number[doc == SEVERAL] = np.concatenate([np.frombuffer(b, dtype=np.uint32, offset=4 + 9 * n) for b, n in zip(bodies, counts, strict=True)])
    _, inverse = np.unique(low, return_inverse=True)
    frequency = np.bincount(inverse, weights=number)[inverse]
    kind = np.minimum(15, (2 * np.log2(np.maximum(frequency, 2))).astype(np.int64) - 1).astype(np.uint8)
    out_b, out_n, at = [], [], 0
    for n, chunk in zip(counts, table.column("chunk").to_pylist(), strict=True):
        keep = np.flatnonzero(frequency[at : at + n] > 1) + at
        if len(keep):
            out_b.append(low[keep].view(np.uint8).reshape(-1, 8)[:, :7].tobytes() + doc[keep].tobytes() + kind[keep].tobytes())
            out_n.append(chunk)
        at += n
    return pa.table({"bucket": pa.array([bucket] * len(out_b), pa.int64()), "chunk": pa.array(out_n, pa.int64()), "body": pa.array(out_b, pa.binary())})


_SETS = pa.schema([("set_key", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])


def _assembler(buckets: int):
    bits = buckets.bit_length() - 1

    def assemble(table: pa.Table) -> pa.Table:
        """Of one chunk: the sets that may have a partner, with their shared hashes in global order.

        A token is the class of its hash's frequency in 4 bits, then 60 bits of the hash.
        """
        keys, found = None, []
        for bucket, body in zip(table.column("bucket").to_pylist(), table.column("body").to_pylist(), strict=True):
            if bucket < 0:
                n, m = np.frombuffer(body, dtype=np.int64, count=2)
                keys, sizes = np.frombuffer(body, dtype=np.int64, count=n, offset=16), np.frombuffer(body, dtype=np.int64, count=n, offset=16 + 8 * n)
                many_h, many_d = np.frombuffer(body, dtype=np.uint64, count=m, offset=16 + 16 * n), np.frombuffer(body, dtype=np.uint16, offset=16 + 16 * n + 8 * m)
            else:
                n = len(body) // 10
                h = _low_bytes(body, n, 0) | (np.uint64(bucket >> (bits - 8)) << np.uint64(56))
                found.append((h, np.frombuffer(body, dtype=np.uint16, count=n, offset=7 * n), np.frombuffer(body, dtype=np.uint8, offset=9 * n)))
        if not found or keys is None:
            return _SETS.empty_table()
        h, doc, kind = map(np.concatenate, zip(*found, strict=True))
        several = doc == SEVERAL
        lo, hi = (np.searchsorted(many_h, h[several], side=s) for s in ("left", "right"))
        n = hi - lo
        place = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        h, doc, kind = (np.concatenate(x) for x in ((h[~several], many_h[place]), (doc[~several], many_d[place]), (kind[~several], np.repeat(kind[several], n))))
        token = (h & np.uint64((1 << 60) - 1)) | (kind.astype(np.uint64) << np.uint64(60))
        order = np.argsort(token)
        order = order[np.argsort(doc[order], kind="stable")]
        token, doc = token[order], doc[order].astype(np.int64)
        first = doc_starts(doc, len(keys))
        good = np.flatnonzero(4 * np.diff(first) >= 3 * sizes)
        return pa.table({"set_key": pa.array(keys[good]), "n": pa.array(sizes[good]), "tokens": pa.array([token[first[i] : first[i + 1]].tobytes() for i in good], pa.binary())}, schema=_SETS)

    return assemble


def _prefixes(sets: DataFrame) -> DataFrame:
    """(token, set_key, n): the shared part of each set's prefix in global order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(1).to_numpy()
            tokens = [np.frombuffer(b, dtype=np.int64) for b in batch.column(2).to_pylist()]
            have = np.array([len(t) for t in tokens])
            length = n - (3 * n + 3) // 4 + 1 - (n - have)  # hashes of its own come first in the order
            out = np.concatenate([t[:p] for t, p in zip(tokens, length, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(np.repeat(batch.column(0).to_numpy(), length)), pa.array(np.repeat(n, length))], names=["token", "set_key", "n"])

    return sets.mapInArrow(work, "token long, set_key long, n long")


def _chains(prefixes: DataFrame) -> DataFrame:
    """Edges that connect all sets which share a prefix hash and admit a link by size.

    Sets of one hash are grouped by size class, a ratio of 4/3 each, so partners are
    in the same or the next class. A class is tied to its least key, and to the class
    above: as many edges as sets, however many there are.
    """
    kinds = prefixes.withColumn("k", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4.0 / 3.0)) + 1e-9).cast("int")).select("token", "k", "set_key")
    least = kinds.groupBy("token", "k").agg(F.min("set_key").alias("least"), F.count(F.lit(1)).alias("sets"))
    inside = join_counted(kinds, least, ["token", "k"], "sets", prefixes.count()).select(F.col("set_key").alias("a"), F.col("least").alias("b"))
    above = least.select("token", (F.col("k") - 1).alias("k"), F.col("least").alias("b"))
    across = least.select("token", "k", F.col("least").alias("a")).join(above, ["token", "k"]).select("a", "b")
    return inside.filter("a <> b").unionByName(across.filter("a <> b")).distinct()


class _Node:
    __slots__ = ("children", "ends", "hi", "lo", "most", "tokens")

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        self.children: dict[int, _Node] = {}
        self.ends: list[int] = []
        self.lo, self.hi, self.most = 1 << 62, 0, 0


class Trie:
    """Sets as paths of globally ordered tokens, runs without branches in one node."""

    def __init__(self):
        self.root = _Node(np.zeros(0, dtype=np.uint64))

    def insert(self, item: int, tokens: np.ndarray, n: int) -> None:
        node, at = self.root, 0
        while True:
            node.lo, node.hi, node.most = min(node.lo, n), max(node.hi, n), max(node.most, len(tokens))
            if at == len(tokens):
                node.ends.append(item)
                return
            child = node.children.get(int(tokens[at]))
            if child is None:
                child = node.children[int(tokens[at])] = _Node(tokens[at:])
                child.lo = child.hi = n
                child.most = len(tokens)
                child.ends.append(item)
                return
            rest = tokens[at : at + len(child.tokens)]
            same = child.tokens[: len(rest)] == rest
            common = len(rest) if same.all() else int(np.argmin(same))
            if common < len(child.tokens):  # split the run
                upper = _Node(child.tokens[:common])
                upper.lo, upper.hi, upper.most = child.lo, child.hi, child.most
                child.tokens = child.tokens[common:]
                upper.children[int(child.tokens[0])] = child
                node.children[int(tokens[at])] = upper
                child = upper
            node, at = child, at + common

    def partners(self, tokens: np.ndarray, n: int, skip) -> list[int]:
        """Items whose overlap with the set reaches the threshold; `skip(item)` leaves one out."""
        found = []
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            if 4 * node.hi < 3 * n or 4 * n < 3 * node.lo:
                continue
            if not node.children and all(map(skip, node.ends)):
                continue
            run, rest = node.tokens, len(tokens)
            if len(run):
                place = np.searchsorted(tokens, run)
                there = place < len(tokens)
                overlap += int((tokens[place[there]] == run[there]).sum())
                rest = len(tokens) - int(np.searchsorted(tokens, run[-1], side="right"))
                depth += len(run)
            if NUMERATOR * (overlap + min(rest, node.most - depth)) < DENOMINATOR * (n + node.lo):
                continue
            found += [(i, overlap) for i in node.ends if not skip(i)]
            stack += [(c, depth, overlap) for c in node.children.values()]
        return found


class Forest:
    """Union-find over the items of a block."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def join_block(keys: np.ndarray, sizes: np.ndarray, tokens: list[np.ndarray], side: np.ndarray | None = None, labels: np.ndarray | None = None) -> Forest:
    """The linked sets of a block, connected; with `side`, links between the two sides only.

    Sets of equal `labels` are known to be connected; what is connected is not compared again.
    """
    forest, trie = Forest(len(keys)), Trie()
    first: dict[int, int] = {}
    for i, label in enumerate([] if labels is None else labels.tolist()):
        forest.union(i, first.setdefault(label, i))
    order = np.argsort(sizes, kind="stable")
    if side is not None:
        for i in (i for i in order if side[i] == 0):
            trie.insert(int(i), tokens[i], int(sizes[i]))
        order = [i for i in order if side[i] == 1]
    for i in map(int, order):
        for j, overlap in trie.partners(tokens[i], int(sizes[i]), lambda j: forest.find(j) == forest.find(i)):  # noqa: B023
            if NUMERATOR * overlap >= DENOMINATOR * int(sizes[i] + sizes[j]):
                forest.union(i, j)
        if side is None:
            trie.insert(i, tokens[i], int(sizes[i]))
    return forest


_LABELS = "cluster long, a long, b long"


def _block(table: pa.Table) -> pa.Table:
    """Of one block: each set (a) with the set that stands for its connected sets (b)."""
    keys, sizes = table.column("set_key").to_numpy(), table.column("n").to_numpy()
    tokens = [np.frombuffer(x, dtype=np.uint64) for x in table.column("tokens").to_pylist()]
    extra = {c: table.column(c).to_numpy() for c in ("side", "label") if c in table.column_names}
    forest = join_block(keys, sizes, tokens, extra.get("side"), extra.get("label"))
    roots = keys[[forest.find(i) for i in range(len(keys))]]
    return pa.table({"cluster": table.column("cluster"), "a": pa.array(keys), "b": pa.array(roots)})


def _slot(count: Column) -> Column:
    """A block number for each of `count` sets, by hash."""
    return F.pmod(F.xxhash64("set_key"), F.ceil(count / BLOCK)).cast("int")


def _groups(members: DataFrame) -> DataFrame:
    """cluster, token, top, left, right, cost: the groups of `members(cluster, token, set_key, label)` of several labels.

    `top` is the label of the most sets, `right` the number of all sets, `left` of those
    without that label; comparing the two in blocks copies `cost` sets.
    """
    labels = members.groupBy("cluster", "token", "label").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("set_key").cast("decimal(38,0)")).alias("sum"))
    top = F.max(F.struct("size", "label")).alias("top")
    groups = labels.groupBy("cluster", "token").agg(top, F.sum("size").alias("right"), F.sum("sum").alias("sum")).withColumn("left", F.col("right") - F.col("top.size")).filter("left > 0")
    cost = F.col("left") * F.ceil(F.col("right") / BLOCK) + F.col("right") * F.ceil(F.col("left") / BLOCK)
    return groups.select("cluster", "token", F.col("top.label").alias("top"), "left", "right", "sum", cost.alias("cost"))


def _apart_parts(sets: DataFrame, prefixes: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between the parts (`labels(cluster, set_key, label)`) of large clusters.

    Linked sets share a prefix hash, so only sets of one prefix hash with several labels
    are compared, once for hashes that the same sets have: those outside the largest
    label with all, block against block. Where a cluster's hashes together would copy
    more sets than the cluster as one group does, it is one group.
    """
    whole = labels.select("cluster", F.lit(0).cast("long").alias("token"), "set_key", "label")
    by_token = prefixes.select("token", "set_key").join(labels, "set_key").select("cluster", "token", "set_key", "label")
    groups = _groups(by_token).groupBy("cluster", "top", "left", "right", "sum", "cost").agg(F.min("token").alias("token"))
    tokens = groups.groupBy("cluster").agg(F.sum("cost").alias("cost"))
    single = _groups(whole)
    cheap = single.alias("s").join(tokens.alias("t"), "cluster").filter(F.col("s.cost") <= F.col("t.cost")).select(F.col("s.cluster").alias("cluster"))
    chosen = single.join(cheap, "cluster", "left_semi").select("cluster", "token", "top", "left", "right").unionByName(groups.join(cheap, "cluster", "left_anti").select("cluster", "token", "top", "left", "right"))
    rows = whole.unionByName(by_token).join(apart(chosen), ["cluster", "token"]).withColumn("q", F.ceil(F.col("right") / BLOCK).cast("int")).withColumn("p", F.ceil(F.col("left") / BLOCK).cast("int"))
    wanted = ["cluster", "token", "i", "j", "side", "label", "set_key"]
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.filter("label <> top").withColumn("i", _slot(F.col("left"))).withColumn("j", every("q")).withColumn("side", F.lit(0)).select(*wanted)
    right = rows.withColumn("j", _slot(F.col("right"))).withColumn("i", every("p")).withColumn("side", F.lit(1)).select(*wanted)
    blocks = left.unionByName(right).join(sets, "set_key")
    return blocks.groupBy("cluster", "token", "i", "j").applyInArrow(_block, _LABELS).select("a", "b")


def _linked(sets: DataFrame, prefixes: DataFrame, clusters: DataFrame, paths: list[str]) -> DataFrame:
    """Edges (a, b) that connect the linked sets of each cluster.

    A cluster is joined in blocks of about BLOCK sets. Of a cluster of several blocks,
    the sets that stand for each block's parts are joined next, and what then is not in
    its largest part is compared where it shares a prefix hash with others; so a large
    group of copies costs in proportion to its size, and no pair goes unseen.
    """

    def table(df: DataFrame, name: str) -> DataFrame:
        out, path = write_table(df, name)
        paths.append(path)
        return out

    counts = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.count(F.lit(1)).alias("rows"))
    member = join_counted(clusters, counts, "component", "rows", clusters.count()).filter("m > 1").select(F.col("vertex").alias("set_key"), F.col("component").alias("cluster"), "m")
    rows = sets.join(member, "set_key").select("cluster", "m", "set_key", "n", "tokens")
    first = table(rows.withColumn("i", _slot(F.col("m"))).groupBy("cluster", "i").applyInArrow(_block, _LABELS), "blocks")
    if member.filter(F.col("m") > BLOCK).isEmpty():
        return first.select("a", "b").filter("a <> b")

    large = rows.filter(F.col("m") > BLOCK)
    heads = first.filter("a = b").select(F.col("a").alias("set_key"))
    parts = large.join(heads, "set_key", "left_semi")
    number = parts.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"))
    parts = parts.join(apart(number), "cluster").withColumn("i", _slot(F.col("k")))
    second = table(parts.select("cluster", "i", "set_key", "n", "tokens").groupBy("cluster", "i").applyInArrow(_block, _LABELS), "heads")
    upper = second.select(F.col("a").alias("b"), F.col("b").alias("label"))
    labels = table(first.join(upper, "b").select("cluster", F.col("a").alias("set_key"), "label"), "parts")
    third = _apart_parts(sets, prefixes, labels)
    return first.select("a", "b").unionByName(second.select("a", "b")).unionByName(third).filter("a <> b")


def candidate_sets(docs: DataFrame) -> DataFrame:
    """set_key, n, tokens of the classes that may have a partner of another class."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(1 << 24, max(256, 1 << (-(-total // BUCKET_BYTES)).bit_length()))
    dealt = _deal(docs, buckets)
    shared = dealt.groupBy("bucket").applyInArrow(_shared, "bucket long, chunk long, body binary")
    sets = shared.groupBy("chunk").applyInArrow(_assembler(buckets), "set_key long, n long, tokens binary")
    return sets.dropDuplicates(["set_key"])


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs(doc_id, text)`.

    Null and empty texts, and texts without words, have an empty set and no links.
    Rows that repeat an id are rows of their own; a null id is never the least of
    its component. Other columns are not read; an empty table gives no row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(document_classes(docs), "classes")
    total = rows.count()
    sets, sets_path = write_table(candidate_sets(docs), "sets")
    prefixes, prefixes_path = write_table(_prefixes(sets), "prefixes")
    paths = [sets_path, prefixes_path]
    clusters = components(_chains(prefixes), "clusters", paths=paths)
    found = components(_linked(sets, prefixes, clusters, paths), "links").select(F.col("vertex").alias("set_key"), "component")
    remove(docs.sparkSession, *paths)
    classes = rows.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    linked = classes.join(found, "set_key")
    least = linked.groupBy("component").agg(F.min("class_id").alias("least"), F.count(F.lit(1)).alias("members"))
    linked = join_counted(linked, least, "component", "members", total).select("set_key", "least")
    known = classes.join(linked, "set_key", "left").select("set_key", "copies", F.coalesce("least", "class_id").alias("known"))
    out = join_counted(rows, known, "set_key", "copies", total, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("known")).alias("component_id"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component, that of the least doc_id; columns as they are.

    A document is an id: rows that repeat an id stay or go together, and stay where
    one of them is its component's representative. Rows of a null id stay.
    """
    found = join_documents(docs).filter(F.col("doc_id").isNotNull())
    (gone_id,) = free_names(docs.columns, "gone_id")
    gone = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first")).filter(~F.col("first")).select(F.col("doc_id").alias(gone_id))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")
