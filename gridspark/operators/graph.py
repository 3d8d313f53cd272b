"""The dependency graph of definitions: names, edges, entry points, neighbourhoods, layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.checkpoints import written

#: The order in which kinds are tried for a name without a hint.
KIND_ORDER = ("query", "table", "form", "report", "macro")
#: DoCmd actions that open an object, with its kind.
OPENERS = {"openform": "form", "openreport": "report", "openquery": "query", "opentable": "table", "runmacro": "macro", "browseto": "form"}


def resolve(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """`references(src, target, hint, edge)` with the id of the node each names (`dst`); unresolved ones go.

    Names match in any case. The hinted kind comes first, then query, table, form, report, macro.
    """
    rank = reduce(lambda acc, kv: acc.when(F.col("kind") == kv[1], kv[0]), enumerate(KIND_ORDER, 1), F.when(F.col("kind") == F.col("hint"), 0)).otherwise(len(KIND_ORDER) + 1)
    named = nodes.select(F.lower("name").alias("__name"), F.col("id").alias("dst"), "kind")
    joined = references.join(named, F.lower("target") == F.col("__name"))
    first = F.row_number().over(Window.partitionBy("src", "target", "hint", "edge").orderBy(rank, "dst"))
    return joined.withColumn("__n", first).filter("__n = 1").select("src", "dst", "edge")


def edges(*parts: DataFrame) -> DataFrame:
    """The distinct edges (src, dst, edge) of several sources, without loops."""
    return reduce(DataFrame.unionByName, parts).filter("src <> dst").dropDuplicates(["src", "dst", "edge"])


def opened_objects(code: DataFrame) -> DataFrame:
    """(src, target, hint) of DoCmd calls with a literal name, of `code(src, line)`."""
    verbs = "|".join(OPENERS)
    verb = F.lower(F.regexp_extract("line", rf"(?i)\bDoCmd\s*\.\s*({verbs})\b", 1))
    target = F.regexp_extract("line", rf'(?i)\bDoCmd\s*\.\s*(?:{verbs})\b[^"]*"([^"]*)"', 1)
    table = F.create_map(*[F.lit(x) for kv in OPENERS.items() for x in kv])
    return code.select("src", target.alias("target"), F.try_element_at(table, verb).alias("hint")).filter("target <> ''")


def read_tables(sql: DataFrame) -> DataFrame:
    """(src, target) of the tables that SQL texts name, of `sql(src, text)`."""
    names = F.regexp_extract_all("text", F.lit(r"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+(\[[^\]]+\]|[A-Za-z_]\w*)"), 1)
    return sql.select("src", F.explode(F.array_distinct(names)).alias("target")).withColumn("target", F.regexp_replace("target", r"^\[|\]$", ""))


def entry_points(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes where work begins: the autoexec macro, and forms and reports that nothing leads to."""
    lonely = nodes.filter(F.col("kind").isin("form", "report")).join(links.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return lonely.unionByName(nodes.filter((F.col("kind") == "macro") & (F.lower("name") == "autoexec")))


def neighbourhood(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, depth) of nodes within `depth` undirected steps of `start(id)`, by the least number of steps."""
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = start.select("id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for step in range(1, depth + 1):
        reached = front.join(both, front["id"] == both["src"]).select(F.col("dst").alias("id")).distinct()
        front = written(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(step)), "front")
        seen = seen.unionByName(front)
    return seen


def _trimmed(links: DataFrame) -> DataFrame:
    """The edges that are left when nodes without edges to or from them are taken off, round by round."""
    now, before = links, -1
    while (size := now.count()) != before:
        before = size
        inner = now.select(F.col("dst").alias("id")).intersect(now.select(F.col("src").alias("id")))
        kept = now.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi")
        now = written(kept.select("src", "dst"), "links")
    return now


def strong_components(links: DataFrame) -> DataFrame:
    """(id, component): the least id of the strongly connected component of each node on a cycle.

    Each node takes the least id that reaches it; what reaches that id by nodes of its kind is one
    component. Components found are taken off until no cycle is left.
    """
    left = _trimmed(links.select("src", "dst").filter("src <> dst").distinct())
    found = None
    while not left.isEmpty():
        colour = written(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct().withColumn("component", F.col("id")), "colour")
        moved = 1
        while moved:
            handed = left.join(colour, left["src"] == colour["id"]).groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("__new"))
            colour = written(colour.join(handed, "id", "left").select("id", F.least("component", "__new").alias("component"), (F.col("__new") < F.col("component")).alias("moved")), "colour")
            moved = colour.filter("moved").limit(1).count()
            colour = colour.select("id", "component")
        ends = left.join(colour.select(F.col("id").alias("src"), F.col("component").alias("__a")), "src").join(colour.select(F.col("id").alias("dst"), "component"), "dst")
        inside = written(ends.filter("__a = component").select("src", "dst", "component"), "inside")
        front = written(colour.filter("id = component"), "front")
        member = front
        while not front.isEmpty():
            reached = inside.join(front.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), "component").distinct()
            front = written(reached.join(member, "id", "left_anti"), "front")
            member = written(member.unionByName(front), "member")
        found = member if found is None else written(found.unionByName(member), "components")
        off = member.select("id")
        rest = left.join(off.withColumnRenamed("id", "src"), "src", "left_anti").join(off.withColumnRenamed("id", "dst"), "dst", "left_anti")
        left = _trimmed(written(rest.select("src", "dst"), "links"))
    return links.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0) if found is None else found


def forward_links(links: DataFrame) -> DataFrame:
    """(src, dst): the edges without those that close cycles, and without loops.

    The nodes of a strongly connected component are in an order: by the number of steps within it
    from where edges enter it (from its least id, where none do), then by id. Edges within
    it that do not lead on in that order go; the rounds are as many as its longest such way.
    """
    own = written(links.select("src", "dst").filter("src <> dst").distinct(), "links")
    parts = written(strong_components(own), "parts")
    if parts.isEmpty():
        return own
    of = lambda name: parts.select(F.col("id").alias(name), F.col("component").alias(f"__{name}"))
    both = own.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    within = F.col("__src").eqNullSafe(F.col("__dst")) & F.col("__dst").isNotNull()
    inside = written(both.filter(within).select("src", "dst", F.col("__dst").alias("component")), "inside")
    entered = both.filter(F.col("__dst").isNotNull() & ~within).select(F.col("dst").alias("id"), F.col("__dst").alias("component")).distinct()
    closed = parts.filter("id = component").join(entered.select("component").distinct(), "component", "left_anti").select("id", "component")
    front = written(entered.unionByName(closed).select("id", F.lit(0).alias("steps")), "front")
    found = front
    while not front.isEmpty():
        reached = inside.join(front.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("steps") + 1).alias("steps")).distinct()
        front = written(reached.join(found.select("id"), "id", "left_anti"), "front")
        found = written(found.unionByName(front), "steps")
    place = lambda name: found.select(F.col("id").alias(name), F.struct("steps", "id").alias(f"__{name}"))
    back = inside.join(place("src"), "src").join(place("dst"), "dst").filter("__src >= __dst").select("src", "dst")
    return own.join(back, ["src", "dst"], "left_anti")


def places(links: DataFrame, layered: DataFrame, sweeps: int = 4) -> DataFrame:
    """(id, layer, place): an order within the layers of `layered(id, layer)` that lets few of the edges cross.

    Nodes start by id. A sweep moves each node to the mean place of its neighbours in the layers
    before it, the next one to that of those behind it, all layers at once; nodes without any stay. Ties
    keep their order. Each layer is numbered by one task.
    """
    numbered = lambda df, *by: df.select("id", "layer", F.row_number().over(Window.partitionBy("layer").orderBy(*by)).alias("place"))
    now = written(numbered(layered.filter("layer is not null"), "id"), "places")
    for sweep in range(sweeps):
        near, far = ("dst", "src") if sweep % 2 == 0 else ("src", "dst")
        known = now.select(F.col("id").alias(far), F.col("place").alias("__there"))
        mean = links.select("src", "dst").distinct().join(known, far).groupBy(F.col(near).alias("id")).agg(F.avg("__there").alias("__mean"))
        now = written(numbered(now.join(mean, "id", "left"), F.coalesce("__mean", F.col("place")), "place"), "places")
    return now


def layers(links: DataFrame, nodes: DataFrame, cycles: str = "null") -> DataFrame:
    """(id, layer): the longest path that leads to each node, of any length.

    Nodes without edges left to them are taken off layer by layer; the rounds are as many as layers.
    With `cycles="null"` nodes on cycles, and behind them, have null; with `cycles="cut"` edges that
    close cycles are left out first (see `forward_links`); with `cycles="component"` every
    strongly connected component counts as one node. In the last two all nodes have a layer, and edges from or
    to what is not in `nodes` are left out.
    """
    if cycles in ("component", "cut"):
        ids = nodes.select("id").distinct()
        links = links.filter("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    if cycles == "cut":
        links = written(forward_links(links), "forward")
    left = links.select("src", "dst").distinct()
    rest = nodes.select("id").distinct()
    done, layer = None, 0
    while True:
        top = rest.join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("layer", F.lit(layer))
        top = written(top, "layer")
        done = top if done is None else done.unionByName(top)
        if top.isEmpty():
            break
        layer += 1
        if layer % 20 == 0:
            done = written(done, "layers")  # keeps the plan short
        rest = written(rest.join(top.select("id"), "id", "left_anti"), "rest")
        left = written(left.join(top.select(F.col("id").alias("src")), "src", "left_anti"), "links")
    if cycles == "component" and not rest.isEmpty():
        return _component_layers(links, nodes, left)
    return done.unionByName(rest.withColumn("layer", F.lit(None).cast("int")))


def _component_layers(links: DataFrame, nodes: DataFrame, cyclic: DataFrame) -> DataFrame:
    """Layers of the graph whose strongly connected components, all within `cyclic`, are single nodes."""
    parts = strong_components(cyclic)
    of = lambda name: parts.select(F.col("id").alias(name), F.col("component").alias(f"__{name}"))
    owned = nodes.select("id").distinct().join(of("id"), "id", "left").select("id", F.coalesce("__id", "id").alias("owner"))
    joined = links.select("src", "dst").join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    merged = joined.select(F.coalesce("__src", "src").alias("src"), F.coalesce("__dst", "dst").alias("dst")).filter("src <> dst").distinct()
    found = layers(written(merged, "merged"), owned.select(F.col("owner").alias("id")))
    return owned.join(found.withColumnRenamed("id", "owner"), "owner").select("id", "layer")


def short_label(column: str, most: int = 90):
    flat = F.regexp_replace(column, r"\s+", " ")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)
