"""Secret scans over a content-addressed ledger of blobs, in DataFrame functions only.

Every version of a path is addressed by the SHA-256 of its text. The ledger says
which rules (with their versions) have seen which blob, and the spans they found.
A scan takes the blobs for which some pair of blob and rule version is missing,
once each however many paths and versions hold them, runs just the missing rules,
and adds rows to the ledger; findings are joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import apart, free_names, new_path

#: Spans have their place in code points and, for cutting texts, in UTF-8 bytes.
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,rule:string,first_byte:bigint,last_byte:bigint>>"
LEDGER = f"blob binary, rules array<string>, spans {_SPANS}"

#: Marks put around matches; these two characters are replaced in the scanned copy
#: of a text first, one for one, and no pattern matches either or their stand-in.
_OPEN, _MID, _CLOSE, _STANDIN = "\x01", "\x02", "\x04", "\x03"


@dataclass(frozen=True)
class Rule:
    """`lead` and `body`: the two parts of the pattern; matches whose body has under
    `least` characters are dropped after they were consumed."""

    kind: str
    version: int
    lead: str
    body: str
    least: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Parts of the pem rule: what may stand around the base64 of a line, line ends (real or
#: escaped), the end of a line, and any of these in a row.
_PAD = r"""[\x20\x09"'+,;>#*|]*+"""
_EOL = rf"(?:(?:\\++[rn]{_PAD})*+(?:\r?\n|\r)|(?:\\++[rn])++)"
_LINE_END = rf"(?={_PAD}(?:[\r\n\\]|\z))"
_GAP = r"""(?:[\s"'+,;>#*|]|\\++[nrt/]?+)*+"""
_B64 = "[A-Za-z0-9+/=]"
_FIELD = r"[A-Z][A-Za-z0-9-]*+:"
#: Header fields, which base64 must follow; a value is one word or the rest of its line.
_FIELDS = rf"(?:{_GAP}{_FIELD}\x20?+(?:[^\s\\]++|(?:[^\r\n\\-]|-(?!----))*+)(?={_GAP}(?:{_FIELD}|{_B64}{{16}})))*+"
#: The key up to its END line, or else its base64: long runs, and lines of nothing else. Beyond
#: a blank line only lines of 16 characters or more count.
_KEY = (
    rf"{_FIELDS}(?:(?:{_GAP}{_B64}++)*+{_GAP}-----END [A-Z0-9 ]*+-----"
    rf"|(?:{_GAP}{_B64}{{32,}}+|{_PAD}(?:{_EOL}{_PAD})++{_B64}{{16,}}+{_LINE_END}|{_PAD}{_EOL}{_PAD}{_B64}++{_LINE_END})*+)"
)

#: The rules, base kinds first and in their order of listing.
RULES = (
    Rule("assign", 1, r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 12, True),
    Rule("access", 1, "AKIA", "[A-Z0-9]+", 14, True),
    Rule("hex", 1, "", "[0-9a-f]{16,}", 16, True),
    Rule("pem", 2, "-----BEGIN ", f"[A-Z0-9 ]*PRIVATE KEY-----{_KEY}"),
    Rule("hosted", 1, r"\bgh[pousr]_", "[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"\beyJ", r"[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url", 2, r"\b[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D/:@]*+:", r"[^\x20\x09-\x0D/:@]{6,}+(?=@)"),
)


def _pieces(scan: Column, rule: Rule, rank: int) -> Column:
    """A text cut before each match of a rule, none without a match: of each piece its number, its
    length, and the lengths of the match at its start and of that match's lead, in code points and bytes."""
    marked = F.regexp_replace(scan, f"({rule.lead})({rule.body})", f"{_OPEN}$1{_MID}$2{_CLOSE}")
    parts = F.split(marked, _OPEN)

    def piece(part: Column, number: Column) -> Column:
        match = F.substring_index(part, _CLOSE, 1)
        found = number > 0  # what is before the first mark is no match
        return F.struct(
            F.lit(rank).alias("rank"),
            number.alias("number"),
            (F.char_length(part) - F.when(found, 2).otherwise(0)).cast("long").alias("chars"),
            (F.octet_length(part) - F.when(found, 2).otherwise(0)).cast("long").alias("bytes"),
            F.when(found, F.char_length(match) - 1).cast("long").alias("match_chars"),
            F.when(found, F.octet_length(match) - 1).cast("long").alias("match_bytes"),
            F.when(found, F.instr(part, _MID) - 1).cast("long").alias("lead_chars"),
        )

    return F.when(F.size(parts) > 1, F.transform(parts, piece))


def _scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, rules, spans: the spans in `blobs(blob, text, pending)` by the pending rules, by start, then rule.

    A piece's place is the sum of the lengths before it, a window over the pieces of
    one blob and rule, so that the work is in proportion to a text's findings. A blob
    has one row and is in one task already: nothing is shuffled here.
    """
    scan = F.translate("text", _OPEN + _MID + _CLOSE, _STANDIN * 3)
    each = [F.when(F.array_contains("pending", rule.key), _pieces(scan, rule, i)) for i, rule in enumerate(rules)]
    pieces = F.flatten(F.filter(F.array(*each), lambda x: x.isNotNull()))
    rows = blobs.select("blob", "pending", F.explode_outer(pieces).alias("piece")).select("blob", "pending", "piece.*")
    before = Window.partitionBy("blob", "rank").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    start, first = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("chars", "bytes"))
    placed = rows.withColumn("start", start).withColumn("first_byte", first)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rank") + 1)
    name = lambda of: F.element_at(F.array(*[F.lit(of(r)) for r in rules]), F.col("rank") + 1)
    span = F.struct("start", "rank", (F.col("start") + F.col("match_chars")).alias("end"), name(lambda r: r.kind).alias("kind"), name(lambda r: r.key).alias("rule"), "first_byte", (F.col("first_byte") + F.col("match_bytes")).alias("last_byte"))
    kept = F.when(F.col("match_chars") - F.col("lead_chars") >= least, span)
    found = placed.groupBy("blob").agg(F.first("pending").alias("rules"), F.sort_array(F.collect_list(kept)).alias("spans"))
    return found.select("blob", "rules", F.col("spans").cast(_SPANS).alias("spans"))


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan_new(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: one for each blob of `versions(text)` with unseen rule versions.

    Null texts are the empty blob. Copies of a blob meet by its address, with one
    copy a task after the partial aggregate, so a hot blob costs one row a task.
    """
    wanted = F.array(*[F.lit(r.key) for r in rules])
    blobs = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    unseen = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    pending = once.join(seen, "blob", "left").withColumn("pending", unseen).filter(F.size("pending") > 0)
    return _scanned(pending.select("blob", "text", "pending"), rules)


class BlobLedger:
    """A ledger kept as Parquet; `update` appends what it had not seen."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES):
        """`path`: a folder that may hold a ledger, be empty or not be there yet; a new one if None."""
        self.spark, self.rules = spark, rules
        self.path = path or new_path(spark, "secret-ledger")
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def update(self, versions: DataFrame) -> None:
        """Scans the unseen pairs of blob and rule version of all versions."""
        scan_new(versions, self.rows(), self.rules).write.mode("append").parquet(self.path)

    def hits(self) -> DataFrame:
        """(blob, found): the distinct spans of blobs that have any, by the rule versions in force, by start, then rule.

        Blobs and rules that two writers scanned at a time count once.
        """
        place = F.create_map(*[F.lit(x) for i, r in enumerate(self.rules) for x in (r.key, i)])
        current = F.filter("spans", lambda s: F.array_contains(F.array(*[F.lit(r.key) for r in self.rules]), s["rule"]))
        rows = self.rows().select("blob", current.alias("spans")).filter(F.size("spans") > 0)
        ranked = F.transform("spans", lambda s: s.withField("rank", F.element_at(place, s["rule"])))
        every = rows.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(ranked))).alias("every"))
        once = F.filter("every", lambda s, i: (i == 0) | (s != F.get(F.col("every"), i - 1)))
        return every.select("blob", once.alias("found"))

    def findings(self, versions: DataFrame, keys: list[str]) -> DataFrame:
        """One row per row of `versions` (`keys`, text): keys, blob, spans (may be empty).

        Only rule versions in force count. Blobs without findings are not joined.
        """
        paths = versions.select(*keys, blob_id(F.col("text")).alias("blob"))
        shown = F.transform(F.coalesce("found", F.array().cast(_SPANS)), lambda s: F.struct(s["kind"].alias("kind"), s["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end")))
        return paths.join(apart(self.hits()), "blob", "left").select(*keys, "blob", shown.alias("spans"))


def _cuts(hits: DataFrame) -> DataFrame:
    """(blob, cuts): the byte ranges that `hits` cover, in order; overlapping spans are one range."""
    rows = hits.select("blob", F.explode("found").alias("s")).select("blob", F.col("s.first_byte").alias("a"), F.col("s.last_byte").alias("b"))
    order = Window.partitionBy("blob").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("opens", (F.col("a") >= F.coalesce(reach, F.lit(-1))).cast("int"))
    ranges = marked.withColumn("range", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("blob", "range").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return ranges.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("cuts"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts and digests of the op4 contract, from `findings(doc_id, spans)`."""
    base = [r.kind for r in rules if r.base]

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    basic = F.filter("spans", lambda s: s["kind"].isin(*base))
    return findings.select("doc_id", *map(number, base), F.sha2(joined(basic), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.lower(F.hex("blob")).alias("blob"))


def scan_documents(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """Per document: counts of the base kinds, digests and all spans of its text.

    Null texts count as empty; repeated rows and ids give a row each; other columns
    are not read; an empty table gives no row.
    """
    versions = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.update(versions)
    return digest(ledger.findings(versions, ["doc_id"]), ledger.rules)


def scan_updates(docs: DataFrame, updates: int = 2) -> DataFrame:
    """`scan_documents` of rows that come in several updates, by a hash of their id: each scans only blobs that no
    update before has seen, and findings are joined back to the rows of all."""
    versions = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    ledger = BlobLedger(docs.sparkSession)
    for i in range(updates):
        ledger.update(versions.filter(F.pmod(F.xxhash64("doc_id"), F.lit(updates)) == i))
    return digest(ledger.findings(versions, ["doc_id"]), ledger.rules)


def redact_documents(docs: DataFrame, ledger: BlobLedger | None = None, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every found span replaced by `mark`; overlapping spans give one mark.

    Columns stay as they are; `n_chars`, where there is one, follows the new text.
    Null texts stay null, repeated rows stay, an empty table gives no row. The join
    back carries byte ranges, by content address.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.update(docs.select(F.col("text").cast("string").alias("text")))
    key, blob, cuts = free_names(docs.columns, "text_key", "blob_of", "cuts_of")
    hits = _cuts(ledger.hits()).select(F.col("blob").alias(blob), F.col("cuts").alias(cuts))
    n = F.size(cuts)

    def between(raw: Column, i: Column) -> Column:  # what is after cut i - 1 and before cut i
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(cuts), i - 1)["b"])
        end = F.when(i == n, F.octet_length(raw)).otherwise(F.get(F.col(cuts), i)["a"])
        return F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")).cast("string")

    whole = F.array(F.col("text").cast("string").cast("binary"))  # an array of one, so that lambdas do not copy the text each time
    clean = F.get(F.transform(whole, lambda raw: F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: between(raw, i)), mark)), 0)
    changed = F.col("text").isNotNull() & F.col(cuts).isNotNull()
    joined_back = docs.withColumn(key, blob_id(F.col("text"))).join(apart(hits), F.col(key) == F.col(blob), "left")
    out = joined_back.withColumn("text", F.when(changed, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
