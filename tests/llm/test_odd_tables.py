"""Every operator and every stage on odd rows, clashing column names and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import decontamination, fingerprints, language, ngramjoin, packing, quality, secrets, tokencounts, toxicity, warc
from gridspark.llm.queries import vocabulary

#: Names that operators give to columns of their own.
CLASHING = ("text_of", "weight_of", "low_text", "gone_id", "text_key", "blob_of", "cuts_of", "set_key", "bucket", "blob", "spans", "cuts", "score", "component", "copies", "known", "token", "label", "held_out", "pending", "piece", "rank", "number", "start", "rank_of", "tie_of", "part_of", "payload_key", "n", "top", "original", "value", "low", "id", "marked_id", "wanted_id", "chosen_id", "sampling_key", "log_weight")


@pytest.fixture(scope="module")
def labels(spark):
    """Conflicting, repeated and null labels, labels of documents that are not there."""
    rows = [(1, 1, 0), (4, 1, 0), (4, 0, 1), (4, 0, 1), (6, 1, None), (9, None, 1), (None, 1, 1), (777, 0, 1), (778, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "w5 w6 w7 w8 w9 w10"), (2, None), (3, ""), (None, "x"), (1, "w5 w6 w7 w8 w9 w10")], "item_id long, text string").withColumn("low_text", F.lit("own"))


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 997}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (4, "other token=abcdefghijklmnop"), (5, "ONE  two"), (6, long), (6, long), (7, long + " end"), (None, "a null id é日本"), (None, None), (8, "x" * 30_000), (9, "x")]
    out = spark.createDataFrame(rows, "doc_id long, text string")
    return out.select("*", *[F.lit("own").alias(c) for c in CLASHING], F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.char_length("text").cast("long").alias("n_chars"))


OPERATORS = {
    "op1": lambda d, lab, b: decontamination.find_contamination(d, b),
    "op2": lambda d, lab, b: packing.pack_documents(d, vocabulary()),
    "op3": lambda d, lab, b: quality.sample_documents(d, lab),
    "op4": lambda d, lab, b: secrets.scan_documents(d),
    "op5": lambda d, lab, b: tokencounts.count_tokens(d, vocabulary("piece_bpe_32k.model")),
    "op6": lambda d, lab, b: toxicity.judge_documents(d, lab),
    "op7": lambda d, lab, b: language.identify_documents(d),
    "op8": lambda d, lab, b: ngramjoin.join_documents(d),
    "op9": lambda d, lab, b: fingerprints.compare_edited(d),
    "op10": lambda d, lab, b: warc.archive_pages(d.drop("value").withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("value", F.lit(1))),
}
STAGES = {
    "quality": lambda d, lab, b: quality.keep_documents(d, lab),
    "join": lambda d, lab, b: ngramjoin.keep_representatives(d),
    "decontamination": lambda d, lab, b: decontamination.remove_contaminated(d, b),
    "secrets": lambda d, lab, b: secrets.redact_documents(d),
}
ALL_ROWS = {"op4", "op5", "op6", "op7", "op8", "op9", "op10"}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_odd_rows(name, odd, labels, benchmark):
    operator = OPERATORS[name]
    rows = operator(odd, labels, benchmark).collect()
    if name in ALL_ROWS:
        assert len(rows) == odd.count()
    if name == "op1":
        assert sorted((r.doc_id, r.item_id) for r in rows) == [(6, 1)] * 4 + [(7, 1)] * 2 + [(9, None)]
    if name == "op2":
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
    if name == "op6":
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "op7":
        assert {r.lang_pred for r in rows} == {"und"}
    assert operator(odd.limit(0), labels, benchmark).count() == 0
    assert operator(odd.limit(0), labels.limit(0), benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_odd_rows(name, odd, labels, benchmark):
    stage = STAGES[name]
    out = stage(odd, labels, benchmark)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    rows = out.collect()
    assert all(r[c] == "own" for r in rows for c in CLASHING)
    got = sorted(str(r.doc_id) for r in rows)
    everything = sorted(["1", "2", "3", "4", "4", "4", "5", "6", "6", "7", "8", "9", "None", "None"])
    if name == "quality":
        assert set(got) <= set(everything)
    elif name == "join":
        assert got == sorted(["1", "2", "3", "4", "4", "4", "6", "6", "8", "9", "None", "None"])
    elif name == "decontamination":
        assert got == sorted(["1", "2", "3", "4", "4", "4", "5", "8", "None", "None"])
    else:
        assert got == everything and {r.text for r in rows if r.doc_id == 4} == {"one two", "other [SECRET]"}
        assert all(r.text is None or r.n_chars == len(r.text) for r in rows)
    nothing = stage(odd.limit(0), labels, benchmark)
    assert nothing.count() == 0 and nothing.columns == odd.columns


def test_the_pipeline_on_an_empty_table(spark, odd, labels, benchmark, tmp_path):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for number, docs in enumerate((plain, plain.limit(0))):
        folder = f"{tmp_path}/{number}"
        for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
            df.write.parquet(f"{folder}/{name}.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert bool(rows) == (number == 0) and all(r.sequence_tokens <= 1024 for r in rows)
