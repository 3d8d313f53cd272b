"""The pipeline's stages on planted documents."""

from __future__ import annotations

import corpus_pipeline
from gridspark.llm import ngramjoin, secrets

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_is_clean(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{number}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{number}")
        if number < 4:
            assert docs.columns == columns
            counts.append(docs.count())
        if number == 1:
            assert all(r.doc_id == r.component_id for r in ngramjoin.join_documents(docs).collect())
        if number == 3:
            assert secrets.scan_documents(docs).agg({"n_assign": "sum", "n_access": "sum", "n_hex": "sum"}).first().asDict().values().__iter__().__next__() == 0
            assert before.count() == docs.count()
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0.5 * counts[0]
    tokens = {r.doc_id: r.doc_tokens for r in docs.collect()}
    assert len(tokens) == counts[4]
    assert sum(tokens.values()) == docs.agg({"length": "sum"}).first()[0]


def test_run_gives_the_packed_pieces(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
