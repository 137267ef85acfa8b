"""The pipeline's stages, each held to what its own input asks for, and the whole run."""

from __future__ import annotations

import corpus_pipeline
from quillon.llm import packing

DATA = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA).cache()
        assert after.columns == columns
        assert after.join(docs.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
        if name == "pii":
            assert after.count() == docs.count()
            assert not after.where(r"text RLIKE '[A-Za-z0-9]@[A-Za-z0-9-]+\\.[a-z]'").count()
            assert after.where("n_chars <> length(text)").count() == 0
        docs = after
    kept = {r.doc_id for r in docs.collect()}
    pieces = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in pieces} == kept
    want = {r.doc_id: r.doc_tokens for r in packing.pack_documents(docs).collect()}
    totals: dict = {}
    for r in pieces:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    assert totals == want


def test_stages_keep_nulls_and_empties(spark):
    rows = [(1, None), (2, ""), (3, "plain words here"), (None, "no id"), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, DATA)
    assert docs.count() == len(rows)
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, DATA).collect()  # the last windows may be cut
    assert {r.doc_id for r in pieces} == {i for i, _ in rows}
