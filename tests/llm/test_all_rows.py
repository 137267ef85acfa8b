"""What the pipeline learns comes from every row, also of tables with more rows than any one task or the driver should hold."""

from __future__ import annotations

import math

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from quillon.llm import pii, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_toxicity_learns_from_all_labelled_rows(spark, tmp_path):
    # The rows behind the 20,000 of the smallest hash alone have one of the two words that make a text toxic.
    ids = spark.range(30_000).where(~toxicity.held_out("id", 5, 0)).orderBy(F.xxhash64("id"), "id")
    ids = [r.id for r in ids.collect()]
    assert len(ids) > 22_000
    words = [f"{x}{y}nly" for x in "bcdfgklm" for y in "aeou"]
    rows = [(i, f"plain {words[at % 32]} words {words[at // 32 % 32] if at % 3 else 'moron' if at < 20_000 else 'idiot'} there", int(at % 3 == 0)) for at, i in enumerate(ids)]
    asked = [(-1, "plain words idiot there"), (-2, "plain words moron there"), (-3, "plain banly words there")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [*[r[:2] for r in rows], *asked]], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {-3, *(i for i, _, y in rows if not y)}

    # The weights are the least point of the loss over all those rows.
    scorer = toxicity.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    seen = toxicity._Features(scorer.model, scorer.index)
    slope = np.append(2e-4 * scorer.weights, 0.0)
    for _, text, y in rows:
        own = {f: math.log1p(n) for f, n in seen.of(text).items()}
        error = 1 / (1 + math.exp(-scorer.bias - sum(scorer.weights[f] * v for f, v in own.items()))) - y
        for f, v in [*own.items(), (-1, 1.0)]:
            slope[f] += error * v / len(rows)
    assert np.abs(slope).max() < 1e-5


def test_least_point_of_a_convex_function():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(40, 12)) * np.logspace(-2, 1, 12)
    bend, off = a.T @ a + 0.01 * np.eye(12), rng.normal(size=12)
    got = toxicity._least(lambda x: (x @ bend @ x / 2 - off @ x, bend @ x - off), np.zeros(12), 1e-8, 500)
    assert np.allclose(bend @ got, off, atol=1e-6)


def test_a_first_look_loses_no_row(spark):
    docs = spark.range(-500, 3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    ids = docs.where("doc_id % 7 = 0").select(F.col("doc_id").cast("int"))
    got = {r.doc_id for r in toxicity._maybe_among(docs, ids).collect()}
    want = {i for i in range(-500, 3000) if i % 7 == 0}
    assert want <= got and len(got) < len(want) + 5


def test_factors_are_counted_on_all_documents(spark):
    # Documents whose hash falls behind the first 50,000 of 60,000 places alone hold a shape of their own.
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("see 12#34 now").alias("text"))
    late = F.pmod(F.xxhash64("doc_id", "text"), F.lit(60_000)) >= 50_000
    docs = docs.select("doc_id", F.when(late, F.col("text")).otherwise("call +49 170 1234567 now").alias("text"))
    field, n = pii.fit(docs), docs.where("text like '%#%'").count()
    assert n > 9000 and set(field.unary) == {"92_#92_", "+92_", "93_", "97_"}
    total = np.array([n, 0, 0, 0, 3 * (60_000 - n)]) + 1  # other; email, ip, card and phone
    unseen = total * np.array([1, 0.1, 0.1, 0.1, 0.1])
    assert np.allclose(field.unseen, np.log(unseen / unseen.sum()))


def test_many_configurations_are_sent_in_parts(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("a "), F.repeat(F.lit("#1"), F.pmod("id", F.lit(9)).cast("int") + 1)).alias("text"))
    want = pii.fit(docs)
    monkeypatch.setattr(pii, "HELD", 3)
    assert pii.fit(docs) == want
