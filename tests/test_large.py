"""Cases in which the library's own operators differed from their SQL, or did work that grew faster than their input."""

from __future__ import annotations

import os

import duckdb
import pytest

from quillon.plans import registry


def rows_of(spark, name, folder):
    """A query's rows and its SQL's, over the tables of a folder."""
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}/*.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    result = con.execute(registry.ORACLES[name])
    at = [[c[0] for c in result.description].index(c) for c in df.columns]
    return sorted(map(tuple, df.collect()), key=repr), sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)


def test_words_end_before_other_letters(spark, tmp_path):
    lines = {1: ["x", "fine", "Réquement est", "R and", "rest", "keepé on"], 2: ["keepé on", "x", "keep on", "Réquement", "x", "keep"]}
    rows = [(conv, turn, "user", text) for conv, texts in lines.items() for turn, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got, want = rows_of(spark, "transcriptions", tmp_path)
    assert got == want


def test_dice_links_in_passes_over_chunks(spark, tmp_path, monkeypatch):
    from quillon.operators import identity

    rows = [(i, "".join(chr(97 + (i // 6 * 7 + k * (1 + i // 6)) % 26) for k in range(14 + i % 6)) + "xyz"[: i % 3], "en") for i in range(48)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    # Chunks of few texts, and sizes with more texts than a chunk holds; no text is shuffled to meet others.
    monkeypatch.setattr(identity, "CHUNK_TEXTS", 3)
    monkeypatch.setattr(identity, "LISTED_SHARE", 2)
    assert any(parts > 1 for _, _, parts in identity._chunks([(14, 7), (15, 2), (16, 1)]))
    got, want = rows_of(spark, "dice_links", tmp_path)
    assert got == want and sum(r[1] for r in want) > 0


def test_hashes_a_few_bits_apart_meet_in_few_keys(spark):
    import random

    from pyspark.sql import functions as F

    from quillon.functions import images as I

    draw = random.Random(3)
    rows = []
    for i in range(400):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), i % (I.MOST_BITS + 1)):
            b ^= 1 << bit
        rows.append((i, *(x - (x >> 63 << 64) for x in (a, b))))
    df = spark.createDataFrame(rows, "i int, a bigint, b bigint")
    assert df.where(F.arrays_overlap(I.parts(F.col("a")), I.near_parts(F.col("b")))).count() == len(rows)
    # Of two hashes of different pictures one in a hundred meets; with nine bands of seven bits one in fourteen did.
    a, b = df.select("i", F.explode(I.parts(F.col("a"))).alias("key")), df.select(F.col("i").alias("j"), F.explode(I.near_parts(F.col("b"))).alias("key"))
    assert a.join(b, "key").where("i <> j").count() < 400 * 399 / 60


def test_tasks_get_no_more_rows_of_a_larger_table(spark, monkeypatch):
    from quillon.sources import tables

    monkeypatch.setattr(tables, "TASK_BYTES", 1 << 13)  # as if the table were larger
    assert tables.boxes(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 4
