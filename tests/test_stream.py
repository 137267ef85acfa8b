"""Streams give what the batch queries give, also where a key's rows come in several Arrow batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators import state
from quillon.streaming import fencing

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


def events(spark):
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(DATA)


def drained(spark, df, tmp_path):
    query = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "rows"))
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "rows"))


def test_cooled_equals_the_batch(spark, small_batches, tmp_path):
    got = drained(spark, fencing.cooled(events(spark).select("event_id", "user_id", "ts", "event_type")), tmp_path)
    want = state.cooldown_state(spark, DATA)
    columns = [c for c in want.columns if c in got.columns]
    assert {"event_id", "n", "parked"} <= set(columns) and got.count() > 100
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_fenced_equals_the_batch(spark, small_batches, tmp_path):
    updates = events(spark).select("event_id", "user_id", "ts", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)).alias("sequence"))
    got = drained(spark, fencing.fenced(updates), tmp_path)
    want = state.progress_dedupe(spark, DATA)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
