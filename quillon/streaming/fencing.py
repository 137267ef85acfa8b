"""Streaming state: updates fenced by sequence, and cool-downs after failures.

Late results are told by their sequence, never by event time; a key's state is two numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.state import COOLDOWN_S, PARKED_AFTER, PROGRESS_DEDUPE
from quillon.sources.work import work_path


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All of a key's rows of one micro-batch in the order of time, however many Arrow batches they come in."""
    return pd.concat(list(frames)).sort_values(["ts", "event_id"], ignore_index=True)


def accept(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows whose sequence is no lower than the highest seen of their run."""
    highest = state.get[0] if state.exists else None
    frame = _in_order(frames)
    before = frame["sequence"].cummax().shift()
    if highest is not None:
        before = before.clip(lower=highest).fillna(highest)
    yield frame.loc[~(frame["sequence"] < before), ["event_id", "user_id", "sequence"]]
    top = int(frame["sequence"].max())
    state.update((top if highest is None else max(highest, top),))


def fenced(updates: DataFrame) -> DataFrame:
    """updates: event_id, user_id, ts, sequence, as a stream."""
    return updates.groupBy("user_id").applyInPandasWithState(accept, "event_id bigint, user_id bigint, sequence bigint", "highest bigint", "append", GroupStateTimeout.NoTimeout)


def cool(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """After each failure the count since the last success, the next try and whether the key is parked."""
    n = state.get[0] if state.exists else 0
    rows = []
    for r in _in_order(frames).itertuples():
        if r.event_type == "purchase":
            n = 0
        elif r.event_type == "error":
            n += 1
            rows.append((r.event_id, r.user_id, n, r.ts + pd.Timedelta(seconds=COOLDOWN_S), n >= PARKED_AFTER))
    yield pd.DataFrame(rows, columns=["event_id", "user_id", "n", "next_ok", "parked"])
    state.update((int(n),))


def cooled(events: DataFrame) -> DataFrame:
    """events: event_id, user_id, ts, event_type, as a stream."""
    return events.groupBy("user_id").applyInPandasWithState(cool, "event_id bigint, user_id bigint, n int, next_ok timestamp_ntz, parked boolean", "n int", "append", GroupStateTimeout.NoTimeout)


def progress_fence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream through the fence, to files and back."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out = work_path(spark, "fence")
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    updates = events.select("event_id", "user_id", "ts", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)).alias("sequence"))
    query = fenced(updates).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


QUERIES = {"progress_fence_stream": progress_fence_stream}
ORACLES = {"progress_fence_stream": PROGRESS_DEDUPE}
