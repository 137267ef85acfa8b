"""Token ids in ORC files, in ascending doc_id order.

The files use what the format offers: run-length encoded integers (delta runs for the sorted ids and starts, bit-packed
runs for the token ids), stripes that readers take in parallel, a row index every `INDEX_ROWS` rows and a Bloom filter on
doc_id. A search for documents reads only stripes and row groups whose statistics and filter admit them.

Each file holds one shard, a range of doc_ids. Rows carry the number of ids before them in the shard; adding the totals of
earlier shards gives the place in the whole, so nothing is sorted or counted again on reading.

Defined cases: a null or empty text is its end id alone; repeated rows are kept, in any order among themselves; null doc_ids
come first; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import lean, table, work_path

INDEX_ROWS = 1000
STRIPE_BYTES = 16 << 20
SCHEMA = "doc_id bigint, shard int, shard_start bigint, n_tokens bigint, ids array<int>"
_FORMAT = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(INDEX_ROWS), "orc.stripe.size": str(STRIPE_BYTES), "orc.compress": "LZ4"}
#: Ids in one Arrow batch on the way to the writer.
_BATCH_IDS = 2_000_000


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0) -> None:
    """Encode every text, append end_id, and write ORC files in ascending doc_id order."""
    end = int(end_id).to_bytes(4, "little")

    def batch_of(ids: list, shard: int, starts: list, lengths: list, data: list) -> pa.RecordBatch:
        offsets = np.zeros(len(lengths) + 1, np.int32)
        np.cumsum(lengths, out=offsets[1:])
        values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(data))])
        arrays = [pa.array(ids, pa.int64()), pa.array([shard] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "shard", "shard_start", "n_tokens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = tokens.encoder(vocabulary).encode, TaskContext.get().partitionId()
        before, since = 0, 0
        ids, starts, lengths, data = [], [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                coded = encode(text) + end
                ids.append(doc_id)
                starts.append(before)
                lengths.append(len(coded) // 4)
                data.append(coded)
                before += lengths[-1]
                if before - since > _BATCH_IDS:
                    yield batch_of(ids, shard, starts, lengths, data)
                    ids, starts, lengths, data, since = [], [], [], [], before
        yield batch_of(ids, shard, starts, lengths, data)

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(lean(run), SCHEMA).write.options(**_FORMAT).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on doc_id reach the row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, all from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            raw = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            begins = ends - lists.value_lengths().to_numpy(zero_copy_only=False)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            length = pa.array(ends - begins, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), length, pa.array(crc, pa.int64())], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    files = read_tokens(spark, path)
    rows = files.select("doc_id", "shard", "shard_start", "ids").mapInArrow(lean(run), "doc_id bigint, shard int, shard_start bigint, n_tokens bigint, ids_crc32 bigint")
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    bases = totals.select(F.col("shard").alias("of"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return rows.join(bases, rows.shard == bases.of).select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def op9_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids below the shared folder and returns the digest of what it reads back."""
    path = work_path(spark, "orc-tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_digest(spark, path)
