"""What the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from quillon.sources import tables
from quillon.sources.work import discard, materialise, work_path

__all__ = ["discard", "fresh", "lean", "materialise", "table", "with_column", "work_path"]

#: Bytes of one Arrow batch on its way to or from a worker. An executor holds a few for each of its tasks outside its heap, and so
#: does each worker, so that the default of 64 MB would take several hundred.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read lazily, in a session whose Arrow batches are small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return tables.table(spark, sf_dir, name)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it until df has no such column in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_column(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], field: StructField) -> DataFrame:
    """docs with one more column, which run puts behind the others of its batches; names may be anything, even repeated."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(lean(run), StructType([*plain.schema.fields, field])).toDF(*docs.columns, field.name)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, after whose last batch the worker gives its memory back; workers outlive their tasks and share a machine."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
