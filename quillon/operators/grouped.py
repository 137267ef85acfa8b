"""Order-dependent work on small groups, without a pandas frame for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_groups(df: DataFrame, key: str, order: list[str], fn: Callable[[list[dict]], list[tuple]], schema: str, dealt: bool = False) -> DataFrame:
    """fn on the rows of each key, in the given order; one group's rows are in memory at a time, batches are streamed.

    dealt: df's rows of a key are in one partition already.
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        rows = (dict(zip(b.schema.names, r, strict=True)) for b in batches for r in zip(*map(_values, b.columns), strict=True))
        for _, group in groupby(rows, key=lambda r: r[key]):
            out += fn(list(group))
            if len(out) >= 10_000:
                yield batch()
                out = []
        yield batch()

    return (df if dealt else df.repartition(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _values(column: pa.Array) -> list:
    """A column's values; of numbers without nulls by way of NumPy, which is faster."""
    plain = not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type))
    return column.to_numpy().tolist() if plain else column.to_pylist()
