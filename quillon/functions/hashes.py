"""A 53-bit hash of byte sequences in 32-bit arithmetic, as column expressions and in DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The start states, multipliers and final multipliers of the hash.
START = (0xDEADBEEF, 0x41C6CE57)
STEP = (2654435761, 1597334677)
LAST = (2246822507, 3266489909)
_MASK = 0xFFFFFFFF


def times(a: Column, c: int) -> Column:
    """a * c modulo 2**32 without leaving 64-bit integers."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * F.lit(c)
    high = F.shiftleft((F.shiftright(a, 16) * F.lit(c)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(_MASK))


def _step(factor: int):
    return lambda h, b: times(h.bitwiseXOR(b.bitwiseAND(F.lit(0xFF)).cast("bigint")), factor)


def with_hash(df: DataFrame, codes: str, name: str) -> DataFrame:
    """df with the hexadecimal hash of an array of codes; intermediate states are columns, so none is worked out twice."""
    names = [f"_{name}_{k}" for k in ("h1", "h2", "f1", "f2")]
    h1, h2, f1, f2 = map(F.col, names)
    for k in range(2):
        df = df.withColumn(names[k], F.aggregate(codes, F.lit(START[k]).cast("bigint"), _step(STEP[k])))

    def final(a: Column, b: Column) -> Column:
        return times(a.bitwiseXOR(F.shiftright(a, 16)), LAST[0]).bitwiseXOR(times(b.bitwiseXOR(F.shiftright(b, 13)), LAST[1]))

    df = df.withColumn(names[2], final(h1, h2))
    df = df.withColumn(names[3], final(h2, f1))
    return df.withColumn(name, F.lower(F.hex(F.shiftleft(f2.bitwiseAND(F.lit(2097151)), 32) + f1))).drop(*names)


def sql_times(a: str, c: int) -> str:
    return f"(((({a}) & 65535) * {c} + ((((({a}) >> 16) * {c}) & 65535) << 16)) & 4294967295)"


def sql_hash(source: str, codes: str, keys: str) -> str:
    """A query of keys and the hash as text_hash over a list of codes."""
    folds = [f"list_reduce({codes}, lambda h, b: {sql_times('xor(h, b & 255)', STEP[k])}, CAST({START[k]} AS BIGINT)) AS h{k + 1}" for k in range(2)]
    final = "xor({}, {})"
    f1 = final.format(sql_times("xor(h1, h1 >> 16)", LAST[0]), sql_times("xor(h2, h2 >> 13)", LAST[1]))
    f2 = final.format(sql_times("xor(h2, h2 >> 16)", LAST[0]), sql_times("xor(f1, f1 >> 13)", LAST[1]))
    parts = [f"SELECT {keys}, {', '.join(folds)} FROM {source}", f"SELECT *, {f1} AS f1 FROM (#)", f"SELECT *, {f2} AS f2 FROM (#)", f"SELECT {keys}, lower(to_hex(((f2 & 2097151) << 32) + f1)) AS text_hash FROM (#)"]
    return reduce(lambda inner, outer: outer.replace("#", inner), parts)
