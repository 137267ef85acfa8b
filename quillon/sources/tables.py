"""Input tables by name, and helper tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files whose rows one task gets, so that what a task sorts doesn't grow with the table.
TASK_BYTES = 8 << 20


def by_key(df: DataFrame, key: str) -> DataFrame:
    """df, just read, dealt by a key into as many partitions as its size asks for, at least the session's number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES)), key)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of a page (an order), made from the integers of its lines: page_id, pos, x1, y1, x2, y2, conf. They are dealt by page."""
    d = by_key(table(spark, sf_dir, "lineitem"), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    x, y = (F.col("l_partkey") % 300).cast("double"), (F.col("l_suppkey") * 7 % 260).cast("double")
    w, h = F.col("l_quantity") * 2 + 20, (F.col("l_linenumber") * 17 % 60 + 24).cast("double")
    return d.select(F.col("l_orderkey").alias("page_id"), F.row_number().over(order).alias("pos"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"), F.round(1 - F.col("l_discount") * 5, 2).alias("conf"))


BOXES = """boxes AS (
    SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice) AS INT) AS pos,
        CAST(l_partkey % 300 AS DOUBLE) AS x1, CAST(l_suppkey * 7 % 260 AS DOUBLE) AS y1,
        CAST(l_partkey % 300 AS DOUBLE) + l_quantity * 2 + 20 AS x2, CAST(l_suppkey * 7 % 260 AS DOUBLE) + CAST(l_linenumber * 17 % 60 + 24 AS DOUBLE) AS y2,
        round(1 - l_discount * 5, 2) AS conf
    FROM lineitem)"""
