"""Greedy line breaking as a fold over words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.tables import table

WIDTH = 40


def greedy_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each turn's words take at WIDTH characters, and how full the last one is."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \n]+"), lambda w: w != "")

    def step(acc, w):
        n, fits = F.length(w), acc["used"] + 1 + F.length(w) <= WIDTH
        return F.struct((acc["lines"] + F.when((acc["lines"] > 0) & fits, 0).otherwise(1)).alias("lines"), F.when((acc["lines"] > 0) & fits, acc["used"] + 1 + n).otherwise(n).alias("used"))

    done = F.aggregate(words, F.struct(F.lit(0).alias("lines"), F.lit(0).alias("used")), step)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", done.alias("d"))
    return c.select("conv_id", "turn", F.col("d.lines").alias("n_lines"), F.col("d.used").alias("last_used"))


GREEDY_WRAP = f"""WITH RECURSIVE w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n]+'), lambda x: x <> '') AS ws FROM conversations),
r AS (SELECT conv_id, turn, ws, 0 AS i, 0 AS lines, 0 AS used FROM w
    UNION ALL SELECT conv_id, turn, ws, i + 1, CASE WHEN lines > 0 AND used + 1 + length(ws[i + 1]) <= {WIDTH} THEN lines ELSE lines + 1 END,
        CASE WHEN lines > 0 AND used + 1 + length(ws[i + 1]) <= {WIDTH} THEN used + 1 + length(ws[i + 1]) ELSE length(ws[i + 1]) END FROM r WHERE i < len(ws))
SELECT conv_id, turn, CAST(lines AS INT) AS n_lines, CAST(used AS INT) AS last_used FROM r WHERE i = len(ws)"""

QUERIES = {"greedy_wrap": greedy_wrap}
ORACLES = {"greedy_wrap": GREEDY_WRAP}
