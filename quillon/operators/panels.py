"""Panels and text blocks of pages: panels from a model's rows, their order, nesting and use, corridors, families, blocks, labels and merged tiles.

Boxes of a page are its lines of text; panels are made of the same integers, larger. Pages are small, so that folds over a page's arrays
settle what depends on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import folds
from quillon.functions import rects as R
from quillon.operators.records import PAGE_H, PAGE_W
from quillon.sources.tables import BOXES, boxes

# Sureness of a panel, of a near miss, near misses kept, panels of a real page, share of a page that the largest covers.
SURE, FLOOR, MISSES, MOST, LARGEST = 0.65, 0.55, 2, 25, 0.03
# Overlap that makes a row or column of panels, the width of a banner, and the share of a panel inside another.
ROW, COLUMN, BANNER, INSIDE = 0.25, 0.5, 0.9, 0.7
#: Side of the square that a model's rows are scaled to.
MODEL = 640.0


def panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of each page from a model's rows: sure ones by size, and the first near misses; scaled, inside the page, of the right class."""
    b = boxes(spark, sf_dir).where(F.col("pos") % 4 != 0)
    fit = lambda c, side, whole: F.least(F.greatest(F.col(c) / MODEL * whole, F.lit(0.0)), F.lit(whole))
    b = b.select("page_id", "pos", "conf", fit("x1", "x", PAGE_W).alias("x1"), fit("y1", "y", PAGE_H).alias("y1"), fit("x2", "x", PAGE_W).alias("x2"), fit("y2", "y", PAGE_H).alias("y2"))
    b = b.where((F.col("conf") >= FLOOR) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).withColumn("sure", F.col("conf") >= SURE)
    size = F.when(F.col("sure"), -R.area("")).otherwise(0.0)
    b = b.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "sure").orderBy(size, "pos")))
    b = b.withColumn("n", F.count_if(F.col("sure")).over(Window.partitionBy("page_id"))).withColumn("top", F.max(F.when(F.col("sure"), R.area(""))).over(Window.partitionBy("page_id")))
    usable = F.coalesce((F.col("n").between(1, MOST)) & (F.col("top") >= LARGEST * PAGE_W * PAGE_H), F.lit(False))
    return b.where(F.col("sure") | (F.col("k") <= MISSES)).select("page_id", "pos", "sure", "k", usable.alias("usable"))


PANEL_ROWS = f"""WITH {BOXES}, s AS (SELECT page_id, pos, conf, least(greatest(x1 / {MODEL} * {PAGE_W}, 0.0), {PAGE_W}) AS x1, least(greatest(y1 / {MODEL} * {PAGE_H}, 0.0), {PAGE_H}) AS y1,
    least(greatest(x2 / {MODEL} * {PAGE_W}, 0.0), {PAGE_W}) AS x2, least(greatest(y2 / {MODEL} * {PAGE_H}, 0.0), {PAGE_H}) AS y2 FROM boxes WHERE pos % 4 <> 0),
f AS (SELECT *, conf >= {SURE} AS sure, (x2 - x1) * (y2 - y1) AS area FROM s WHERE conf >= {FLOOR} AND x2 > x1 AND y2 > y1),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id, sure ORDER BY CASE WHEN sure THEN -area ELSE 0 END, pos) AS INT) AS k, count(*) FILTER (sure) OVER (PARTITION BY page_id) AS n, max(area) FILTER (sure) OVER (PARTITION BY page_id) AS top FROM f)
SELECT page_id, pos, sure, k, coalesce(n BETWEEN 1 AND {MOST} AND top >= {LARGEST * PAGE_W * PAGE_H}, false) AS usable FROM k WHERE sure OR k <= {MISSES}"""


def _panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels: every box, three times as wide and high."""
    b = boxes(spark, sf_dir)
    return b.select("page_id", "pos", (F.col("x1") * 2).alias("x1"), (F.col("y1") * 2).alias("y1"), (F.col("x1") * 2 + (F.col("x2") - F.col("x1")) * 3).alias("x2"), (F.col("y1") * 2 + (F.col("y2") - F.col("y1")) * 3).alias("y2"), "conf")


_PANELS = f"{BOXES}, panels AS (SELECT page_id, pos, x1 * 2 AS x1, y1 * 2 AS y1, x1 * 2 + (x2 - x1) * 3 AS x2, y1 * 2 + (y2 - y1) * 3 AS y2, conf FROM boxes)"


def _joined(df: DataFrame, near: Column, name: str) -> DataFrame:
    """df with the smallest pos of its page that links lead to; near: a condition on a and b of one page."""
    met = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.pos") < F.col("b.pos")) & near
    edges = df.alias("a").join(df.alias("b"), met).select(F.col("a.page_id").alias("page_id"), F.struct(F.col("a.pos").alias("a"), F.col("b.pos").alias("b")).alias("e"))
    pages = df.groupBy("page_id").agg(F.max("pos").alias("n")).join(edges.groupBy("page_id").agg(F.collect_list("e").alias("edges")), "page_id", "left")
    labels = pages.select("page_id", F.posexplode(folds.labels(F.col("n"), F.col("edges"))).alias("p", name)).select("page_id", (F.col("p") + 1).alias("pos"), name)
    return df.join(labels, ["page_id", "pos"])


def _over(n: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.col(f"a.{n}2"), F.col(f"b.{n}2")) - F.greatest(F.col(f"a.{n}1"), F.col(f"b.{n}1")))


def _least_side(n: str) -> Column:
    return F.least(F.col(f"a.{n}2") - F.col(f"a.{n}1"), F.col(f"b.{n}2") - F.col(f"b.{n}1"))


def panel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels in reading order from right to left, and the smallest larger panel that holds each: rows that overlap in height, in them
    columns that overlap in width; a banner joins a row only at its level."""
    p = _panels(spark, sf_dir)
    banner = (F.col("a.x2") - F.col("a.x1") >= BANNER * PAGE_W) | (F.col("b.x2") - F.col("b.x1") >= BANNER * PAGE_W)
    rows = (_over("y") >= ROW * _least_side("y")) & ~(banner & (F.abs(F.col("a.y1") - F.col("b.y1")) > ROW * _least_side("y")))
    p = _joined(p, rows, "row")
    p = _joined(p, (F.col("a.row") == F.col("b.row")) & (_over("x") >= COLUMN * _least_side("x")), "col")
    row, column = Window.partitionBy("page_id", "row"), Window.partitionBy("page_id", "row", "col")
    p = p.withColumn("top", F.min("y1").over(row)).withColumn("right", F.max("x2").over(column))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("top", "row", F.desc("right"), "col", "y1", "pos")) - 1
    a, b = p.alias("a"), p.alias("b")
    larger = (R.area("b") > R.area("a")) | ((R.area("b") == R.area("a")) & (F.col("b.pos") < F.col("a.pos")))
    held = a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.pos") != F.col("b.pos")) & larger & (R.overlap("a", "b") >= INSIDE * R.area("a")))
    parent = held.groupBy(F.col("a.page_id").alias("page_id"), F.col("a.pos").alias("pos")).agg(F.min(F.struct(R.area("b").alias("s"), F.col("b.pos").alias("p")))["p"].alias("parent"))
    return p.withColumn("rank", rank).join(parent, ["page_id", "pos"], "left").select("page_id", "pos", "rank", "parent")


def _sql_over(n: str) -> str:
    return f"greatest(0.0, least(a.{n}2, b.{n}2) - greatest(a.{n}1, b.{n}1))"


def _sql_side(n: str) -> str:
    return f"least(a.{n}2 - a.{n}1, b.{n}2 - b.{n}1)"


PANEL_ORDER = f"""WITH RECURSIVE {_PANELS},
rl AS (SELECT a.page_id, a.pos AS p, b.pos AS q FROM panels a JOIN panels b ON a.page_id = b.page_id AND (a.pos = b.pos OR ({_sql_over('y')} >= {ROW} * {_sql_side('y')}
    AND NOT ((a.x2 - a.x1 >= {BANNER * PAGE_W} OR b.x2 - b.x1 >= {BANNER * PAGE_W}) AND abs(a.y1 - b.y1) > {ROW} * {_sql_side('y')})))),
rr AS (SELECT page_id, p, q FROM rl UNION SELECT r.page_id, r.p, l.q FROM rr r JOIN rl l ON l.page_id = r.page_id AND l.p = r.q),
w AS (SELECT x.*, r.row_ FROM panels x JOIN (SELECT page_id, p, min(q) AS row_ FROM rr GROUP BY ALL) r ON r.page_id = x.page_id AND r.p = x.pos),
cl AS (SELECT a.page_id, a.pos AS p, b.pos AS q FROM w a JOIN w b ON a.page_id = b.page_id AND a.row_ = b.row_ AND (a.pos = b.pos OR {_sql_over('x')} >= {COLUMN} * {_sql_side('x')})),
cr AS (SELECT page_id, p, q FROM cl UNION SELECT r.page_id, r.p, l.q FROM cr r JOIN cl l ON l.page_id = r.page_id AND l.p = r.q),
c AS (SELECT w.*, r.col FROM w JOIN (SELECT page_id, p, min(q) AS col FROM cr GROUP BY ALL) r ON r.page_id = w.page_id AND r.p = w.pos),
t AS (SELECT *, min(y1) OVER (PARTITION BY page_id, row_) AS top, max(x2) OVER (PARTITION BY page_id, row_, col) AS rightmost FROM c),
h AS (SELECT a.page_id, a.pos, b.pos AS parent FROM panels a JOIN panels b ON a.page_id = b.page_id AND a.pos <> b.pos AND ({R.SQL_AREA['b']} > {R.SQL_AREA['a']} OR ({R.SQL_AREA['b']} = {R.SQL_AREA['a']} AND b.pos < a.pos))
    AND {R.SQL_OVERLAP} >= {INSIDE} * {R.SQL_AREA['a']} QUALIFY row_number() OVER (PARTITION BY a.page_id, a.pos ORDER BY {R.SQL_AREA['b']}, b.pos) = 1)
SELECT t.page_id, t.pos, CAST(row_number() OVER (PARTITION BY t.page_id ORDER BY top, row_, rightmost DESC, col, y1, t.pos) - 1 AS INT) AS rank, parent FROM t LEFT JOIN h ON h.page_id = t.page_id AND h.pos = t.pos"""


def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose boxes stand in two groups side by side: where the widest middle corridor runs that each box has a neighbour across."""
    g = boxes(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x1", "y1", "x2", "y2"))).alias("b"))
    g = g.where("size(b) >= 4")
    least = lambda xs, n: F.array_min(F.transform(xs, lambda r: r[n]))
    most = lambda xs, n: F.array_max(F.transform(xs, lambda r: r[n]))
    g = g.withColumn("from", least(F.col("b"), "x1")).withColumn("w", most(F.col("b"), "x2") - F.col("from")).withColumn("h", most(F.col("b"), "y2") - least(F.col("b"), "y1"))
    widths = F.array_sort(F.transform("b", lambda r: r["x2"] - r["x1"]))
    g = g.withColumn("med", F.element_at(widths, (F.floor(F.size("b") / 2) + 1).cast("int")))
    tall = F.forall("b", lambda r: r["y2"] - r["y1"] >= 1.2 * (r["x2"] - r["x1"]))
    g = g.where(((F.col("w") >= 1.8 * F.col("h")) & (F.col("w") >= 3 * F.col("med"))) | (tall & (F.col("w") >= 2.5 * F.col("med"))))
    edges = F.array_sort(F.array_distinct(F.flatten(F.transform("b", lambda r: F.array(r["x1"], r["x2"])))))
    g = g.withColumn("edges", edges)
    cuts = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: (F.element_at("edges", i) + F.element_at("edges", i + 1)) / 2)
    meets = lambda a, c: F.least(a["y2"], c["y2"]) > F.greatest(a["y1"], c["y1"])

    def tried(x: Column) -> Column:
        left, right = F.filter("b", lambda r: r["x2"] <= x), F.filter("b", lambda r: r["x1"] >= x)
        gap = F.least(x - most(left, "x2"), least(right, "x1") - x)
        inside = (x >= F.col("from") + 0.3 * F.col("w")) & (x <= F.col("from") + 0.7 * F.col("w"))
        whole = (F.size(left) >= 2) & (F.size(right) >= 2) & (F.size(left) + F.size(right) == F.size("b"))
        paired = F.forall(left, lambda a: F.exists(right, lambda c: meets(a, c))) & F.forall(right, lambda a: F.exists(left, lambda c: meets(a, c)))
        wide = gap >= F.greatest(0.5 * F.col("med"), 0.02 * F.col("w"))
        return F.when(inside & whole & paired & wide, F.struct(gap.alias("gap"), (-x).alias("at")))

    best = F.array_max(F.filter(F.transform(cuts, tried), lambda t: t.isNotNull()))
    return g.select("page_id", best["gap"].alias("gap"), (-best["at"]).alias("at")).where("gap IS NOT NULL")


CORRIDORS = f"""WITH {BOXES}, g AS (SELECT page_id, count(*) AS n, min(x1) AS from_, max(x2) - min(x1) AS w, max(y2) - min(y1) AS h, list_sort(list(x2 - x1))[count(*) // 2 + 1] AS med, bool_and(y2 - y1 >= 1.2 * (x2 - x1)) AS tall FROM boxes GROUP BY 1),
p AS (SELECT * FROM g WHERE n >= 4 AND ((w >= 1.8 * h AND w >= 3 * med) OR (tall AND w >= 2.5 * med))),
e AS (SELECT DISTINCT page_id, unnest([x1, x2]) AS e FROM boxes SEMI JOIN p USING (page_id)),
c AS (SELECT page_id, (e + lead(e) OVER (PARTITION BY page_id ORDER BY e)) / 2 AS x FROM e),
t AS (SELECT c.page_id, x, p.*, (SELECT list(b) FROM boxes b WHERE b.page_id = c.page_id AND b.x2 <= x) AS l, (SELECT list(b) FROM boxes b WHERE b.page_id = c.page_id AND b.x1 >= x) AS r FROM c JOIN p ON p.page_id = c.page_id WHERE x IS NOT NULL),
v AS (SELECT page_id, x, least(x - list_max(list_transform(l, lambda b: b.x2)), list_min(list_transform(r, lambda b: b.x1)) - x) AS gap FROM t
    WHERE x >= from_ + 0.3 * w AND x <= from_ + 0.7 * w AND len(l) >= 2 AND len(r) >= 2 AND len(l) + len(r) = n
    AND len(list_filter(l, lambda a: len(list_filter(r, lambda b: least(a.y2, b.y2) > greatest(a.y1, b.y1))) = 0)) = 0 AND len(list_filter(r, lambda a: len(list_filter(l, lambda b: least(a.y2, b.y2) > greatest(a.y1, b.y1))) = 0)) = 0
    AND least(x - list_max(list_transform(l, lambda b: b.x2)), list_min(list_transform(r, lambda b: b.x1)) - x) >= greatest(0.5 * med, 0.02 * w))
SELECT page_id, gap, x AS "at" FROM v QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY gap DESC, x) = 1"""

#: How far apart siblings may be that are read one after the other.
FAMILY_GAP = 96.0


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of each page's boxes once near siblings follow the first of them; lines of one part are siblings."""
    b = boxes(spark, sf_dir).withColumn("sib", F.floor(F.col("x1") / 120).cast("int"))
    order = Window.partitionBy("page_id", "sib").orderBy("pos")
    lag = lambda c: F.lag(c).over(order)
    gap = [F.greatest(F.lit(0.0), lag(f"{n}1") - F.col(f"{n}2"), F.col(f"{n}1") - lag(f"{n}2")) for n in "xy"]
    apart = F.when((gap[0] > 0) & (gap[1] > 0), F.least(*gap)).otherwise(F.greatest(*gap))
    b = b.withColumn("apart", apart)
    family = Window.partitionBy("page_id", "sib")
    near = F.coalesce(F.max("apart").over(family), F.lit(0.0)) <= FAMILY_GAP
    b = b.withColumn("head", F.when(near, F.min("pos").over(family)).otherwise(F.col("pos")))
    return b.select("page_id", "pos", (F.row_number().over(Window.partitionBy("page_id").orderBy("head", "pos")) - 1).alias("rank"))


FAMILIES = f"""WITH {BOXES}, s AS (SELECT *, CAST(floor(x1 / 120) AS INT) AS sib FROM boxes),
l AS (SELECT *, greatest(0.0, lag(x1) OVER w - x2, x1 - lag(x2) OVER w) AS gx, greatest(0.0, lag(y1) OVER w - y2, y1 - lag(y2) OVER w) AS gy, lag(x1) OVER w IS NULL AS first FROM s WINDOW w AS (PARTITION BY page_id, sib ORDER BY pos)),
a AS (SELECT *, max(CASE WHEN first THEN NULL WHEN gx > 0 AND gy > 0 THEN least(gx, gy) ELSE greatest(gx, gy) END) OVER (PARTITION BY page_id, sib) AS apart, min(pos) OVER (PARTITION BY page_id, sib) AS head FROM l)
SELECT page_id, pos, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN coalesce(apart, 0) <= {FAMILY_GAP} THEN head ELSE pos END, pos) - 1 AS INT) AS rank FROM a"""


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each page's words: those in one row and lines stacked over each other, their height, and what is large lettering."""
    b = boxes(spark, sf_dir)
    unit = _least_side("y")
    tallest, narrow = F.greatest(*[F.col(f"{s}.y2") - F.col(f"{s}.y1") for s in "ab"]), _least_side("x")
    gap = {n: F.greatest(F.col(f"a.{n}1") - F.col(f"b.{n}2"), F.col(f"b.{n}1") - F.col(f"a.{n}2"), F.lit(0.0)) for n in "xy"}
    level = F.abs(F.col("a.y1") + F.col("a.y2") - F.col("b.y1") - F.col("b.y2")) <= 1.2 * unit
    stacked = (gap["x"] == 0) & (_over("x") >= 0.5 * narrow) & (gap["y"] <= 0.6 * F.greatest(unit, F.least(narrow, tallest)))
    b = _joined(b, (level & (gap["x"] <= 0.9 * unit)) | stacked, "block")
    heights = F.array_sort(F.collect_list(F.col("y2") - F.col("y1")).over(Window.partitionBy("page_id")))
    b = b.withColumn("med", F.element_at(heights, (F.floor(F.size(heights) / 2) + 1).cast("int")))
    high = F.col("y2") - F.col("y1")
    lettering = (high >= 1.5 * F.col("med")) & (F.col("x2") - F.col("x1") >= 1.8 * F.col("med"))
    main = high > 0.7 * F.col("med")
    extent = lambda c: F.max(F.when(c, F.col("y2"))) - F.min(F.when(c, F.col("y1")))
    return b.groupBy("page_id", "block").agg(F.count("*").alias("n"), F.count_if(lettering).alias("lettering"), F.coalesce(extent(main), extent(F.lit(True))).alias("height"))


_STACK = f"greatest({_sql_side('y')}, least({_sql_side('x')}, greatest(a.y2 - a.y1, b.y2 - b.y1)))"
TEXT_BLOCKS = f"""WITH RECURSIVE {BOXES}, l AS (SELECT a.page_id, a.pos AS p, b.pos AS q FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND (a.pos = b.pos OR (abs(a.y1 + a.y2 - b.y1 - b.y2) <= 1.2 * {_sql_side('y')} AND greatest(a.x1 - b.x2, b.x1 - a.x2, 0.0) <= 0.9 * {_sql_side('y')})
    OR (greatest(a.x1 - b.x2, b.x1 - a.x2, 0.0) = 0 AND {_sql_over('x')} >= 0.5 * {_sql_side('x')} AND greatest(a.y1 - b.y2, b.y1 - a.y2, 0.0) <= 0.6 * {_STACK}))),
r AS (SELECT page_id, p, q FROM l UNION SELECT r.page_id, r.p, l.q FROM r JOIN l ON l.page_id = r.page_id AND l.p = r.q),
k AS (SELECT page_id, p, min(q) AS block FROM r GROUP BY ALL),
m AS (SELECT b.*, block, list_sort(list(y2 - y1) OVER (PARTITION BY b.page_id)) AS hs FROM boxes b JOIN k ON k.page_id = b.page_id AND k.p = b.pos),
h AS (SELECT *, hs[len(hs) // 2 + 1] AS med FROM m)
SELECT page_id, block, count(*) AS n, count(*) FILTER (y2 - y1 >= 1.5 * med AND x2 - x1 >= 1.8 * med) AS lettering, coalesce(max(y2) FILTER (y2 - y1 > 0.7 * med) - min(y1) FILTER (y2 - y1 > 0.7 * med), max(y2) - min(y1)) AS height FROM h GROUP BY 1, 2"""


def mask_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as regions of a mask: whether each may stand alone, and its best corroborating box, whose union it becomes."""
    b = boxes(spark, sf_dir)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    fill = F.col("pos") * 0.15
    eligible = (w >= 14) & (h >= 14) & (fill >= 0.02) & (fill <= 0.9) & (w * h <= 0.2 * PAGE_W * PAGE_H) & ((F.col("conf") >= 0.75) | (F.col("pos") % 2 == 0))
    a, o = b.alias("a"), b.alias("b")
    fits = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.pos") != F.col("b.pos")) & (F.col("b.conf") >= 0.2) & (R.area("b") <= 2.5 * R.area("a")) & (R.overlap("a", "b") >= 0.8 * R.area("a"))
    best = a.join(o, fits).groupBy(F.col("a.page_id").alias("page_id"), F.col("a.pos").alias("pos")).agg(F.max(F.struct(R.area("b").alias("s"), (-F.col("b.pos")).alias("p"), F.struct(*[F.col(f"b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]).alias("r")))["r"].alias("r"))
    pad = F.least(F.lit(4.0), F.floor(F.least(w, h) * 0.15 + 0.5))
    out = b.join(best, ["page_id", "pos"], "left")
    wide = [F.least(F.col("x1"), F.coalesce(F.col("r.x1") - pad, "x1")), F.least(F.col("y1"), F.coalesce(F.col("r.y1") - pad, "y1")), F.greatest(F.col("x2"), F.coalesce(F.col("r.x2") + pad, "x2")), F.greatest(F.col("y2"), F.coalesce(F.col("r.y2") + pad, "y2"))]
    return out.select("page_id", "pos", eligible.alias("eligible"), F.col("r").isNotNull().alias("extended"), *[c.alias(n) for c, n in zip(wide, ("x1", "y1", "x2", "y2"), strict=True)])


MASK_REGIONS = f"""WITH {BOXES}, m AS (SELECT a.page_id, a.pos, b.x1, b.y1, b.x2, b.y2 FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.pos <> b.pos AND b.conf >= 0.2 AND {R.SQL_AREA['b']} <= 2.5 * {R.SQL_AREA['a']} AND {R.SQL_OVERLAP} >= 0.8 * {R.SQL_AREA['a']}
    QUALIFY row_number() OVER (PARTITION BY a.page_id, a.pos ORDER BY {R.SQL_AREA['b']} DESC, b.pos) = 1),
p AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h, pos * 0.15::DOUBLE AS fill, least(4.0, floor(least(x2 - x1, y2 - y1) * 0.15 + 0.5)) AS pad FROM boxes)
SELECT p.page_id, p.pos, w >= 14 AND h >= 14 AND fill >= 0.02 AND fill <= 0.9 AND w * h <= {0.2 * PAGE_W * PAGE_H} AND (conf >= 0.75 OR p.pos % 2 = 0) AS eligible, m.pos IS NOT NULL AS extended,
    least(p.x1, coalesce(m.x1 - pad, p.x1)) AS x1, least(p.y1, coalesce(m.y1 - pad, p.y1)) AS y1, greatest(p.x2, coalesce(m.x2 + pad, p.x2)) AS x2, greatest(p.y2, coalesce(m.y2 + pad, p.y2)) AS y2 FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.pos = p.pos"""


def erase_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each box by the answers for its page: erased, kept, a repeat of another's text, or missed; and the plan's key."""
    b = boxes(spark, sf_dir).select("page_id", "pos", "x1", "y1", "x2", "y2")
    said = F.when(F.col("pos") % 5 == 4, F.lit(None)).when(F.col("pos") % 3 == 0, "keep").otherwise(F.concat(F.lit("t"), (F.col("pos") % 2).cast("string")))
    b = b.withColumn("said", said)
    earlier = F.row_number().over(Window.partitionBy("page_id", "said").orderBy("pos"))
    fate = F.when(F.col("said").isNull(), "missed").when(F.col("said") == "keep", "keep").when(earlier > 1, "dup").otherwise("erase")
    b = b.withColumn("fate", fate)
    rect = F.concat_ws(",", *[F.format_number(c, 0) for c in ("x1", "y1", "x2", "y2")])
    g = b.groupBy("page_id").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("fate") == f, F.struct("pos", rect.alias("r"))))), lambda x: x["r"]), ";").alias(f"{f}_key") for f in ("erase", "keep")], *[F.count_if(F.col("fate") == f).alias(f) for f in ("erase", "keep", "dup", "missed")])
    return g.select("page_id", "erase", "keep", "dup", "missed", F.md5(F.concat_ws("|", "erase_key", "keep_key")).alias("plan"))


ERASE_PLAN = f"""WITH {BOXES}, s AS (SELECT *, CASE WHEN pos % 5 = 4 THEN NULL WHEN pos % 3 = 0 THEN 'keep' ELSE 't' || (pos % 2) END AS said FROM boxes),
f AS (SELECT *, CASE WHEN said IS NULL THEN 'missed' WHEN said = 'keep' THEN 'keep' WHEN row_number() OVER (PARTITION BY page_id, said ORDER BY pos) > 1 THEN 'dup' ELSE 'erase' END AS fate, CAST(x1 AS BIGINT) || ',' || CAST(y1 AS BIGINT) || ',' || CAST(x2 AS BIGINT) || ',' || CAST(y2 AS BIGINT) AS r FROM s)
SELECT page_id, count(*) FILTER (fate = 'erase') AS erase, count(*) FILTER (fate = 'keep') AS keep, count(*) FILTER (fate = 'dup') AS dup, count(*) FILTER (fate = 'missed') AS missed,
    md5(coalesce(string_agg(r, ';' ORDER BY pos) FILTER (fate = 'erase'), '') || '|' || coalesce(string_agg(r, ';' ORDER BY pos) FILTER (fate = 'keep'), '')) AS plan FROM f GROUP BY 1"""

_LABEL_W, _LABEL_H = 30.0, 20.0
_RECT = "array<struct<pos:int,x1:double,y1:double,x2:double,y2:double>>"


def label_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the label of each box goes: the first place above, below, left or right that is inside the page and free of boxes and earlier labels."""
    b = boxes(spark, sf_dir)
    g = b.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x1", "y1", "x2", "y2"))).alias("b"))
    hits = lambda a, c: (a["x1"] < c["x2"]) & (c["x1"] < a["x2"]) & (a["y1"] < c["y2"]) & (c["y1"] < a["y2"])

    def spots(r: Column) -> Column:
        at = lambda x, y: F.struct(r["pos"].alias("pos"), x.alias("x1"), y.alias("y1"), (x + _LABEL_W).alias("x2"), (y + _LABEL_H).alias("y2"))
        return F.array(at(r["x1"], r["y1"] - _LABEL_H), at(r["x1"], r["y2"]), at(r["x1"] - _LABEL_W, r["y1"]), at(r["x2"], r["y1"]))

    def step(done: Column, r: Column) -> Column:
        free = F.filter(spots(r), lambda s: (s["x1"] >= 0) & (s["y1"] >= 0) & (s["x2"] <= PAGE_W) & (s["y2"] <= PAGE_H) & ~F.exists("b", lambda k: hits(k, s)) & ~F.exists(done, lambda k: hits(k, s)))
        return F.when(F.size(free) > 0, F.array_append(done, free[0])).otherwise(done)

    g = g.select("page_id", F.inline(F.aggregate("b", F.array().cast(_RECT), step)))
    return g.select("page_id", "pos", "x1", "y1")


_HIT = "{0}.x1 < s.x + 30.0 AND s.x < {0}.x2 AND {0}.y1 < s.y + 20.0 AND s.y < {0}.y2"
LABEL_PLACES = f"""WITH RECURSIVE {BOXES}, g AS (SELECT page_id, list({{'pos': pos, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY pos) AS b FROM boxes GROUP BY 1),
r AS (SELECT page_id, b, 0 AS i, CAST([] AS STRUCT(pos INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS done FROM g
    UNION ALL SELECT page_id, b, i + 1, list_concat(done, list_transform(list_filter([{{'x': b[i + 1].x1, 'y': b[i + 1].y1 - 20.0}}, {{'x': b[i + 1].x1, 'y': b[i + 1].y2}}, {{'x': b[i + 1].x1 - 30.0, 'y': b[i + 1].y1}}, {{'x': b[i + 1].x2, 'y': b[i + 1].y1}}],
        lambda s: s.x >= 0 AND s.y >= 0 AND s.x + 30.0 <= {PAGE_W} AND s.y + 20.0 <= {PAGE_H} AND len(list_filter(b, lambda k: {_HIT.format('k')})) = 0 AND len(list_filter(done, lambda k: {_HIT.format('k')})) = 0)[1:1],
        lambda s: {{'pos': b[i + 1].pos, 'x1': s.x, 'y1': s.y, 'x2': s.x + 30.0, 'y2': s.y + 20.0}})) FROM r WHERE i < len(b)),
d AS (SELECT page_id, unnest(done) AS s FROM r WHERE i = len(b))
SELECT page_id, s.pos AS pos, s.x1 AS x1, s.y1 AS y1 FROM d"""


def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsure boxes of each page that no sure one covers, the first few."""
    b = boxes(spark, sf_dir)
    sure, unsure = b.where("conf >= 0.8"), b.where("conf < 0.8")
    a, o = unsure.alias("a"), sure.alias("b")
    free = a.join(o, (F.col("a.page_id") == F.col("b.page_id")) & (R.iou("a", "b") > 0.1), "left_anti")
    return free.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where("k <= 2").select("page_id", "pos", "k")


NEAR_MISSES = f"""WITH {BOXES} SELECT page_id, pos, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INT) AS k FROM boxes a WHERE conf < 0.8 AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.page_id = a.page_id AND b.conf >= 0.8 AND {R.SQL_IOU} > 0.1)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 2"""

QUERIES = {f.__name__: f for f in (panel_rows, panel_order, corridors, families, text_blocks, mask_regions, erase_plan, label_places, near_misses)}
ORACLES = {
    "panel_rows": PANEL_ROWS, "panel_order": PANEL_ORDER, "corridors": CORRIDORS, "families": FAMILIES, "text_blocks": TEXT_BLOCKS, "mask_regions": MASK_REGIONS,
    "erase_plan": ERASE_PLAN, "label_places": LABEL_PLACES, "near_misses": NEAR_MISSES,
}
