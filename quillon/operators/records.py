"""Record rules: scopes, policies, rankings, overlays, counters and rosters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import hashes as H
from quillon.functions import policy as P
from quillon.functions import text as T
from quillon.functions import urls as U
from quillon.sources.tables import BOXES, boxes, table

# How chapter containers and trailing chapter segments are written.
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
CONTAINER = "(?i)^(.*)/(?:chapter|episode|ep|ch)/[^/]+/?$"
TAIL = f"(?i)^((?:/[^/]+){{2,}}?)(?:/(?:[0-9]+|{UUID}|(?:chapter|ch|episode|ep)[-_]?[0-9]+))+/?$"
# Path segments that navigate and never name a story.
NAV = "(?i)/(?:genre|genres|tag|tags|author|authors|artist|artists|group|groups|search|popular|latest|browse|category|categories)(?:/|$)"
CHAPTER_PARAMS = ("page", "p", "pg", "chapter", "ch", "ep", "episode", "vol", "volume")
NAV_LAST = "(?i)/(?:read|view|watch|list|page|pages)/?$"


def story_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The story that a page's path names: what stands before a chapter container, or without trailing chapter segments."""
    p = table(spark, sf_dir, "pages").select("page_id", U.part(F.col("url"), U.PATH).alias("path"), U.part(F.col("url"), U.SEARCH).alias("search"))
    inside = F.regexp_extract("path", CONTAINER, 1)
    stem = F.when(F.col("path").rlike(CONTAINER), inside).when(F.col("path").rlike(TAIL), F.regexp_extract("path", TAIL, 1)).otherwise(F.regexp_replace("path", "/$", ""))
    p = p.withColumn("stem", stem)
    named = (F.size(U.segments(F.col("stem"))) >= 2) & ~F.col("stem").rlike(NAV) & ~F.col("stem").rlike(NAV_LAST)
    left = F.filter(F.split(F.substring("search", 2, 1_000_000), "&"), lambda x: (x != "") & ~F.regexp_extract(x, "^([^=]*)", 1).isin(*CHAPTER_PARAMS))
    query = F.when(F.size(left) > 0, F.concat(F.lit("?"), F.array_join(left, "&"))).otherwise("")
    return p.select("page_id", F.when(named, F.concat("stem", query)).alias("story"))


STORY_PATH = f"""WITH {U.SQL_PARTS},
s AS (SELECT page_id, list_filter(string_split(substr(search, 2), '&'), lambda x: x <> '' AND regexp_extract(x, '^([^=]*)', 1) NOT IN {CHAPTER_PARAMS}) AS q, CASE WHEN regexp_matches(path, '{CONTAINER}') THEN regexp_extract(path, '{CONTAINER}', 1) WHEN regexp_matches(path, '{TAIL}') THEN regexp_extract(path, '{TAIL}', 1) ELSE regexp_replace(path, '/$', '') END AS stem FROM parts)
SELECT page_id, CASE WHEN len(list_filter(string_split(stem, '/'), lambda x: x <> '')) >= 2 AND NOT regexp_matches(stem, '{NAV}') AND NOT regexp_matches(stem, '{NAV_LAST}') THEN stem || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS story FROM s"""


def hotlink_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each scheme its first eight parent domains in order, as one pattern."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^(https?)://", 1).alias("scheme"), F.regexp_extract("url", r"^https?://(?:[^/?#]*\.)?([^./?#]+\.[^./?#]+)", 1).alias("domain")).distinct()
    first = p.withColumn("k", F.row_number().over(Window.partitionBy("scheme").orderBy("domain"))).where("k <= 8")
    return first.groupBy("scheme").agg(F.array_join(F.array_sort(F.collect_list("domain")), "|").alias("pattern"))


HOTLINK_HOSTS = r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://(?:[^/?#]*\.)?([^./?#]+\.[^./?#]+)', 1) AS domain FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY domain) AS k FROM p)
SELECT scheme, string_agg(domain, '|' ORDER BY domain) AS pattern FROM k WHERE k <= 8 GROUP BY scheme"""


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold a search text: those that begin with it first, else in their own order."""
    n = table(spark, sf_dir, "nation").where(F.lower("n_name").contains("n"))
    return n.select("n_name", F.when(F.lower("n_name").startswith("n"), 0).otherwise(1).alias("tier"), "n_nationkey").orderBy("tier", "n_nationkey").select("n_name", "tier")


RANKED_SEARCH = "SELECT n_name, CASE WHEN starts_with(lower(n_name), 'n') THEN 0 ELSE 1 END AS tier FROM nation WHERE contains(lower(n_name), 'n')"


def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before: whether they are equal but for white space, and the shared share of long words."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(order).alias("before"))

    def long_words(name: str):
        return F.array_distinct(F.filter(F.split(T.normalized(F.col(name)), " "), lambda w: F.length(w) > 2))

    c = c.where("before IS NOT NULL AND text IS NOT NULL").withColumn("a", long_words("text")).withColumn("b", long_words("before"))
    least = F.least(F.size("a"), F.size("b"))
    share = F.when(least > 0, F.size(F.array_intersect("a", "b")) / least).otherwise(0.0)

    def flat(name: str):
        return F.trim(F.regexp_replace(F.col(name), r"\s+", " "))

    return c.select("conv_id", "turn", (flat("text") == flat("before")).alias("equal"), (F.floor(share * 1000000 + 0.5) / 1000000).alias("share"), (share >= 0.5).alias("similar"))


_LONG = "list_distinct(list_filter(string_split({}, ' '), lambda w: length(w) > 2))"
TURN_SIMILARITY = rf"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
d AS (SELECT *, {_LONG.format(T.SQL_NORMALIZED)} AS a, {_LONG.format(T.SQL_NORMALIZED.replace('lower(text)', 'lower(before)'))} AS b FROM c WHERE before IS NOT NULL AND text IS NOT NULL),
s AS (SELECT *, CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0.0 END AS s FROM d)
SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) = trim(regexp_replace(before, '\s+', ' ', 'g')) AS equal, floor(s * 1000000 + 0.5) / 1000000 AS share, s >= 0.5 AS similar FROM s"""


def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds to wait after each error: its header as seconds, or as a date against the event's time, from 1 to 300 s; 45 s without one."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    stated = F.date_format((F.floor(at / 1_000_000) + F.floor("value") * 5).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    header = F.when(F.col("event_id") % 3 == 0, stated).when(F.col("event_id") % 3 == 1, F.col("value").cast("string")).otherwise("soon")
    e = e.select("event_id", at.alias("at"), header.alias("header"))
    by_date = F.unix_micros(F.try_to_timestamp("header", F.lit("yyyy-MM-dd'T'HH:mm:ss"))) / 1000 - F.col("at") / 1000
    ms = F.coalesce(F.col("header").try_cast("double") * 1000, by_date, F.lit(45_000.0))
    return e.select("event_id", F.floor(F.least(F.greatest(ms, F.lit(1000.0)), F.lit(300_000.0))).alias("wait_ms"))


RETRY_AFTER = """WITH e AS (SELECT event_id, epoch_us(ts) AS at_, value FROM events WHERE event_type = 'error')
SELECT event_id, CAST(floor(least(greatest(CASE event_id % 3 WHEN 0 THEN (at_ // 1000000 + floor(value) * 5) * 1000 - at_ / 1000 WHEN 1 THEN value * 1000 ELSE 45000 END, 1000), 300000)) AS BIGINT) AS wait_ms FROM e"""


def settings_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored settings over defaults: values of a wrong kind give way, numbers are clamped, and a fingerprint of what shapes output."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    e = table(spark, sf_dir, "events").select("event_id", F.least(F.greatest(F.coalesce(k, F.lit(10)), F.lit(5)), F.lit(60)).alias("size"), F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise("view").alias("mode"))
    return e.select("event_id", "size", "mode", F.md5(F.concat(F.lit("["), F.col("size").cast("string"), F.lit(',"'), "mode", F.lit('"]'))).alias("fingerprint"))


SETTINGS_OVERLAY = """WITH s AS (SELECT event_id, least(greatest(coalesce(TRY_CAST(props ->> '$.k' AS BIGINT), 10), 5), 60) AS size, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'view' END AS mode FROM events)
SELECT event_id, size, mode, md5('[' || size || ',"' || mode || '"]') AS fingerprint FROM s"""


def ensure_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id get the next ones after the largest, in order, in each book of twenty neighbours."""
    c = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 20).alias("book"), "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("id"))
    n = F.row_number().over(Window.partitionBy("book", F.col("id").isNull()).orderBy("c_custkey"))
    return c.select("book", "c_custkey", F.coalesce("id", F.coalesce(F.max("id").over(Window.partitionBy("book")), F.lit(0)) + n).alias("id"))


ENSURE_IDS = """WITH c AS (SELECT c_custkey // 20 AS book, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS id FROM customer)
SELECT book, c_custkey, coalesce(id, coalesce(max(id) OVER (PARTITION BY book), 0) + row_number() OVER (PARTITION BY book, id IS NULL ORDER BY c_custkey)) AS id FROM c"""


def pick_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events the one of the best kind, then of the largest value; the first wins ties."""
    kinds = F.array(*[F.lit(x) for x in ("error", "purchase", "signup", "click", "view")])
    e = table(spark, sf_dir, "events").withColumn("rank", F.array_position(kinds, F.col("event_type")))
    return e.groupBy("user_id").agg(F.min_by("event_id", F.struct("rank", -F.col("value"), "event_id")).alias("event_id"), F.min("rank").alias("rank"))


PICK_ACTIVITY = """WITH e AS (SELECT *, CAST(list_position(['error', 'purchase', 'signup', 'click', 'view'], event_type) AS BIGINT) AS rank FROM events)
SELECT user_id, event_id, rank FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank, value DESC, event_id) = 1"""


def phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders done, failed and under way by priority."""
    status = F.col("o_orderstatus")
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority")
    return o.agg(F.count_if(status == "F").alias("done"), F.count_if(status == "P").alias("failed"), F.count_if(status == "O").alias("inflight"), F.count("*").alias("total"))


PHASE_COUNTS = "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS inflight, count(*) AS total FROM orders GROUP BY 1"


def line_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of a page's smaller sides, and that of their lower half."""
    minor = F.array_sort(F.collect_list(F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))))
    b = boxes(spark, sf_dir).groupBy("page_id").agg(minor.alias("d"))
    half = F.greatest(F.lit(1), F.floor(F.size("d") / 2)).cast("int")
    return b.select("page_id", F.element_at("d", (F.floor(F.size("d") / 2) + 1).cast("int")).alias("median"), F.element_at("d", (F.floor(half / 2) + 1).cast("int")).alias("unit"))


LINE_UNIT = f"""WITH {BOXES}, d AS (SELECT page_id, list_sort(list(least(x2 - x1, y2 - y1))) AS d FROM boxes GROUP BY page_id)
SELECT page_id, d[len(d) // 2 + 1] AS median, d[greatest(1, len(d) // 2) // 2 + 1] AS unit FROM d"""


#: What a page of boxes measures.
PAGE_W, PAGE_H = 800.0, 700.0
_SMALL, _NEAR = 0.005 * PAGE_W * PAGE_H, 0.05 * math.hypot(PAGE_W, PAGE_H)


def split_deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small boxes that have another small one near by, edge to edge, which are read last."""
    small = boxes(spark, sf_dir).where((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) < _SMALL)
    a, o = small.alias("a"), small.alias("o")
    gap = [F.greatest(F.lit(0.0), F.col(f"a.{n}1") - F.col(f"o.{n}2"), F.col(f"o.{n}1") - F.col(f"a.{n}2")) for n in "xy"]
    near = F.sqrt(gap[0] * gap[0] + gap[1] * gap[1]) < _NEAR
    return a.join(o, (F.col("a.page_id") == F.col("o.page_id")) & (F.col("a.pos") != F.col("o.pos")) & near, "left_semi").select("page_id", "pos")


SPLIT_DEFERRED = f"""WITH {BOXES}, s AS (SELECT * FROM boxes WHERE (x2 - x1) * (y2 - y1) < {_SMALL})
SELECT page_id, pos FROM s a WHERE EXISTS (SELECT 1 FROM s o WHERE o.page_id = a.page_id AND o.pos <> a.pos
    AND sqrt(power(greatest(0.0, a.x1 - o.x2, o.x1 - a.x2), 2) + power(greatest(0.0, a.y1 - o.y2, o.y1 - a.y2), 2)) < {_NEAR})"""

_SEAM_H = 300
_BAND = max(24, math.floor(0.06 * _SEAM_H + 0.5))


def seam_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which a low box continues in a high box of the next page: near the cut by 6 % of the height, 40 units and 40 % of overlap across."""
    b = boxes(spark, sf_dir)
    low = b.where(F.lit(_SEAM_H) - F.col("y2") <= _BAND).select("page_id", F.col("x1").alias("ax1"), F.col("x2").alias("ax2"))
    high = b.where(F.col("y1") <= _BAND).select((F.col("page_id") - 1).alias("page_id"), F.col("x1").alias("bx1"), F.col("x2").alias("bx2"))
    across = F.least("ax2", "bx2") - F.greatest("ax1", "bx1")
    narrow = F.least(F.col("ax2") - F.col("ax1"), F.col("bx2") - F.col("bx1"))
    return low.join(high, "page_id").where((across >= 40) & (across >= 0.4 * narrow)).groupBy("page_id").agg(F.count("*").alias("n_links"))


SEAM_LINKED = f"""WITH {BOXES}
SELECT a.page_id, count(*) AS n_links FROM boxes a JOIN boxes b ON b.page_id = a.page_id + 1 AND {_SEAM_H} - a.y2 <= {_BAND} AND b.y1 <= {_BAND}
    AND least(a.x2, b.x2) - greatest(a.x1, b.x1) >= 40 AND least(a.x2, b.x2) - greatest(a.x1, b.x1) >= 0.4 * least(a.x2 - a.x1, b.x2 - b.x1) GROUP BY 1"""

#: How far a box's area reaches beyond it, and the share of the smaller area that two must share to be divided.
_REACH, _SHARED = 30.0, 0.05


def divider_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of boxes whose areas overlap while the boxes are apart: the mid-line between them, across if they are apart so, else down."""
    b = boxes(spark, sf_dir)
    a, o, c = b.alias("a"), b.alias("o"), F.col
    shared = [F.least(c(f"a.{n}2"), c(f"o.{n}2")) - F.greatest(c(f"a.{n}1"), c(f"o.{n}1")) + 2 * _REACH for n in "xy"]
    area = lambda s: (c(f"{s}.x2") - c(f"{s}.x1") + 2 * _REACH) * (c(f"{s}.y2") - c(f"{s}.y1") + 2 * _REACH)
    across, down = ((c(f"a.{n}2") <= c(f"o.{n}1")) | (c(f"o.{n}2") <= c(f"a.{n}1")) for n in "xy")
    met = (c("a.page_id") == c("o.page_id")) & (c("a.pos") != c("o.pos")) & (shared[0] > 0) & (shared[1] > 0)
    p = a.join(o, met & (shared[0] * shared[1] > F.least(area("a"), area("o")) * _SHARED) & (across | down))

    def limits(n: str, when: Column) -> list[Column]:
        before = c(f"a.{n}2") <= c(f"o.{n}1")
        mid = F.when(before, (c(f"a.{n}2") + c(f"o.{n}1")) / 2).otherwise((c(f"o.{n}2") + c(f"a.{n}1")) / 2)
        return [F.max(F.when(when & ~before, mid)).alias(f"{n}_from"), F.min(F.when(when & before, mid)).alias(f"{n}_to")]

    return p.groupBy(c("a.page_id").alias("page_id"), c("a.pos").alias("pos")).agg(*limits("x", across), *limits("y", ~across & down))


def _sql_limits(n: str, when: str) -> str:
    low, high = f"max(CASE WHEN {when} AND o.{n}2 <= a.{n}1 AND NOT a.{n}2 <= o.{n}1 THEN (o.{n}2 + a.{n}1) / 2 END) AS {n}_from", f"min(CASE WHEN {when} AND a.{n}2 <= o.{n}1 THEN (a.{n}2 + o.{n}1) / 2 END) AS {n}_to"
    return f"{low}, {high}"


_ACROSS, _DOWN = ("(a.{0}2 <= o.{0}1 OR o.{0}2 <= a.{0}1)".format(n) for n in "xy")
_OVER = "(least(a.{0}2, o.{0}2) - greatest(a.{0}1, o.{0}1) + {1})"
DIVIDER_CLIPS = f"""WITH {BOXES}
SELECT a.page_id, a.pos, {_sql_limits('x', _ACROSS)}, {_sql_limits('y', f'NOT {_ACROSS} AND {_DOWN}')}
FROM boxes a JOIN boxes o ON a.page_id = o.page_id AND a.pos <> o.pos AND {_OVER.format('x', 2 * _REACH)} > 0 AND {_OVER.format('y', 2 * _REACH)} > 0 AND ({_ACROSS} OR {_DOWN})
    AND {_OVER.format('x', 2 * _REACH)} * {_OVER.format('y', 2 * _REACH)} > {_SHARED} * least((a.x2 - a.x1 + {2 * _REACH}) * (a.y2 - a.y1 + {2 * _REACH}), (o.x2 - o.x1 + {2 * _REACH}) * (o.y2 - o.y1 + {2 * _REACH})) GROUP BY ALL"""


def run_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log's newest three runs (hours) of each user, and of each the last five events."""
    e = table(spark, sf_dir, "events").withColumn("run", F.date_trunc("hour", F.col("ts")))
    runs = e.select("user_id", "run").distinct().withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("run")))).where("k <= 3")
    kept = e.join(runs, ["user_id", "run"]).withColumn("n", F.row_number().over(Window.partitionBy("user_id", "run").orderBy(F.desc("ts"), F.desc("event_id"))))
    return kept.where("n <= 5").select("user_id", "event_id", F.col("k").alias("run_rank"), F.col("n").alias("age_rank"))


RUN_RETENTION = """WITH e AS (SELECT *, date_trunc('hour', ts) AS run FROM events),
r AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY run DESC) AS INT) AS run_rank, CAST(row_number() OVER (PARTITION BY user_id, run ORDER BY ts DESC, event_id DESC) AS INT) AS age_rank FROM e)
SELECT user_id, event_id, run_rank, age_rank FROM r WHERE run_rank <= 3 AND age_rank <= 5"""


def earliest_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest time of each key, for the newest forty keys of each user."""
    e = table(spark, sf_dir, "events").withColumn("key", F.get_json_object("props", "$.k").try_cast("bigint")).groupBy("user_id", "key").agg(F.min("ts").alias("t0"))
    newest = Window.partitionBy("user_id").orderBy(F.desc("t0"), "key")
    return e.withColumn("k", F.row_number().over(newest)).where("k <= 40").select("user_id", "key", "t0")


EARLIEST_MARKS = """SELECT user_id, key, t0 FROM (SELECT user_id, TRY_CAST(props ->> '$.k' AS BIGINT) AS key, min(ts) AS t0 FROM events GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t0 DESC, key) <= 40"""

def remaining_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns from its first answer on; without one none, never the head."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    anchor = F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return c.withColumn("anchor", anchor).where("turn >= anchor").select("conv_id", "turn")


REMAINING_PAGES = """SELECT conv_id, turn FROM conversations QUALIFY turn >= min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id)"""


def take_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order the lines that can be committed: the run of numbers from 1 on without a gap."""
    n = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return n.withColumn("k", k).where("l_linenumber = k").groupBy("l_orderkey").agg(F.count("*").alias("n_ready"))


TAKE_ORDERED = """WITH n AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM n)
SELECT l_orderkey, count(*) AS n_ready FROM k WHERE l_linenumber = k GROUP BY 1"""


def count_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct logical pages of each user's store among whole rows of the current epoch: signups are of an older one, small events partial."""
    e = table(spark, sf_dir, "events").where("event_type <> 'signup' AND value >= 15")
    return e.groupBy("user_id").agg(F.count_distinct(F.get_json_object("props", "$.k")).alias("n_pages"))


COUNT_PAGES = "SELECT user_id, count(DISTINCT props ->> '$.k') AS n_pages FROM events WHERE event_type <> 'signup' AND value >= 15 GROUP BY 1"


def pick_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed orders that may be tried again and weren't yet."""
    o, tried = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.where("o_orderstatus = 'P' AND o_orderpriority <> '5-LOW'").join(tried, "o_orderkey", "left_anti").select("o_custkey", "o_orderkey")


PICK_RETRY = "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"


def gender_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text to M, F or ?; the word "male" is looked for first, so "female" is M, as it always was."""
    c = table(spark, sf_dir, "customer")
    free = F.when(F.col("c_custkey") % 6 == 0, "Female").when(F.col("c_custkey") % 6 == 1, "f").when(F.col("c_custkey") % 6 == 2, "M").when(F.col("c_custkey") % 6 == 3, "ผู้หญิง").when(F.col("c_custkey") % 6 == 4, "เด็กชาย").otherwise(F.col("c_mktsegment"))
    c = c.select("c_custkey", F.lower(free).alias("g"))
    g = F.col("g")
    return c.select("c_custkey", F.when((g == "m") | g.rlike("male|ชาย|ผู้ชาย"), "M").when((g == "f") | g.rlike("female|หญิง|ผู้หญิง"), "F").otherwise("?").alias("gender"))


GENDER_WORDS = """WITH c AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'female' WHEN 1 THEN 'f' WHEN 2 THEN 'm' WHEN 3 THEN 'ผู้หญิง' WHEN 4 THEN 'เด็กชาย' ELSE lower(c_mktsegment) END AS g FROM customer)
SELECT c_custkey, CASE WHEN g = 'm' OR regexp_matches(g, 'male|ชาย|ผู้ชาย') THEN 'M' WHEN g = 'f' OR regexp_matches(g, 'female|หญิง|ผู้หญิง') THEN 'F' ELSE '?' END AS gender FROM c"""

def byte_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short hash of each page's address."""
    p = table(spark, sf_dir, "pages").select("page_id", F.transform(F.split("url", ""), lambda c: F.ascii(c)).alias("codes"))
    return H.with_hash(p, "codes", "text_hash").select("page_id", "text_hash")


BYTE_HASH = H.sql_hash("pages", "list_transform(string_split(url, ''), lambda c: CAST(ascii(c) AS BIGINT))", "page_id")


def signature_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population deviation of each vector's values, and whether it is too flat to be told apart."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    v = v.withColumn("m", mean)
    var = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("m")) * (x - F.col("m"))) / F.size("v")
    return v.select("vec_id", F.round(F.sqrt(var), 6).alias("contrast"), F.forall("v", lambda x: F.abs(x - F.col("v")[0]) <= 0.2).alias("uniform"))


SIGNATURE_CONTRAST = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
m AS (SELECT vec_id, v, list_reduce(v, lambda s, x: s + x, 0.0::DOUBLE) / len(v) AS m FROM v)
SELECT vec_id, round(sqrt(list_reduce(list_transform(v, lambda x: (x - m) * (x - m)), lambda s, x: s + x, 0.0::DOUBLE) / len(v)), 6) AS contrast, len(list_filter(v, lambda x: abs(x - v[1]) > 0.2)) = 0 AS uniform FROM m"""

def fetch_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fetches each rule blocks, of addresses made from events, asked for by a page on 10.1.1.5."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0))
    scheme = F.when(F.col("event_id") % 9 == 0, "ftp").otherwise("http")
    url = F.concat(scheme, F.lit("://"), (F.col("user_id") + k).cast("string"), F.lit("."), (k * 2).cast("string"), F.lit(".1.5:8080/x"))
    e = P.with_verdict(table(spark, sf_dir, "events").select(url.alias("url"), F.lit("https://10.1.1.5/reader").alias("sender")), "url", "sender")
    return e.groupBy(F.coalesce("verdict", F.lit("allowed")).alias("verdict")).agg(F.count("*").alias("n"))


FETCH_POLICY = """WITH k AS (SELECT event_id % 9 = 0 AS ftp, user_id + coalesce(TRY_CAST(props ->> '$.k' AS BIGINT), 0) AS a, 2 * coalesce(TRY_CAST(props ->> '$.k' AS BIGINT), 0) AS b FROM events)
SELECT CASE WHEN ftp THEN 'scheme' WHEN (a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)) AND NOT (a = 10 AND b = 1) THEN 'local network' ELSE 'allowed' END AS verdict,
    count(*) AS n FROM k GROUP BY 1"""


def new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links not on the first page, each where it occurs first."""
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    known = p.where("page_id = 0").select("href").distinct()
    first = p.join(known, "href", "left_anti").groupBy("href").agg(F.min(F.struct("page_id", "pos")).alias("at"))
    return first.select("href", F.col("at.page_id").alias("page_id"), F.col("at.pos").alias("pos"))


NEW_LINKS = """WITH h AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages),
p AS (SELECT page_id, i - 1 AS pos, l[i] AS href FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM h))
SELECT href, arg_min(page_id, ROW(page_id, pos)) AS page_id, CAST(arg_min(pos, ROW(page_id, pos)) AS INT) AS pos FROM p WHERE href NOT IN (SELECT href FROM p WHERE page_id = 0) GROUP BY href"""

_F = [story_path, hotlink_hosts, ranked_search, turn_similarity, retry_after, settings_overlay, ensure_ids, pick_activity, phase_counts, line_unit, split_deferred, seam_linked, divider_clips, run_retention, earliest_marks, remaining_pages, take_ordered, count_pages, pick_retry, gender_words, byte_hash, signature_contrast, fetch_policy, new_links]
QUERIES = {f.__name__: f for f in _F}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _F}
