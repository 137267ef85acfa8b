"""What is known of pages and books from marks, links, extras, plans, masks, profiles and verified matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import cached as K
from quillon.functions import folds
from quillon.functions import manifests as M
from quillon.functions import urls as U
from quillon.operators.images import PICTURES, _pictures
from quillon.operators.manifests import CHAPTERS, _chapters
from quillon.sources.tables import BOXES, boxes, table

#: Milliseconds for which a mark is fresh, and the time it is looked at.
FRESH_MS, NOW_MS = 15 * 60_000, 1_000_000


def warming_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks left by readers: key and time of those that are whole, and whether they are fresh."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))
    ts = (NOW_MS - (k - 20) * 20_000).cast("string")
    raw = F.when(F.col("event_id") % 5 == 0, "{broken").when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"key":7,"ts":'), ts, F.lit("}"))).when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"key":"k","ts":"'), ts, F.lit('"}'))).otherwise(F.concat(F.lit('{"key":"p'), k.cast("string"), F.lit('","ts":'), ts, F.lit("}")))
    e = e.select("event_id", raw.alias("raw"))
    sound = F.col("raw").rlike(r'"key"\s*:\s*"') & F.col("raw").rlike(r'"ts"\s*:\s*-?[0-9]')
    e = e.where(sound).select("event_id", F.get_json_object("raw", "$.key").alias("key"), F.get_json_object("raw", "$.ts").try_cast("bigint").alias("ts"))
    return e.where("key IS NOT NULL").select("*", ((F.lit(NOW_MS) - F.col("ts") >= 0) & (F.lit(NOW_MS) - F.col("ts") < FRESH_MS)).alias("fresh"))


WARMING_MARKS = f"""WITH k AS (SELECT event_id, coalesce(TRY_CAST(props ->> '$.k' AS INT), 0) AS k FROM events), m AS (SELECT event_id, 'p' || k AS key, CAST({NOW_MS} - (k - 20) * 20000 AS BIGINT) AS ts FROM k WHERE event_id % 5 > 2)
SELECT event_id, key, ts, {NOW_MS} - ts >= 0 AND {NOW_MS} - ts < {FRESH_MS} AS fresh FROM m"""


def next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that each page declares as its next one, if it is another one of the same chapter."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"))
    rel = F.when(F.col("page_id") % 3 == 0, "prev next").when(F.col("page_id") % 3 == 1, "nextish").otherwise("next")
    href = F.when(F.col("page_id") % 2 == 0, F.concat(U.part(F.col("url"), U.PATH), F.lit("?page=2"))).otherwise("/elsewhere/1")
    html = F.concat(F.lit('<p><a href="/x">x</a><a class="n" rel="'), rel, F.lit('" href="'), href, F.lit('">on</a>'))
    tag = F.try_element_at(F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<(?:a|link)\s[^>]*>"), F.lit(0)), lambda t: t.rlike(r'(?i)\srel="(?:[^"]*\s)?next(?:\s[^"]*)?"')), F.lit(1))
    p = p.withColumn("next", M.resolved(F.regexp_extract(tag, r'(?i)\shref="([^"]*)"', 1), F.col("url")))
    key = lambda c: U.chapter_key(*(U.part(F.col(c), x) for x in (U.ORIGIN, U.PATH, U.SEARCH, U.HASH)))
    same = (F.col("next") != F.col("url")) & (U.part(F.col("next"), U.ORIGIN) == U.part(F.col("url"), U.ORIGIN)) & (key("next") == key("url"))
    return p.select("page_id", F.when(same, F.col("next")).alias("next"))


NEXT_LINKS = """SELECT page_id, CASE WHEN page_id % 3 <> 1 AND page_id % 2 = 0 THEN regexp_replace(url, '[?#].*$', '') || '?page=2' END AS next FROM pages"""


def scaled_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra regions that lie wholly in the content of an annotated picture, in the source's pixels; thresholds in bounds, else their defaults."""
    b = boxes(spark, sf_dir)
    inside = (F.col("x1") >= 40) & (F.col("y1") >= 30) & (F.col("x2") <= 340) & (F.col("y2") <= 280) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    to = lambda c, off, size, whole: F.round((F.col(c) - off) * whole / size, 6).alias(c)
    limit = F.when((F.col("conf") >= 0.05) & (F.col("conf") <= 0.9), F.col("conf")).otherwise(0.25)
    return b.where(inside).select("page_id", "pos", to("x1", 40, 300, 1200), to("y1", 30, 250, 1000), to("x2", 40, 300, 1200), to("y2", 30, 250, 1000), limit.alias("threshold"))


SCALED_EXTRAS = f"""WITH {BOXES} SELECT page_id, pos, round((x1 - 40) * 1200 / 300, 6) AS x1, round((y1 - 30) * 1000 / 250, 6) AS y1, round((x2 - 40) * 1200 / 300, 6) AS x2, round((y2 - 30) * 1000 / 250, 6) AS y2,
    CASE WHEN conf BETWEEN 0.05 AND 0.9 THEN conf ELSE 0.25 END AS threshold FROM boxes WHERE x1 >= 40 AND y1 >= 30 AND x2 <= 340 AND y2 <= 280 AND x2 > x1 AND y2 > y1"""


def same_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order as a checkpoint against the line before it: whether their plans are the same, and what a record takes."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("fp"))
    plan = F.to_json(F.struct(F.array(F.col("p") % 2, F.col("s") % 2).alias("boxes"), F.col("fp").alias("outputs")))
    mask = F.array_repeat(F.col("s") % 2, 4)
    order = Window.partitionBy("o").orderBy("n", "p", "s", "fp")
    p = p.select("*", plan.alias("plan"), mask.alias("mask"))
    same = (F.col("plan") == F.lag("plan").over(order)) & (F.col("mask") == F.lag("mask").over(order))
    size = K.entry_bytes([2 * F.length("plan"), 8 * F.size("mask"), F.lit(8)])
    return p.select("o", "n", "p", "s", F.coalesce(same, F.lit(False)).alias("same"), size.alias("bytes"), F.get_json_object("plan", "$.boxes[0]").cast("bigint").alias("first_box"))


SAME_PLANS = """WITH p AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_returnflag AS fp FROM lineitem)
SELECT o, n, p, s, coalesce(p % 2 = lag(p % 2) OVER w AND s % 2 = lag(s % 2) OVER w AND fp = lag(fp) OVER w, false) AS same, CAST(2 * length('{"boxes":[' || (p % 2) || ',' || (s % 2) || '],"outputs":"' || fp || '"}') + 40 AS INT) AS bytes, p % 2 AS first_box
FROM p WINDOW w AS (PARTITION BY o ORDER BY n, p, s, fp)"""


def mask_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected parts of each picture's ink, four neighbours a place: how many have four places or more, and the size of the largest."""
    p = _pictures(spark, sf_dir).select("vec_id", F.transform("v", lambda x: x > 140).alias("ink"))
    beside = F.filter(F.sequence(F.lit(1), F.lit(64)), lambda i: (i % 8 != 0) & F.element_at("ink", i) & F.element_at("ink", F.least(i + 1, F.lit(64))))
    below = F.filter(F.sequence(F.lit(1), F.lit(56)), lambda i: F.element_at("ink", i) & F.element_at("ink", i + 8))
    edges = F.concat(F.transform(beside, lambda i: F.struct(i.alias("a"), (i + 1).alias("b"))), F.transform(below, lambda i: F.struct(i.alias("a"), (i + 8).alias("b"))))
    p = p.withColumn("label", folds.labels(F.lit(64), edges))
    inked = F.filter("label", lambda x, i: F.get("ink", i))
    sizes = F.transform(F.array_distinct(inked), lambda k: F.size(F.filter(inked, lambda x: x == k)))
    return p.select("vec_id", F.size(F.filter(sizes, lambda n: n >= 4)).alias("n_parts"), F.coalesce(F.array_max(sizes), F.lit(0)).alias("largest"))


MASK_PARTS = f"""WITH RECURSIVE {PICTURES}, e AS (SELECT vec_id, unnest(v) > 140 AS ink, unnest(range(0, 64)) AS i FROM pictures), c AS (SELECT vec_id, i FROM e WHERE ink),
r AS (SELECT vec_id, i, i AS j FROM c UNION SELECT r.vec_id, r.i, c.i FROM r JOIN c ON c.vec_id = r.vec_id AND ((abs(c.i - r.j) = 8) OR (abs(c.i - r.j) = 1 AND c.i // 8 = r.j // 8))),
l AS (SELECT vec_id, i, min(j) AS k FROM r GROUP BY 1, 2), s AS (SELECT vec_id, k, count(*) AS n FROM l GROUP BY 1, 2)
SELECT p.vec_id, CAST(count(*) FILTER (n >= 4) AS INT) AS n_parts, CAST(coalesce(max(n), 0) AS INT) AS largest FROM pictures p LEFT JOIN s ON s.vec_id = p.vec_id GROUP BY 1"""

#: Smallest type, and a line's height against its letters'.
LEAST_TYPE, LINE = 3.0, 1.25


def line_pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text in each picture's profile, a value a row: how far apart they are, how high their letters, and the type that fits them."""
    p = _pictures(spark, sf_dir).select("vec_id", F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("v", i) > 128).alias("rows"))
    band = "struct<first:int,last:int>"
    grow = lambda acc, r: F.when((F.size(acc) > 0) & (r - F.try_element_at(acc, F.lit(-1))["last"] <= 1), F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), r.alias("last")).cast(band))).otherwise(F.array_append(acc, F.struct(r.alias("first"), r.alias("last")).cast(band)))
    p = p.withColumn("bands", F.aggregate("rows", F.array().cast(f"array<{band}>"), grow)).where((F.size("bands") > 0) & (F.size("bands") <= 16))
    p = p.withColumn("span", F.try_element_at("bands", F.lit(-1))["last"] - F.get("bands", 0)["first"] + 1).withColumn("heights", F.array_sort(F.transform("bands", lambda b: b["last"] - b["first"] + 1)))
    top = F.array_max("heights")
    main = F.when(top < 0.5 * F.col("span"), F.filter("heights", lambda h: h >= top / 3)).otherwise(F.col("heights"))
    glyph = F.get(main, F.floor(F.size(main) / 2).cast("int"))
    pitch = F.col("span") / F.size("bands")
    return p.select("vec_id", F.round(pitch, 6).alias("pitch"), glyph.alias("glyph"), F.greatest(F.lit(LEAST_TYPE), F.floor(F.greatest(glyph.cast("double"), pitch / LINE) + 0.5)).alias("type"))


LINE_PITCHES = f"""WITH {PICTURES}, e AS (SELECT vec_id, unnest(v) > 128 AS ink, unnest(range(0, 64)) AS i FROM pictures),
g AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM e WHERE ink),
b AS (SELECT vec_id, g, min(i) AS a, max(i) AS z FROM g GROUP BY 1, 2),
h AS (SELECT vec_id, count(*) AS n, max(z) - min(a) + 1 AS span, list_sort(list(z - a + 1)) AS hs FROM b GROUP BY 1 HAVING count(*) <= 16),
m AS (SELECT *, CASE WHEN hs[-1] < 0.5 * span THEN list_filter(hs, lambda x: x >= hs[-1] / 3) ELSE hs END AS main FROM h)
SELECT vec_id, round(span / n, 6) AS pitch, CAST(main[len(main) // 2 + 1] AS INT) AS glyph, greatest({LEAST_TYPE}, floor(greatest(CAST(main[len(main) // 2 + 1] AS DOUBLE), span / n / {LINE}) + 0.5)) AS type FROM m"""


def book_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that are shown: the open one, stored ones, and session ones that no stored book of the same site or of the same rows stands for."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("h"), (F.col("c_custkey") % 40).cast("string")).alias("host"), (F.col("c_custkey") % 13).alias("rows"))
    tier = F.when(F.col("k") % 9 == 0, 0).when(F.col("k") % 2 == 0, 1).otherwise(2)
    c = c.select("*", tier.alias("tier"), F.concat(F.when(F.col("k") % 2 == 0, "book:").otherwise("session:"), "host", F.lit("/"), (F.col("k") % 80).cast("string")).alias("scope")).where("rows > 0")
    stored = c.where("scope LIKE 'book:%'").select("host", "rows")
    free = c.join(stored.select("host").distinct(), "host", "left_anti").join(stored.select("rows").distinct(), "rows", "left_anti")
    shown = c.where("tier < 2").select("scope", "tier", "k", "rows").unionByName(free.where("tier = 2").select("scope", "tier", "k", "rows"))
    return shown.groupBy("scope").agg(F.min(F.struct("tier", "k")).alias("m")).select("scope", F.col("m.tier").alias("tier"), F.col("m.k").alias("k"))


BOOK_SECTIONS = """WITH c AS (SELECT c_custkey AS k, 'h' || (c_custkey % 40) AS host, c_custkey % 13 AS rows_, CASE WHEN c_custkey % 9 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS tier,
    CASE WHEN c_custkey % 2 = 0 THEN 'book:' ELSE 'session:' END || 'h' || (c_custkey % 40) || '/' || (c_custkey % 80) AS scope FROM customer WHERE c_custkey % 13 > 0),
s AS (SELECT * FROM c WHERE tier < 2 OR (host NOT IN (SELECT host FROM c WHERE starts_with(scope, 'book:')) AND rows_ NOT IN (SELECT rows_ FROM c WHERE starts_with(scope, 'book:'))))
SELECT scope, CAST(min(tier) AS INT) AS tier, arg_min(k, ROW(tier, k)) AS k FROM s GROUP BY 1"""


def verified_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each chapter's page is by its content: at the hinted place if that matches, else at the only match, else unknown; by its address
    before that, and by its twin's."""
    c = _chapters(spark, sf_dir)
    n, o = F.size("names"), F.col("o")
    same = lambda i: (F.get("names", i) == F.element_at("names", -1)) & (i % 2 == o % 2)
    hint = (o % 7).cast("int")
    matches = F.filter(F.sequence(F.lit(0), n - 1), same)
    by_content = F.when(F.array_contains(matches, hint), hint).when(F.size(matches) == 1, matches[0]).otherwise(-1)
    by_url = F.when(o % 4 == 0, F.array_position("names", F.lit("p3.jpg")).cast("int") - 1).otherwise(-1)
    known = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("names", i).startswith("x/")))
    highest = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("names", i).startswith("x/"))), F.lit(-1))
    return c.select("o", F.when(by_url >= 0, by_url).otherwise(by_content).alias("place"), known.alias("known"), highest.alias("highest"))


VERIFIED_PLACES = f"""WITH {CHAPTERS}, m AS (SELECT o, names, list_filter(range(0, len(names)), lambda i: names[i + 1] = names[-1] AND i % 2 = o % 2) AS m, CASE WHEN o % 4 = 0 THEN coalesce(list_position(names, 'p3.jpg'), 0) - 1 ELSE -1 END AS u,
    list_filter(range(0, len(names)), lambda i: starts_with(names[i + 1], 'x/')) AS x FROM chapters)
SELECT o, CAST(CASE WHEN u >= 0 THEN u WHEN list_contains(m, o % 7) THEN o % 7 WHEN len(m) = 1 THEN m[1] ELSE -1 END AS INT) AS place, CAST(len(x) AS INT) AS known, CAST(coalesce(list_max(x), -1) AS INT) AS highest FROM m"""


def single_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that are sent: the first of each reader and set of parts while an equal one is on its way; others join it; and the wake-ups
    that every run that is at work is told of."""
    parts = F.sha2(F.concat_ws("|", F.lit("v2"), "event_type", (F.col("event_id") % 6).cast("string"), F.coalesce("props", F.lit(""))), 256)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.concat_ws("|", "event_type", (F.col("event_id") % 6).cast("string")).alias("key"), parts.alias("id"))
    order = Window.partitionBy("user_id", "key").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))
    e = e.withColumn("sent", F.coalesce(gap > 86_400_000_000 * 3, F.lit(True)))
    return e.groupBy("user_id").agg(F.count_if("sent").alias("sent"), F.count_if(~F.col("sent")).alias("joined"), F.count_distinct("id").alias("ids"), F.count_if((F.col("event_type") == "signup") & F.col("sent")).alias("woken"))


SINGLE_FLIGHTS = """WITH e AS (SELECT user_id, event_id, ts, event_type, event_type || '|' || (event_id % 6) AS key, 'v2|' || event_type || '|' || (event_id % 6) || '|' || coalesce(props, '') AS id FROM events),
g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, key ORDER BY ts, event_id)) > 259200000000, true) AS sent FROM e)
SELECT user_id, count(*) FILTER (sent) AS sent, count(*) FILTER (NOT sent) AS joined, count(DISTINCT id) AS ids, count(*) FILTER (event_type = 'signup' AND sent) AS woken FROM g GROUP BY 1"""

QUERIES = {f.__name__: f for f in (warming_marks, next_links, scaled_extras, same_plans, mask_parts, line_pitches, book_sections, verified_places, single_flights)}
ORACLES = {
    "warming_marks": WARMING_MARKS, "next_links": NEXT_LINKS, "scaled_extras": SCALED_EXTRAS, "same_plans": SAME_PLANS, "mask_parts": MASK_PARTS, "line_pitches": LINE_PITCHES,
    "book_sections": BOOK_SECTIONS, "verified_places": VERIFIED_PLACES, "single_flights": SINGLE_FLIGHTS,
}
