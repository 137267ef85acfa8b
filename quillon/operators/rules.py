"""Queries of the small rules: replies, messages, rectangles, addresses, anchors, names and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import rules as L
from quillon.functions import text as T
from quillon.functions import urls as U
from quillon.operators.manifests import CHAPTERS, _chapters
from quillon.sources.tables import BOXES, boxes, table

_STATUS = (200, 400, 401, 402, 403, 404, 410, 422, 429, 500, 503)
_MESSAGES = ("too many images", "Maximum of 4 images", "image not supported", "thinking budget is too large", "bad request", "only one image per request", "Reasoning effort unknown")


def _pick(values: tuple, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _sql_pick(values: tuple, key: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST({key} % {len(values)} + 1 AS INT)]"


def reply_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each failed request is: its kind, whether its images were too many, its thinking refused, or the walk over pages ended."""
    e = table(spark, sf_dir, "events").select("event_id", _pick(_STATUS, F.col("event_id")).alias("status"), _pick(_MESSAGES, F.col("user_id")).alias("message"))
    e = e.withColumn("kind", L.error_kind(F.col("status"), F.col("message")))
    return e.select("event_id", "kind", L.image_cap(F.col("kind"), F.col("message")).alias("too_many_images"), L.thinking_refused(F.col("status"), F.col("message")).alias("thinking_refused"), L.walk_ended(F.col("status")).alias("ended"))


REPLY_ERRORS = f"""WITH e AS (SELECT event_id, {_sql_pick(_STATUS, 'event_id')} AS status, {_sql_pick(_MESSAGES, 'user_id')} AS message FROM events),
k AS (SELECT *, CASE WHEN status IN (401, 402, 403, 404) THEN 'auth' WHEN status = 429 THEN 'ratelimit' WHEN status = 400 AND regexp_matches(message, '{L.IMAGE_WORDS}') THEN 'parse' WHEN status >= 500 THEN 'server' ELSE 'parse' END AS kind FROM e)
SELECT event_id, kind, kind = 'parse' AND regexp_matches(message, '(?i)image') AND NOT regexp_matches(message, '{L.NOT_A_CAP.replace("'", "''")}') AND regexp_matches(message, '{L.CAP_WORDS}') AS too_many_images,
    status IN (400, 422) AND regexp_matches(message, '{L.THINKING_WORDS}') AS thinking_refused, status IN (404, 410) AS ended FROM k"""


def run_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of each order as a run: pages ready, why there is nothing to do, and why it was halted and for how long."""
    phases, halts = ("stopping", "stopped", "error", "waiting", "complete", "running"), ("user", "cache", "ratelimit", "auth")
    o, line = F.col("l_orderkey"), table(spark, sf_dir, "lineitem")
    g = line.groupBy("l_orderkey").agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("done"), F.count_if(F.col("l_returnflag") == "A").alias("errors"))
    g = g.withColumn("phase", _pick(phases, o)).withColumn("ready", F.concat("done", F.lit(" of "), L.counted(F.col("total"), "page"), F.lit(" ready to read")))
    phase, ready, errors = F.col("phase"), F.col("ready"), F.col("errors")
    said = F.when(phase == "stopping", F.concat(F.lit("Stopping · "), ready)).when(phase == "stopped", F.concat(F.lit("Stopped · "), ready)).when(phase == "error", F.concat(F.lit("Paused · "), ready))
    said = said.when(phase == "waiting", F.concat(ready, F.lit(" · Waiting for more pages"))).when((phase == "complete") & (errors > 0), F.concat(ready, F.lit(" · "), L.counted(errors, "page"), F.lit(" failed")))
    said = said.when(phase == "complete", F.concat(F.lit("Complete · "), L.counted(F.col("done"), "page"), F.lit(" ready to read"))).otherwise(ready)
    left = (o * 37 % 50_000) - 10_000
    halt = _pick(halts, o)
    halted = F.when(halt == "ratelimit", F.concat(F.lit("Limit reached"), F.when(left > 0, F.concat(F.lit(" ("), F.ceil(left / 1000).cast("string"), F.lit("s)"))).otherwise(""))).when(halt == "user", "Paused").when(halt == "cache", "Cleared").otherwise("Check the key")
    anchor = o % 9 - 1
    return g.select("l_orderkey", said.alias("said"), halted.alias("halted"), L.sweep_reason(F.col("total"), anchor).alias("reason"), L.sweep_count(F.col("total"), anchor).cast("bigint").alias("to_do"))


RUN_MESSAGES = """WITH g AS (SELECT l_orderkey AS o, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS done, count(*) FILTER (l_returnflag = 'A') AS errors FROM lineitem GROUP BY 1),
p AS (SELECT *, ['stopping', 'stopped', 'error', 'waiting', 'complete', 'running'][CAST(o % 6 + 1 AS INT)] AS phase, done || ' of ' || total || CASE WHEN total = 1 THEN ' page' ELSE ' pages' END || ' ready to read' AS ready,
    ['user', 'cache', 'ratelimit', 'auth'][CAST(o % 4 + 1 AS INT)] AS halt, o * 37 % 50000 - 10000 AS left_, o % 9 - 1 AS anchor FROM g)
SELECT o AS l_orderkey, CASE phase WHEN 'stopping' THEN 'Stopping · ' || ready WHEN 'stopped' THEN 'Stopped · ' || ready WHEN 'error' THEN 'Paused · ' || ready WHEN 'waiting' THEN ready || ' · Waiting for more pages'
    WHEN 'complete' THEN CASE WHEN errors > 0 THEN ready || ' · ' || errors || CASE WHEN errors = 1 THEN ' page' ELSE ' pages' END || ' failed' ELSE 'Complete · ' || done || CASE WHEN done = 1 THEN ' page' ELSE ' pages' END || ' ready to read' END ELSE ready END AS said,
    CASE halt WHEN 'ratelimit' THEN 'Limit reached' || CASE WHEN left_ > 0 THEN ' (' || CAST(ceil(left_ / 1000) AS BIGINT) || 's)' ELSE '' END WHEN 'user' THEN 'Paused' WHEN 'cache' THEN 'Cleared' ELSE 'Check the key' END AS halted,
    CASE WHEN total = 0 THEN 'no-pages' WHEN anchor < 0 THEN 'no-anchor' WHEN anchor >= total THEN 'last-page' ELSE 'known' END AS reason, CAST(CASE WHEN anchor < 0 THEN 0 ELSE greatest(0, total - anchor) END AS BIGINT) AS to_do FROM p"""

_SEAM, _MARGIN, _VIEW = 150.0, 8.0, (400.0, 200.0)


def box_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box as a reader's window sees it: signed overlap, visible area, device pixels, whether it spans a seam, its place in the stack."""
    b = boxes(spark, sf_dir)
    c = F.col
    seen = F.greatest(F.lit(0.0), F.least(c("x2"), F.lit(_VIEW[0])) - F.greatest(c("x1"), F.lit(0.0))) * F.greatest(F.lit(0.0), L.span_overlap(c("y1"), c("y2"), _VIEW[1]))
    spans = (c("y1") < _SEAM - _MARGIN) & (c("y2") > _SEAM + _MARGIN)
    shift = 300.0 * (c("page_id") % 3)
    crop = L.device_crop(c("x1") - 20, c("y1") - 20, c("x2") - c("x1"), c("y2") - c("y1"), 1.5, 500, 400)
    return b.select("page_id", "pos", L.span_overlap(c("y1"), c("y2"), _VIEW[1]).alias("overlap"), seen.alias("seen"), *crop, spans.alias("spans"), (c("y1") + shift).alias("stacked_y1"), (c("y2") + shift).alias("stacked_y2"))


BOX_VIEWS = f"""WITH {BOXES}, p AS (SELECT *, greatest(0, CAST(floor((x1 - 20) * 1.5) AS BIGINT)) AS sx, greatest(0, CAST(floor((y1 - 20) * 1.5) AS BIGINT)) AS sy FROM boxes)
SELECT page_id, pos, least(y2, {_VIEW[1]}) - greatest(y1, 0.0) AS overlap, greatest(0.0, least(x2, {_VIEW[0]}) - greatest(x1, 0.0)) * greatest(0.0, least(y2, {_VIEW[1]}) - greatest(y1, 0.0)) AS seen,
    sx, sy, least(500 - sx, CAST(floor((x2 - x1) * 1.5) AS BIGINT)) AS sw, least(400 - sy, CAST(floor((y2 - y1) * 1.5) AS BIGINT)) AS sh,
    y1 < {_SEAM - _MARGIN} AND y2 > {_SEAM + _MARGIN} AS spans, y1 + 300.0 * (page_id % 3) AS stacked_y1, y2 + 300.0 * (page_id % 3) AS stacked_y2 FROM p"""


def _reader_url(o: Column) -> Column:
    """An address of one of six kinds."""
    n = (o % 40).cast("string")
    forms = [
        F.concat(F.lit("https://r.mangadex.org/chapter/0f3a-44bb-99"), n, F.lit("/"), n), F.concat(F.lit("https://h.example.com/reader/"), n, F.lit(".html#"), n), F.concat(F.lit("https://x.example.com:8080/series/12/"), n, F.lit("/")),
        F.concat(F.lit("http://x.example.com/read/7?page="), n, F.lit("&v=1")), F.concat(F.lit("https://x.example.com/title/"), n), F.concat(F.lit("ftp://x.example.com/a/"), n),
    ]
    out = forms[-1]
    for k, form in enumerate(forms[:-1]):
        out = F.when(o % 6 == k, form).otherwise(out)
    return out


_SQL_READER = """CASE o % 6 WHEN 0 THEN 'https://r.mangadex.org/chapter/0f3a-44bb-99' || (o % 40) || '/' || (o % 40) WHEN 1 THEN 'https://h.example.com/reader/' || (o % 40) || '.html#' || (o % 40)
    WHEN 2 THEN 'https://x.example.com:8080/series/12/' || (o % 40) || '/' WHEN 3 THEN 'http://x.example.com/read/7?page=' || (o % 40) || '&v=1' WHEN 4 THEN 'https://x.example.com/title/' || (o % 40) ELSE 'ftp://x.example.com/a/' || (o % 40) END"""


def address_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order's address its site, grant pattern, shape, ids, key and the next page's address."""
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), _reader_url(F.col("o_orderkey")).alias("url"))
    of = [U.part(F.col("url"), p) for p in (U.ORIGIN, U.PATH, U.SEARCH, U.HASH)]
    r = r.select("*", *[c.alias(n) for c, n in zip(of, ("origin", "path", "search", "hash"), strict=True)]).withColumn("key", U.chapter_key(*map(F.col, ("origin", "path", "search", "hash"))))
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    return r.select("o", F.nullif("origin", F.lit("")).alias("site"), L.host_pattern(F.col("url")).alias("pattern"), L.page_shape(F.col("url")).alias("shape"), L.chapter_uuid(host, F.col("path")).alias("uuid"), L.reader_id(F.col("path")).alias("reader"), "key", L.next_address(F.col("url"), F.col("key")).alias("next"))


ADDRESS_RULES = rf"""WITH u AS (SELECT o_orderkey AS o, {_SQL_READER.replace('o %', 'o_orderkey %')} AS url FROM orders),
p AS (SELECT o, url, regexp_extract(url, '{U.ORIGIN}', 1) AS origin, regexp_extract(url, '{U.PATH}', 1) AS path, regexp_extract(url, '{U.SEARCH}', 1) AS search, regexp_extract(url, '{U.HASH}', 1) AS hash FROM u),
k AS (SELECT *, {U.sql_key('origin', 'path', 'search', 'hash')} AS key, {U.sql_key('origin', 'path', 'search', "''")} AS folded, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs, regexp_extract(search, '[?&]page=([0-9]+)(?:&|$)', 1) AS page FROM p),
s AS (SELECT *, CASE WHEN page <> '' THEN origin || path || regexp_extract(search, '^(.*[?&]page=)[0-9]+(?:&|$)', 1) || (CAST(page AS BIGINT) + 1) || regexp_extract(search, '[?&]page=[0-9]+(&.*)?$', 1) || hash END AS a,
    CASE WHEN len(segs) >= 2 AND regexp_matches(segs[-1], '^[0-9]+$') AND regexp_matches(array_to_string(segs[:-2], '/'), '[0-9]') THEN origin || '/' || array_to_string(segs[:-2], '/') || '/' || (CAST(segs[-1] AS BIGINT) + 1) || CASE WHEN ends_with(path, '/') THEN '/' ELSE '' END || search || hash END AS b,
    CASE WHEN regexp_matches(hash, '^#[0-9]+$') AND folded = key THEN origin || path || search || '#' || (CAST(substr(hash, 2) AS BIGINT) + 1) END AS c FROM k),
parts_of AS (SELECT o, {', '.join(f"regexp_extract({x}, '{p}', 1) AS {x}{i}" for x in 'abc' for i, p in enumerate((U.ORIGIN, U.PATH, U.SEARCH, U.HASH)))} FROM s),
keys AS (SELECT o, {', '.join(f"{U.sql_key(f'{x}0', f'{x}1', f'{x}2', f'{x}3')} AS key_{x}" for x in 'abc')} FROM parts_of)
SELECT s.o, nullif(origin, '') AS site, CASE WHEN origin <> '' THEN regexp_extract(url, '^(https?://[^/:?#]+)', 1) || '/*' END AS pattern, origin || regexp_replace(path, '/+$', '') || search AS shape,
    CASE WHEN contains(origin, 'mangadex.') THEN nullif(regexp_extract(path, '^/chapter/([0-9a-f-]{{10,}})(?:/|$)', 1), '') END AS uuid, nullif(regexp_extract(path, '^/reader/([0-9]+)\.html$', 1), '') AS reader, key,
    coalesce(CASE WHEN key_a = key AND a <> url THEN a END, CASE WHEN key_b = key AND b <> url THEN b END, CASE WHEN key_c = key AND c <> url THEN c END) AS next FROM s JOIN keys ON keys.o = s.o"""


def series_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order's page the longest link of its site that its path continues, and the scope that its book belongs to."""
    o = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(o.alias("o"), F.concat(F.lit("/title/t"), (o % 50).cast("string"), F.lit("/ch-"), (o % 20).cast("string"), F.lit("/"), (o % 7).cast("string")).alias("path"))
    origin = F.lit("https://x.example.com")
    t = F.concat(F.lit("/title/t"), (F.col("o") % 50).cast("string"))
    links = F.array(F.concat(origin, t, F.lit("/")), F.concat(origin, F.when(F.col("o") % 3 == 0, F.concat(t, F.lit("/ch-"), (F.col("o") % 20).cast("string"))).otherwise(F.lit("/title"))), F.concat(origin, F.lit("/genre/x")), F.concat(F.lit("https://y.example.com"), t, F.lit("/ch-1")))
    r = r.withColumn("links", F.when(F.col("o") % 5 == 4, F.array(F.lit("https://x.example.com/"))).otherwise(links))
    own = F.transform(F.filter("links", lambda u: U.part(u, U.ORIGIN) == origin), lambda u: F.regexp_replace(U.part(u, U.PATH), "/+$", ""))
    fits = F.filter(own, lambda p: (F.size(U.segments(p)) >= 2) & ~p.rlike("(?i)/(?:genre|tag|search)(?:/|$)") & F.startswith(F.col("path"), F.concat(p, F.lit("/"))))
    best = F.aggregate(fits, F.lit(None).cast("string"), lambda acc, p: F.when(acc.isNull() | (F.length(p) > F.length(acc)), p).otherwise(acc))
    r = r.withColumn("series", best)
    chapter = F.regexp_replace("path", "/[0-9]+$", "")
    derived = F.when(F.col("o") % 4 != 0, F.regexp_extract("path", "^(/title/t[0-9]+)/", 1))
    candidate = F.coalesce(derived, F.col("series"))
    return r.select("o", "series", F.when(candidate == chapter, F.when(F.col("series") == chapter, chapter)).otherwise(candidate).alias("scope"))


SERIES_LINKS = """WITH r AS (SELECT o_orderkey AS o, '/title/t' || (o_orderkey % 50) AS t, '/title/t' || (o_orderkey % 50) || '/ch-' || (o_orderkey % 20) AS chapter FROM orders),
s AS (SELECT *, CASE WHEN o % 5 = 4 THEN NULL WHEN o % 3 = 0 THEN chapter ELSE t END AS series FROM r),
c AS (SELECT *, coalesce(CASE WHEN o % 4 <> 0 THEN t END, series) AS candidate FROM s)
SELECT o, series, CASE WHEN candidate = chapter THEN CASE WHEN series = chapter THEN chapter END ELSE candidate END AS scope FROM c"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the reader is in each chapter's list: exact before twin, the nearest usable page, the window from it, the first urgent task."""
    c = _chapters(spark, sf_dir).withColumn("items", F.transform("names", lambda n: F.concat(F.lit("https://a.example.com/"), n)))
    n, o = F.size("items"), F.col("o")
    wanted = F.array(F.lit("https://a.example.com/p9.jpg"), F.concat(F.when(o % 2 == 0, "https://b.example.com/").otherwise("https://a.example.com/"), F.element_at("names", -1)), F.col("items")[0])
    c = c.withColumn("wanted", F.when(o % 5 == 0, F.slice(wanted, 1, 1)).otherwise(F.slice(wanted, 1, 2)))
    first = lambda places: F.coalesce(F.try_element_at(F.filter(places, lambda p: p >= 0), F.lit(1)), F.lit(-1))
    path = lambda u: F.regexp_extract(u, "^https://[^/]+(/.*)$", 1)
    exact = first(F.transform("wanted", lambda w: F.array_position("items", w).cast("int") - 1))
    twin = first(F.transform("wanted", lambda w: F.array_position(F.transform("items", lambda i: (i != w) & (path(i) == path(w))), F.lit(True)).cast("int") - 1))
    c = c.withColumn("anchor", F.when(exact >= 0, exact).otherwise(twin))
    usable = F.filter(F.sequence(F.lit(0), F.size("items") - 1), lambda i: (i + o) % 3 != 0)
    at = F.coalesce(F.array_max(F.filter(usable, lambda i: i <= F.col("anchor"))), F.lit(-1))
    c = c.withColumn("usable", usable).withColumn("at", at)
    shown = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i + o) % 4 == 1)
    ahead = F.when(F.size(shown) > 0, F.slice("items", F.array_min(shown) + 1, F.array_max(shown) - F.array_min(shown) + 2)).otherwise(F.array().cast("array<string>"))
    urgent = F.array_position(F.transform("names", lambda x: x.startswith("x/")), F.lit(True)).cast("int") - 1
    return c.select("o", "anchor", F.when(F.col("at") >= 0, F.array_position("usable", F.col("at")).cast("int") - 1).otherwise(-1).alias("usable_at"), F.array_join(F.transform(L.window_from(n, F.col("anchor"), 3), lambda i: i.cast("string")), ",").alias("places"), F.size(ahead).alias("n_ahead"), F.greatest(urgent, F.lit(0)).alias("task"))


ANCHORS = rf"""WITH {CHAPTERS}, i AS (SELECT o, names, list_transform(names, lambda x: 'https://a.example.com/' || x) AS items, len(names) AS n FROM chapters),
w AS (SELECT *, ['https://a.example.com/p9.jpg', CASE WHEN o % 2 = 0 THEN 'https://b.example.com/' ELSE 'https://a.example.com/' END || names[-1]][1:CASE WHEN o % 5 = 0 THEN 1 ELSE 2 END] AS wanted FROM i),
p AS (SELECT *, list_filter(list_transform(wanted, lambda x: coalesce(list_position(items, x), 0) - 1), lambda x: x >= 0) AS exact,
    list_filter(list_transform(wanted, lambda x: coalesce(list_position(list_transform(items, lambda y: y <> x AND regexp_extract(y, '^https://[^/]+(/.*)$', 1) = regexp_extract(x, '^https://[^/]+(/.*)$', 1)), true), 0) - 1), lambda x: x >= 0) AS twin FROM w),
a AS (SELECT *, CASE WHEN len(exact) > 0 THEN exact[1] ELSE coalesce(twin[1], -1) END AS anchor, list_filter(range(0, n), lambda x: (x + o) % 3 <> 0) AS usable, list_filter(range(0, n), lambda x: (x + o) % 4 = 1) AS shown FROM p),
u AS (SELECT *, coalesce(list_max(list_filter(usable, lambda x: x <= anchor)), -1) AS at_ FROM a)
SELECT o, CAST(anchor AS INT) AS anchor, CAST(CASE WHEN at_ >= 0 THEN list_position(usable, at_) - 1 ELSE -1 END AS INT) AS usable_at,
    array_to_string(range(CASE WHEN anchor >= 0 THEN anchor ELSE 0 END, least(n, CASE WHEN anchor >= 0 THEN anchor ELSE 0 END + 3)), ',') AS places,
    CAST(CASE WHEN len(shown) > 0 THEN least(n, list_max(shown) + 2) - list_min(shown) ELSE 0 END AS INT) AS n_ahead, CAST(greatest(coalesce(list_position(list_transform(names, lambda x: starts_with(x, 'x/')), true), 0) - 1, 0) AS INT) AS task FROM u"""


def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers against the one before them in their segment: without forms of address, as keys, and whether they are one person."""
    suffix = _pick(("", "-san", " Chan", "kun", " Sensei"), F.col("c_custkey"))
    name = F.concat(F.element_at(F.array(*map(F.lit, ("Ada", "Ada Byron", "Boris", "boris  K", "Ka"))), (F.col("c_custkey") * 7 % 5 + 1).cast("int")), suffix)
    order = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), F.lag(name).over(order).alias("before")).where("before IS NOT NULL")
    return c.select("c_custkey", L.without_honorific(F.col("name")).alias("bare"), L.name_key(F.col("name")).alias("key"), L.same_person(F.col("name"), F.col("before")).alias("same"), L.joined_notes([F.col("before"), F.col("name"), F.col("before")]).alias("note"))


_SQL_BARE = "CASE WHEN trim(regexp_replace({0}, '" + L.HONORIFIC + "', '')) = '' THEN {0} ELSE trim(regexp_replace({0}, '" + L.HONORIFIC + "', '')) END"
_SQL_KEY = r"regexp_replace(translate(lower({0}), '" + L.LONG_VOWELS + "', '" + L.SHORT_VOWELS + r"'), '[^\p{{L}}\p{{N}}\p{{M}}]', '', 'g')"
NAME_MATCHES = rf"""WITH n AS (SELECT c_custkey, c_nationkey, c_mktsegment, ['Ada', 'Ada Byron', 'Boris', 'boris  K', 'Ka'][CAST(c_custkey * 7 % 5 + 1 AS INT)] || ['', '-san', ' Chan', 'kun', ' Sensei'][CAST(c_custkey % 5 + 1 AS INT)] AS name FROM customer),
b AS (SELECT c_custkey, name, lag(name) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS before FROM n),
l AS (SELECT *, trim(lower(name)) AS la, trim(lower(before)) AS lb, {_SQL_BARE.format('name')} AS bare FROM b WHERE before IS NOT NULL),
s AS (SELECT *, {_SQL_BARE.format('la')} AS a, {_SQL_BARE.format('lb')} AS c FROM l),
k AS (SELECT *, {_SQL_BARE.format('a')} AS aa, {_SQL_BARE.format('c')} AS cc FROM s),
t AS (SELECT *, {_SQL_KEY.format('aa')} AS ka, {_SQL_KEY.format('cc')} AS kc, list_distinct(regexp_split_to_array(a, '\s+')) AS ta, list_distinct(regexp_split_to_array(c, '\s+')) AS tc FROM k)
SELECT c_custkey, bare, {_SQL_KEY.format('bare')} AS key,
    a <> '' AND c <> '' AND (a = c OR (length(ka) >= 3 AND ka = kc) OR CASE WHEN len(ta) <= len(tc) THEN list_has_all(tc, ta) ELSE list_has_all(ta, tc) END) AS same,
    CASE WHEN contains(trim(before), trim(name)) THEN trim(before) ELSE trim(before) || ' · ' || trim(name) END AS note FROM t"""


def similar_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each turn says nearly what the one before says: equal, half of the shorter's long words, contained, or a Dice of 0.85."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring("text", 1, 60).alias("text"))
    part = F.when(F.col("turn") % 3 == 1, F.substring(F.lag("text").over(order), 4, 30)).when(F.col("turn") % 3 == 2, F.lag("text").over(order)).otherwise(F.col("text"))
    c = c.select("conv_id", "turn", T.normalized(part).alias("a"), T.normalized(F.lag("text").over(order)).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return c.select("conv_id", "turn", T.similar(F.col("a"), F.col("b")).alias("similar"))


_FLAT = "replace({}, ' ', '')"
_GRAMS = "list_distinct(CASE WHEN length({0}) >= 2 THEN list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)) WHEN {0} <> '' THEN [{0}] ELSE [] END)"
SIMILAR_TURNS = rf"""WITH c AS (SELECT conv_id, turn, substr(text, 1, 60) AS text FROM conversations),
l AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM c),
p AS (SELECT conv_id, turn, CASE turn % 3 WHEN 1 THEN substr(before, 4, 30) WHEN 2 THEN before ELSE text END AS text, before FROM l),
n AS (SELECT conv_id, turn, {T.SQL_NORMALIZED} AS a, {T.SQL_NORMALIZED.replace('lower(text)', 'lower(before)')} AS b FROM p WHERE text IS NOT NULL AND before IS NOT NULL),
w AS (SELECT *, list_distinct(list_filter(string_split(a, ' '), lambda x: length(x) > 2)) AS wa, list_distinct(list_filter(string_split(b, ' '), lambda x: length(x) > 2)) AS wb,
    CASE WHEN length(a) <= length(b) THEN {_FLAT.format('a')} ELSE {_FLAT.format('b')} END AS s, CASE WHEN length(a) <= length(b) THEN {_FLAT.format('b')} ELSE {_FLAT.format('a')} END AS g FROM n),
d AS (SELECT *, {_GRAMS.format('s')} AS gs, {_GRAMS.format('g')} AS gg FROM w)
SELECT conv_id, turn, a <> '' AND b <> '' AND (a = b OR (len(wa) > 0 AND len(wb) > 0 AND len(list_intersect(wa, wb)) / least(len(wa), len(wb)) >= 0.5) OR (length(s) >= 10 AND contains(g, s))
    OR (length(s) >= 12 AND 2 * len(list_intersect(gs, gg)) / (len(gs) + len(gg)) >= 0.85)) AS similar FROM d"""

QUERIES = {f.__name__: f for f in (reply_errors, run_messages, box_views, address_rules, series_links, anchors, name_matches, similar_turns)}
ORACLES = {
    "reply_errors": REPLY_ERRORS, "run_messages": RUN_MESSAGES, "box_views": BOX_VIEWS, "address_rules": ADDRESS_RULES, "series_links": SERIES_LINKS,
    "anchors": ANCHORS, "name_matches": NAME_MATCHES, "similar_turns": SIMILAR_TURNS,
}
