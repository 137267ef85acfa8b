"""What runs next: queues, prefetching, retries of what is missing, answers dealt back to pages, walks over pages, epochs and usage.

Events are requests, a user is a reader; an order's lines are the regions of a chapter's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import rules as L
from quillon.sources.tables import by_key, table

#: Pages that are fetched ahead, failures that a reader remembers, the wait after a refusal in seconds.
AHEAD, REMEMBERED, WAIT = 3, 20, 45


def queue_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reader's requests in turn: active for the page at work, dup for one that waits already, else queued; and the order in which they
    run: what was asked for by force first, then by what is seen, then by age."""
    key = (F.col("event_id") % 7).alias("key")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", key, (F.col("event_type") == "purchase").alias("force"), (F.col("event_type") == "view").alias("auto"))
    e = e.withColumn("active", F.first("key").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    e = e.withColumn("earlier", F.count("*").over(Window.partitionBy("user_id", "key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)))
    result = F.when(F.col("key") == F.col("active"), "active").when((F.col("earlier") > 0) & ~F.col("force"), "dup").otherwise("queued")
    e = e.withColumn("result", result)
    # Of several queued requests for a key the last one stands, since a forced one takes the place of the one that waits.
    last = F.row_number().over(Window.partitionBy("user_id", "key", "result").orderBy(F.desc("ts"), F.desc("event_id"))) == 1
    stands = (F.col("result") == "queued") & last
    e = e.withColumn("stands", stands)
    run = F.row_number().over(Window.partitionBy("user_id", "stands").orderBy(F.desc("force"), F.desc("value"), "ts", "event_id"))
    return e.select("user_id", "event_id", "result", F.when(F.col("stands"), run).alias("runs"), (F.col("stands") & F.col("auto") & ~F.col("force") & (F.col("key") > 3)).alias("dropped"))


QUEUE_RESULTS = """WITH e AS (SELECT user_id, event_id, ts, value, event_id % 7 AS key, event_type = 'purchase' AS force_, event_type = 'view' AS auto_ FROM events),
a AS (SELECT *, first_value(key) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS active, row_number() OVER (PARTITION BY user_id, key ORDER BY ts, event_id) - 1 AS earlier FROM e),
r AS (SELECT *, CASE WHEN key = active THEN 'active' WHEN earlier > 0 AND NOT force_ THEN 'dup' ELSE 'queued' END AS result FROM a),
s AS (SELECT *, result = 'queued' AND row_number() OVER (PARTITION BY user_id, key, result ORDER BY ts DESC, event_id DESC) = 1 AS stands FROM r)
SELECT user_id, event_id, result, CASE WHEN stands THEN CAST(row_number() OVER (PARTITION BY user_id, stands ORDER BY force_ DESC, value DESC, ts, event_id) AS INT) END AS runs, stands AND auto_ AND NOT force_ AND key > 3 AS dropped FROM s"""


def prefetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order to fetch ahead: behind the reader, not on screen, not owned by a job or its twin, not parked, as many as the budget leaves."""
    p = by_key(table(spark, sf_dir, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), "l_returnflag", "l_linestatus")
    url = F.concat(F.lit("https://h"), (F.col("s") % 3).cast("string"), F.lit(".example.com/"), F.col("p").cast("string"))
    p = p.withColumn("url", url).withColumn("path", F.regexp_extract("url", "^https://[^/]+(/.*)$", 1))
    some = lambda c: F.coalesce(F.max(c & F.col("url").isNotNull()), F.lit(False))
    p = p.withColumn("owned", F.coalesce(F.max(F.expr("l_returnflag = 'R' AND n <= 2 AND url IS NOT NULL")).over(Window.partitionBy("o", "path")), F.lit(False)))
    parked, shown = F.expr("l_linestatus = 'F' AND n = 3"), F.col("n") == 1
    first = p.groupBy("o", "url").agg(F.min(F.when(F.col("n") > 1, F.col("n"))).alias("n"), (some(F.col("owned")) | some(parked) | some(shown)).alias("out")).where("n IS NOT NULL AND NOT out").drop("out")
    budget = F.greatest(F.lit(0), F.lit(AHEAD) - F.col("o") % 3)
    return first.withColumn("k", F.row_number().over(Window.partitionBy("o").orderBy("n", "url"))).where(F.col("k") <= budget).select("o", "url", "n", "k")


PREFETCHES = f"""WITH p AS (SELECT l_orderkey AS o, l_linenumber AS n, 'https://h' || (l_suppkey % 3) || '.example.com/' || l_partkey AS url, l_partkey AS path, l_returnflag AS r, l_linestatus AS l FROM lineitem),
f AS (SELECT o, url, min(n) AS n FROM p WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.o = p.o AND q.path = p.path AND q.r = 'R' AND q.n <= 2) AND NOT EXISTS (SELECT 1 FROM p q WHERE q.o = p.o AND q.url = p.url AND q.l = 'F' AND q.n = 3)
    AND NOT EXISTS (SELECT 1 FROM p q WHERE q.o = p.o AND q.url = p.url AND q.n = 1) GROUP BY 1, 2)
SELECT o, url, n, k FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o ORDER BY n, url) AS INT) AS k FROM f) WHERE k <= greatest(0, {AHEAD} - o % 3)"""


def answers_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of a group of pages answered together, dealt back to their pages by running counts; what is missing is asked again, and
    only if nothing came back everything is; each conversation is a group and each turn a page of some regions."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length(F.coalesce("text", F.lit(""))) % 4 + 1).alias("n"))
    pages = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("base", F.coalesce(F.sum("n").over(pages.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")).withColumn("total", F.sum("n").over(Window.partitionBy("conv_id")))
    regions = c.select("conv_id", "turn", "base", "total", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("local")).withColumn("ix", F.col("base") + F.col("local"))
    came = (F.col("ix") % 3 != 0) & (F.col("conv_id") % 5 != 0)
    again = (F.col("ix") % 2 == 1) | (F.col("conv_id") % 5 == 0)
    r = regions.withColumn("first", came).withColumn("any", F.max(came.cast("int")).over(Window.partitionBy("conv_id")) == 1)
    r = r.withColumn("leg", F.when(F.col("first"), 1).when(again, 2))
    return r.groupBy("conv_id", "turn").agg(F.count_if(F.col("leg") == 1).alias("answered"), F.count_if(F.col("leg") == 2).alias("retried"), F.count_if(F.col("leg").isNull()).alias("missing"), F.max(F.when(F.col("any"), "missing").otherwise("all")).alias("asked"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("leg").isNotNull(), F.col("local")))), lambda x: x.cast("string")), ",").alias("got"))


ANSWERS_DEALT = """WITH c AS (SELECT conv_id, turn, length(coalesce(text, '')) % 4 + 1 AS n FROM conversations),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM c),
r AS (SELECT conv_id, turn, i AS local, base + i AS ix FROM b, LATERAL (SELECT unnest(range(1, n + 1)) AS i)),
l AS (SELECT *, CASE WHEN ix % 3 <> 0 AND conv_id % 5 <> 0 THEN 1 WHEN ix % 2 = 1 OR conv_id % 5 = 0 THEN 2 END AS leg, bool_or(ix % 3 <> 0 AND conv_id % 5 <> 0) OVER (PARTITION BY conv_id) AS some_ FROM r)
SELECT conv_id, turn, count(*) FILTER (leg = 1) AS answered, count(*) FILTER (leg = 2) AS retried, count(*) FILTER (leg IS NULL) AS missing, max(CASE WHEN some_ THEN 'missing' ELSE 'all' END) AS asked, coalesce(string_agg(CAST(local AS VARCHAR), ',' ORDER BY local) FILTER (leg IS NOT NULL), '') AS got FROM l GROUP BY 1, 2"""


def request_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reader's requests in waves: all before the first refusal run, a run has failed only if every one of its requests did; usage adds
    up over attempts and stays unknown where none reports any."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    width = F.col("user_id") % 6 + 1
    e = e.withColumn("wave", F.floor((F.row_number().over(order) - 1) / width)).withColumn("refused", F.col("value") > 150)
    stop = F.min(F.when(F.col("refused"), F.col("wave"))).over(Window.partitionBy("user_id"))
    e = e.withColumn("ran", stop.isNull() | (F.col("wave") <= stop))
    usage = F.when(F.col("event_type").isin("click", "purchase"), F.floor("value"))
    return e.groupBy("user_id").agg(F.max("wave").alias("last_wave"), F.count_if(F.col("ran")).alias("ran"), F.min((F.col("event_type") == "error") | ~F.col("ran")).alias("failed"), F.sum(F.when(F.col("ran"), usage)).alias("usage"))


REQUEST_WAVES = """WITH w AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // (user_id % 6 + 1) AS wave FROM events),
s AS (SELECT *, min(CASE WHEN value > 150 THEN wave END) OVER (PARTITION BY user_id) AS stop FROM w),
r AS (SELECT *, stop IS NULL OR wave <= stop AS ran FROM s)
SELECT user_id, max(wave) AS last_wave, count(*) FILTER (ran) AS ran, bool_and(event_type = 'error' OR NOT ran) AS failed, CAST(sum(CASE WHEN event_type IN ('click', 'purchase') THEN floor(value) END) FILTER (ran) AS BIGINT) AS usage FROM r GROUP BY 1"""


_WALK = "struct<url:string,seen:array<string>,end:string>"


def walk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a walk from each order's first page comes: step by step to the next one until the chapter ends, a page repeats, or it leaves
    the chapter. A walk is a fold over its steps, so that no job runs between them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), (F.col("o_orderkey") % 6).alias("last"), (F.col("o_orderkey") % 4 == 3).alias("loops"))
    key = F.lit("https://x.example.com/series/9")
    url = lambda n: F.concat(key, F.lit("/"), n.cast("string"))

    def step(at: Column, _: Column) -> Column:
        n = F.regexp_extract(at["url"], "([0-9]+)$", 1).cast("int")
        ahead = F.when(F.col("loops") & (n >= 2), url(F.lit(1))).otherwise(L.next_address(at["url"], key))
        status = F.when(n >= F.col("last"), 404).otherwise(200)
        end = F.when(F.array_contains(at["seen"], ahead), "repeats").when(L.walk_ended(status), "end")
        on = F.struct(F.when(end.isNull(), ahead).otherwise(at["url"]).alias("url"), F.when(end.isNull(), F.array_append(at["seen"], ahead)).otherwise(at["seen"]).alias("seen"), end.alias("end"))
        return F.when(at["end"].isNotNull(), at).otherwise(on).cast(_WALK)

    begin = F.struct(url(F.lit(1)).alias("url"), F.array(url(F.lit(1))).alias("seen"), F.lit(None).cast("string").alias("end")).cast(_WALK)
    walk = o.select("o", F.aggregate(F.sequence(F.lit(1), F.lit(7)), begin, step).alias("w"))
    return walk.select("o", F.size("w.seen").alias("n_pages"), "w.end", "w.url")


WALK_PAGES = """WITH o AS (SELECT o_orderkey AS o, o_orderkey % 6 AS last, o_orderkey % 4 = 3 AS loops FROM orders)
SELECT o, CAST(CASE WHEN loops AND last > 2 THEN 2 ELSE greatest(1, last) END AS INT) AS n_pages, CASE WHEN loops AND last >= 2 THEN 'repeats' ELSE 'end' END AS "end", 'https://x.example.com/series/9/' || CASE WHEN loops AND last > 2 THEN 2 ELSE greatest(1, last) END AS url FROM o"""


def request_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each order's line goes when it is asked for: not to a run that lost its page or settings; by force a retry, else a request, a
    place ahead, or what is there; with the sweep's phase and its lanes, and the refusal window that is left."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    phase, active, force = pick(("queued", "paused", "failed", "ready"), F.col("p")), F.col("o") % 2 == 0, F.col("s") % 3 == 0
    owned = (F.col("p") % 5 != 0) & (F.col("o") % 7 != 0)
    route = F.when(~owned, "queue").when(force, "retry").when(phase.isin("paused", "failed") | (~active & (phase != "ready")), "request").when((phase == "queued") & active, "prioritize").otherwise("attach")
    sweep = F.when(F.col("o") % 11 == 0, "idle").when(F.col("o") % 5 == 0, "dead").when(F.col("o") % 3 == 0, "stopping").when(active, "starting").otherwise("running")
    cloud, gpu, wasm = F.col("p") % 2 == 0, F.col("p") % 3 == 0, F.col("s") % 2 == 0
    lanes = F.when(cloud, 3).when(~gpu | wasm, 2).otherwise(3)
    left = F.greatest(F.lit(0), F.lit(WAIT * 1000) - (F.col("p") * 977 % 90_000))
    blocked = (F.col("s") % 2 == 0) & (F.col("p") % 2 == 0) & (F.col("n") % 2 == 0)
    return p.select("o", "n", "p", "s", route.alias("route"), sweep.alias("sweep"), lanes.alias("lanes"), F.when(gpu, 3).otherwise(1).alias("paint_lanes"), left.alias("left_ms"), blocked.alias("blocked"))


REQUEST_ROUTES = f"""WITH p AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, ['queued', 'paused', 'failed', 'ready'][CAST(l_partkey % 4 + 1 AS INT)] AS phase FROM lineitem)
SELECT o, n, p, s, CASE WHEN p % 5 = 0 OR o % 7 = 0 THEN 'queue' WHEN s % 3 = 0 THEN 'retry' WHEN phase IN ('paused', 'failed') OR (o % 2 <> 0 AND phase <> 'ready') THEN 'request' WHEN phase = 'queued' AND o % 2 = 0 THEN 'prioritize' ELSE 'attach' END AS route,
    CASE WHEN o % 11 = 0 THEN 'idle' WHEN o % 5 = 0 THEN 'dead' WHEN o % 3 = 0 THEN 'stopping' WHEN o % 2 = 0 THEN 'starting' ELSE 'running' END AS sweep, CASE WHEN p % 2 = 0 THEN 3 WHEN p % 3 <> 0 OR s % 2 = 0 THEN 2 ELSE 3 END AS lanes,
    CASE WHEN p % 3 = 0 THEN 3 ELSE 1 END AS paint_lanes, CAST(greatest(0, {WAIT * 1000} - p * 977 % 90000) AS BIGINT) AS left_ms, s % 2 = 0 AND p % 2 = 0 AND n % 2 = 0 AS blocked FROM p"""


def record_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by key after all writes and deletes of the newest generation: the last write of each key, unless a delete came later; what
    was written under an older generation counts for nothing."""
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 5).alias("key"), "ts", "event_id", "event_type", "value")
    started = F.max(F.when(F.col("event_type") == "signup", F.struct("ts", "event_id"))).over(Window.partitionBy("user_id"))
    at = F.struct("ts", "event_id")
    e = e.withColumn("started", started).where(F.col("started").isNull() | (at > F.col("started")))
    last = e.groupBy("user_id", "key").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("w"), F.count("*").alias("n"))
    return last.where("w.event_type <> 'error'").select("user_id", "key", F.col("w.value").alias("value"), "n")


RECORD_STORE = """WITH e AS (SELECT *, event_id % 5 AS key, max(CASE WHEN event_type = 'signup' THEN ROW(ts, event_id) END) OVER (PARTITION BY user_id) AS started FROM events),
f AS (SELECT * FROM e WHERE started IS NULL OR ROW(ts, event_id) > started),
l AS (SELECT user_id, key, event_type, value, count(*) OVER (PARTITION BY user_id, key) AS n, row_number() OVER (PARTITION BY user_id, key ORDER BY ts DESC, event_id DESC) AS k FROM f)
SELECT user_id, key, value, n FROM l WHERE k = 1 AND event_type <> 'error'"""


def last_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest errors that each reader keeps, and what is said when nothing runs: pages ready, queued and parked."""
    e = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))))
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("event_type") == "error") & (F.col("k") <= REMEMBERED), F.struct("k", "event_id")))), lambda x: x["event_id"].cast("string")), ",")
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    g = e.groupBy("user_id").agg(kept.alias("errors"), count("view").alias("loaded"), count("purchase").alias("ready"), count("click").alias("queued"), count("error").alias("parked"))
    parked = F.when(F.col("parked") > 60, F.concat(F.lit(" · "), F.col("parked").cast("string"), F.lit(" paused"))).otherwise("")
    of = F.concat(F.col("ready").cast("string"), F.lit(" of "), F.col("loaded").cast("string"), F.lit(" ready"))
    said = F.when((F.col("ready") >= F.col("loaded")) & (F.col("queued") == 0) & (parked == ""), "").when(F.col("ready") == 0, F.regexp_replace(parked, "^ · ", "")).otherwise(F.concat(of, F.when(F.col("queued") > 0, F.concat(F.lit(" · "), F.col("queued").cast("string"), F.lit(" queued"))).otherwise(""), parked))
    return g.select("user_id", "errors", said.alias("said"))


LAST_ERRORS = f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events),
g AS (SELECT user_id, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k) FILTER (event_type = 'error' AND k <= {REMEMBERED}), '') AS errors, count(*) FILTER (event_type = 'view') AS loaded, count(*) FILTER (event_type = 'purchase') AS ready,
    count(*) FILTER (event_type = 'click') AS queued, count(*) FILTER (event_type = 'error') AS parked FROM e GROUP BY 1),
p AS (SELECT *, CASE WHEN parked > 60 THEN ' · ' || parked || ' paused' ELSE '' END AS pause FROM g)
SELECT user_id, errors, CASE WHEN ready >= loaded AND queued = 0 AND pause = '' THEN '' WHEN ready = 0 THEN regexp_replace(pause, '^ · ', '') ELSE ready || ' of ' || loaded || ' ready' || CASE WHEN queued > 0 THEN ' · ' || queued || ' queued' ELSE '' END || pause END AS said FROM p"""


def row_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a shape's rows, each order's lines from top to bottom: ends that leap are held, and the span that all rows of the middle share."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 60).alias("a"), (100 + F.col("l_suppkey") * 7 % 80).alias("b"), "l_partkey", "l_suppkey")
    g = p.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("n", "l_partkey", "l_suppkey", "a", "b"))).alias("rows"))
    held = lambda name, way: F.aggregate("rows", F.array().cast("array<bigint>"), lambda acc, r: F.array_append(acc, F.when((F.size(acc) > 0) & (way * (F.try_element_at(acc, F.lit(-1)) - r[name]) > 36), F.try_element_at(acc, F.lit(-1))).otherwise(r[name])))
    g = g.select("o", held("a", 1).alias("a"), held("b", -1).alias("b"))
    inner = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 2, F.lit(0)))
    lo, hi = F.array_max(inner(F.col("a"))), F.array_min(inner(F.col("b")))
    return g.select("o", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("from"), F.array_join(F.transform("b", lambda x: x.cast("string")), ",").alias("to"), F.when(hi > lo, lo).alias("x1"), F.when(hi > lo, hi).alias("x2"))


ROW_SPANS = """WITH RECURSIVE p AS (SELECT l_orderkey AS o, l_partkey % 60 AS a, 100 + l_suppkey * 7 % 80 AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem),
r AS (SELECT o, k, c, a, b, [a] AS xa, [b] AS xb FROM p WHERE k = 1
    UNION ALL SELECT p.o, p.k, p.c, CASE WHEN r.a - p.a > 36 THEN r.a ELSE p.a END, CASE WHEN p.b - r.b > 36 THEN r.b ELSE p.b END, list_append(xa, CASE WHEN r.a - p.a > 36 THEN r.a ELSE p.a END), list_append(xb, CASE WHEN p.b - r.b > 36 THEN r.b ELSE p.b END)
    FROM r JOIN p ON p.o = r.o AND p.k = r.k + 1),
f AS (SELECT o, xa, xb, list_max(xa[2:-2]) AS lo, list_min(xb[2:-2]) AS hi FROM r WHERE k = c)
SELECT o, array_to_string(xa, ',') AS "from", array_to_string(xb, ',') AS "to", CASE WHEN hi > lo THEN lo END AS x1, CASE WHEN hi > lo THEN hi END AS x2 FROM f"""

QUERIES = {f.__name__: f for f in (queue_results, prefetches, answers_dealt, request_waves, walk_pages, request_routes, record_store, last_errors, row_spans)}
ORACLES = {
    "queue_results": QUEUE_RESULTS, "prefetches": PREFETCHES, "answers_dealt": ANSWERS_DEALT, "request_waves": REQUEST_WAVES, "walk_pages": WALK_PAGES, "request_routes": REQUEST_ROUTES,
    "record_store": RECORD_STORE, "last_errors": LAST_ERRORS, "row_spans": ROW_SPANS,
}
