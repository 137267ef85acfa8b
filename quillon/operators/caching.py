"""Cached pages: gates, lookups in two tiers, merges in order, deletes, masks, stamps, leases and logs.

An order's lines are the cached rows of a chapter; its events and their kinds are what happens to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import cached as K
from quillon.sources.tables import table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached rows o, n, hash, fp, w, h, partial, key_gen, split_gen, mask_bytes, cloud."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("o"), c("l_linenumber").alias("n"), c("l_partkey").alias("p"), c("l_suppkey").alias("s"), (c("l_partkey") % 5).alias("hash"), F.when(c("l_returnflag") == "R", "f1").otherwise("f2").alias("fp"),
        (100 + c("l_partkey") % 3).alias("w"), (200 + c("l_suppkey") % 2).alias("h"), (c("l_linestatus") == "F").alias("partial"), F.when(c("l_partkey") % 7 != 0, 1).alias("key_gen"),
        F.when(c("l_partkey") % 4 != 0, 17 + c("l_partkey") % 4).alias("split_gen"), F.when(c("l_suppkey") % 4 == 0, 5).otherwise(16).alias("mask_bytes"), (c("l_linenumber") % 2 == 0).alias("cloud"),
    )


CACHED = """cached AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_partkey % 5 AS hash, CASE WHEN l_returnflag = 'R' THEN 'f1' ELSE 'f2' END AS fp, 100 + l_partkey % 3 AS w, 200 + l_suppkey % 2 AS h,
    l_linestatus = 'F' AS partial, CASE WHEN l_partkey % 7 <> 0 THEN 1 END AS key_gen, CASE WHEN l_partkey % 4 <> 0 THEN 17 + l_partkey % 4 END AS split_gen, CASE WHEN l_suppkey % 4 = 0 THEN 5 ELSE 16 END AS mask_bytes, l_linenumber % 2 = 0 AS cloud FROM lineitem)"""


def cache_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each cached row whether it resumes, is used, keeps its patches, can lend them and may be painted, with the first reason against."""
    r, c = _rows(spark, sf_dir), F.col
    dims = (c("w") != 101) | (c("h") != 200)
    mask = c("mask_bytes") != 16
    fresh = K.split_fresh(c("split_gen"), c("cloud"))
    miss = K.first_reason([("fingerprint", c("fp") != "f1"), ("dims", dims), ("splitgen", ~fresh), ("mask", mask), ("partial", c("partial"))])
    page = K.first_reason([("legacy", ~c("key_gen").eqNullSafe(F.lit(K.PAGE_KEY_GEN))), ("fingerprint", c("fp") != "f1"), ("dims", dims), ("partial", c("partial"))])
    resumes = c("partial") & (c("fp") == "f1") & ~dims & ~mask & fresh
    lends = ~c("partial") & (c("s") % 3 == 0) & (c("fp") == "f1") & ~dims
    painted = (c("s") % 5 == 0) | (c("fp") == "f1")
    return r.select("o", "n", "p", "s", miss.alias("miss"), F.coalesce(page, F.lit("ok")).alias("page"), (page.isNull() & (c("hash") != 2)).alias("drops"), resumes.alias("resumes"), lends.alias("lends"), painted.alias("painted"))


CACHE_GATES = f"""WITH {CACHED}, g AS (SELECT *, w <> 101 OR h <> 200 AS dims, mask_bytes <> 16 AS mask, NOT cloud OR coalesce(split_gen, 0) >= {K.SPLIT_GEN} AS fresh FROM cached),
p AS (SELECT *, CASE WHEN key_gen IS NULL OR key_gen <> 1 THEN 'legacy' WHEN fp <> 'f1' THEN 'fingerprint' WHEN dims THEN 'dims' WHEN partial THEN 'partial' ELSE 'ok' END AS page FROM g)
SELECT o, n, p, s, CASE WHEN fp <> 'f1' THEN 'fingerprint' WHEN dims THEN 'dims' WHEN NOT fresh THEN 'splitgen' WHEN mask THEN 'mask' WHEN partial THEN 'partial' END AS miss, page, page = 'ok' AND hash <> 2 AS drops,
    partial AND fp = 'f1' AND NOT dims AND NOT mask AND fresh AS resumes, NOT partial AND s % 3 = 0 AND fp = 'f1' AND NOT dims AS lends, s % 5 = 0 OR fp = 'f1' AS painted FROM p"""


def cache_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that answers a lookup for each order: a fresh one of its content, else a verified one of its slot, scaled to the picture."""
    r = _rows(spark, sf_dir).where("NOT partial")
    order = F.struct("n", "p", "s")
    exact = r.where("fp = 'f1' AND w = 101 AND h = 200").groupBy("o").agg(F.min(order).alias("exact"))
    slot = r.where((F.col("key_gen") == K.PAGE_KEY_GEN) & (F.col("fp") == "f1") & K.same_shape(F.col("w") * 2, F.col("h") * 2, F.col("w") * 0 + 202, F.col("w") * 0 + 400) & (F.col("hash") != 1))
    slot = slot.groupBy("o").agg(F.min(F.struct("n", "p", "s", "w", "h")).alias("slot"))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"))
    found = wanted.join(exact, "o", "left").join(slot, "o", "left")
    box = F.struct(F.lit(10.0).alias("x1"), F.lit(20.0).alias("y1"), F.lit(30.0).alias("x2"), F.lit(50.0).alias("y2"))
    resized = K.scaled(box, F.lit(202.0) / F.col("slot.w"), F.lit(400.0) / F.col("slot.h"))
    tier = F.when(F.col("exact").isNotNull(), "exact").when(F.col("slot").isNotNull(), "slot")
    return found.select("o", tier.alias("tier"), F.coalesce("exact.n", "slot.n").alias("n"), F.when(tier == "slot", F.round(resized["x2"], 6)).when(tier == "exact", 30.0).alias("x2"), F.when(tier == "slot", F.round(resized["y2"], 6)).when(tier == "exact", 50.0).alias("y2"))


CACHE_SELECT = f"""WITH {CACHED}, r AS (SELECT * FROM cached WHERE NOT partial),
e AS (SELECT o, min(ROW(n, p, s)) AS e FROM r WHERE fp = 'f1' AND w = 101 AND h = 200 GROUP BY o),
v AS (SELECT o, n, w, h FROM r WHERE key_gen = 1 AND fp = 'f1' AND abs((w * 2 / (h * 2)) / (202 / 400) - 1) <= 0.005 AND hash <> 1 QUALIFY row_number() OVER (PARTITION BY o ORDER BY n, p, s, w, h) = 1),
x AS (SELECT o, n FROM r WHERE fp = 'f1' AND w = 101 AND h = 200 QUALIFY row_number() OVER (PARTITION BY o ORDER BY n, p, s) = 1)
SELECT o_orderkey AS o, CASE WHEN x.n IS NOT NULL THEN 'exact' WHEN v.n IS NOT NULL THEN 'slot' END AS tier, coalesce(x.n, v.n) AS n,
    CASE WHEN x.n IS NOT NULL THEN 30.0 WHEN v.n IS NOT NULL THEN round(30.0 * (202.0 / v.w), 6) END AS x2, CASE WHEN x.n IS NOT NULL THEN 50.0 WHEN v.n IS NOT NULL THEN round(50.0 * (400.0 / v.h), 6) END AS y2
FROM orders LEFT JOIN x ON x.o = o_orderkey LEFT JOIN v ON v.o = o_orderkey"""

_ENTRY = "struct<n:int,p:bigint,s:bigint,fp:string,partial:boolean,texts:array<string>,patches:bigint,atime:int>"


def entry_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's writes under one key, merged in order: another recipe replaces, a checkpoint never undoes a page, two checkpoints fill
    each other's texts, and a page without patches inherits them."""
    r = _rows(spark, sf_dir)
    texts = F.array(F.when(F.col("p") % 2 == 0, F.concat(F.lit("a"), F.col("p"))).otherwise(""), F.when(F.col("s") % 2 == 0, F.concat(F.lit("b"), F.col("s"))).otherwise(""))
    entry = F.struct("n", "p", "s", "fp", "partial", texts.alias("texts"), F.when(~F.col("partial") & (F.col("p") % 3 == 0), F.col("p")).alias("patches"), F.col("n").alias("atime"))
    writes = r.groupBy("o").agg(F.array_sort(F.collect_list(entry)).alias("writes"))

    def merge(before: Column, now: Column) -> Column:
        fills = now["partial"] & before["partial"]
        merged = F.struct(
            now["n"].alias("n"), now["p"].alias("p"), now["s"].alias("s"), now["fp"].alias("fp"), now["partial"].alias("partial"), F.when(fills, K.filled(now["texts"], before["texts"], F.size(now["texts"]))).otherwise(now["texts"]).alias("texts"),
            F.when(now["partial"], now["patches"]).otherwise(F.coalesce(now["patches"], before["patches"])).alias("patches"), now["atime"].alias("atime"),
        )
        touched = F.struct(*[before[k].alias(k) for k in ("n", "p", "s", "fp", "partial", "texts", "patches")], now["atime"].alias("atime"))
        out = F.when(before.isNull() | (before["fp"] != now["fp"]), now).when(now["partial"] & ~before["partial"], touched).otherwise(merged)
        return out.cast(_ENTRY)

    last = F.aggregate("writes", F.lit(None).cast(_ENTRY), merge)
    return writes.select("o", last.alias("e")).select("o", "e.n", "e.fp", "e.partial", F.array_join("e.texts", "|").alias("texts"), "e.patches", "e.atime")


ENTRY_MERGES = f"""WITH RECURSIVE {CACHED}, w AS (SELECT o, n, p, s, fp, partial, CASE WHEN p % 2 = 0 THEN 'a' || p ELSE '' END AS t1, CASE WHEN s % 2 = 0 THEN 'b' || s ELSE '' END AS t2, CASE WHEN NOT partial AND p % 3 = 0 THEN p END AS patches,
    row_number() OVER (PARTITION BY o ORDER BY n, p, s, fp, partial) AS k, count(*) OVER (PARTITION BY o) AS c FROM cached),
r AS (SELECT o, k, c, n, fp, partial, t1, t2, patches, n AS atime FROM w WHERE k = 1
    UNION ALL SELECT o, k, c, CASE WHEN keep THEN rn ELSE n END, fp, CASE WHEN keep THEN rp ELSE partial END,
        CASE WHEN keep THEN r1 WHEN same AND partial AND rp THEN coalesce(nullif(t1, ''), r1) ELSE t1 END, CASE WHEN keep THEN r2 WHEN same AND partial AND rp THEN coalesce(nullif(t2, ''), r2) ELSE t2 END,
        CASE WHEN keep THEN rq WHEN same AND NOT partial THEN coalesce(patches, rq) ELSE patches END, n
    FROM (SELECT r.o, w.k, r.c, r.n AS rn, r.partial AS rp, r.t1 AS r1, r.t2 AS r2, r.patches AS rq, w.n, w.fp, w.partial, w.t1, w.t2, w.patches, r.fp = w.fp AS same, r.fp = w.fp AND w.partial AND NOT r.partial AS keep FROM r JOIN w ON w.o = r.o AND w.k = r.k + 1))
SELECT o, n, fp, partial, t1 || '|' || t2 AS texts, patches, atime FROM r WHERE k = c"""


def cache_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached keys of each order after the deletes of its second line's content and of one chapter's prefix, and what a chapter has in either form."""
    r = _rows(spark, sf_dir).select("o", F.concat(F.lit("ch"), (F.col("o") % 9).cast("string"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("@p"), F.col("n"))).otherwise(F.concat(F.lit("#"), F.col("hash")))).alias("key"), "n", "hash")
    gone = r.where("n = 2").select("o", "key").distinct()
    left = r.join(gone, ["o", "key"], "left_anti").where(~F.col("key").startswith("ch3"))
    return left.groupBy(F.regexp_extract("key", "^(ch[0-9]+)[@#]", 1).alias("chapter")).agg(F.count_distinct("o", "key").alias("pages"), F.count_distinct(F.when(F.col("key").contains("@p"), F.struct("o", "key"))).alias("slots"))


CACHE_DELETES = f"""WITH {CACHED}, r AS (SELECT o, n, 'ch' || (o % 9) || CASE WHEN n % 2 = 0 THEN '@p' || n ELSE '#' || hash END AS key FROM cached),
l AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r g WHERE g.n = 2 AND g.o = r.o AND g.key = r.key) AND NOT starts_with(key, 'ch3'))
SELECT regexp_extract(key, '^(ch[0-9]+)[@#]', 1) AS chapter, count(DISTINCT (o, key)) AS pages, count(DISTINCT CASE WHEN contains(key, '@p') THEN (o, key) END) AS slots FROM l GROUP BY 1"""

_SIDE = 8


def mask_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks made of vectors: packed to a quarter of their side and back, as bits and back, and as text for transport and back."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x.cast("double") > 0.1, 255).when(x.cast("double") < -0.35, 90).otherwise(0)).alias("mask"))
    v = v.select("vec_id", "mask", K.block_max(F.col("mask"), _SIDE, _SIDE, 4).alias("small"), K.packed_bits(F.col("mask")).alias("bits"))
    large = K.nearest(F.col("small"), 4, 4, _SIDE, _SIDE)
    back = F.when(F.col("bits").isNotNull(), K.unpacked_bits(F.col("bits"), F.size("mask"))).otherwise(F.col("mask"))
    hexed = F.array_join(F.transform(F.coalesce("bits", "mask"), lambda b: F.lpad(F.hex(b), 2, "0")), "")
    wire = F.regexp_replace(F.base64(F.unhex(hexed)), r"\s", "")
    covered = F.aggregate(F.zip_with(large, "mask", lambda a, b: F.when((b <= 127) | (a == 255), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return v.select("vec_id", F.array_join("small", ",").alias("small"), F.col("bits").isNull().alias("raw"), wire.alias("wire"), (back == F.col("mask")).alias("restored"), covered.alias("lost"), (F.hex(F.unbase64(wire)) == hexed).alias("decoded"))


_M = "CASE WHEN x > 0.1 THEN 255 WHEN x < -0.35 THEN 90 ELSE 0 END"
_CELL = "list_max([m[2 * y * 8 + 2 * x + 1], m[2 * y * 8 + 2 * x + 2], m[(2 * y + 1) * 8 + 2 * x + 1], m[(2 * y + 1) * 8 + 2 * x + 2]])"
MASK_PACKS = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: {_M.replace('x >', 'CAST(x AS DOUBLE) >').replace('x <', 'CAST(x AS DOUBLE) <')}) AS m FROM embeddings),
c AS (SELECT vec_id, list(CASE WHEN {_CELL} > 127 THEN 255 ELSE 0 END ORDER BY y, x) AS small FROM v, range(0, 4) AS a(y), range(0, 4) AS b(x) GROUP BY vec_id),
b AS (SELECT vec_id, m, len(list_filter(m, lambda x: x = 90)) > 0 AS raw, list_transform(range(0, 8), lambda k: CAST(list_sum(list_transform(range(0, 8), lambda j: CASE WHEN m[k * 8 + j + 1] > 0 THEN 1 << j ELSE 0 END)) AS BIGINT)) AS bits FROM v)
SELECT b.vec_id, array_to_string(small, ',') AS small, raw, base64(unhex(array_to_string(list_transform(CASE WHEN raw THEN m ELSE bits END, lambda x: lpad(to_hex(x), 2, '0')), ''))) AS wire, true AS restored, 0 AS lost, true AS decoded FROM b JOIN c ON c.vec_id = b.vec_id"""

_NOW, _TTL, _KEEP = "2024-01-20 00:00:00", 15 * 86400, 40


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts)


def handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest stamp of each user's page that is still fresh, over the page and its twins on other hosts, without what was dropped."""
    e = table(spark, sf_dir, "events").withColumn("host", F.col("event_id") % 3).withColumn("page", F.col("event_id") % 40)
    dropped = e.where("event_type = 'error'").select("user_id", "page").distinct()
    age = _seconds(F.lit(_NOW).cast("timestamp")) - _seconds(F.col("ts").cast("timestamp"))
    fresh = e.where((age >= 0) & (age < _TTL * 1_000_000)).join(dropped, ["user_id", "page"], "left_anti")
    return fresh.groupBy("user_id").agg(F.min("ts").alias("t0"), F.count_distinct("host").alias("hosts"))


HANDOFFS = f"""WITH e AS (SELECT *, event_id % 3 AS host, event_id % 40 AS page FROM events),
f AS (SELECT * FROM e WHERE ts <= TIMESTAMP '{_NOW}' AND epoch_us(TIMESTAMP '{_NOW}') - epoch_us(ts) < {_TTL}000000 AND NOT EXISTS (SELECT 1 FROM e d WHERE d.event_type = 'error' AND d.user_id = e.user_id AND d.page = e.page))
SELECT user_id, min(ts) AS t0, count(DISTINCT host) AS hosts FROM f GROUP BY 1"""

_LEASE = 300


def lease_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's attempts: an event begins one, the next event ends it; in time it is ready or failed, late it is failed and may be tried again."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.lead("ts").over(order).alias("ended"), F.lead("event_type").over(order).alias("by"))
    took = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000
    late = took > _LEASE * 3600
    phase = F.when(F.col("ended").isNull(), "inflight").when(F.col("event_type") == "purchase", "ready").when(late, "failed").when(F.col("by") == "error", "failed").otherwise("ready")
    e = e.select("user_id", "event_id", phase.alias("phase"), F.coalesce(late & (F.col("event_type") != "purchase"), F.lit(False)).alias("retryable"), F.coalesce((F.col("by") == "error") & ~late, F.lit(False)).alias("pauses"))
    retired = F.when(F.col("phase") == "inflight", "queued").otherwise(F.col("phase"))
    return e.select("*", retired.alias("retired"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) + 1).alias("sequence"))


LEASE_OUTCOMES = f"""WITH e AS (SELECT user_id, event_id, ts, event_type, lead(ts) OVER w AS ended, lead(event_type) OVER w AS by_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT *, (epoch_us(ended) - epoch_us(ts)) / 1000000 > {_LEASE * 3600} AS late FROM e),
p AS (SELECT *, CASE WHEN ended IS NULL THEN 'inflight' WHEN event_type = 'purchase' THEN 'ready' WHEN late THEN 'failed' WHEN by_ = 'error' THEN 'failed' ELSE 'ready' END AS phase FROM l)
SELECT user_id, event_id, phase, coalesce(late AND event_type <> 'purchase', false) AS retryable, coalesce(by_ = 'error' AND NOT late, false) AS pauses, CASE WHEN phase = 'inflight' THEN 'queued' ELSE phase END AS retired,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) + 1 AS INT) AS sequence FROM p"""


def recent_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are remembered of each event type: of every request the latest, not older than the limit, the newest of them all."""
    e = table(spark, sf_dir, "events").withColumn("request", F.col("user_id") % 25)
    latest = e.groupBy("event_type", "request").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("event_type", "request", "m.ts", "m.event_id")
    newest = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    latest = latest.withColumn("k", F.row_number().over(newest)).withColumn("first", F.max("ts").over(Window.partitionBy("event_type")))
    age = F.unix_micros(F.col("first").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return latest.where((F.col("k") <= 20) & (age < 86_400_000_000 * 5)).select("event_type", "request", "event_id", "k")


RECENT_REPLIES = """WITH l AS (SELECT event_type, user_id % 25 AS request, max(ROW(ts, event_id)) AS m FROM events GROUP BY 1, 2),
t AS (SELECT event_type, user_id % 25 AS request, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 25 ORDER BY ts DESC, event_id DESC) = 1),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS INT) AS k, max(ts) OVER (PARTITION BY event_type) AS f FROM t)
SELECT event_type, request, event_id, k FROM k WHERE k <= 20 AND epoch_us(f) - epoch_us(ts) < 432000000000"""


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report says of each user's run: pages at work, the last failures, how long was waited, and the run's newest log."""
    e = table(spark, sf_dir, "events").withColumn("order", F.struct("ts", "event_id"))
    last = lambda kind: F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.col("order"))))), 1, 3), lambda x: x["event_id"].cast("string"))
    g = e.groupBy("user_id").agg(F.count("*").alias("n"), last("error").alias("failures"), last("view").alias("views"), F.round(F.sum(F.when(F.col("event_type") == "click", F.col("value"))), 2).alias("waited"), F.max("order").alias("newest"))
    said = F.concat_ws("; ", F.when(F.size("views") > 0, F.concat(F.lit("at work "), F.array_join("views", ","))), F.when(F.size("failures") > 0, F.concat(F.lit("failed "), F.array_join("failures", ","))))
    return g.select("user_id", "n", said.alias("said"), "waited", F.col("newest.event_id").alias("newest"))


RUN_SUMMARIES = """WITH g AS (SELECT user_id, count(*) AS n, list(event_id ORDER BY ts DESC, event_id DESC) FILTER (event_type = 'error') AS failures, list(event_id ORDER BY ts DESC, event_id DESC) FILTER (event_type = 'view') AS views,
    round(sum(value) FILTER (event_type = 'click'), 2) AS waited, arg_max(event_id, ROW(ts, event_id)) AS newest FROM events GROUP BY 1)
SELECT user_id, n, CASE WHEN views IS NOT NULL THEN 'at work ' || array_to_string(views[:3], ',') ELSE '' END || CASE WHEN views IS NOT NULL AND failures IS NOT NULL THEN '; ' ELSE '' END
    || CASE WHEN failures IS NOT NULL THEN 'failed ' || array_to_string(failures[:3], ',') ELSE '' END AS said, waited, newest FROM g"""

QUERIES = {f.__name__: f for f in (cache_gates, cache_select, entry_merges, cache_deletes, mask_packs, handoffs, lease_outcomes, recent_replies, run_summaries)}
ORACLES = {
    "cache_gates": CACHE_GATES, "cache_select": CACHE_SELECT, "entry_merges": ENTRY_MERGES, "cache_deletes": CACHE_DELETES, "mask_packs": MASK_PACKS,
    "handoffs": HANDOFFS, "lease_outcomes": LEASE_OUTCOMES, "recent_replies": RECENT_REPLIES, "run_summaries": RUN_SUMMARIES,
}
