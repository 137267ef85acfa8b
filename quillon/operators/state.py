"""Keyed state in batch form: caches, ledgers, logs, progress, cool-downs, plans and conversation context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.tables import table

LRU_PAGES, PARTIALS, BYTES = 12, 5, 600.0
LAST_PAIRS = 3
COOLDOWN_S, PARKED_AFTER = 60, 3
CHUNK = 3
SEAM_GAP = 40


def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a grouped LRU cache keeps, one cache a user: rows of the current epoch; of whole pages the latest LRU_PAGES; of partial rows the
    latest PARTIALS; of those, latest first, what fits into BYTES. An event's number is its page, signups are of an older epoch, small ones are partial."""
    page = F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(-1))
    e = table(spark, sf_dir, "events").select("user_id", page.alias("page"), "event_id", "ts", "value", (F.col("value") < 15).alias("partial")).where("event_type <> 'signup'")
    cache = Window.partitionBy("user_id")
    full = e.where("NOT partial").groupBy("user_id", "page").agg(F.max("ts").alias("atime"), F.sum("value").alias("bytes"), F.count("*").alias("n")).withColumn("event_id", F.lit(-1).cast("bigint"))
    full = full.withColumn("k", F.row_number().over(cache.orderBy(F.desc("atime"), "page"))).where(F.col("k") <= LRU_PAGES)
    part = e.where("partial").select("user_id", "page", F.col("ts").alias("atime"), F.col("value").alias("bytes"), F.lit(1).cast("bigint").alias("n"), "event_id")
    part = part.withColumn("k", F.row_number().over(cache.orderBy(F.desc("atime"), "event_id"))).where(F.col("k") <= PARTIALS)
    left = full.unionByName(part)  # LRU_PAGES + PARTIALS rows a cache
    newest = cache.orderBy(F.desc("atime"), "page", "event_id")
    kept = left.withColumn("total", F.round(F.sum("bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0)), 4)).where(F.col("total") <= BYTES)
    return kept.select("user_id", "page", "event_id", "n", F.round("bytes", 4).alias("bytes"))


LRU_EVICT = f"""WITH e AS (SELECT user_id, coalesce(TRY_CAST(props ->> '$.k' AS BIGINT), -1) AS page, event_id, ts, value, value < 15 AS partial FROM events WHERE event_type <> 'signup'),
f AS (SELECT user_id, page, max(ts) AS atime, sum(value) AS bytes, count(*) AS n, CAST(-1 AS BIGINT) AS event_id FROM e WHERE NOT partial GROUP BY user_id, page
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, page) <= {LRU_PAGES}),
p AS (SELECT user_id, page, ts AS atime, value AS bytes, CAST(1 AS BIGINT) AS n, event_id FROM e WHERE partial QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= {PARTIALS}),
u AS (SELECT * FROM f UNION ALL BY NAME SELECT * FROM p),
t AS (SELECT *, round(sum(bytes) OVER (PARTITION BY user_id ORDER BY atime DESC, page, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM u)
SELECT user_id, page, event_id, n, round(bytes, 4) AS bytes FROM t WHERE total <= {BYTES}"""


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of each key after all its writes: the latest full row once there is one, else the latest partial; a partial write after
    a full one only renews the access time."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", F.col("event_type").isin("view", "error").alias("partial"))
    g = e.groupBy("user_id").agg(
        F.max("ts").alias("atime"),
        F.max_by(F.when(~F.col("partial"), F.col("event_id")), F.when(~F.col("partial"), F.struct("ts", "event_id"))).alias("full_id"),
        F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"),
        F.count("*").alias("writes"),
    )
    return g.select("user_id", F.coalesce("full_id", "last_id").alias("event_id"), F.col("full_id").isNull().alias("partial"), "atime", "writes")


UPSERT_MERGE = """WITH e AS (SELECT *, event_type IN ('view', 'error') AS partial FROM events)
SELECT user_id, coalesce(arg_max(event_id, ROW(ts, event_id)) FILTER (NOT partial), arg_max(event_id, ROW(ts, event_id))) AS event_id,
    count(*) FILTER (NOT partial) = 0 AS partial, max(ts) AS atime, count(*) AS writes FROM e GROUP BY user_id"""


def cache_miss_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a lookup for an order misses: the first gate that fails, over a cache of some orders' lines."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_returnflag").alias("flag"), F.max("l_quantity").alias("q"))
    reason = F.when(F.col("n").isNull(), "absent").when(F.col("flag") == "R", "fingerprint").when(F.col("q") > 48, "dims").when(F.col("o_orderpriority") == "5-LOW", "splitgen").when(F.col("n") == 1, "mask").when(F.col("o_orderstatus") == "P", "partial")
    return o.join(c, "o_orderkey", "left").groupBy(F.coalesce(reason, F.lit("hit")).alias("reason")).agg(F.count("*").alias("n_orders"))


CACHE_MISS_REASON = """WITH c AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, max(l_returnflag) AS flag, max(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT CASE WHEN n IS NULL THEN 'absent' WHEN flag = 'R' THEN 'fingerprint' WHEN q > 48 THEN 'dims' WHEN o_orderpriority = '5-LOW' THEN 'splitgen' WHEN n = 1 THEN 'mask' WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'hit' END AS reason,
    count(*) AS n_orders FROM orders LEFT JOIN c USING (o_orderkey) GROUP BY 1"""


def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds that each user spent in each stage: from an event to the next of another stage, purchases ending it."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(order)).where("before IS NULL OR before <> event_type")
    e = e.withColumn("next_ts", F.lead("ts").over(order)).where("next_ts IS NOT NULL AND event_type <> 'purchase'")
    return e.groupBy("user_id", F.col("event_type").alias("stage")).agg(F.sum(F.expr("timestampdiff(MICROSECOND, ts, next_ts)")).alias("us"), F.count("*").alias("visits"))


STAGE_DURATIONS = """WITH e AS (SELECT * FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type),
n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM e)
SELECT user_id, event_type AS stage, CAST(sum(date_diff('microsecond', ts, next_ts)) AS BIGINT) AS us, count(*) AS visits FROM n WHERE next_ts IS NOT NULL AND event_type <> 'purchase' GROUP BY ALL"""


def log_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of known kinds with whitelisted, clamped fields."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "error", "purchase"))
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return e.select("event_id", F.col("event_type").alias("kind"), F.least(F.greatest(F.floor("value").cast("bigint"), F.lit(0)), F.lit(1_000_000)).alias("ms"), F.when(k.between(10, 59), k * 10).alias("status"))


LOG_SANITIZE = """SELECT event_id, event_type AS kind, least(greatest(CAST(floor(value) AS BIGINT), 0), 1000000) AS ms,
    CASE WHEN TRY_CAST(props ->> '$.k' AS BIGINT) BETWEEN 10 AND 59 THEN TRY_CAST(props ->> '$.k' AS BIGINT) * 10 END AS status
FROM events WHERE event_type IN ('click', 'view', 'error', 'purchase')"""


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a JSON counter by user, beside the error kinds it stands for."""
    e = table(spark, sf_dir, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)))
    status = 400 + F.col("k")
    kind = F.when(F.col("event_type") != "error", None).when(status.isin(401, 402, 403, 404), "auth").when(status == 429, "ratelimit").when(status >= 480, "server").otherwise("parse")
    e = e.withColumn("kind", kind)
    return e.groupBy("user_id").agg(F.sum("k").alias("tokens"), *[F.count_if(F.col("kind") == x).alias(f"n_{x}") for x in ("auth", "ratelimit", "server", "parse")])


USAGE_TOTALS = """WITH e AS (SELECT user_id, event_type, coalesce(TRY_CAST(props ->> '$.k' AS BIGINT), 0) AS k FROM events),
f AS (SELECT *, CASE WHEN event_type <> 'error' THEN NULL WHEN 400 + k IN (401, 402, 403, 404) THEN 'auth' WHEN 400 + k = 429 THEN 'ratelimit' WHEN 400 + k >= 480 THEN 'server' ELSE 'parse' END AS kind FROM e)
SELECT user_id, CAST(sum(k) AS BIGINT) AS tokens, count(*) FILTER (kind = 'auth') AS n_auth, count(*) FILTER (kind = 'ratelimit') AS n_ratelimit, count(*) FILTER (kind = 'server') AS n_server, count(*) FILTER (kind = 'parse') AS n_parse FROM f GROUP BY user_id"""


def cooldown_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each failure: how many, when the key may be tried again, and whether it is parked; a purchase clears the key."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("round", F.sum((F.col("event_type") == "purchase").cast("int")).over(order)).where("event_type = 'error'")
    n = F.row_number().over(Window.partitionBy("user_id", "round").orderBy("ts", "event_id"))
    return e.select("event_id", "user_id", n.alias("n"), (F.col("ts") + F.expr(f"INTERVAL {COOLDOWN_S} SECONDS")).alias("next_ok"), (n >= PARKED_AFTER).alias("parked"))


COOLDOWN_STATE = f"""WITH e AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS round FROM events),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, round ORDER BY ts, event_id) AS INT) AS n FROM e WHERE event_type = 'error')
SELECT event_id, user_id, n, ts + INTERVAL {COOLDOWN_S} SECOND AS next_ok, n >= {PARKED_AFTER} AS parked FROM n"""


def progress_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that a fence accepts: those whose sequence is no lower than any before of the same run."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf_dir, "events").withColumn("sequence", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)))
    e = e.withColumn("highest", F.max("sequence").over(order)).where("highest IS NULL OR sequence >= highest")
    return e.select("event_id", "user_id", "sequence")


PROGRESS_DEDUPE = """WITH e AS (SELECT event_id, user_id, ts, coalesce(TRY_CAST(props ->> '$.k' AS BIGINT), 0) AS sequence FROM events),
h AS (SELECT *, max(sequence) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM e)
SELECT event_id, user_id, sequence FROM h WHERE highest IS NULL OR sequence >= highest"""


def ledger_replace_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger's last contribution by key, and how often it was replaced; errors delete."""
    e = table(spark, sf_dir, "events").withColumn("key", F.get_json_object("props", "$.k").try_cast("bigint"))
    g = e.groupBy("user_id", "key").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("last"), (F.count("*") - 1).alias("replaced"))
    return g.where("last.event_type <> 'error'").select("user_id", "key", F.col("last.event_id").alias("event_id"), F.col("last.value").alias("value"), "replaced")


LEDGER_REPLACE_EDITS = """SELECT user_id, key, event_id, value, replaced FROM (
    SELECT user_id, TRY_CAST(props ->> '$.k' AS BIGINT) AS key, event_id, event_type, value, count(*) OVER w - 1 AS replaced, row_number() OVER (w ORDER BY ts DESC, event_id DESC) AS k
    FROM events WINDOW w AS (PARTITION BY user_id, TRY_CAST(props ->> '$.k' AS BIGINT))) WHERE k = 1 AND event_type <> 'error'"""


def next_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first CHUNK open orders of each customer: urgent ones first, then by key."""
    due = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    order = Window.partitionBy("o_custkey").orderBy((F.col("o_orderpriority") == "1-URGENT").desc(), "o_orderkey")
    return due.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CHUNK).select("o_custkey", "o_orderkey", "rank")


NEXT_GROUP = f"""SELECT o_custkey, o_orderkey, CAST(k AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O') WHERE k <= {CHUNK}"""


def stacked_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's place when a conversation's turns are laid end to end."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.sum(n).over(order), F.lit(0)).alias("offset"), n.alias("n"))


STACKED_OFFSETS = """SELECT conv_id, turn, CAST(coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, length(coalesce(text, '')) AS n FROM conversations"""


def context_last_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn the LAST_PAIRS latest answered questions before it, as turn numbers."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("asked", (F.lag("role").over(order) == "user") & (F.col("role") == "assistant"))
    # Answers are numbered, so that each turn looks up a few numbers and no list grows with the conversation.
    c = c.withColumn("k", F.coalesce(F.sum(F.col("asked").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = c.select("conv_id", "turn", F.explode_outer(F.when(F.col("k") > 0, F.sequence(F.greatest(F.lit(1), F.col("k") - LAST_PAIRS + 1), F.col("k")))).alias("number"))
    answers = c.where("asked").select("conv_id", (F.col("k") + 1).alias("number"), F.col("turn").alias("answer"))
    found = wanted.join(answers, ["conv_id", "number"], "left").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("answer")).alias("past"))
    return found.select("conv_id", "turn", F.array_join(F.transform("past", lambda t: t.cast("string")), ",").alias("pairs"))


CONTEXT_LAST_PAIRS = f"""WITH c AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' AND role = 'assistant', false) AS asked FROM conversations)
SELECT a.conv_id, a.turn, coalesce(array_to_string(list_reverse(list(b.turn ORDER BY b.turn DESC)[1:{LAST_PAIRS}]), ','), '') AS pairs
FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.asked GROUP BY a.conv_id, a.turn"""


def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in requests of CHUNK, and the size that a failed request is halved to."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("chunk", F.floor((F.row_number().over(order) - 1) / CHUNK).cast("bigint"))
    n = F.count("*")
    return c.groupBy("conv_id", "chunk").agg(F.min("turn").alias("first_turn"), n.alias("n"), F.greatest(F.lit(1), F.floor(n / 2)).cast("bigint").alias("next_size"))


GREEDY_CHUNKS = f"""WITH c AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // {CHUNK} AS chunk FROM conversations)
SELECT conv_id, chunk, min(turn) AS first_turn, count(*) AS n, greatest(1, count(*) // 2) AS next_size FROM c GROUP BY ALL"""


def missing_rows_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two answers for the same rows made one: labels first, documents for those that labels miss."""
    first = table(spark, sf_dir, "labels").select("doc_id", F.lit("labels").alias("leg"), F.col("quality").cast("bigint").alias("value"))
    rest = table(spark, sf_dir, "documents").join(first, "doc_id", "left_anti").select("doc_id", F.lit("documents").alias("leg"), F.col("n_chars").alias("value"))
    return first.unionByName(rest)


MISSING_ROWS_MERGE = """SELECT doc_id, 'labels' AS leg, CAST(quality AS BIGINT) AS value FROM labels
UNION ALL SELECT doc_id, 'documents', n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""


def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable id for each turn from the JSON of its ordered parts."""
    c = table(spark, sf_dir, "conversations")
    parts = F.concat(F.lit('["'), F.col("conv_id").cast("string"), F.lit('","'), F.col("turn").cast("string"), F.lit('","'), "role", F.lit('"]'))
    return c.select("conv_id", "turn", F.sha2(parts, 256).alias("request_id"))


REQUEST_IDS = """SELECT conv_id, turn, sha256('["' || conv_id || '","' || turn || '","' || role || '"]') AS request_id FROM conversations"""


def cap_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rosters of twenty neighbours capped at four rows: user rows always stay, else named ones before others and later before earlier."""
    c = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 20).alias("book"), "c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("user"), (F.col("c_acctbal") > 0).cast("int").alias("named"))
    order = Window.partitionBy("book").orderBy(F.desc("user"), F.desc("named"), F.desc("c_custkey"))
    return c.withColumn("k", F.row_number().over(order)).where("user OR k <= 4").select("book", "c_custkey")


CAP_BY_RANK = """SELECT c_custkey // 20 AS book, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_mktsegment = 'BUILDING' DESC, c_acctbal > 0 DESC, c_custkey DESC) AS k FROM customer)
WHERE c_mktsegment = 'BUILDING' OR k <= 4"""


def parse_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each page by name: how many open, and how many are closed."""
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(/?[a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag"))
    name = F.lower(F.regexp_replace("tag", "^/", ""))
    return p.groupBy("page_id", name.alias("name")).agg(F.count_if(~F.col("tag").startswith("/")).alias("n_open"), F.count_if(F.col("tag").startswith("/")).alias("n_closed"))


PARSE_MARKUP = """WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<(/?[a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)
SELECT page_id, lower(regexp_replace(tag, '^/', '')) AS name, count(*) FILTER (NOT starts_with(tag, '/')) AS n_open, count(*) FILTER (starts_with(tag, '/')) AS n_closed FROM t GROUP BY ALL"""

_F = [lru_evict, upsert_merge, cache_miss_reason, stage_durations, log_sanitize, usage_totals, cooldown_state, progress_dedupe, ledger_replace_edits, next_group, stacked_offsets, context_last_pairs, greedy_chunks, missing_rows_merge, request_ids, cap_by_rank, parse_markup]
QUERIES = {f.__name__: f for f in _F}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _F}
