"""Edits of people by key, registries of page addresses, scopes of books, and settings over defaults and presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import rules as L
from quillon.sources.tables import table

#: People that a book keeps, retired addresses that are remembered.
MOST_PEOPLE, RETIRED = 10, 50


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of books: scope (a segment of forty neighbours), at, id, look, name, gender."""
    c = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit(":"), F.floor(F.col("c_custkey") / 40)).alias("scope"), F.col("c_custkey").alias("at"), F.col("c_acctbal").alias("bal"))
    k = F.col("at")
    return c.select(
        "scope", "at", F.when(k % 3 != 0, F.concat(F.lit("c"), (k % 6).cast("string"))).alias("id"), F.concat(F.lit("look "), (k % 8).cast("string")).alias("look"),
        F.when(k % 4 != 0, F.concat(F.lit("N"), (k % 5).cast("string"))).alias("name"), F.when(k % 7 == 0, "F").otherwise("?").alias("gender"),
    )


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits by key: scoped, bare, by look, and by name; each with a gender and perhaps a name."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).where("k < 40")
    k = F.col("k")
    key = F.when(k % 4 == 0, F.concat(F.lit("BUILDING:"), (k % 25).cast("string"), F.lit("|c"), (k % 6).cast("string"))).when(k % 4 == 1, F.concat(F.lit("c"), (k % 6).cast("string"))).when(k % 4 == 2, F.concat(F.lit("look "), (k % 8).cast("string"))).otherwise(F.concat(F.lit("N"), (k % 5).cast("string")))
    return p.select(key.alias("key"), F.struct("k", F.when(k % 2 == 0, "M").otherwise("?").alias("gender"), F.when(k % 3 == 0, F.concat(F.lit("E"), k.cast("string"))).alias("name")).alias("e")).groupBy("key").agg(F.max("e").alias("e")).select("key", "e.*")


_BOOK = """people AS (SELECT c_mktsegment || ':' || (c_custkey // 40) AS scope, c_custkey AS at_, CASE WHEN c_custkey % 3 <> 0 THEN 'c' || (c_custkey % 6) END AS id, 'look ' || (c_custkey % 8) AS look,
    CASE WHEN c_custkey % 4 <> 0 THEN 'N' || (c_custkey % 5) END AS name, CASE WHEN c_custkey % 7 = 0 THEN 'F' ELSE '?' END AS gender FROM customer),
e0 AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'BUILDING:' || (p_partkey % 25) || '|c' || (p_partkey % 6) WHEN 1 THEN 'c' || (p_partkey % 6) WHEN 2 THEN 'look ' || (p_partkey % 8) ELSE 'N' || (p_partkey % 5) END AS key,
    CASE WHEN p_partkey % 2 = 0 THEN 'M' ELSE '?' END AS gender, CASE WHEN p_partkey % 3 = 0 THEN 'E' || p_partkey END AS name FROM part WHERE p_partkey < 40),
edits AS (SELECT * FROM e0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1)"""


def edited_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person with the edit of the scoped key, else the bare one, else of the look, else of the name; edits fill what they name."""
    p, e = _people(spark, sf_dir), _edits(spark, sf_dir)  # edits are as many as users made, far below a broadcast's bound; joins decide by size
    own = F.coalesce("id", "look")
    out = p.withColumn("own", own)
    for tier, key in enumerate((F.concat("scope", F.lit("|"), "own"), F.col("own"), F.when(F.col("own") != F.col("look"), F.col("look")), F.col("name"))):
        tiered = e.select(F.col("key").alias(f"key{tier}"), F.struct(F.lit(tier).alias("tier"), "gender", "name").alias(f"e{tier}"))
        out = out.withColumn(f"want{tier}", key).join(tiered, F.col(f"want{tier}") == F.col(f"key{tier}"), "left").drop(f"want{tier}", f"key{tier}")
    found = F.coalesce(*[F.col(f"e{t}") for t in range(4)])
    return out.select("scope", "at", found["tier"].alias("tier"), F.when(F.coalesce(found["gender"], F.lit("?")) != "?", found["gender"]).otherwise(F.col("gender")).alias("gender"), F.coalesce(found["name"], "name").alias("name"))


EDITED_PEOPLE = f"""WITH {_BOOK}, p AS (SELECT *, coalesce(id, look) AS own FROM people)
SELECT p.scope, p.at_ AS "at", CASE WHEN a.key IS NOT NULL THEN 0 WHEN b.key IS NOT NULL THEN 1 WHEN c.key IS NOT NULL THEN 2 WHEN d.key IS NOT NULL THEN 3 END AS tier,
    CASE WHEN coalesce(a.gender, b.gender, c.gender, d.gender, '?') <> '?' THEN coalesce(a.gender, b.gender, c.gender, d.gender) ELSE p.gender END AS gender,
    coalesce(CASE WHEN a.key IS NOT NULL THEN a.name WHEN b.key IS NOT NULL THEN b.name WHEN c.key IS NOT NULL THEN c.name ELSE d.name END, p.name) AS name
FROM p LEFT JOIN edits a ON a.key = p.scope || '|' || p.own LEFT JOIN edits b ON b.key = p.own LEFT JOIN edits c ON c.key = p.look AND p.own <> p.look LEFT JOIN edits d ON d.key = p.name"""

_BY = "struct<at:bigint,id:string,look:string,name:string,gender:string>"


def collapsed_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book after its rows of one look have become one, in order, with ids for those without one, and at most the limit of rows."""
    p = _people(spark, sf_dir)
    g = p.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("at", "id", "look", "name", "gender"))).alias("rows"))
    joined = lambda k, r: F.struct(k["at"].alias("at"), k["id"].alias("id"), k["look"].alias("look"), F.coalesce(r["name"], k["name"]).alias("name"), F.when(r["gender"] != "?", r["gender"]).otherwise(k["gender"]).alias("gender")).cast(_BY)
    step = lambda acc, r: F.when(F.exists(acc, lambda k: k["look"] == r["look"]), F.transform(acc, lambda k: F.when(k["look"] == r["look"], joined(k, r)).otherwise(k))).otherwise(F.array_append(acc, r.cast(_BY)))
    g = g.select("scope", F.aggregate("rows", F.array().cast(f"array<{_BY}>"), step).alias("rows"))
    top = F.coalesce(F.array_max(F.transform("rows", lambda r: F.regexp_extract(r["id"], "^c([0-9]+)$", 1).try_cast("int"))), F.lit(0))
    rank = lambda i: F.size(F.filter(F.slice("rows", 1, i + 1), lambda r: r["id"].isNull()))
    g = g.withColumn("top", top)
    named = F.transform("rows", lambda r, i: F.struct(F.coalesce(r["id"], F.concat(F.lit("c"), (F.col("top") + rank(i)).cast("string"))).alias("id"), r["look"].alias("look"), r["name"].alias("name"), r["gender"].alias("gender")))
    return g.select("scope", F.inline(F.slice(named, 1, MOST_PEOPLE)))


COLLAPSED_PEOPLE = f"""WITH {_BOOK}, l AS (SELECT scope, look, min(at_) AS first, arg_min(id, at_) FILTER (true) AS x, count(*) AS c,
    arg_max(name, at_) FILTER (name IS NOT NULL) AS name, coalesce(arg_max(gender, at_) FILTER (gender <> '?'), '?') AS gender FROM people GROUP BY 1, 2),
i AS (SELECT l.*, p.id FROM l JOIN people p ON p.scope = l.scope AND p.at_ = l.first),
n AS (SELECT *, coalesce(max(TRY_CAST(substr(id, 2) AS INT)) OVER (PARTITION BY scope), 0) AS top, sum(CASE WHEN id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY scope ORDER BY first) AS r, row_number() OVER (PARTITION BY scope ORDER BY first) AS k FROM i)
SELECT scope, coalesce(id, 'c' || CAST(top + r AS BIGINT)) AS id, look, name, gender FROM n WHERE k <= {MOST_PEOPLE}"""


def moved_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edits after bare keys of one book have been claimed by it and another book's have moved to a third; what is there already stays."""
    e = _edits(spark, sf_dir).select("key", "k")
    claim = F.when(F.col("key").rlike("^c[0-3]$"), F.concat(F.lit("BUILDING:0|"), "key"))
    move = F.when(F.col("key").startswith("BUILDING:4|"), F.concat(F.lit("BUILDING:8"), F.substring("key", 11, 100)))
    e = e.select(F.coalesce(claim, move, "key").alias("to"), (claim.isNotNull() | move.isNotNull()).alias("moved"), "key", "k")
    first = Window.partitionBy("to").orderBy("moved", "key")
    return e.withColumn("r", F.row_number().over(first)).where("r = 1").select(F.col("to").alias("key"), "k", "moved")


MOVED_EDITS = f"""WITH {_BOOK}, m AS (SELECT CASE WHEN regexp_matches(key, '^c[0-3]$') THEN 'BUILDING:0|' || key WHEN starts_with(key, 'BUILDING:4|') THEN 'BUILDING:8' || substr(key, 11) ELSE key END AS to_, key, k FROM edits)
SELECT to_ AS key, k, to_ <> key AS moved FROM m QUALIFY row_number() OVER (PARTITION BY to_ ORDER BY to_ <> key, key) = 1"""


def page_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that each address names: live ones first, then retired ones while they are remembered; each line of an order is a page with
    up to three addresses, and lines that came back retire theirs."""
    c = F.col
    p = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("page"), c("l_linenumber").alias("n"), (c("l_returnflag") == "R").alias("gone"), c("l_partkey").alias("p"), c("l_suppkey").alias("s"))
    alias = F.array(F.concat(F.lit("https://h/"), "p"), F.when(c("s") % 2 == 0, F.concat(F.lit("blob:"), (c("p") * 31 + c("s")).cast("string"))), F.when(c("p") % 3 == 0, F.concat(F.lit("blob:d"), c("s").cast("string"))))
    a = p.select("page", "n", "gone", F.explode(alias).alias("address")).where("address IS NOT NULL")
    live = a.where("NOT gone").groupBy("address").agg(F.max(F.struct("page", "n"))["page"].alias("page"), F.lit(0).alias("tier"))
    retired = a.where("gone AND address LIKE 'blob:%'").groupBy("address").agg(F.max(F.struct("page", "n")).alias("m")).orderBy(F.desc("m"), "address").limit(RETIRED)
    both = live.unionByName(retired.select("address", F.col("m.page").alias("page"), F.lit(1).alias("tier")))
    return both.groupBy("address").agg(F.min_by("page", "tier").alias("page"), F.min("tier").alias("tier"))


PAGE_REGISTRY = f"""WITH p AS (SELECT l_orderkey AS page, l_linenumber AS n, l_returnflag = 'R' AS gone, unnest(['https://h/' || l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN 'blob:' || (l_partkey * 31 + l_suppkey) END, CASE WHEN l_partkey % 3 = 0 THEN 'blob:d' || l_suppkey END]) AS address FROM lineitem),
l AS (SELECT address, arg_max(page, ROW(page, n)) AS page, 0 AS tier FROM p WHERE NOT gone AND address IS NOT NULL GROUP BY 1),
r AS (SELECT address, arg_max(page, ROW(page, n)) AS page, 1 AS tier FROM p WHERE gone AND starts_with(address, 'blob:') GROUP BY 1 ORDER BY max(ROW(page, n)) DESC, address LIMIT {RETIRED})
SELECT address, arg_min(page, tier) AS page, min(tier) AS tier FROM (SELECT * FROM l UNION ALL SELECT * FROM r) GROUP BY 1"""


def book_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book that each order's page belongs to, whether the context starts anew there, and how many books a customer sees."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4 != 0).alias("cross"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("id"), (F.col("o_custkey") % 7).cast("string"))).alias("series"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("/t"), (F.col("o_custkey") % 9).cast("string"))).alias("story"), F.concat(F.lit("ch"), (F.col("o_orderkey") % 11).cast("string")).alias("chapter"))
    scope = F.when(F.col("cross") & F.col("series").isNotNull(), F.concat(F.lit("book:"), "series")).when(F.col("cross") & F.col("story").isNotNull(), F.concat(F.lit("book:"), "story")).otherwise(F.concat(F.lit("chapter:"), "chapter"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = o.withColumn("scope", scope).withColumn("before", F.lag("chapter").over(order)).withColumn("scope_before", F.lag("scope").over(order))
    anew = F.coalesce(F.col("before") != F.col("chapter"), F.lit(True))
    kept = anew & F.col("cross") & F.col("scope").startswith("book:") & F.col("scope").eqNullSafe(F.col("scope_before"))
    return o.select("o_orderkey", "scope", anew.alias("anew"), kept.alias("keeps_people"))


BOOK_SCOPES = """WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 <> 0 AS cross_, CASE WHEN o_orderkey % 5 = 0 THEN 'id' || (o_custkey % 7) END AS series, CASE WHEN o_orderkey % 3 = 0 THEN '/t' || (o_custkey % 9) END AS story, 'ch' || (o_orderkey % 11) AS chapter FROM orders),
s AS (SELECT *, CASE WHEN cross_ AND series IS NOT NULL THEN 'book:' || series WHEN cross_ AND story IS NOT NULL THEN 'book:' || story ELSE 'chapter:' || chapter END AS scope FROM o),
l AS (SELECT *, lag(chapter) OVER w AS before, lag(scope) OVER w AS scope_before FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey, scope, coalesce(before <> chapter, true) AS anew, coalesce(before <> chapter, true) AND cross_ AND starts_with(scope, 'book:') AND scope IS NOT DISTINCT FROM scope_before AS keeps_people FROM l"""

# Settings with their default, least and greatest; choices with their default first; switches with their default.
NUMBERS = {"size": (10.0, 5.0, 60.0), "conf": (0.35, 0.0, 1.0), "pairs": (15.0, 0.0, 200.0)}
CHOICES = {"way": ("rtl", "ltr"), "fill": ("auto", "on", "off"), "engine": ("local", "cloud")}
PRESETS = {"fast": {"size": 5.0, "pairs": 0.0}, "best": {"size": 60.0, "pairs": 30.0, "conf": 0.2}}
#: Settings that a preset leaves to the reader.
OWN = ("way", "engine", "fill")


def _loaded(stored: Column, name: str) -> Column:
    """A setting as stored if it is of the right kind and in bounds, else its default."""
    value = F.get_json_object(stored, f"$.{name}")
    if name in NUMBERS:
        default, least, most = NUMBERS[name]
        number = value.try_cast("double")
        return F.coalesce(F.when((number >= least) & (number <= most), number), F.lit(default))
    return F.coalesce(F.when(value.isin(*CHOICES[name]), value), F.lit(CHOICES[name][0]))


def settings_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that each event stores: loaded, under a preset, which preset they are, what matters of them, and how pictures are filled."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    stored = F.concat(F.lit('{"size":'), k.cast("string"), F.lit(',"conf":'), (k / 50).cast("string"), F.lit(',"way":"'), F.when(k % 3 == 0, "ltr").otherwise("up"), F.lit('","fill":"'), F.when(k % 2 == 0, "on").otherwise("off"), F.lit('","engine":"'), F.when(k % 5 == 0, "cloud").otherwise("local"), F.lit('"}'))
    stored = F.when(F.col("event_id") % 6 == 0, F.lit('{"size":5,"pairs":0}')).otherwise(stored)
    names = [*NUMBERS, *CHOICES]
    e = e.select("event_id", stored.alias("stored")).select("event_id", *[_loaded(F.col("stored"), n).alias(n) for n in names])
    under = {n: F.lit(PRESETS["best"].get(n, NUMBERS[n][0])) if n in NUMBERS else F.col(n) for n in names}
    is_preset = lambda patch: F.forall(F.array(*[F.col(n) == patch.get(n, NUMBERS[n][0]) for n in NUMBERS]), lambda x: x)
    preset = F.when(is_preset(PRESETS["fast"]), "fast").when(is_preset(PRESETS["best"]), "best").otherwise("custom")
    fill = F.when(F.col("fill") == "off", "fill").when(F.col("engine") != "cloud", F.when(F.col("fill") == "on", "local").otherwise("fill")).otherwise("cloud")
    mark = F.md5(F.concat_ws("|", *[F.col(n).cast("string") for n in names]))
    return e.select("event_id", *names, (under["size"] + under["pairs"]).alias("best_sum"), preset.alias("preset"), fill.alias("filled"), mark.alias("mark"))


SETTINGS_RULES = """WITH e AS (SELECT event_id, TRY_CAST(props ->> '$.k' AS INT) AS k FROM events),
s AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 5.0 WHEN k BETWEEN 5 AND 60 THEN CAST(k AS DOUBLE) ELSE 10.0 END AS size, CASE WHEN event_id % 6 = 0 OR k / 50 > 1 THEN 0.35 ELSE k / 50 END AS conf, CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE 15.0 END AS pairs,
    CASE WHEN event_id % 6 <> 0 AND k % 3 = 0 THEN 'ltr' ELSE 'rtl' END AS way, CASE WHEN event_id % 6 = 0 THEN 'auto' WHEN k % 2 = 0 THEN 'on' ELSE 'off' END AS fill, CASE WHEN event_id % 6 <> 0 AND k % 5 = 0 THEN 'cloud' ELSE 'local' END AS engine FROM e)
SELECT *, 90.0 AS best_sum, CASE WHEN size = 5 AND pairs = 0 AND conf = 0.35 THEN 'fast' WHEN size = 60 AND pairs = 30 AND conf = 0.2 THEN 'best' ELSE 'custom' END AS preset,
    CASE WHEN fill = 'off' THEN 'fill' WHEN engine <> 'cloud' THEN CASE WHEN fill = 'on' THEN 'local' ELSE 'fill' END ELSE 'cloud' END AS filled, md5(concat_ws('|', size, conf, pairs, way, fill, engine)) AS mark FROM s"""


def site_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's orders the sites in order without empties and repeats, their grant patterns, and pages that wait outside a list."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 6 == 5, "").otherwise(F.concat(F.lit("https://S"), (F.col("o_orderkey") % 4).cast("string"), F.lit(".example.com:81/x"))).alias("url"))
    g = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "url"))), lambda x: x["url"]).alias("urls"))
    sites = F.array_distinct(F.filter("urls", lambda u: u != ""))
    return g.select("o_custkey", F.array_join(sites, " ").alias("sites"), F.array_join(F.array_distinct(F.filter(F.transform("urls", L.host_pattern), lambda p: p.isNotNull())), " ").alias("patterns"), F.size(F.filter("urls", lambda u: ~u.contains("S1") & (u != ""))).alias("waiting"))


SITE_LISTS = """WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE 'S' || (o_orderkey % 4) END AS s FROM orders),
f AS (SELECT o_custkey, s, min(o_orderkey) AS first, count(*) AS n FROM o WHERE s IS NOT NULL GROUP BY 1, 2),
g AS (SELECT o_custkey, string_agg('https://' || s || '.example.com:81/x', ' ' ORDER BY first) AS sites, string_agg('https://' || lower(s) || '.example.com/*', ' ' ORDER BY first) AS patterns, CAST(sum(CASE WHEN s <> 'S1' THEN n ELSE 0 END) AS INT) AS waiting FROM f GROUP BY 1)
SELECT c.o_custkey, coalesce(sites, '') AS sites, coalesce(patterns, '') AS patterns, coalesce(waiting, 0) AS waiting FROM (SELECT DISTINCT o_custkey FROM orders) c LEFT JOIN g ON g.o_custkey = c.o_custkey"""

QUERIES = {f.__name__: f for f in (edited_people, collapsed_people, moved_edits, page_registry, book_scopes, settings_rules, site_lists)}
ORACLES = {
    "edited_people": EDITED_PEOPLE, "collapsed_people": COLLAPSED_PEOPLE, "moved_edits": MOVED_EDITS, "page_registry": PAGE_REGISTRY, "book_scopes": BOOK_SCOPES,
    "settings_rules": SETTINGS_RULES, "site_lists": SITE_LISTS,
}
