"""Tolerant parsing of region markup: elements that are closed, self-closing or left open, and what counts as kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.sources.tables import table

ELEMENT, KEEP, EMPTYISH = T.ELEMENT, T.KEEP, T.EMPTYISH


def attribute(attrs: Column, name: str) -> Column:
    return F.regexp_extract(attrs, T.bounded(rf'(?i)\b{name}\s*=\s*"([^"]*)"'), 1)


def _elements(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """df without text, one row an element: pos, attrs and content."""
    rest = [c for c in df.columns if c != text]
    e = df.select(*rest, F.posexplode(F.regexp_extract_all(text, F.lit(T.bounded(pattern)), F.lit(0))).alias("pos", "e"))
    name = F.regexp_extract("e", "^<([a-zA-Z]+)", 1)
    e = e.withColumn("attrs", F.regexp_extract("e", T.bounded(r"^<[a-zA-Z]+\b([^>]*?)/?>"), 1))
    return e.withColumn("content", F.trim(F.regexp_replace(F.regexp_replace("e", T.bounded(r"^<[a-zA-Z]+\b[^>]*>"), ""), F.concat(F.lit("(?i)</"), name, F.lit(T.bounded(r"\b[^>]*>$"))), ""))).drop("e")


def _given(name: str) -> Column:
    return F.nullif(F.trim(attribute(F.col("attrs"), name)), F.lit(""))


def gender(word: Column) -> Column:
    """M, F or ? of free text; the words for M are looked for first."""
    w = F.lower(F.coalesce(word, F.lit("")))
    return F.when((w == "m") | w.rlike("male|ชาย|ผู้ชาย"), "M").when((w == "f") | w.rlike("female|หญิง|ผู้หญิง"), "F").otherwise("?")


def parsed(df: DataFrame, text: str, expected: str) -> DataFrame:
    """The other columns of df with one row a region: n from 1 to expected, its source, its speaker by id or by look, gender and name, and
    the translation, "keep" where nothing is said."""
    rest = [c for c in df.columns if c not in (text, expected)]
    e = _elements(df, text, ELEMENT)
    e = e.withColumn("n", attribute(F.col("attrs"), "n").try_cast("int")).where(F.col("n").between(1, F.col(expected)))
    spk, keep = _given("spk"), T.kept(F.col("attrs"), F.col("content"))
    known = spk.rlike(r"(?i)^(c[0-9]+|new)$")
    who = F.when(known & (F.lower(spk) != "new"), F.lower(spk))
    look = F.when(spk.isNotNull(), F.when(known, F.coalesce(_given("desc"), F.lit(""))).otherwise(spk))
    return e.select(*rest, "pos", "n", F.trim(attribute(F.col("attrs"), "src")).alias("source"), who.alias("spk"), look.alias("look"), F.when(spk.isNotNull(), gender(_given("g"))).alias("gender"), F.when(spk.isNotNull(), _given("name")).alias("name"), F.when(keep, "keep").otherwise(F.col("content")).alias("translation"))


# How extra regions and mentions may be written.
EXTRA = r"(?i)<extra\b[^>]*?>[\s\S]*?</extra\b[^>]*>|<extra\b[^>]*?>[^\n<]*"
MENTION = r"(?i)<m\b[^>]*?/>|<m\b[^>]*?>[\s\S]*?</m\s*>"


def extras(df: DataFrame, text: str) -> DataFrame:
    """Regions that a reply adds: four coordinates and a text; others are left out."""
    rest = [c for c in df.columns if c != text]
    e = _elements(df, text, EXTRA)
    xs = F.transform(F.split(attribute(F.col("attrs"), "x"), ","), lambda x: F.trim(x).try_cast("double"))
    e = e.withColumn("xs", xs).where((F.size("xs") == 4) & F.forall("xs", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.col("content") != ""))
    return e.select(*rest, "pos", *[F.col("xs")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], F.col("content").alias("translation"))


def mentions(df: DataFrame, text: str) -> DataFrame:
    """People that a reply names or gives orders about; those without a name and an id are left out."""
    rest = [c for c in df.columns if c != text]
    e = _elements(df, text, MENTION).where(_given("name").isNotNull() | _given("id").isNotNull())
    short = lambda c, n: F.substring(c, 1, n)
    return e.select(
        *rest, "pos", _given("id").alias("id"), _given("name").alias("name"), _given("full").alias("full"), gender(_given("g")).alias("gender"), short(F.col("content"), 160).alias("role"), _given("sameAs").alias("same_as"),
        F.lower(_given("correct")).alias("correct"), _given("now").alias("now"), short(_given("why"), 160).alias("why"), short(_given("note"), 120).alias("note"),
    )


def parse_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of each conversation's turns, written four ways, and parsed; the last turn's number is out of range."""
    c = table(spark, sf_dir, "conversations").withColumn("line", F.regexp_replace(F.coalesce("text", F.lit("")), "[\n<>]", " "))
    n = (F.col("turn") + 1).cast("string")
    element = F.when(F.col("turn") % 4 == 0, F.concat(F.lit('<r n="'), n, F.lit('" spk="C1" src="a b" g="female">'), "line", F.lit("</r>"))).when(F.col("turn") % 4 == 1, F.concat(F.lit('<r n="'), n, F.lit('" spk="new" desc="tall" name="Bo"/>'), "line")).when(F.col("turn") % 4 == 2, F.concat(F.lit('<r n="'), n, F.lit('" keep="true"/>'))).otherwise(F.concat(F.lit('<R n="'), n, F.lit('" spk="a girl" g="f"/>'), "line"))
    r = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", element.alias("e")))), lambda x: x["e"]), "\n").alias("reply"), (F.count("*") - 1).alias("expected"))
    return parsed(r, "reply", "expected")


_SQL_SILENT = rf"regexp_matches(content, '{KEEP}') OR content = '' OR regexp_matches(content, '{EMPTYISH}') OR regexp_matches(content, '(?i){T.META_NO_TEXT}')"
PARSE_REPLIES = rf"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[\n<>]', ' ', 'g')) AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) - 1 AS expected FROM conversations)
SELECT conv_id, CAST(pos AS INT) AS pos, CAST(turn + 1 AS INT) AS n, CASE WHEN turn % 4 = 0 THEN 'a b' ELSE '' END AS source, CASE WHEN turn % 4 = 0 THEN 'c1' END AS spk, ['', 'tall', NULL, 'a girl'][CAST(turn % 4 + 1 AS INT)] AS look,
    ['M', '?', NULL, 'F'][CAST(turn % 4 + 1 AS INT)] AS gender, CASE WHEN turn % 4 = 1 THEN 'Bo' END AS name, CASE WHEN turn % 4 = 2 OR {_SQL_SILENT} THEN 'keep' ELSE content END AS translation FROM c WHERE turn + 1 <= expected"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with extra regions and mentions, one a turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\n<>\"]", " ")).alias("line"))
    t = F.col("turn").cast("string")
    extra = F.concat(F.lit('<extra n="new" x="'), t, F.lit(", 2,30,"), F.when(F.col("turn") % 3 == 2, "x").otherwise("40.5"), F.lit('">'), "line", F.when(F.col("turn") % 2 == 0, "</extra>").otherwise("\n"))
    order = F.concat(F.lit('<m id="c'), t, F.lit('" sameAs="c9"/><m name=" Ada " full="Ada B" g="m">'), F.substring("line", 1, 30), F.lit('</m ><m g="F">nobody</m><m name="Bo" correct="Gender" now="F" why="'), "line", F.lit('" note=""/>'))
    return c.select("conv_id", "turn", F.concat(extra, order).alias("reply"))


def parse_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra regions of replies, closed or left open."""
    return extras(_notes(spark, sf_dir), "reply")


_SQL_LINE = r"""c AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[\n<>"]', ' ', 'g')) AS line FROM conversations)"""
PARSE_EXTRAS = f"WITH {_SQL_LINE} SELECT conv_id, turn, CAST(0 AS INT) AS pos, CAST(turn AS DOUBLE) AS x1, 2.0::DOUBLE AS y1, 30.0::DOUBLE AS x2, 40.5::DOUBLE AS y2, line AS translation FROM c WHERE turn % 3 <> 2 AND line <> ''"


def parse_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions and orders of replies."""
    return mentions(_notes(spark, sf_dir), "reply")


PARSE_MENTIONS = f"""WITH {_SQL_LINE}
SELECT conv_id, turn, CAST(0 AS INT) AS pos, 'c' || turn AS id, NULL AS name, NULL AS "full", '?' AS gender, '' AS role, 'c9' AS same_as, NULL AS correct, NULL AS now, NULL AS why, NULL AS note FROM c
UNION ALL SELECT conv_id, turn, CAST(1 AS INT), NULL, 'Ada', 'Ada B', 'M', trim(substr(line, 1, 30)), NULL, NULL, NULL, NULL, NULL FROM c
UNION ALL SELECT conv_id, turn, CAST(3 AS INT), NULL, 'Bo', NULL, '?', '', NULL, 'gender', 'F', nullif(substr(line, 1, 160), ''), NULL FROM c"""

QUERIES = {"parse_replies": parse_replies, "parse_extras": parse_extras, "parse_mentions": parse_mentions}
ORACLES = {"parse_replies": PARSE_REPLIES, "parse_extras": PARSE_EXTRAS, "parse_mentions": PARSE_MENTIONS}
