"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every window of 8 words the smallest hash of its five 4-word grams is kept. Equal windows have equal minima, so joining the
minima of training and test texts finds every shared window, and with it every shared span of at least 8 words. A window that
meets one of the same minimum is extended to its 8 words and compared word by word. Test items of fewer words are one window
of their own length; their hashes join beside the minima.

The windows of the test items are broadcast if, counted first, they are `BROADCAST_BYTES` at most. Then texts are read once and
never shuffled: a window is built, met and compared in one stage, and only documents' counts and hits leave it. Beyond that
size the hashes meet by a shuffle, and texts follow for documents that share one.

Defined cases: null texts have no words; a document of no words is returned with zero hits; repeated rows are each returned, as are
rows that share a doc_id with different texts; null doc_ids are kept; items without words, or a null item_id, match nothing; items
with equal texts are all named; without items nothing is hit; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

WINDOW, GRAM = 8, 4
#: Most bytes of test items' windows that are broadcast.
BROADCAST_BYTES = 64 << 20
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATORS), "")


def gram_hashes(ws: Column) -> Column:
    """Hashes of all runs of GRAM words; the array has at least GRAM words."""
    return F.transform(F.sequence(F.lit(0), F.size(ws) - GRAM), lambda i: F.xxhash64(*[ws[i + j] for j in range(GRAM)]))


def minima(ws: Column, grams: Column) -> Column:
    """For every window its smallest gram hash; empty below WINDOW words."""
    span = range(WINDOW - GRAM + 1)
    own = F.transform(F.sequence(F.lit(0), F.size(ws) - WINDOW), lambda i: F.least(*[grams[i + j] for j in span]))
    return F.when(F.size(ws) >= WINDOW, own).otherwise(F.array().cast("array<bigint>"))


def short_hashes(ws: Column, length: int) -> Column:
    own = F.transform(F.sequence(F.lit(1), F.size(ws) - length + 1), lambda i: F.xxhash64(F.slice(ws, i, length)))
    return F.when(F.size(ws) >= length, own).otherwise(F.array().cast("array<bigint>"))


def window_text(ws: Column, at: Column, length: int | Column) -> Column:
    """The words of one window joined by a space, which no word contains; `at` counts from 0."""
    return F.array_join(F.slice(ws, at + 1, length), " ")


def _with_minima(df: DataFrame) -> DataFrame:
    df = df.withColumn("grams", F.when(F.size("ws") >= WINDOW, gram_hashes(F.col("ws"))))
    return df.withColumn("least", minima(F.col("ws"), F.col("grams")))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, length, hash and key (the window's text), one row a distinct window of an item."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    long = _with_minima(items.where(F.size("ws") >= WINDOW))
    rows = F.transform(F.sequence(F.lit(0), F.size("ws") - WINDOW), lambda i: F.struct(F.lit(WINDOW).alias("length"), F.col("least")[i].alias("hash"), window_text(F.col("ws"), i, WINDOW).alias("key")))
    long = long.select("item_id", F.inline(rows))
    short = items.where(F.size("ws") < WINDOW).select("item_id", F.size("ws").alias("length"), F.xxhash64("ws").alias("hash"), F.array_join("ws", " ").alias("key"))
    return long.unionByName(short).distinct()


def _places(worded: DataFrame, lengths: list[int]) -> DataFrame:
    """Per document one row with `at` -1, and one for each of its windows: at (the first word's place), length and hash."""

    def rows(length: int, hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: F.struct(i.alias("at"), F.lit(length).alias("length"), h.alias("hash")))

    itself = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("length"), F.lit(None).cast("bigint").alias("hash")))
    every = F.concat(itself, rows(WINDOW, F.col("least")), *[rows(n, short_hashes(F.col("ws"), n)) for n in lengths])
    # A column of its own, so that the rows are generated in compiled code, which doesn't copy the words for each of them. The
    # array is never empty; inline_outer keeps the optimizer from testing that with a filter that builds it a second time.
    return worded.select("doc_id", "text_hash", "ws", every.alias("every")).select("doc_id", "text_hash", "ws", F.inline_outer("every"))


def _in_one_pass(worded: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Documents and their hits; each window meets the broadcast ones of its hash and is compared with them at once."""
    places = _places(worded, lengths)
    windows = windows.select(F.col("hash").alias("h"), F.col("length").alias("l"), "key", "items")
    text = window_text(F.col("ws"), F.greatest("at", F.lit(0)), F.col("length"))
    # Written as two comparisons: an equality would become a join key, and the text would be built for every window.
    same = (F.col("hash") == F.col("h")) & (F.col("length") <= F.col("l")) & (F.col("length") >= F.col("l")) & (text <= F.col("key")) & (text >= F.col("key"))
    met = places.join(F.broadcast(windows), same, "left").where("at < 0 OR items IS NOT NULL")
    return met.select("doc_id", "text_hash", F.when(F.col("at") < 0, F.size("ws")).alias("n_words"), "at", "length", "items")


def _by_shuffle(worded: DataFrame, own: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for more windows than can be broadcast: hashes meet by a shuffle, then the texts of documents that share one."""
    found = F.array_distinct(F.concat("least", *[short_hashes(F.col("ws"), n) for n in lengths]))
    base = materialise(worded.select("doc_id", "text_hash", F.size("ws").alias("n_words"), found.alias("hashes")), "prints")
    kept = base.select("doc_id", "text_hash", F.explode("hashes").alias("hash")).distinct()
    shared = kept.join(windows.select("hash").distinct(), "hash").groupBy("doc_id", "text_hash").agg(F.collect_set("hash").alias("shared"))
    shared = shared.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), "shared")
    texts = own.join(shared, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th")))
    texts = _with_minima(texts.select("doc_id", "text_hash", words(F.col("text")).alias("ws"), "shared"))

    def extended(length: int, hashes: Column) -> Column:
        places = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains("shared", h), i)), lambda i: i.isNotNull())
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(length).alias("length"), window_text(F.col("ws"), i, length).alias("key")))

    spans = F.concat(extended(WINDOW, F.col("least")), *[extended(n, short_hashes(F.col("ws"), n)) for n in lengths])
    hits = texts.select("doc_id", "text_hash", F.inline(spans)).join(windows.select("length", "key", "items"), ["length", "key"])
    none = [F.lit(-1).alias("at"), F.lit(0).alias("length"), F.lit(None).cast("array<string>").alias("items")]
    hits = hits.select("doc_id", "text_hash", F.lit(None).cast("int").alias("n_words"), "at", "length", "items")
    return base.select("doc_id", "text_hash", "n_words", *none).unionByName(hits)  # repeated rows repeat their hits, which are sets later


def find_hits(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, and item_ids, the sorted ids (as strings) of items with an occurring window."""
    items = item_windows(benchmark).groupBy("length", "hash", "key").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    windows = materialise(items, "item-windows")
    size = F.length("key") + F.aggregate("items", F.lit(0), lambda n, i: n + F.length(i) + 24) + 64
    total = windows.agg(F.sum(size)).first()[0] or 0
    lengths = sorted(r[0] for r in windows.where(F.col("length") < WINDOW).select("length").distinct().collect())  # seven at most

    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    worded = _with_minima(own.withColumn("ws", words(F.col("text"))))
    met = _in_one_pass(worded, windows, lengths) if total <= broadcast_bytes else _by_shuffle(worded, own, windows, lengths)
    met = materialise(met, "hits")

    hits = met.where("at >= 0").groupBy("doc_id", "text_hash")
    hits = hits.agg(F.collect_set(F.struct("at", "length")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))))
    hits = hits.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), F.size(covered).cast("bigint").alias("n_hit"), F.array_sort("item_ids").alias("item_ids"))
    out = met.where("at < 0").select("doc_id", "text_hash", "n_words").join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th")), "left")
    return out.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "text_hash")


def op10_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all benchmark items in all documents."""
    hits = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("item_ids") >= 2).alias("contaminated"))
