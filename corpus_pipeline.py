"""From documents to packed training windows: five operators of quillon.llm, each on all that the one before it kept.

Defined cases, of every stage: null doc_ids and null or empty texts are kept unless the stage's own test rejects them; repeated rows
are judged alike, and all of them kept or dropped; an empty table gives an empty one; columns beyond those of documents are
passed on as they are, whatever their names, until the last stage, which returns columns of its own; very long texts are judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, minhash, packing, pii, toxicity
from quillon.llm.common import discard, fresh, materialise, table

#: SQL can't express the first stage's decoder and fitted scorer; tests/llm/test_pipeline_kept.py holds every stage and run() to
#: plain versions on planted documents.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half, by a scorer fitted on labels of the documents given; without labels all of them."""
    scorer, into = toxicity.fit(docs, table(spark, sf_dir, "labels")), fresh(docs, "toxicity")
    return toxicity.score(docs, scorer, into=into).where(F.col(into) < 0.5).drop(into)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near duplicates; rows without doc_id stay, and so do rows that share the id."""
    own = fresh(docs, "gone_id")
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[own], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold windows of at most one benchmark item; equal items count as several."""
    hits, own, text = decontam.find_hits(docs, table(spark, sf_dir, "benchmark")), fresh(docs, "leaked_id"), fresh(docs, "leaked_hash")
    leaked = hits.where(F.size("item_ids") >= 2).select(F.col("doc_id").alias(own), F.col("text_hash").alias(text))
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked[own]) & (F.xxhash64(docs["text"]) == leaked[text]), "left_anti")


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text, and is null with it."""
    into = fresh(docs, "found")
    found = pii.find_spans(docs, pii.fit(docs), into=into).withColumn("text", pii.redact(F.col("text"), F.col(into)))
    return found.withColumn("n_chars", F.length("text").cast("bigint")).drop(into)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens, with the digest of their ids."""
    pieces = packing.pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written below the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        discard(*before)  # what a stage read goes when it has written
        before = [docs]
    return docs
