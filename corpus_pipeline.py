"""Corpus cleaning pipeline: each stage reads what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, packing, secret_scan, simhash
from tidemark.llm.common import fold, prepare, shared_root, store, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go (no letters, or too doubtful)."""
    prepare(spark)
    docs = docs.select(COLUMNS)
    return langid.identified(docs, langid.train(docs, fold("doc_id", 4) != 2))


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and ``text_key``, a hash of the text. Both stages
    below decide by the text alone, so rows find their decision by this key,
    whether they have an id, share it with another text, or have none. (Two texts
    of one 64-bit key would share a decision; of 10^9 texts, one pair in 40 tables.)"""
    return docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: that with the smallest id (rows without
    an id come last, then the smallest key). Of rows repeated as wholes one stays."""
    prepare(spark)
    docs = keyed(docs)
    groups = simhash.simhash_components(docs, id_col="text_key", shingle=3, radius=3).select("doc_id", "component_id").distinct()
    rows = docs.groupBy("doc_id", "text_key").count()
    first = F.struct(F.col("rows.doc_id").isNull(), F.col("rows.doc_id").alias("doc_id"), F.col("rows.text_key").alias("text_key"), F.col("rows.count").alias("rows"))
    stays = store(rows.alias("rows").join(groups.alias("groups"), F.col("rows.text_key") == F.col("groups.doc_id"))
                  .groupBy("groups.component_id").agg(F.min(first).alias("first")).select("first.doc_id", "first.text_key", "first.rows"), "pipeline-stays")
    same = docs["text_key"].eqNullSafe(stays["text_key"]) & docs["doc_id"].eqNullSafe(stays["doc_id"])
    kept = docs.join(stays, same, "left_semi")
    if stays.where("rows > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text_key"])
    return kept.select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go, with or without an id."""
    prepare(spark)
    docs = keyed(docs)
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), id_col="text_key")
    gone = found.where("contaminated").select(F.col("doc_id").alias("text_key")).distinct()
    return docs.join(gone, "text_key", "left_anti").select(COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the value of every reported secret is blotted out and
    n_chars follows the text."""
    prepare(spark)
    docs = docs.select(COLUMNS)
    return secret_scan.redact(docs, secret_scan.scan(docs, owner_col="source", repo_col="doc_id"), length_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences of all documents left."""
    import public_tokenizers
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # model, hash and tokenizer stages have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet into
    the shared folder and read again as the next stage's input."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_root(spark)}/llm/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
