"""A corpus pipeline over `documents`: five stages, each written as Parquet and read again as the next one's input.

Null and empty texts are kept by all stages (they are no copies, leaks or secrets and have the bias's toxicity) and come
out with no ids; rows that repeat are judged alike, but for near_duplicates, which leaves one row of a class; null
doc_ids are kept as other rows are; an empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralens.llm import decontam, fm_toxicity, forced_bpe, ngram_jaccard, secret_scan
from terralens.llm._tables import Scratch, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go: those with a score of 0.5 or more."""
    return fm_toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, the one with the least doc_id; see ngram_jaccard.keep_one for ties."""
    return ngram_jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; without items all stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars follows the text, null for a null one."""
    return secret_scan.redacted(secret_scan.scan(docs)).select(*docs.columns).withColumn("n_chars", F.char_length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as token ids (little-endian unsigned 32-bit integers), none for null and empty texts."""
    encoded = forced_bpe.encode(docs, forced_bpe.vocabulary_path(), "doc_id", "lang", "source")
    return encoded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

#: A trained model and a tokenizer decide what stays; SQL cannot express them, so tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for `documents`. A stage's table is deleted when the next one has been written."""
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
