"""From raw documents to batches for training: each stage calls one operator on all rows that its predecessor kept.

language_id drops documents without a clear language, near_dedup keeps one document of each group, pii replaces personal data in
the texts, mix takes each document as often as the sources' target weights ask for, and pack deals the rows into batches of
nearly equal length. All stages but the last return the columns of documents.

Defined results: rows with null texts or ids, repeated rows, empty tables and further columns go through every stage by the
rules in the operators' modules; n_chars, if there, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import language_id, mixing, near_duplicates, packing, pii
from corvane.llm.common import marked, release, word_count, written


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    mixed, _ = mixing.mix(docs.select(F.col("doc_id"), F.array(F.col("source").cast("string")).alias("sources"), word_count(F.col("text")).alias("size"), own))
    return mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language_id", identify_languages), ("near_dedup", drop_near_duplicates), ("pii", redact_personal_data), ("mix", mix_sources), ("pack", pack_batches)]

#: No stage can be said in SQL as a whole; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again; what earlier stages wrote there is deleted."""
    since = marked()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
            release(spark, since, keep_last=True)
    return docs
