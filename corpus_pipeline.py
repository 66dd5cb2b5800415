"""The corpus pipeline: language, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs``, and
returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``docs``.

Null ids and texts, repeated rows and empty tables are defined: a null text
has no language and goes with the first stage; of repeated rows one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import exact_dedup, language_id, minhash, packing, personal_data
from meshloom.llm.common import SPACES, keep_rows, remove, row_key, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; what has no letter, no text, or no likely language goes."""
    return language_id.accepted(docs, language_id.learn(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest."""
    kept = exact_dedup.exact_dedup(docs).where("kept")
    digest = F.sha2(F.translate(F.coalesce(docs["text"], F.lit("")), SPACES, "").cast("binary"), 256)
    # Copies of one id differ in white space alone; the longest has the place.
    return keep_rows(docs, row_key(docs["doc_id"], digest), kept.select(row_key(F.col("doc_id"), F.col("text_sha256"))), F.desc(F.length(docs["text"])))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words are alike by 0.8 or more."""
    kept = minhash.near_duplicates(docs).where("kept")
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    return keep_rows(docs, row_key(docs["doc_id"], digest), kept.select(row_key(F.col("doc_id"), F.col("text_sha256"))))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by their kind, its length counted anew."""
    return personal_data.masked(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("personal_data", private), ("packing", sequences)]

#: SQL can express neither the network nor the packing: tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
