"""A corpus pipeline: quality rules, near-duplicates, repeated passages, source mixing, sequence packing.

Each stage takes (spark, docs, sf_dir), works on all the documents that the one before it kept, and is written
as Parquet before the next one reads it. All but the last return the columns of documents; other columns of the
input go. Rows that repeat are rows of their own to every stage, rows without an id too; an empty table passes through
all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import minhash, mixing, packing, quality, substring
from tracelake.llm.shared import mark, new_path, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null, empty and blank texts have no words and are among them."""
    return quality.judge(docs).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, with all rows that repeat that id.

    Documents without words are like no other and stay, and so do rows without an id, which are in no group.
    """
    return minhash.near_duplicates(docs).filter("kept").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages go that an earlier document has. A document that loses nothing keeps its text as it is, null or blank too; one that loses all goes."""
    cut = substring.remove_repeats(docs).filter("n_words > n_removed or n_words = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of smaller sources up to half of them twice. Null sources are one source, empty texts one token."""
    return mixing.mix(docs, slots=False).select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens; a null or empty text is its end token."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("repeated passages", substring_dedup),
    ("source mixing", source_mixing),
    ("sequence packing", sequence_packing),
]

#: Near-duplicates and tokens can't be expressed in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path, before = new_path(spark, name.replace(" ", "-")), mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, before)  # what the stage left in the shared folder
    return STAGES[-1][1](spark, docs, sf_dir)
