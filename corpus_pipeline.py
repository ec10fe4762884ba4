"""A corpus pipeline over ``documents``: language, lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes each stage's result to the shared folder and rereads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestq.llm import decontaminate, jaccard, language, lines, packing
from nestq.llm.common import Kept

#: Documents whose language scores lower are rejected.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: undetermined ones and those under MIN_SCORE go. Learns from the labelled documents that are not held out."""
    labelled = docs.where(~language.held_out(F.col("doc_id"))).select("text", "lang")
    found = language.identify(docs, labelled)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, n_chars brought up to date; those of which no word is left go."""
    cleaned = lines.dedup_lines(docs)
    left = cleaned.where(F.col("text").isNull() | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates. Rows that repeat id and text come out once; different texts under one id all stay, as do rows without an id."""
    found = jaccard.similar_documents(docs)
    gone = Kept(spark, found.where("component_id <> doc_id").select("doc_id").distinct(), "near").df
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = Kept(spark, docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated").df
    if not repeated.isEmpty():
        once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_benchmark(docs, benchmark)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The stages hold a trained model, iterative components and dynamic programming: none that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: Kept | None = None
    for name, stage in STAGES:
        done = Kept(spark, stage(spark, docs, sf_dir), name)
        if before is not None:
            before.forget()
        before, docs = done, done.df
    return docs
