"""The corpus pipeline: documents to a mix for training, one operator a stage.

Each stage takes what its predecessor kept. All but the last return the columns of the
documents; the last returns how often each document is taken into the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import decontamination, language_id, mixing, repeats, simhash
from logweir.llm.store import written
from logweir.session import configure

#: A text that is no nearer to a language than this is rejected.
LEAST_SCORE = 0.02


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no known language: null, without a letter, or unlike every language."""
    configure(spark)
    profiles = language_id.learn(docs.where(~language_id.held_out()))
    # The whole row is one column, so no column of the documents meets one of the results.
    rows = docs.select(F.struct("*").alias("row"), "text")
    known = language_id.with_language(rows, profiles).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies; a row that repeats id and text goes."""
    configure(spark)
    groups = simhash.near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = groups.select(F.col("doc_id").alias("_first")).distinct()
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    return kept.withColumn("_same", F.xxhash64("text")).dropDuplicates(["doc_id", "_same"]).drop("_same")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings that an earlier document has; documents of which nothing is left go."""
    configure(spark)
    return repeats.without_repeats(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark items contaminate."""
    configure(spark)
    judged = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    tainted = judged.where("contaminated").select(F.col("doc_id").alias("_tainted")).distinct()
    return docs.join(tainted, F.col("doc_id").eqNullSafe(F.col("_tainted")), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken, so that sources come to their targets."""
    configure(spark)
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", languages),
    ("simhash", near_duplicates),
    ("suffix_repeats", repeated_passages),
    ("decontamination", clean_of_benchmarks),
    ("mixing", mixed),
]

#: Learned languages cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
