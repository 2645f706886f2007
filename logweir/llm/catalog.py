"""Queries of the operators over whole tables, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from logweir.llm import (
    decontamination,
    fingerprints,
    html_text,
    language_id,
    licenses,
    lm_scoring,
    mixing,
    negatives,
    neighbours,
    repeats,
    simhash,
    warc,
    whitening,
)
from logweir.session import configure

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Build) -> Build:
        QUERIES[name] = lambda spark, folder: build(configure(spark), folder)
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_lm_scoring")
def op1(spark, folder):
    return lm_scoring.pseudo_likelihood(table(spark, folder, "documents"))


@query("op2_decontamination", decontamination.checking_sql("documents"))
def op2(spark, folder):
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontamination.digest(found)


@query("op3_simhash")
def op3(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op4_language_id")
def op4(spark, folder):
    return language_id.identify(table(spark, folder, "documents"))


@query("op5_license_scan")
def op5(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query("op6_html_extraction")
def op6(spark, folder):
    return html_text.extract(table(spark, folder, "pages"))


@query("op7_fingerprints")
def op7(spark, folder):
    return fingerprints.version_fingerprints(table(spark, folder, "documents"))


@query("op8_mixing", mixing.checking_sql("documents"))
def op8(spark, folder):
    return mixing.mix_sources(table(spark, folder, "documents"))


@query("op9_suffix_repeats")
def op9(spark, folder):
    return repeats.repeated_bytes(table(spark, folder, "documents"))


@query(
    "op10_warc",
    """WITH facts AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages)
, digests AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first_id FROM facts)
, cut AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM digests)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> s) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM cut""",
)
def op10(spark, folder):
    archive = warc.write_archive(table(spark, folder, "pages"))
    records = warc.read_archive(spark, archive)
    return records.select(
        warc.page_number(F.col("record_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_number(F.col("refers_to_id")).cast("long").alias("refers_to"),
    )


@query("op11_hard_negatives", negatives.checking_sql("embeddings"))
def op11(spark, folder):
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op12_nearest_neighbours", neighbours.checking_sql("embeddings"))
def op12(spark, folder):
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op13_whitening")
def op13(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)
