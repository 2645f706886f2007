from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from logweir.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, header string"


def pages(spark):
    rows = [(3, "http://c", "same"), (1, "http://a", "same"), (2, None, "größe"), (4, "http://d\r\nX: y", None), (5, "http://e", ""), (6, "u", "x" * 200_000), (6, "u", "x" * 200_000)]
    rows += [(n, f"http://n/{n}", "very common") for n in range(100, 400)]
    return spark.createDataFrame([(*row, "clash", None) for row in rows], SCHEMA), rows


def test_round_trip(spark):
    df, rows = pages(spark)
    archive = warc.write_archive(df, date="2024-05-06T07:08:09Z")
    got = warc.read_archive(spark, archive).withColumn("page_id", warc.page_number(F.col("record_id")).cast("long")).collect()
    assert len(got) == len(rows)
    first = {}
    for number, _, html in rows:
        first[html or ""] = min(number, first.get(html or "", number))
    by_id = {row.page_id: row for row in got}
    for number, url, html in rows:
        row, payload = by_id[number], (html or "").encode()
        assert row.payload_bytes == len(payload)
        assert row.payload_digest == row.stated_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert row.record_type == ("response" if first[html or ""] == number else "revisit")
        assert row.refers_to_id == (None if row.record_type == "response" else f"<urn:page:{first[html or '']}>")
        head, _, block = bytes(row.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        assert head.count(b"\r\nWARC-Date: 2024-05-06T07:08:09Z\r\n") == 1
        assert (f"\r\nWARC-Profile: {warc.SAME_PAYLOAD}\r\n".encode() in head) == (row.record_type == "revisit")
        assert block == (payload if row.record_type == "response" else b"") + b"\r\n\r\n"
    stored = spark.read.parquet(archive.payloads)
    assert stored.count() == stored.select("digest").distinct().count() == len(first)


def test_damaged_and_missing_payloads_are_errors(spark):
    df, _ = pages(spark)
    archive = warc.write_archive(df)
    stored = spark.read.parquet(archive.payloads)
    worse = warc.Archive(archive.payloads + "-worse", archive.records)
    stored.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(worse.payloads)
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, worse).collect()
    less = warc.Archive(archive.payloads + "-less", archive.records)
    stored.limit(2).write.parquet(less.payloads)
    with pytest.raises(Exception, match="missing payload"):
        warc.read_archive(spark, less).collect()


def test_empty_table(spark):
    archive = warc.write_archive(spark.createDataFrame([], SCHEMA))
    assert warc.read_archive(spark, archive).collect() == []


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "u", "a"), (None, "u", "a"), (1, "v", "a"), (2, "w", "b"), (2, "w", "b"), (None, None, None)]
    archive = warc.write_archive(spark.createDataFrame([(*row, "", "") for row in rows], SCHEMA))
    found = warc.read_archive(spark, archive).select(warc.page_number(F.col("record_id")).cast("long").alias("n"), "record_type", "payload_bytes", warc.page_number(F.col("refers_to_id")).alias("to"))
    got = sorted((tuple(row) for row in found.collect()), key=repr)
    # Null ids come first, so a null id is the response that the page with id 1 refers to.
    assert got == sorted([(None, "response", 1, None)] * 2 + [(1, "revisit", 1, None)] + [(2, "response", 1, None)] * 2 + [(None, "response", 0, None)], key=repr)
