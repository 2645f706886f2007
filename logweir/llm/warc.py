"""Content-addressed archive of WARC records.

Payload bytes are stored once per SHA-256 digest, record headers exactly and apart from
them; records are reconstructed by a join on the digest. On reading, the digest of every
stored payload is computed again, so a damaged payload is an error and never a record.

Nulls: a null html is an empty payload, a null url an empty target. Null ids sort first.
Rows that repeat both id and payload are the same record repeated and have one type. An
empty table makes an empty archive. Other columns of the pages are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.store import new_folder

#: The base32 alphabet, a fixed value.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LINE = "\r\n"
#: Profile of a record whose payload an earlier one has, a fixed value.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digits: Column, length: int = 40) -> Column:
    """Base32 text of a hex text whose length is a multiple of 5: 5 hex digits are 4 characters."""
    chars = []
    for start in range(1, length + 1, 5):
        value = F.conv(F.substring(hex_digits, start, 5), 16, 10).cast("int")
        chars += [
            F.lit(BASE32).substr(F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)
        ]
    return F.concat(*chars)


@dataclass(frozen=True)
class Archive:
    """Folders of the two tables: ``payloads`` (digest, payload) and ``records`` (headers)."""

    payloads: str
    records: str


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(LINE))


def records_of_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> DataFrame:
    """One record per page: page_id, exact header text, digest of the full payload, type, refers_to.

    ``date`` is the time of all records (``2024-01-01T00:00:00Z``), else the present time.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    facts = pages.select(
        F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.sha2(payload, 256).alias("digest"), base32(F.sha1(payload)).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"),
    )
    # One row per payload and task before the shuffle, however many pages share it.
    first = facts.groupBy("digest").agg(F.min(F.struct("page_id")).alias("_first"))
    records = facts.join(first, "digest").withColumn("first_id", F.col("_first.page_id"))
    own = F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(own, "response").otherwise("revisit")
    name = lambda column: F.concat(F.lit("<urn:page:"), F.coalesce(column.cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{LINE}"),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", name(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}{LINE}"),
        _header("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(own, F.lit("")).otherwise(F.concat(_header("WARC-Refers-To", name(F.col("first_id"))), F.lit(f"WARC-Profile: {SAME_PAYLOAD}{LINE}"))),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        # A revisit carries no block of its own.
        _header("Content-Length", F.when(own, F.col("bytes")).otherwise(F.lit(0)).cast("string")),
        F.lit(LINE),
    )
    return records.select("page_id", "digest", kind.alias("record_type"), F.encode(header, "UTF-8").alias("header"))


def write_archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> Archive:
    """Write both tables into the shared folder."""
    archive = Archive(new_folder(pages.sparkSession, "warc-payloads"), new_folder(pages.sparkSession, "warc-records"))
    records_of_pages(pages, page_id, url, html, date).write.option("compression", "zstd").parquet(archive.records)

    # Payloads of one digest are equal, so any of them serves; a task passes on one of each.
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    bodies = pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    bodies.groupBy("digest").agg(F.any_value("payload").alias("payload")).write.option("compression", "zstd").parquet(archive.payloads)
    return archive


def read_archive(spark, archive: Archive) -> DataFrame:
    """Records as they were written: header fields, and ``record``, the whole bytes.

    ``payload_bytes`` and ``payload_digest`` are computed from the stored payload, also
    for revisits. A payload that does not have its digest, or is missing, raises.
    Without ``payload`` and ``record`` in the selection, no payload is shuffled.
    """
    stored = spark.read.parquet(archive.payloads)
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.octet_length("payload").cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("long")
    )
    store = stored.select("digest", "payload", checked.alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    head = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(head, rf"\n{name}: ([^\r\n]*)\r\n", 1)
    names = {
        "record_type": field("WARC-Type"),
        "record_id": field("WARC-Record-ID"),
        "url": field("WARC-Target-URI"),
        "refers_to_id": F.nullif(field("WARC-Refers-To"), F.lit("")),
        "stated_digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", ""),
    }
    records = spark.read.parquet(archive.records).select("digest", "header", *[column.alias(name) for name, column in names.items()])
    joined = records.join(store, "digest", "left").withColumn(
        "payload_bytes",
        F.coalesce("payload_bytes", F.raise_error(F.concat(F.lit("missing payload "), F.col("digest"))).cast("long")),
    )
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.withColumn("record", F.concat("header", block, F.lit((LINE * 2).encode())))


def page_number(record_id: Column) -> Column:
    """The page id in a record id of :func:`records_of_pages`; null for null."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(.*)>$", 1), F.lit(""))
