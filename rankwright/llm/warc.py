"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; the exact header block of every record is kept
beside the digest; original records come back by joining the two. Reading verifies the digest of
every payload and the length that its header states, and fails on a difference.

Of records with equal payloads of at least ``least_bytes`` the one with the largest id is the
response and the others are revisits that refer to it; smaller records are all responses. Null
payload counts as empty. A null url leaves the target header out; line ends in a url are percent-
encoded. Records that repeat the largest id are all responses; a null id is smaller than any other,
and if all ids of a group are null, all are responses. An empty table gives an empty archive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm.common import shared_dir, table, text_bytes

_END = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Where the two tables of an archive are."""

    payloads: str
    records: str


def _line(name: str, value: Column) -> Column:
    """A header line; nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))


def _header(kind: Column, url: Column, record: Column, digest: Column, refers: Column, length: Column) -> Column:
    clean = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    urn = lambda x: F.concat(F.lit("<urn:record:"), x, F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", urn(F.coalesce(record.cast("string"), F.lit("none")))),
        _line("WARC-Target-URI", clean),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        _line("WARC-Refers-To", urn(refers.cast("string"))),
        _line("Content-Length", length.cast("string")),
        F.lit(_END),
    )


def write_archive(df: DataFrame, folder: str, record: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 1000) -> Archive:
    """Write the payload store and the record headers of ``df`` under ``folder``."""
    raw = text_bytes(payload)
    base = df.select(F.col(record).alias("id"), F.col(url).alias("url"), raw.alias("payload"))
    base = base.withColumns({"address": F.sha2("payload", 256), "key": F.coalesce(F.col("id").cast("string"), F.lit(""))})
    owners = base.groupBy("address").agg(F.max("id").alias("owner"))
    stored = owners.select("address", F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("key"))
    # joined by address and id, so that copies of one payload do not meet in one task
    once = base.select("address", "key", "payload").join(stored, ["address", "key"]).groupBy("address", "key").agg(F.first("payload").alias("payload"))
    out = Archive(f"{folder}/payloads", f"{folder}/records")
    once.select("address", "payload").write.option("compression", "zstd").parquet(out.payloads)

    size = F.length("payload").cast("long")
    light = base.select("id", "url", "address", size.alias("size"), F.sha1("payload").alias("digest")).join(owners, "address")
    revisit = (F.col("size") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("owner")) & F.col("owner").isNotNull()
    kind = F.when(revisit, "revisit").otherwise("response")
    refers = F.when(revisit, F.col("owner"))
    header = _header(kind, F.col("url"), F.col("id"), F.col("digest"), refers, F.when(revisit, F.lit(0)).otherwise(F.col("size")))
    light.select("id", "address", refers.alias("refers_to"), header.alias("header")).write.parquet(out.records)
    return out


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """The original records: id, refers_to, header, payload and the record's own bytes.

    A revisit's record has no block of its own; its payload is that of the record it refers to.
    """
    records = spark.read.parquet(archive.records)
    payloads = spark.read.parquet(archive.payloads)
    checked = payloads.select("address", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary")).alias("payload"))
    joined = records.join(checked, "address")
    revisit = header_value("WARC-Type") == "revisit"
    stated = header_value("Content-Length").cast("long")
    whole = F.when(revisit | (stated == F.length("payload")), F.concat(F.col("header").cast("binary"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n")))
    return joined.select("id", "refers_to", "header", "payload", F.coalesce(whole, F.raise_error(F.lit("a record's length differs from its header")).cast("binary")).alias("record"))


def header_value(name: str) -> Column:
    """The value of a header line of ``header``; null if there is none."""
    found = F.regexp_extract("header", f"\\r\\n{name}: ([^\\r\\n]*)\\r\\n", 1)
    return F.when(found != "", found)


def export_files(records: DataFrame, path: str) -> None:
    """Write plain ``.warc`` content: the records of ``read_archive``, one after another."""
    records.select(F.expr("cast(substring(record, 1, octet_length(record) - 4) as string)").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archive back and describe each record."""
    archive = write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    back = read_archive(spark, archive)
    return back.select(
        F.col("id").alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        header_value("WARC-Type").alias("record_type"),
        F.col("refers_to"),
    )


SQL_OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h FROM p),
o AS (SELECT h, max(page_id) AS owner FROM d GROUP BY h)
SELECT page_id, n AS payload_bytes, d.h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM d JOIN o ON d.h = o.h
"""
