"""Content-addressed WARC archive.

Payload bytes are stored once per SHA-256; the exact header of every record is
stored apart from them, and a join on the digest gives the original records
back. Both digests are computed again from the stored bytes on reading.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import shared_dir

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 1000
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Paths of the two tables of an archive."""

    payloads: str
    records: str


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _header(min_bytes: int, date: str) -> Column:
    page, owner = F.col("page_id").cast("string"), F.col("owner").cast("string")
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    digest = _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))
    revisit = (F.col("n_bytes") >= min_bytes) & (F.col("owner") != F.coalesce("page_id", F.col("owner") - 1))
    identity = F.when(F.col("page_id").isNotNull(), F.concat(F.lit("page:"), page)).otherwise(F.concat(F.lit("uuid:"), F.expr("uuid()")))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", F.concat(F.lit("<urn:"), identity, F.lit(">"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", url),
        digest,
        F.when(
            revisit,
            F.concat(
                _field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), owner, F.lit(">"))),
                _field("WARC-Profile", F.lit(REVISIT_PROFILE)),
            ),
        ).otherwise(""),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, "0").otherwise(F.col("n_bytes").cast("string"))),
        F.lit(CRLF),
    )


def write_archive(
    pages: DataFrame,
    path: str | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    date: str | None = None,
) -> Archive:
    """Write one record per row of ``pages``.

    A null payload is an empty one and a null url an empty field. Of the rows
    with equal payloads of at least ``min_revisit_bytes`` the one with the
    largest id is the response and the others revisit it; rows that repeat that
    very id are all responses, and rows without an id revisit it. If no row of
    the group has an id, all are responses. Line breaks in a url are escaped. A
    record's id is its row's id, or a random UUID where that is null; rows that
    repeat an id repeat it. All records carry one ``date`` (ISO 8601, UTC), by
    default the time of this call, as rows say no time of capture.
    Other columns are not read. An empty table gives an empty archive.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    source = pages.select(
        F.col(f"`{id_col}`").alias("page_id"),
        F.col(f"`{url_col}`").alias("url"),
        F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha256", F.sha2("payload", 256))
    # Copies meet on the map side first, so that a hot payload is shuffled once a task.
    stored = source.groupBy("sha256").agg(F.any_value("payload").alias("payload"), F.max("page_id").alias("owner"))
    archive = Archive(f"{path}/payloads", f"{path}/records")
    stored.write.parquet(archive.payloads)
    owners = spark.read.parquet(archive.payloads).select("sha256", "owner")
    headed = (
        source.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))
        .join(owners, "sha256")
        .select("page_id", "sha256", F.encode(_header(min_revisit_bytes, date), "UTF-8").alias("header"))
    )
    headed.write.parquet(archive.records)
    return archive


def _parsed(name: str, pattern: str = "([^\r]*)") -> Column:
    return F.regexp_extract(F.col("head"), f"\n{name}: {pattern}\r", 1)


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Reconstruct the records: page_id, record_type, refers_to, url, header, payload, record.

    ``payload`` is the full payload, of revisits too; ``record`` holds the exact
    bytes of the record (a revisit has no block). A stored payload whose bytes
    don't match its SHA-256 or the record's SHA-1 fails the job.
    """
    payloads = spark.read.parquet(archive.payloads).select("sha256", "payload")
    records = spark.read.parquet(archive.records).withColumn("head", F.decode("header", "UTF-8"))
    joined = records.select(
        "sha256",
        "header",
        F.expr("try_cast(nullif(regexp_extract(head, '\\nWARC-Record-ID: <urn:page:(-?[0-9]+)>', 1), '') as bigint)").alias("page_id"),
        _parsed("WARC-Type").alias("record_type"),
        _parsed("WARC-Target-URI").alias("url"),
        F.expr("try_cast(nullif(regexp_extract(head, '\\nWARC-Refers-To: <urn:page:(-?[0-9]+)>', 1), '') as bigint)").alias("refers_to"),
        _parsed("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("header_sha1"),
        _parsed("Content-Length", "([0-9]+)").cast("long").alias("content_length"),
    ).join(payloads, "sha256")
    good = (
        (F.sha2("payload", 256) == F.col("sha256"))
        & (F.sha1("payload") == F.col("header_sha1"))
        & (F.col("content_length") == F.when(F.col("record_type") == "response", F.octet_length("payload")).otherwise(0))
    )
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return joined.select(
        "page_id",
        "record_type",
        "refers_to",
        "url",
        "header",
        F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digests"))).alias("payload"),
        F.concat(F.col("header"), block, F.encode(F.lit(CRLF + CRLF), "UTF-8")).alias("record"),
    )
