"""Content-addressed WARC archive: payload bytes once per digest, exact record headers apart.

``payloads`` holds each distinct payload once, named by its SHA-256 and length; ``records`` holds the
record headers byte for byte. A record is the header followed by its payload (responses) or by nothing
(revisits), put together by a join on the digest. Payload bytes are checked against their name each time
they are read, so a damaged or wrongly named payload stops the job.

Among records with equal payloads of ``min_bytes`` or more, the one with the largest id is the response and
the others revisit it. Defined cases: a null or empty payload is empty and a response; a null URL has no
target line; CR and LF in a URL are written as %0D and %0A; null ids are written as ``none`` and never
answer for others unless all ids are null; repeated rows give a record each; an empty table gives empty
archives. A payload held by a third of all rows is collapsed before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

MIN_BYTES = 1000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _bytes(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def write_archive(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES, date: str = "2000-01-01T00:00:00Z") -> str:
    """Write ``payloads`` and ``records`` below ``path`` (by default a fresh shared path), which is returned.

    ``date`` is every record's WARC-Date: pages have no time of capture, and a second run writes the same bytes.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    named = pages.select(
        F.col(page_id).alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.col(url).cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        _bytes(payload).alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "length": F.octet_length("payload").cast("long")})
    # one row for each payload and task crosses the shuffle
    once = named.groupBy("digest", "length").agg(F.max("page_id").alias("owner"), F.first("payload").alias("payload"))
    once.select("*", F.sha1("payload").alias("sha1")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    owners = spark.read.parquet(f"{path}/payloads").select("digest", "length", "owner", "sha1")
    rows = named.select("page_id", "url", "digest", "length").join(owners, ["digest", "length"])
    revisit = (F.col("length") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    kind = F.when(revisit, "revisit").otherwise("response")
    urn = lambda c: F.concat(F.lit("<urn:cubiform:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    target = lambda name: F.coalesce(F.concat(F.lit(f"\r\n{name}: "), F.col("url")), F.lit(""))
    http = F.concat(F.lit(_HTTP), F.col("length").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http.cast("binary")) + F.when(revisit, F.lit(0)).otherwise(F.col("length"))
    lines = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), urn("page_id"), F.lit(f"\r\nWARC-Date: {date}"), target("WARC-Target-URI"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit("\r\nWARC-Block-Store: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            urn("owner"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit("\r\n\r\n"), http,
    )
    rows.select("page_id", "digest", "length", lines.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")
    return path


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``(digest, length, payload, sha1)``, checked: each payload's own SHA-256 and length must be its name."""
    stored = spark.read.parquet(f"{path}/payloads").select("digest", "length", "payload")
    sound = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("length"))
    checked = F.when(sound, F.sha1("payload")).otherwise(F.raise_error(F.lit("payload does not match its digest")))
    return stored.withColumns({"sha1": checked, "payload_bytes": F.octet_length("payload").cast("long")})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Parsed headers: ``(page_id, record_type, url, refers_to, header_sha1, digest, length, header)``."""
    text = F.col("header").cast("string")
    field = lambda name, value: F.nullif(F.regexp_extract(text, rf"\r\n{name}: {value}", 1), F.lit(""))
    rows = spark.read.parquet(f"{path}/records").select("header")
    number = lambda c: F.when(c != "none", c).cast("long")
    return rows.select(
        number(field("WARC-Record-ID", "<urn:cubiform:page:([^>]*)>")).alias("page_id"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Target-URI", "([^\r\n]*)").alias("url"),
        number(field("WARC-Refers-To", "<urn:cubiform:page:([^>]*)>")).alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("header_sha1"),
        field("WARC-Block-Store", "sha256:([0-9a-f]+)").alias("digest"),
        F.regexp_extract(text, r"msgtype=response\r\nContent-Length: \d+\r\n\r\nHTTP/1.1 200 OK\r\n[^\r]*\r\nContent-Length: (\d+)\r\n", 1).cast("long").alias("length"),
        "header",
    )


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: parsed header fields, the full payload, its measures and the record's exact bytes.

    What a caller does not select is not moved: measures are taken where the payload is read.
    """
    joined = read_records(spark, path).join(read_payloads(spark, path), ["digest", "length"])
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.withColumn("record", F.concat(F.col("header"), body, F.lit(b"\r\n\r\n")))
