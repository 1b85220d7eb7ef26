"""Content-addressed WARC archive.

A capture table becomes two Parquet tables: ``blobs`` holds each payload once
under its SHA-256, ``headers`` holds each record's exact header bytes and the
digest of its payload.  The first capture of a payload (smallest page id) is a
``response``, later ones of the same payload are ``revisit`` records that
refer to it.  Reading joins headers and blobs on the digest; each blob's
digest is computed again and must be the name it is stored under, and the
original records are header bytes, payload and the closing line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Stages, session

DATE = "2024-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 0
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed values: RFC 4648


def sha1_base32(payload: Column) -> Column:
    """Base32 SHA-1, upper case (160 bits need no padding)."""
    hexed = F.sha1(payload)
    chars = []
    for chunk in range(8):  # 20 bits: five hexadecimal digits, four base32 characters
        value = F.conv(F.substring(hexed, 5 * chunk + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1
            chars.append(F.substr(F.lit(_BASE32), at, F.lit(1)))
    return F.concat(*chars)


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(pages: DataFrame, stages: Stages, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_revisit: int = MIN_REVISIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Write the archive and return (headers, blobs) as read back.

    A null payload is empty; a null page id is written as ``none`` and comes
    after all others; a null url gives a record without a target.  Rows that
    repeat the first capture's id and payload: one of them is the response.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    captured = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page"),
                            F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    captures = stages.put("captures", captured.select(
        "row", "page", "url", F.sha2("payload", 256).alias("digest"), sha1_base32(F.col("payload")).alias("sha1"),
        F.octet_length("payload").cast("long").alias("bytes")))
    order = F.struct(F.col("page").isNull().alias("none"), "page", "row")
    first = stages.put("first", captures.where(F.col("bytes") >= min_revisit).groupBy("digest")
                       .agg(F.min(order).alias("m")).select("digest", F.col("m.page").alias("first_page"), F.col("m.row").alias("first_row")))
    typed = captures.join(first, "digest", "left")
    revisit = F.coalesce(F.col("row") != F.col("first_row"), F.lit(False))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    absent = F.lit("")
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page"))), line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNull(), absent).otherwise(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%20"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                                 line("WARC-Refers-To", record_id(F.col("first_page"))))).otherwise(absent),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))), F.lit("\r\n"))
    headers = stages.put("headers", typed.select(F.encode(header, "UTF-8").alias("header"), "digest"))
    # payloads: one row per digest, taken from the first capture (or any, below min_revisit)
    keep = captured.select("payload", F.sha2("payload", 256).alias("digest"))
    blobs = stages.put("blobs", keep.groupBy("digest").agg(F.first("payload").alias("payload")))
    stages.drop("captures")
    stages.drop("first")
    return headers, blobs


def read_archive(headers: DataFrame, blobs: DataFrame) -> DataFrame:
    """Each record: record (header bytes, block, two line ends), payload, and what its header says.

    ``verified`` is false where the payload's SHA-256 is not the digest it is
    stored under, or its SHA-1 not that of the header.
    """
    checked = blobs.select("digest", "payload", (F.sha2("payload", 256) == F.col("digest")).alias("intact"),
                           sha1_base32(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    text = F.decode("header", "UTF-8")
    field = lambda name, what="([^\r]*)": F.regexp_extract("head", rf"\r\n{name}: {what}\r\n", 1)
    rows = headers.withColumn("head", text).join(checked, "digest")
    revisit = field("WARC-Type") == "revisit"
    end = F.lit(b"\r\n\r\n")
    return rows.select(
        F.concat("header", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), end).alias("record"), "payload",
        field("WARC-Type").alias("record_type"), field("WARC-Record-ID", "<urn:page:([^>]*)>").alias("page"),
        F.nullif(field("WARC-Refers-To", "<urn:page:([^>]*)>"), F.lit("")).alias("refers_to"),
        "payload_bytes", "payload_digest",
        (F.col("intact") & (field("WARC-Payload-Digest", "sha1:([A-Z2-7]*)") == F.col("payload_digest"))).alias("verified"))


def archive_report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_revisit: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, record_bytes.

    Raises (in the job) if a payload does not verify.  An empty table gives an
    empty table.
    """
    stages = Stages(session(pages), "warc")
    kind = dict(pages.dtypes)[id_col]
    read = read_archive(*write_archive(pages, stages, id_col, url_col, payload_col, min_revisit))
    back = lambda c: F.when(F.col(c) == "none", F.lit(None)).otherwise(F.col(c)).cast(kind)
    sound = F.when(F.col("verified"), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a payload does not match its digest")).cast("long"))
    return read.select(back("page").alias("page_id"), sound.alias("payload_bytes"), "payload_digest", "record_type",
                       back("refers_to").alias("refers_to"), F.octet_length("record").cast("long").alias("record_bytes"))
