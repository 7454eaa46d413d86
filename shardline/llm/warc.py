"""A content-addressed WARC archive: payload bytes once, record headers apart, records by a join.

Two tables below one folder. ``payloads`` holds each distinct payload under its SHA-256; ``headers``
holds a row per record with its exact header block and the address of its payload. An original
record is header block, payload (for a response) and the two line ends; ``records`` joins
them and checks each payload against its address while it is scanned, and against the digest and
length that the header states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shardline.session import cut_lineage

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ALPHABET = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(data: Column) -> Column:
    """SHA-1 as the 32 upper-case base32 letters that WARC headers carry."""
    digits = F.sha1(data)
    parts = [  # 12 letters from 15 hex digits, and 8 from the last 10
        F.lpad(F.conv(F.substring(digits, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10))
    ]
    return F.translate(F.concat(*parts), *_ALPHABET)


def _urn(id_column: Column, kind: T.DataType) -> Column:
    """A page's name in headers; ids that are text are written as in URLs, so that no sign of theirs ends the field."""
    text = F.url_encode(id_column) if isinstance(kind, T.StringType) else id_column.cast("string")
    return F.concat(F.lit("<urn:page:"), F.coalesce(text, F.lit("null")), F.lit(">"))


def _head(date: str, kind: T.DataType) -> Column:
    """The header block of a record: WARC fields, an empty line, HTTP fields, an empty line."""
    is_response = F.col("record_type") == "response"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.octet_length(http) + F.when(is_response, F.col("bytes")).otherwise(0)
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "),
        _urn(F.col("id"), kind),
        F.lit(f"\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"),
        F.col("sha1"),
        F.when(is_response, F.lit("")).otherwise(
            F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("first"), kind))
        ),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        block.cast("string"),
        F.lit("\r\n\r\n"),
        http,
    )


def write_archive(
    pages: DataFrame,
    path: str,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a record per page to ``path/payloads`` and ``path/headers``.

    Of the pages with equal payloads of at least ``min_bytes`` bytes that with the largest id is the
    response and the others revisit it; pages with smaller payloads are all responses. A null payload is empty, a
    null URL leaves its header out, a null id sorts below all others and is written ``null``. Rows that
    repeat an id and its payload are responses together. Payloads are equal if their
    SHA-256 is, which is also their address. Only payloads are shuffled, once, after a map-side reduction of
    repeated rows; copies meet as digests, which are written first, so that the pages of one very common payload
    can be split. Ids are of any type that sorts and that casts to text and back. An empty table gives an empty archive.
    """
    payload = F.coalesce(F.col(f"`{payload_column}`"), F.lit("").cast(pages.schema[payload_column].dataType))
    rows = pages.select(
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{url_column}`").alias("url"),
        payload.cast("binary").alias("payload"),
    ).select("*", F.unhex(F.sha2("payload", 256)).alias("digest"))
    slim = rows.select(
        "id",
        "url",
        "digest",
        base32_sha1(F.col("payload")).alias("sha1"),
        F.octet_length("payload").cast("long").alias("bytes"),
    )
    firsts = cut_lineage(slim.groupBy("digest").agg(F.max("id").alias("first")), "firsts")
    headers = slim.join(firsts, "digest").withColumn(
        "record_type",
        F.when((F.col("bytes") < min_bytes) | F.col("id").eqNullSafe(F.col("first")), "response").otherwise("revisit"),
    )
    head = _head(date, slim.schema["id"].dataType).alias("head")
    headers.select("id", "digest", head).write.option("compression", "zstd").parquet(f"{path}/headers")

    def owner(id_column: str):  # never null, so that the join needs no other partitioning than the grouping
        return F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("owner")

    (
        rows.groupBy(owner("id"), "digest")
        .agg(F.first("payload").alias("payload"))
        .join(firsts.select(owner("first"), "digest"), ["owner", "digest"], "left_semi")
        .select("digest", "payload")
        .write.option("compression", "zstd")
        .parquet(f"{path}/payloads")
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive: fields of its header, its full payload and the exact ``record`` bytes.

    A payload that doesn't hash to its address, or to the digest that a header states, ends the read with an error,
    and so does a record whose block isn't as long as its header says. Ids have the type they were written with.
    Facts about payloads are taken where they are scanned, so a reader that needs no bytes shuffles none.
    """
    headers = spark.read.parquet(f"{path}/headers")
    stored = spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    stored = stored.select(
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("digest"))
        .otherwise(F.raise_error(F.concat(F.lit("payload differs from its address "), F.hex("digest"))))
        .alias("digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        "payload",
    )

    def field(name: str) -> Column:
        return F.regexp_extract("head", rf"\r\n{name}: ([^\r]*)\r\n", 1)

    def held(value: str, truth: Column, fault: str) -> Column:
        return F.when(truth, F.col(value)).otherwise(F.raise_error(F.concat(F.lit(fault), F.hex("digest")))).alias(value)

    kind = headers.schema["id"].dataType
    refers = F.regexp_extract("head", r"\r\nWARC-Refers-To: <urn:page:([^\r]*)>\r\n", 1)
    named = F.url_decode(refers) if isinstance(kind, T.StringType) else refers.try_cast(kind)
    is_response = field("WARC-Type") == "response"
    # the first Content-Length of a head is that of the block, behind the first empty line
    block = F.octet_length("head") - F.instr("head_bytes", "\r\n\r\n") - 3
    block = block + F.when(is_response, F.col("payload_bytes")).otherwise(0)
    joined = headers.join(stored, "digest").withColumn("head_bytes", F.decode(F.col("head").cast("binary"), "ISO-8859-1"))
    return joined.select(
        "id",
        field("WARC-Type").alias("record_type"),
        F.when(F.col("head").contains("\r\nWARC-Refers-To: "), named).alias("refers_to"),
        F.when(F.col("head").contains("\r\nWARC-Target-URI: "), field("WARC-Target-URI")).alias("url"),
        field("WARC-Payload-Digest").alias("stated_digest"),
        held("payload_bytes", field("Content-Length").try_cast("long") == block, "length differs from the header's: "),
        held(
            "payload_digest",
            F.concat(F.lit("sha1:"), F.col("payload_digest")) == field("WARC-Payload-Digest"),
            "digest differs from the header's: ",
        ),
        "payload",
        "head",
        F.concat(
            F.col("head").cast("binary"),
            F.when(is_response, F.col("payload")).otherwise(F.lit(b"")),
            F.lit(b"\r\n\r\n"),
        ).alias("record"),
    )


def export(archive: DataFrame, path: str) -> None:
    """The records as WARC text files; the line separator of the writer is the end of a record."""
    body = F.expr("substring(record, 1, octet_length(record) - 4)").cast("string")
    archive.select(body.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
