"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; record headers are kept apart, byte for byte, with the digest they
refer to. Reading joins the two, checks both digests over the payload and gives the whole records back.

An archive is a folder of two Parquet tables, ``payloads`` (digest, payload) and ``records`` (page_id, header block, digest,
salt). Records are WARC/1.1: of records with equal payloads of at least ``min_bytes`` the one with the largest id is a
``response`` and the others are ``revisit`` records that name it; smaller payloads are always ``response``.

Defined results: a null html is an empty payload; a null url is an empty target; a null page_id is written as an empty id
and ranks below all others; rows that repeat the response's page_id with its payload are responses as well;
an empty table gives an empty archive; other columns are not archived.

One payload may belong to a large part of all pages: it is stored once through map-side aggregation, and on reading its
records are spread over salts, each of at most ``RECORDS_PER_SALT`` records, with the payload repeated for each salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
RECORDS_PER_SALT = 2000


def write_archive(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload")).withColumns({"digest": F.unhex(F.sha2("payload", 256)), "sha1": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.count("*").alias("n_records")).withColumn("salts", F.ceil(F.col("n_records") / RECORDS_PER_SALT).cast("int")).write.mode("overwrite").parquet(f"{path}/payloads")
    # headers: payload bytes stay out of this shuffle; large payloads that occur once need no holder either
    narrow = rows.drop("payload").withColumn("tie", F.xxhash64("url"))
    holders = narrow.groupBy("digest").agg(F.max(F.struct("page_id", "tie")).alias("holder"), F.count("*").alias("n_records"))
    joined = narrow.hint("merge").join(holders, "digest").withColumn("salts", F.ceil(F.col("n_records") / RECORDS_PER_SALT).cast("int"))
    revisit = (F.col("n_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("holder.page_id"))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), ident(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), ident(F.col("holder.page_id")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))),
    ]
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)).cast("binary")
    joined.select("page_id", header.alias("header"), "digest", F.pmod(F.xxhash64("page_id", "tie"), "salts").cast("int").alias("salt")).write.mode("overwrite").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, payload, record): ``record`` is the WARC record as it stands in a file, ``payload`` always whole.

    A payload whose SHA-256 isn't its address ends the read with an error.
    """
    payloads = spark.read.parquet(f"{path}/payloads").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    checked = F.when(F.sha2("payload", 256) == F.lower(F.hex("digest")), F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its digest")).cast("binary"))
    records = spark.read.parquet(f"{path}/records")
    joined = records.join(payloads.select("digest", "salt", "payload"), ["digest", "salt"])
    is_revisit = F.decode("header", "UTF-8").contains(CRLF + "WARC-Type: revisit" + CRLF)
    body = F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload"))
    end = F.lit((CRLF + CRLF).encode())
    return joined.withColumn("payload", checked).select("page_id", "header", "payload", F.concat("header", body, end).alias("record"))


def record_fields(records: DataFrame) -> DataFrame:
    """What the rebuilt records say: id, type, the record referred to, and the digest and size of the full payload.

    A response's payload is taken from the record itself, behind its header; a revisit has none of its own.
    """
    records = records.select("page_id", F.decode(F.substring("record", F.lit(1), F.octet_length("header")), "UTF-8").alias("head"), "header", "record", "payload")
    records = records.withColumn("payload", F.when(F.col("head").contains("WARC-Type: revisit" + CRLF), F.col("payload")).otherwise(F.substring("record", F.octet_length("header") + 1, F.octet_length("record") - F.octet_length("header") - 4)))
    head = F.col("head")
    refers = F.regexp_extract(head, r"WARC-Refers-To: <urn:page:(-?\d*)>", 1)
    return records.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        F.regexp_extract(head, r"WARC-Type: (\w+)", 1).alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )
