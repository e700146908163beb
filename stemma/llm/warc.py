"""Content-addressed WARC archive: each payload's bytes stored once, exact record headers apart, records rebuilt by joins.

Two tables in the archive's folder:

- payloads (key, payload): one row per distinct payload; key is its SHA-256, checked again on reading
- headers (page_id, header, original, key): the exact bytes of each record's header and HTTP header; for a revisit also
  those of the response that the page would be by itself; and the payload's key

A response record is header + payload + two line ends; a revisit record has no payload of its own, its original record
is rebuilt with the payload that it shares. Payloads are shuffled once each way, never by digest before copies are
gone, and joined to headers with hot payloads dealt out, so one that many pages share costs no more than any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import heavy_join, only, release, shared_dir, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of binary data in upper-case base 32: 40 bits make 10 hexadecimal or 8 base-32 digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _uri(url: Column) -> Column:
    """The url with each control character percent-encoded; urn:none for null."""
    control = "[\\x00-\\x1F\\x7F]"
    coded = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(control), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")
    return F.coalesce(F.when(url.rlike(control), coded).otherwise(url), F.lit("urn:none"))


#: Responses, of some 100 bytes each, that are broadcast when payloads are written; more are joined by shuffle.
BROADCAST_RESPONSES = 100_000


def write_archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0, date: str = DATE) -> str:
    """Write pages(page_id long, url, html) and return the archive's folder.

    The payload is the html in UTF-8; null counts as empty. Of pages with equal payloads of at least least_bytes, the
    one with the largest page_id is the response and the others revisit it; repeated rows of that page_id are all
    responses, and so are rows with a null page_id. A null url is written as urn:none, each control character in it is
    percent-encoded. An empty table gives an empty archive. Other columns are ignored.
    """
    spark, path = pages.sparkSession, path or shared_dir(pages.sparkSession, "warc")
    rows = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    light = written(rows.select("page_id", "url", F.sha2("payload", 256).alias("key"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes")), "light")
    largest = light.groupBy("key").agg(F.max("page_id").alias("response"))
    one = heavy_join(light, largest, "key", "page_id")
    revisit = F.coalesce((F.col("page_id") != F.col("response")) & (F.col("n_bytes") >= least_bytes), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _line("Content-Type", F.lit("text/html; charset=UTF-8")), _line("Content-Length", F.col("n_bytes").cast("string")), F.lit("\r\n"))
    record = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    def header(kind: str, more: Column, payload_bytes: Column) -> Column:
        length = (F.octet_length(http) + payload_bytes).cast("string")
        head = F.concat(
            F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.lit(kind)), _line("WARC-Record-ID", record("page_id")), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", _uri(F.col("url"))),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), more, _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", length), F.lit("\r\n"), http,
        )
        return F.encode(head, "UTF-8")

    full = header("response", F.lit(""), F.col("n_bytes"))
    short = header("revisit", F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", record("response"))), F.lit(0))
    one.select("page_id", F.when(revisit, short).otherwise(full).alias("header"), F.when(revisit, full).alias("original"), "key").write.option("compression", "zstd").parquet(f"{path}/headers")
    # the page of the largest page_id brings the payload: a join by page and key, so that no payload is a hot key
    # where those pages are few enough to be sent to every task, no payload is shuffled
    few = largest.limit(BROADCAST_RESPONSES + 1).count() <= BROADCAST_RESPONSES
    kept = rows.withColumn("key", F.sha2("payload", 256)).alias("r").join((F.broadcast(largest) if few else largest).alias("l"), (F.col("r.key") == F.col("l.key")) & F.col("r.page_id").eqNullSafe(F.col("l.response")), "left_semi")
    kept = kept.select("key", "payload")
    twice = light.groupBy("key", "page_id").count().where("count > 1").limit(1).count()
    (kept.dropDuplicates(["key"]) if twice else kept).write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The payloads, each checked against its key."""
    rows = spark.read.schema("key string, payload binary").parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("stored payload differs from its digest "), F.col("key")))
    return rows.select("key", F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"))


END = "\r\n\r\n"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id; record, the exact bytes of the page's record; original, those of its response record: for a response the
    same, for a revisit rebuilt from its own header and the payload that it shares; payload_at, where the payload starts
    in original, from 0. A header without its payload is an error."""
    headers = spark.read.schema("page_id long, header binary, original binary, key string").parquet(f"{path}/headers")
    joined = heavy_join(headers, _stored(spark, path), "key", "page_id", how="left")
    wrong = F.raise_error(F.concat(F.lit("no payload for page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    payload, end = F.coalesce("payload", wrong.cast("binary")), F.encode(F.lit(END), "UTF-8")
    full = F.coalesce("original", "header")
    record = F.when(F.col("original").isNull(), F.concat("header", payload, end)).otherwise(F.concat("header", end))
    return joined.select("page_id", record.alias("record"), F.concat(full, payload, end).alias("original"), F.octet_length(full).alias("payload_at"), "header")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record: the payload's figures from the
    rebuilt original record and held against the header's."""
    release(spark)  # the shuffle files of the archive's writing, which nothing refers to any more
    rows = read_records(spark, path)
    text = F.decode("header", "UTF-8")
    field = lambda p: F.regexp_extract(text, f"\r\n{p}\r\n", 1)
    payload = F.substring("original", F.col("payload_at") + 1, F.octet_length("original") - F.col("payload_at") - len(END))
    rows = rows.select(
        "page_id", payload.alias("payload"), field("WARC-Type: (\\w+)").alias("record_type"), F.nullif(field("WARC-Refers-To: <urn:page:(-?\\d+)>"), F.lit("")).cast("long").alias("refers_to"),
        field("WARC-Payload-Digest: sha1:(\\w+)").alias("told"),
    )
    rows = rows.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", "refers_to", "told")
    wrong = F.raise_error(F.concat(F.lit("the payload differs from the digest of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    return rows.withColumn("payload_digest", F.when(F.col("told") == F.col("payload_digest"), F.col("payload_digest")).otherwise(wrong.cast("string"))).drop("told")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as an archive and read back, one row per record."""
    return read_index(spark, write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet")))


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, ((i // 8) * 10 + 1)::INT, 10))::UBIGINT >> (35 - 5 * (i % 8))::UBIGINT) & 31)::INT + 1), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""
