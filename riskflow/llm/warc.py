r"""WARC archives whose repeated payloads are revisit records.

Headers are shuffled by payload digest: of the records with equal payloads of at least
``min_bytes`` bytes, the one with the smallest page id is a response and the others become
revisits that name it. Archives are written and read by Spark's text source, so they work
on any file system Spark knows: a record ends with two line breaks, which is the line
separator of the writer, and the reader cuts where those are followed by a record's first
line. A payload that holds that very sequence gets an archive file of its own, which is
read whole. On reading, the payload is what the content length says; a revisit is resolved
by joining the record it refers to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm.common import col
from riskflow.workspace import fresh_path, stage

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
_CUT = END + VERSION
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"


def _record_id(*parts: str) -> Column:
    h = F.md5(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _headers(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.coalesce(col(html_col), F.lit(""))
    return pages.select(
        col(id_col).alias("id"), col(url_col).alias("url"), payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line breaks cannot get in."""
    clean = F.regexp_replace(value.cast("string"), r"[\x00-\x20\x7f]+", "%20")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def _record(kind: str, date: str) -> Column:
    http = F.concat(F.lit(f"{_HTTP}\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    body = F.concat(http, F.col("payload")) if kind == "response" else http
    lines = [
        F.lit(VERSION), F.lit(f"WARC-Type: {kind}\r\n"), _line("WARC-Record-ID", F.col("record")),
        F.lit(f"WARC-Date: {date}\r\n"), _line("WARC-Target-URI", F.col("url")), _line("X-Page-Id", F.url_encode(F.col("id").cast("string"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n")),
    ]
    if kind == "revisit":
        lines += [
            F.lit(f"WARC-Profile: {PROFILE}\r\n"), _line("WARC-Refers-To", F.col("original")),
            _line("WARC-Refers-To-Target-URI", F.col("original_url")),
        ]
    lines += [
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body), F.lit(END), body,
    ]
    return F.concat(*lines).alias("value")


def resolve_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(responses with payload, revisits without) for every row of ``pages``.

    Rows equal in id, url and payload are counted; all but one of them are revisits of the
    one. Ties on the id go to the smaller url; a null id or url comes last.
    """
    full = _headers(pages, id_col, url_col, html_col)
    rows = stage(full.groupBy("id", "url", "digest", "bytes").agg(F.count("*").alias("m")), "warc-headers")
    long_ = rows.where(F.col("bytes") >= min_bytes)
    order = F.struct(F.col("id").isNull().alias("a"), "id", F.col("url").isNull().alias("b"), "url")
    first = long_.groupBy("digest").agg(F.min(order).alias("o"), F.sum("m").alias("n"), F.first("bytes").alias("bytes"))
    first = stage(
        first.where("n > 1").select("digest", "bytes", F.col("o.id").alias("id"), F.col("o.url").alias("url"))
        .withColumn("record", _record_id("id", "url", "digest")), "warc-first",
    )
    original = first.select(
        F.col("digest").alias("d"), F.col("id").alias("oid"), F.col("url").alias("original_url"),
        F.col("record").alias("original"),
    )
    same = F.col("id").eqNullSafe(F.col("oid")) & F.col("url").eqNullSafe(F.col("original_url"))
    revisits = (
        long_.join(original, F.col("digest") == F.col("d"))
        .withColumn("m", F.col("m") - same.cast("long")).where("m > 0")
        .withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("m"))))
        .withColumn("record", _record_id("id", "url", "digest", "nth"))
    )
    # A short payload is never shared; its repeated rows get ids of their own.
    short = (
        full.where(F.col("bytes") < min_bytes).groupBy("id", "url", "payload", "digest", "bytes")
        .agg(F.count("*").alias("m")).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("m"))))
        .withColumn("record", _record_id("id", "url", "digest", "nth"))
        .select("id", "url", "payload", "digest", "bytes", "record")
    )
    several = stage(long_.where(F.col("m") > 1).select("id", "url", "digest").join(
        original.select("d", "oid", "original_url"),
        (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("oid")) & F.col("url").eqNullSafe(F.col("original_url")),
    ).select("digest"), "warc-several")
    keyed = full.where(F.col("bytes") >= min_bytes).join(
        original.hint("shuffle_hash"), F.col("digest") == F.col("d"), "left"
    )
    alone = keyed.where(F.col("d").isNull() | same).select("id", "url", "payload", "digest", "bytes")
    if not several.isEmpty():
        once = alone.join(several, "digest", "left_semi").dropDuplicates(["digest"])
        alone = alone.join(several, "digest", "left_anti").unionByName(once)
    responses = alone.withColumn("record", _record_id("id", "url", "digest")).unionByName(short)
    return responses, revisits


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_bytes: int = 100, date: str = "1970-01-01T00:00:00Z", compression: str | None = "gzip",
) -> None:
    """Write deduplicated archives with fresh headers below ``path``.

    A null payload is empty; a null url or id has no header line; an empty table writes
    empty archives; other columns are not read.
    """
    responses, revisits = resolve_revisits(pages, id_col, url_col, html_col, min_bytes)
    odd = F.contains(F.concat(F.lit(END), "payload"), F.lit(_CUT)) | F.col("payload").endswith("\r")
    options = {"compression": compression} if compression else {}
    responses = responses.withColumn("odd", F.coalesce(odd, F.lit(False)))
    text = responses.where("not odd").select(_record("response", date)).unionByName(
        revisits.select(_record("revisit", date))
    )
    text.write.options(**options).option("lineSep", END).text(f"{path}/plain")
    single = responses.where("odd").select(_record("response", date))
    single.write.options(**options).option("lineSep", END).option("maxRecordsPerFile", 1).text(f"{path}/single")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(record, type, id, url, digest, refers_to, payload) of every record; payload is binary."""
    plain = spark.read.option("lineSep", _CUT).text(f"{path}/plain")
    whole = spark.read.text(f"{path}/single", wholetext=True)
    records = plain.unionByName(whole).where(F.length("value") > 0).select(F.split("value", END, 3).alias("part"))
    head = F.concat(F.lit("\r\n"), F.col("part")[0], F.lit("\r\n"))
    field = lambda name: F.nullif(F.regexp_extract(head, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    page = F.when(F.contains(head, F.lit("\r\nX-Page-Id: ")), F.url_decode(F.regexp_extract(head, r"\r\nX-Page-Id: ([^\r]*)\r\n", 1)))
    length = field("Content-Length").cast("long")
    skipped = F.octet_length(F.col("part")[1]) + 4
    payload = F.substring(
        F.coalesce(F.get("part", 2), F.lit("")).cast("binary"), F.lit(1), (length - skipped).cast("int")
    )
    return records.select(
        field("WARC-Record-ID").alias("record"), field("WARC-Type").alias("type"), page.alias("id"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("digest"),
        field("WARC-Refers-To").alias("refers_to"), payload.alias("payload"),
    )


def resolved_index(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """One row per record read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest are computed from the payload that was read; a revisit takes those
    of the record it refers to.
    """
    records = stage(
        read_archive(spark, path).select(
            "record", "type", F.col("id").cast(id_type).alias("page_id"), "refers_to",
            F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        ), "warc-read",
    )
    responses = records.where("type = 'response'")
    target = responses.select(
        F.col("record").alias("refers_to"), F.col("page_id").alias("to"),
        F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("h"),
    )
    revisits = records.where("type = 'revisit'").join(target, "refers_to").select(
        "page_id", F.col("b").alias("payload_bytes"), F.col("h").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("to").alias("refers_to"),
    )
    return responses.select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.lit(None).cast(id_type).alias("refers_to"),
    ).unionByName(revisits)


def archive_index(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Write an archive of all pages into the shared folder, read it back and resolve it.

    Ids of any type come back as they were: their header is percent-encoded.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archive(pages, path, id_col)
    return resolved_index(spark, path, pages.select(col(id_col)).schema[0].dataType.simpleString())


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM r
"""
