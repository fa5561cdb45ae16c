"""WARC archives: writing, reading, and assembly of transactions."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import materialize, shared_dir, sized, table

#: Payloads of fewer bytes are stored again rather than revisited.
LEAST_REVISIT = 1000
#: Captures of one archive file at most.
FILE_PAGES = 10_000
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Fixed name of the revisit profile.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"<urn:lattica:{kind}:"), key, F.lit(">"))


def _record(fields: list[tuple[str, Column | str]], block: Column) -> Column:
    """One WARC record; fields that are null are left out, the length is that of the block's UTF-8."""
    lines = [F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(CRLF)) for name, value in fields]
    head = F.concat_ws("", F.lit("WARC/1.1" + CRLF), *lines)
    return F.concat(head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)


def plan_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages (page_id, url, html) with payload, digest (SHA-1), refers_to: null for a response, else the page it revisits.

    Pages with equal payloads of `least` bytes or more revisit the one with the largest page_id. Null html is empty; a
    null page_id is never a target and revisits its group's. Rows that share a page_id and a payload are all responses
    if that id is the largest. Only digests that occur twice are
    joined back, by broadcast if they are few enough, so that pages stay where they are; a hot digest is pre-aggregated.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    same = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n"))
    same = sized(materialize(same.filter("n > 1").select("digest", "target"), "warc-targets"))
    return rows.join(same, "digest", "left").withColumn("refers_to", F.when((F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("target")), F.col("target"))).drop("target")


def write(captures: DataFrame, path: str) -> None:
    """Write request, response or revisit, and metadata records of each capture as gzip files under path.

    Record ids name the page and its payload's digest; equal rows have equal records. A record ends with the line
    separator of the text writer, so the files are plain WARC.
    """
    key = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.col("digest"))
    rows = captures.withColumn("key", key).withColumn("target", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x1F\x7F]", ""))
    page, uri = F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target")
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF * 2), F.when(is_revisit, F.lit("")).otherwise(F.col("payload")))
    response = _record(
        [
            ("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", _record_id("response", F.col("key"))),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(is_revisit, PROFILE)),
            ("WARC-Refers-To", F.when(is_revisit, _record_id("response", F.concat(F.col("refers_to").cast("string"), F.lit(":"), F.col("digest"))))),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        http,
    )
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _record_id("request", F.col("key"))), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", _record_id("response", F.col("key"))), ("Content-Type", "application/http; msgtype=request")],
        F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1" + CRLF * 2)),
    )
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id("metadata", F.col("key"))), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", _record_id("response", F.col("key"))), ("Content-Type", "application/warc-fields")],
        F.concat(F.lit("page: "), page, F.lit(CRLF + "payloadBytes: "), F.octet_length("payload").cast("string"), F.lit(CRLF)),
    )
    rows.select(F.concat_ws(CRLF * 2, request, response, metadata).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_PAGES).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record; empty lines between records are skipped."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no WARC record starts with {line[:40]!r}")
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record ends early")
        yield fields, block


def records(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under path, plain or gzip; a malformed record fails the read.

    Columns: record_id, concurrent_to, record_type, target_uri, refers_to, payload_digest (of the header),
    payload (of responses, null unless asked for), payload_sha1 and payload_bytes (of the block itself), and fields
    (of metadata).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                raw = io.BytesIO(content)
                stream = gzip.open(raw) if content[:2] == b"\x1f\x8b" else raw
                rows = []
                for fields, block in parse(stream):
                    kind = fields.get("warc-type")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    rows.append(
                        (
                            fields.get("warc-record-id"),
                            fields.get("warc-concurrent-to"),
                            kind,
                            fields.get("warc-target-uri"),
                            fields.get("warc-refers-to"),
                            fields.get("warc-payload-digest"),
                            payload if with_payload else None,
                            hashlib.sha1(payload).hexdigest() if payload is not None else None,
                            len(payload) if payload is not None else None,
                            dict(x.split(": ", 1) for x in block.decode("utf-8").splitlines() if ": " in x) if kind == "metadata" else None,
                        )
                    )
                    if len(rows) == 500:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(run, SCHEMA)


COLUMNS = ["record_id", "concurrent_to", "record_type", "target_uri", "refers_to", "payload_digest", "payload", "payload_sha1", "payload_bytes", "fields"]
SCHEMA = "record_id string, concurrent_to string, record_type string, target_uri string, refers_to string, payload_digest string, payload binary, payload_sha1 string, payload_bytes bigint, fields map<string,string>"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    out["payload_bytes"] = out["payload_bytes"].astype("Int64")
    return out


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, main, request, metadata, as the records name each other.

    A response, revisit or resource record is the main one; others join it by their concurrent-to id, or are named by
    its own. Captures without a request or metadata keep a null there; of several, the one with the least id counts.
    Records that name no capture in the archives are left over and give no row.
    """
    body = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload", "payload_sha1", "payload_bytes"]
    main = found.filter(F.col("record_type").isin("response", "revisit", "resource")).select(F.col("record_id").alias("capture"), F.col("concurrent_to").alias("named"), F.struct(*body).alias("main"))
    other = found.filter(F.col("record_type").isin("request", "metadata"))
    part = F.struct("record_id", "target_uri", "fields")
    direct = other.filter("concurrent_to is not null").select(F.col("concurrent_to").alias("capture"), "record_type", part.alias("part"))
    named = main.filter("named is not null").select("capture", "named").join(other.filter("concurrent_to is null").select(F.col("record_id").alias("named"), "record_type", part.alias("part")), "named").select("capture", "record_type", "part")
    pick = lambda kind: F.min_by("part", F.when(F.col("record_type") == kind, F.col("part.record_id"))).alias(kind)
    sides = direct.unionByName(named).groupBy("capture").agg(pick("request"), pick("metadata"))
    return main.drop("named").join(sides, "capture", "left").withColumnRenamed("capture", "record_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/lattica/warc-{uuid.uuid4().hex}"
    write(plan_revisits(table(spark, sf_dir, "pages")), path)
    # Assembly reads the records several times; without payloads they are small enough to be written once.
    captures = assemble(materialize(records(spark, path, with_payload=False), "warc-records"))
    page = lambda c: F.regexp_extract(c, r"^<urn:lattica:response:(-?\d+):", 1).cast("bigint")
    fields = F.col("metadata.fields")
    return captures.select(
        F.expr("try_cast(metadata.fields['page'] as bigint)").alias("page_id"),
        F.coalesce(F.col("main.payload_bytes"), fields["payloadBytes"].cast("bigint")).alias("payload_bytes"),
        F.coalesce(F.col("main.payload_sha1"), F.regexp_replace("main.payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("main.record_type").alias("record_type"),
        F.when(F.col("main.refers_to").isNotNull(), page(F.col("main.refers_to"))).alias("refers_to"),
    )


OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS target FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> target THEN target END AS refers_to
FROM t
"""

QUERIES = {"op8_warc": op8_warc}
ORACLES = {"op8_warc": OP8_SQL}
