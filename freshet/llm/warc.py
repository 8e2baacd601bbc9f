"""WARC archives: written and read back by Spark's own writer and reader, or read from others; their records joined into captures."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pick, small

EOL = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # of base32 (fixed value)


def sha1_base32(data: Column) -> Column:
    """SHA-1 as bare upper-case base32: 40 hex digits are 8 groups of 20 bits, each of them 4 digits of base 32."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def _header(name: str, value: Column) -> Column:
    """A header line; none where the value is null. Line breaks in a value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(EOL)), F.lit(""))


def _record(kind: Column, record_id: Column, block: Column, *more: Column, archive: str | None = None) -> Column:
    """A record; all but warcinfo name their archive's in the second line, which is where a reader of the archive parts them."""
    first = f"WARC/1.1{EOL}" + (f"WARC-Warcinfo-ID: <urn:uuid:{archive}>{EOL}" if archive else "")
    return F.concat(F.lit(first), _header("WARC-Type", kind), _header("WARC-Record-ID", record_id), *more, _header("Content-Length", F.octet_length(block).cast("string")), F.lit(EOL), block)


def plan_roles(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, payload, digest, n_bytes) -> also record_type, refers_to and refers_to_url.

    Of payloads that are equal and of min_bytes or more, the one with the smallest page_id is a response, the others revisit
    it; rows that share that smallest page_id are all responses; null page_ids come last. Only digests that several rows have
    are joined, by broadcast while they are few, so payloads stay where they are read; beyond that AQE splits a hot digest.
    """
    target = F.struct(F.col("page_id").isNull().alias("null"), "page_id", "url")
    groups = pages.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min(target).alias("m"), F.count("*").alias("c")).where("c > 1")
    groups = scratch.save(groups.select(F.col("digest").alias("of"), F.col("m.page_id").alias("first"), F.col("m.url").alias("first_url")), "repeats")
    out = pages.join(small(groups, scratch, "repeats"), F.col("digest") == F.col("of"), "left")
    revisit = F.col("of").isNotNull() & (F.col("n_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first"))).withColumn("refers_to_url", F.when(revisit, F.col("first_url"))).drop("of", "first", "first_url")


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> str:
    """Writes a capture for every row of pages as WARC/1.1 (gzip) under path and returns the archives' id.

    A capture is a response (an HTTP message with the payload, in UTF-8) or a revisit (the message's head alone), its request,
    and its metadata with page-id, payload-bytes and refers-to-page; the last two name the first in WARC-Concurrent-To. One
    warcinfo record describes all files. Null html is an empty payload, a null url has no target URI; repeated rows give a capture each;
    other columns are not looked at; an empty table gives the warcinfo record alone.

    Records end in two line breaks as the format asks, which Spark's text writer puts there; the archives' id, new for each call,
    stands in each record's second line, so that no payload can hold what parts two records and a reader can still split
    the stream at it. A file is one gzip member; record-wise members, which the format recommends, Spark's writer can't make.
    """
    archive, scratch = str(uuid.uuid4()), Scratch(pages.sparkSession)
    body = F.coalesce(pick(pages, html, "string"), F.lit(""))
    p = pages.select(pick(pages, page_id).alias("page_id"), pick(pages, url, "string").alias("url"), body.alias("payload"), sha1_base32(body).alias("digest"), F.octet_length(body).cast("bigint").alias("n_bytes"))
    p = plan_roles(p, scratch, min_bytes).withColumn("id", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
    target, of, when = _header("WARC-Target-URI", F.col("url")), _header("WARC-Concurrent-To", F.col("id")), _header("WARC-Date", F.lit(date))
    revisit = F.col("record_type") == "revisit"
    again = [_header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), _header("WARC-Refers-To-Target-URI", F.col("refers_to_url")), _header("WARC-Refers-To-Date", F.when(revisit, F.lit(date)))]
    digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))

    def http(kind: str) -> Column:
        return _header("Content-Type", F.lit(f"application/http;msgtype={kind}"))

    head = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(EOL * 2))
    main = _record(F.col("record_type"), F.col("id"), F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))), when, target, *again, digest, http("response"), archive=archive)
    clean = F.regexp_replace(F.col("url"), r"[\r\n ]", "")
    host = F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
    asked = F.concat(F.lit("GET "), F.coalesce(clean, F.lit("/")), F.lit(f" HTTP/1.1{EOL}"), F.coalesce(F.concat(F.lit("Host: "), host, F.lit(EOL)), F.lit("")), F.lit(EOL))
    request = _record(F.lit("request"), F.replace(F.col("id"), F.lit(">"), F.lit("-request>")), asked, when, target, of, http("request"), archive=archive)
    facts = F.concat(_header("page-id", F.col("page_id").cast("string")), _header("payload-bytes", F.col("n_bytes").cast("string")), _header("refers-to-page", F.col("refers_to").cast("string")))
    fields = _header("Content-Type", F.lit("application/warc-fields"))
    metadata = _record(F.lit("metadata"), F.replace(F.col("id"), F.lit(">"), F.lit("-metadata>")), facts, when, target, of, fields, archive=archive)
    info = _record(F.lit("warcinfo"), F.lit(f"<urn:uuid:{archive}>"), F.lit(f"software: freshet{EOL}format: WARC File Format 1.1{EOL}"), when, fields)
    records = p.select(F.explode(F.array(main, request, metadata)).alias("value"))
    records.unionByName(pages.sparkSession.range(1, numPartitions=1).select(info.alias("value"))).write.mode("overwrite").option("lineSep", EOL * 2).option("compression", "gzip").text(path)
    return archive


def read_archives(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """The records of write_archives as (record_id, record_type, concurrent_to, target_uri, payload_digest, content_length, body, payload).

    Streams record by record; body is the block, cut to Content-Length, payload what follows an HTTP message's head; a record
    that is shorter raises an error. For archives of other writers see read_warc.
    """
    part = f"{EOL * 2}WARC/1.1{EOL}WARC-Warcinfo-ID: <urn:uuid:{archive}>{EOL}"
    rows = spark.read.option("lineSep", part).text(path)
    at = F.locate(EOL * 2, F.col("value"))
    head = F.substring("value", F.lit(1), at + 1)
    rows = rows.select(head.alias("head"), F.substring("value", at + 4, F.char_length("value")).alias("rest"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r]*)", 1), F.lit(""))
    n = field("Content-Length").cast("bigint")
    has = F.octet_length("rest")
    body = F.when(has == n, F.col("rest")).when(has > n, F.col("rest").cast("binary").substr(F.lit(1), n.cast("int")).cast("string")).otherwise(F.raise_error(F.lit("a WARC record is shorter than its Content-Length")).cast("string"))
    rows = rows.select(
        field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"), field("WARC-Concurrent-To").alias("concurrent_to"), field("WARC-Target-URI").alias("target_uri"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"), field("Content-Type").startswith("application/http").alias("http"), n.alias("content_length"), body.alias("body"),
    )
    after = F.locate(EOL * 2, F.col("body"))
    return rows.withColumn("payload", F.when(F.col("http") & (after > 0), F.substring("body", after + 4, F.char_length("body"))).otherwise(F.col("body"))).drop("http")


_FIELD = re.compile(rb"(?m)^([A-Za-z-]+):[ \t]*([^\r\n]*)")
RECORD = "record_id string, record_type string, concurrent_to string, target_uri string, date string, payload_digest string, content_type string, content_length long, body binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of any writer's archives under path, gzip (record-wise or whole) or plain, as RECORD; body is the block's bytes.

    Files are streamed in pieces that begin after a "WARC/1." and put together to each record's Content-Length, whatever the
    block holds, so memory is bound by the longest record. Field names are read in any case; of a field given twice the first
    counts. A record that ends too soon raises an error, as does a plain file that Spark has split (larger than
    spark.sql.files.maxPartitionBytes): its records can't be found from the middle.
    """
    mark = b"WARC/1."
    whole = F.when(F.col("_metadata.file_block_length") < F.col("_metadata.file_size"), F.raise_error(F.lit("a plain WARC file was split: raise spark.sql.files.maxPartitionBytes or use gzip")).cast("string")).otherwise(F.col("_metadata.file_path"))
    pieces = spark.read.option("lineSep", mark.decode()).option("recursiveFileLookup", "true").text(path).select(whole.alias("file"), F.col("value").cast("binary").alias("piece"))
    names = [c.split()[0] for c in RECORD.split(", ")]

    def read(batches):
        file, held, have, need = None, [], 0, 0

        def record():
            data = b"".join(held)
            end = data.find(b"\r\n\r\n")
            fields: dict[bytes, str] = {}
            for k, v in _FIELD.findall(data[:end]):
                fields.setdefault(k.lower(), v.strip().decode("utf-8", "replace"))
            n = int(fields.get(b"content-length", 0))
            digest = fields.get(b"warc-payload-digest")
            return [fields.get(b"warc-record-id"), fields.get(b"warc-type"), fields.get(b"warc-concurrent-to"), fields.get(b"warc-target-uri"), fields.get(b"warc-date"), digest.split(":", 1)[-1] if digest else None, fields.get(b"content-type"), n, data[end + 4 : end + 4 + n]]

        for rb in batches:
            out = []
            for name, piece in zip(rb.column(0).to_pylist(), rb.column(1)):
                if name != file:
                    if held:
                        raise ValueError(f"a record of {file} is shorter than its Content-Length")
                    file = name
                    if not piece.as_py().strip():
                        continue  # what comes before the first record
                data = piece.as_py()
                if held:
                    held.append(mark)
                    have += len(mark)
                held.append(data)
                have += len(data)
                if need == 0:
                    begun = b"".join(held)
                    held = [begun]
                    end = begun.find(b"\r\n\r\n")
                    if end < 0:
                        continue
                    n = re.search(rb"(?im)^content-length:[ \t]*(\d+)", begun[:end])
                    need = end + 4 + (int(n[1]) if n else 0)
                if have >= need:
                    out.append(record())
                    held, have, need = [], 0, 0
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if c == "content_length" else pa.binary() if c == "body" else pa.string()) for i, c in enumerate(names)], names=names)
        if held:
            raise ValueError(f"a record of {file} is shorter than its Content-Length")

    return pieces.mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id and the structs capture, request and metadata, joined through concurrent_to.

    Either side may name the other. Each struct has all other columns of records, so project a wide body away before if only
    figures of it are wanted. A capture without request or metadata has a null struct; of several, the one with the smallest
    record_id is taken. Captures that share a record_id (which the format forbids) get the same ones; records without an id are no captures.
    """
    rest = [F.col(f"`{c}`") for c in records.columns if c not in ("record_id", "concurrent_to")]
    captures = records.where(F.col("record_type").isin("response", "revisit", "resource") & F.col("record_id").isNotNull())
    main = captures.select("record_id", F.struct(*rest).alias("capture"))
    naming = captures.where(F.col("concurrent_to").isNotNull()).select(F.col("record_id").alias("__main"), F.col("concurrent_to").alias("__side"))
    for kind in ("request", "metadata"):
        side = records.where(F.col("record_type") == kind).select("record_id", "concurrent_to", F.struct(*rest).alias(kind))
        named = side.join(naming, F.col("record_id") == F.col("__side")).select(F.col("__main").alias("of"), "record_id", kind)
        both = side.where(F.col("concurrent_to").isNotNull()).select(F.col("concurrent_to").alias("of"), "record_id", kind).unionByName(named)
        main = main.join(both.groupBy(F.col("of").alias("record_id")).agg(F.min_by(kind, "record_id").alias(kind)), "record_id", "left")
    return main


def op7(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = Scratch(spark).path("warc")
    records = read_archives(spark, path, write_archives(pages, path))
    records = records.withColumn("sha1", F.when(F.col("record_type") == "response", sha1_base32(F.col("payload")))).withColumn("n_bytes", F.octet_length("payload")).withColumn("facts", F.when(F.col("record_type") == "metadata", F.col("body"))).drop("body", "payload")
    captures = assemble(records)
    kind = pages.schema["page_id"].dataType
    fact = lambda name: F.nullif(F.regexp_extract("metadata.facts", rf"(?m)^{name}: ([^\r]*)", 1), F.lit(""))
    stored = F.col("capture.record_type") == "response"
    return captures.select(
        fact("page-id").cast(kind).alias("page_id"), F.when(stored, F.col("capture.n_bytes")).otherwise(fact("payload-bytes")).cast("bigint").alias("payload_bytes"),
        F.when(stored, F.col("capture.sha1")).otherwise(F.col("capture.payload_digest")).alias("payload_digest"), F.col("capture.record_type").alias("record_type"), fact("refers-to-page").cast(kind).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first,
             list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(1 + 5 * i AS BIGINT), 5) AS BIGINT)) AS g FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((g[CAST(j // 4 + 1 AS BIGINT)] >> CAST(15 - 5 * (j % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM g
"""
