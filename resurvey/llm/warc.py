"""Operator 6: pages as WARC archives, and archives as one nested row per capture.

Each page gives a request, a response (or a revisit of an equal payload) and a metadata record;
request and metadata name the response in ``WARC-Concurrent-To``.  Each record is a gzip member of
its own.  Archives are written by Spark's text sink, whose line end is the zero byte that every
member of less than 16 MiB ends with, so they go to whatever file system the cluster shares; they
are read as binary files.  Reading joins the records of a transaction through their identifiers.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resurvey.llm.base import only, small_side, written

# Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
# Compressed bytes after which an archive is closed; a reading task holds one archive.
FILE_BYTES = 64 << 20
MEMBER_BYTES = (16 << 20) - 1
# Compressed bytes handed to the library at once.
INFLATE_BYTES = 1 << 13
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _id(kind: str, *cols: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols]))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: str, rid: Column, uri: Column, content_type: str, block: Column, *more: tuple[str, Column]) -> Column:
    """A record in bytes; ``more`` headers that are NULL are left out."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), uri)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in more]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    head = F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")), "UTF-8")
    return F.concat(head, block, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def _utf8(*parts: Column) -> Column:
    return F.encode(F.concat(*parts), "UTF-8")


def _numbered(pages: DataFrame) -> DataFrame:
    """``copy``: rows that share a page_id are numbered; usually none do."""
    twice = written(pages.groupBy("page_id").agg(F.count("*").alias("_n")).where("_n > 1").select("page_id"), "warc-twice")
    twice = small_side(twice)
    same = F.col("page_id").eqNullSafe(F.col("_id"))
    marked = pages.join(twice.select(F.col("page_id").alias("_id"), F.lit(True).alias("_twice")), same, "left")
    alone = marked.where("_twice IS NULL").withColumn("copy", F.lit(0))
    order = Window.partitionBy("page_id").orderBy("url", "html")
    among = marked.where("_twice IS NOT NULL").withColumn("copy", F.row_number().over(order) - 1)
    return alone.unionByName(among).drop("_id", "_twice")


def transactions(pages: DataFrame) -> DataFrame:
    """One row per page with its records in bytes, in the order request, response or revisit, metadata."""
    pages = _numbered(only(pages, "page_id", "url", "html"))
    rows = pages.select(
        "page_id", "copy",
        # line ends and spaces cannot stand in a header
        F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\x00-\x20\x7f]", "%20").alias("uri"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.withColumns({"n": F.octet_length("payload"), "digest": F.sha1("payload")})
    groups = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("digest", "n").agg(F.max("page_id").alias("original"), F.count("*").alias("_n"))
    groups = small_side(written(groups.where("_n > 1").drop("_n"), "warc-equal"))
    rows = rows.join(groups, ["digest", "n"], "left")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    key = (F.col("page_id"), F.col("copy"))
    uri, digest = F.col("uri"), F.concat(F.lit("sha1:"), F.col("digest"))
    http = _utf8(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    main = F.when(again, _id("revisit", *key)).otherwise(_id("response", *key))
    asked = _utf8(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\nAccept: text/html\r\n\r\n"))
    facts = _utf8(F.concat_ws("\r\n", F.concat(F.lit("page_id: "), F.col("page_id").cast("string")), F.lit("via: pages")), F.lit("\r\n"))
    concurrent = ("WARC-Concurrent-To", main)
    response = _record("response", main, uri, "application/http; msgtype=response", F.concat(http, F.col("payload")), ("WARC-Payload-Digest", digest))
    revisit = _record(
        "revisit", main, uri, "application/http; msgtype=response", http, ("WARC-Payload-Digest", digest),
        ("WARC-Refers-To", _id("response", F.col("original"), F.lit(0))), ("WARC-Profile", F.lit(PROFILE)),
    )
    return rows.select(
        F.array(
            _record("request", _id("request", *key), uri, "application/http; msgtype=request", asked, concurrent),
            F.when(again, revisit).otherwise(response),
            _record("metadata", _id("metadata", *key), uri, "application/warc-fields", facts, concurrent),
        ).alias("records")
    )


def compressed(record: bytes) -> bytes:
    """The record as gzip members of less than 16 MiB each, up to the last zero byte."""
    parts = [record[i : i + MEMBER_BYTES] for i in range(0, len(record), MEMBER_BYTES)]
    return b"".join(gzip.compress(p, 6, mtime=0) for p in parts)[:-1]


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write the records of rows (page_id, url, html) as archives below ``path``.

    Of rows with equal payloads of at least 1000 bytes the one with the largest page_id is a
    response, the others are revisits of it.  An archive is closed once it holds ``file_bytes``; the
    records of a page stay together.  NULL html is an empty payload, a NULL url becomes
    ``urn:none``; a row with NULL page_id is written without naming it; repeated rows are written
    one by one; an empty table gives no records; other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        archive = held = 0
        for batch in batches:
            for records in batch.column(0):
                members = [compressed(r.as_py()) for r in records.values]
                yield pa.record_batch([pa.array([archive] * len(members), pa.int32()), pa.array(members, pa.binary())], ["archive", "value"])
                held += sum(map(len, members))
                if held >= file_bytes:
                    archive, held = archive + 1, 0

    members = transactions(pages).mapInArrow(run, "archive int, value binary")
    # the text sink writes the bytes as they are; a task's archives are folders apart
    sink = members.select("archive", F.col("value").cast("string").alias("value")).write
    sink.option("lineSep", "\0").partitionBy("archive").text(path)


def inflate(data: bytes) -> Iterator[bytes]:
    """The gzip members of an archive one by one; an archive that is not compressed as a whole."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a record")
            step = view[at : at + INFLATE_BYTES]  # what lies behind the member is copied, so not all of the rest
            parts.append(member.decompress(step))
            at += len(step) - len(member.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, found by its stated length."""
    rest = b""
    for part in inflate(data):
        rest += part
        at = 0
        while True:
            end = rest.find(b"\r\n\r\n", at)
            if end < 0:
                break
            lines = rest[at:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = {}
            for line in lines[1:]:
                name, _, value = line.partition(":")
                headers[name.strip().lower()] = value.strip()
            size = int(headers["content-length"])
            stop = end + 4 + size + 4
            if stop > len(rest):
                break
            yield headers, rest[end + 4 : end + 4 + size]
            at = stop
        rest = rest[at:]
    if rest.strip():
        raise ValueError("the archive ends inside a record")


RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, "
    "payload_digest string, payload_bytes long, head string, fields map<string,string>, payload binary"
)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``, see ``RECORD``.

    ``payload_digest`` (bare lower-case hex SHA-1) and ``payload_bytes`` are taken from the payload of
    a response itself, for a revisit from its headers.
    """

    def row(headers: dict[str, str], block: bytes) -> dict:
        kind = headers.get("warc-type", "")
        out = {
            "record_id": headers.get("warc-record-id"), "type": kind, "concurrent_to": headers.get("warc-concurrent-to"),
            "refers_to": headers.get("warc-refers-to"), "uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
        }
        if kind == "metadata":
            pairs = [line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n") if ":" in line]
            out["fields"] = [(a.strip(), c.strip()) for a, _, c in pairs]
            return out
        head, _, payload = block.partition(b"\r\n\r\n")
        out["head"] = head.decode("utf-8", "replace")
        if kind == "response":
            out |= {"payload_digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload)}
            if with_payload:
                out["payload"] = payload
        elif kind == "revisit":
            out["payload_digest"] = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
            lengths = [h.partition(":")[2] for h in out["head"].split("\r\n") if h.lower().startswith("content-length:")]
            out["payload_bytes"] = int(lengths[0]) if lengths else None
        return out

    texts = ["record_id", "type", "concurrent_to", "refers_to", "uri", "date", "payload_digest"]
    schema = pa.schema([
        *[(n, pa.string()) for n in texts], ("payload_bytes", pa.int64()), ("head", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parse(content.as_buffer().to_pybytes()):
                    rows.append(row(headers, block))
                    size += len(block) if with_payload else 200
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One row per response or revisit with its transaction nested.

    Columns: the record's own (``record_id`` to ``payload``), ``requests`` and ``metadata``: lists of the
    records that are concurrent to it, directly or through one of its requests (empty if none).
    Records of other types and without a capture are left out.
    """
    main = records.where(F.col("type").isin("response", "revisit")).drop("concurrent_to", "fields")
    asked = records.where("type = 'request'").select("record_id", "concurrent_to", "head")
    noted = records.where("type = 'metadata'").select("record_id", "concurrent_to", "fields")
    through = asked.select(F.col("record_id").alias("concurrent_to"), F.col("concurrent_to").alias("_main"))
    noted = noted.join(through, "concurrent_to", "left").withColumn("_main", F.coalesce("_main", "concurrent_to"))
    requests = asked.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.collect_list(F.struct("record_id", "head")).alias("requests"))
    notes = noted.groupBy(F.col("_main").alias("record_id")).agg(F.collect_list(F.struct("record_id", "fields")).alias("metadata"))
    joined = main.join(requests, "record_id", "left").join(notes, "record_id", "left")
    return joined.withColumns({
        "requests": F.coalesce("requests", F.array().cast("array<struct<record_id:string,head:string>>")),
        "metadata": F.coalesce("metadata", F.array().cast("array<struct<record_id:string,fields:map<string,string>>>")),
    })


def page_digests(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response) of captures."""
    rows = found.select(
        "record_id", "type", "refers_to", "payload_bytes", "payload_digest",
        F.element_at(F.col("metadata")[0]["fields"], "page_id").cast("long").alias("page_id"),
    )
    rows = written(rows, "warc-captures")
    originals = rows.where("type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")
    )
    return rows.join(originals, "refers_to", "left").select(
        "page_id", F.coalesce("_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("_digest", "payload_digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("_page").alias("refers_to"),
    )
