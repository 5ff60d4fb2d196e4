"""Operator 6: what is written is read back, revisits point to the largest page."""

import gzip
import hashlib
import random
from collections import Counter

import pytest

from resurvey.llm import warc
from resurvey.llm.base import fresh_path

KIND = "page_id long, url string, html string, digest string, record_id string, copy int"


@pytest.fixture(scope="module")
def page_rows():
    big, other = "<p>é</p>" * 200, "<b>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</b>" * 60
    htmls = [None, "", "short", "short", big, big, big, other, other, "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "z" * 40_000]
    rows = [(i * 3, f"http://h/{i} a\r\nb" if i % 4 else None, h, "d", "r", 5) for i, h in enumerate(htmls)]
    return rows + [rows[4], (None, "http://h/none", big, "d", "r", 5), (None, "http://h/own", "own" * 500, "d", "r", 5)]


def expected(rows):
    groups = {}
    for r in rows:
        data = (r[2] or "").encode()
        if len(data) >= 1000 and r[0] is not None:
            groups[data] = max(groups.get(data, r[0]), r[0])
    out = Counter()
    for r in rows:
        data = (r[2] or "").encode()
        first = groups.get(data)
        again = first is not None and r[0] != first
        out[r[0], len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    return out


@pytest.mark.parametrize("file_bytes", [1, 3000, 64 << 20])
def test_round_trip(spark, page_rows, file_bytes):
    path = fresh_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(page_rows, KIND).repartition(3), path, file_bytes)
    got = warc.page_digests(warc.captures(warc.read_records(spark, path, with_payload=False))).collect()
    assert Counter(map(tuple, got)) == expected(page_rows)


def test_nested_captures(spark, page_rows):
    path = fresh_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(page_rows[:8], KIND), path)
    found = warc.captures(warc.read_records(spark, path)).collect()
    assert len(found) == 8
    for r in found:
        assert len(r.requests) == 1 and r.requests[0].head.startswith("GET ")
        assert len(r.metadata) == 1 and r.metadata[0].fields["via"] == "pages"
        page = int(r.metadata[0].fields["page_id"])
        html = next(x[2] for x in page_rows if x[0] == page)
        assert r.payload is None if r.type == "revisit" else bytes(r.payload) == (html or "").encode()


def test_metadata_through_a_request(spark):
    rows = [("<a>", "response", None, None), ("<b>", "request", "<a>", None), ("<c>", "metadata", "<b>", {"k": "v"}), ("<d>", "warcinfo", None, None)]
    df = spark.createDataFrame(rows, "record_id string, type string, concurrent_to string, fields map<string,string>").selectExpr("*", "'h' AS head")
    (r,) = warc.captures(df).collect()
    assert [m.fields for m in r.metadata] == [{"k": "v"}] and [q.record_id for q in r.requests] == ["<b>"]


def test_nothing(spark):
    path = fresh_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], KIND), path)
    assert warc.page_digests(warc.captures(warc.read_records(spark, path))).collect() == []


def test_members_and_damage(monkeypatch):
    record = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    monkeypatch.setattr(warc, "MEMBER_BYTES", 20)
    data = warc.compressed(record) + b"\0"
    assert gzip.decompress(data) == record
    assert list(warc.parse(data + data)) == [({"warc-type": "x", "content-length": "4"}, b"abcd")] * 2
    assert list(warc.parse(record)) == [({"warc-type": "x", "content-length": "4"}, b"abcd")]
    for bad in (data[:-4], record[:-6], b"HTTP" + record):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


def test_archives_are_closed_by_bytes(spark):
    """Pages of very different sizes: no archive holds more than the bound and one page."""
    rng = random.Random(1)
    rows = [(i, "u", "".join(rng.choices("abcdefgh", k=200_000 if i % 9 == 0 else 300)), "d", "r", 1) for i in range(60)]
    path = fresh_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, KIND).coalesce(1), path, 150_000)
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    assert len(files) > 3 and max(f.length for f in files) < 150_000 + 110_000
    assert warc.page_digests(warc.captures(warc.read_records(spark, path, with_payload=False))).count() == 60
