"""Archives written and read back, whole and in part, and indexed anew."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import warc

PAGE = "<p>" + "word " * 40 + "</p>"
LONG = "".join(f"<p>line {i} with\r\n\r\nbreaks é</p>" for i in range(60_000))
ROWS = [
    (3, "http://a/3", PAGE), (1, "http://a/1", PAGE), (2, "http://a/2", PAGE), (1, "http://a/1 again", PAGE), (None, "http://a/null", PAGE),
    (4, None, "short"), (5, "http://a/5", "short"), (6, "http://a/6", None), (7, "", ""), (8, "http://x/%20 \r\nWARC-Type: metadata", "é" * 60),
    (9, "http://ü/", LONG), (10, "http://ü/", LONG), (None, None, "x" * 200), (None, None, "x" * 200), (11, "u", "b" * 99), (12, "u", "b" * 99),
]


def pages(spark, rows=ROWS, partitions=3):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions)
    return df.withColumns({c: F.lit("x") for c in ("digest", "first", "offset", "file", "n", "refers_to")})


def expected(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, other in rows if (other or "") == (html or "") and j is not None]
        first = min(same) if same and len(data) >= 100 and len([1 for _, _, o in rows if (o or "") == (html or "")]) > 1 else None
        revisit = first is not None and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    index = warc.write_archives(pages(spark))
    got = warc.read_records(index)
    assert sorted((tuple(r)[:1] + (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == expected(ROWS)
    bodies = {r.page_id: bytes(r.payload).decode() for r in got.collect() if r.record_type == "response" and r.page_id is not None}
    assert all(bodies[i] == (html or "") for i, _, html in ROWS if i in bodies) and {4, 5, 6, 7, 8, 9, 11, 12} <= set(bodies)
    assert all(r.payload is None for r in got.where("record_type = 'revisit'").collect())
    index_rows = {(r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in index.collect()}
    assert index_rows == {(r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()}


def test_archives_are_gzip_members_and_can_be_indexed_anew(spark):
    index = warc.write_archives(pages(spark))
    for r in index.collect():
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")
    anew = warc.index_archives(spark, index.select("file").distinct())
    columns = ["file", "offset", "length", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(str, anew.select(columns).collect())) == sorted(map(str, index.select(columns).collect()))


def test_reads_only_what_is_selected(spark):
    index = warc.write_archives(pages(spark))
    got = warc.read_records(index.where("page_id IN (4, 9)")).collect()
    assert sorted(r.page_id for r in got) == [4, 9] and all(r.record_type == "response" for r in got)
    assert warc.read_records(index.limit(0)).collect() == []
    assert warc.read_records(index.where("page_id = 4").union(index.where("page_id = 4"))).count() == 2


def test_spans():
    assert list(warc.spans([(0, 10), (10, 5), (40, 2), (300, 7)], gap=50, most=100)) == [(0, 42, 3), (300, 307, 1)]
    assert list(warc.spans([(0, 60), (60, 60)], gap=50, most=100)) == [(0, 60, 1), (60, 120, 1)]
    assert list(warc.spans([(5, 3), (5, 3)])) == [(5, 8, 2)] and list(warc.spans([])) == []


def test_empty_and_broken(spark):
    assert warc.write_archives(pages(spark).limit(0)).count() == 0
    data = warc.record(1, "http://a/", b"abc", hashlib.sha256(b"abc").hexdigest(), None, "1970-01-01T00:00:00Z")
    assert warc.parsed(data)["payload"] == b"abc"
    for bad in (data[:-1], data.replace(b"abc", b"abd"), data.replace(b"WARC/1.1", b"HTTP/1.1", 1)):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    got = warc.read_records(warc.write_archives(pages(spark)), payloads=False)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == expected(ROWS)
