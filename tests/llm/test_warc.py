import gzip
import hashlib
from base64 import b32encode

import pytest

from conftest import SMALL
from tallyloom.llm import warc
from tallyloom.llm.common import table

PAGES = "page_id bigint, url string, html string, key string, payload string"


@pytest.fixture
def rows():
    same = "<p>" + "same " * 50
    return [(1, "http://b.example.com/x?q=1", same, "", ""), (2, "http://a.example.com/", same, "", ""), (3, None, None, None, None), (4, "", "", "", ""), (5, "http://é.com/a b\nc", "ünï 😀", "", ""), (1, "http://b.example.com/x?q=1", same, "", ""), (None, "http://a.example.com/", same, "", "")]


def _plain(rows):
    first = {}
    for p, _, h, *_ in rows:
        data = (h or "").encode()
        if p is not None:
            first[data] = min(first.get(data, p), p)
    out = []
    for p, _, h, *_ in rows:
        data = (h or "").encode()
        again = data in first and p != first[data]
        out.append((str(p) if p is not None else None, len(data), b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", str(first[data]) if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark, rows):
    archive = warc.write(spark.createDataFrame(rows, PAGES))
    for got in (warc.read_all(archive), warc.lookup(archive, warc.capture_key(spark.createDataFrame(rows, PAGES).select("page_id", "url")))):
        back = sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
        assert back == _plain(rows)
    texts = {r.page_id: r.payload.decode() for r in warc.read_all(archive).where("record_type = 'response'").collect()}
    assert texts["5"] == "ünï 😀" and texts["3"] == ""


def test_lookup_through_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 5)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/{i}", f"page {i}") for i in range(300)], "page_id long, url string, html string")
    archive = warc.write(pages)
    wanted = warc.capture_key(pages.where("page_id % 10 = 3").select("page_id", "url"))
    assert {int(r.page_id) for r in warc.lookup(archive, wanted).collect()} == set(range(3, 300, 10))
    assert {int(r.page_id) for r in warc.lookup(archive, wanted, most_blocks=2).collect()} == set(range(3, 300, 10))
    assert warc.lookup(archive, spark.createDataFrame([("zz)/",), (None,)], "key string")).collect() == []


def test_records_are_standard_members(spark):
    archive = warc.write(spark.createDataFrame([(1, "http://a.com/", "hello")], "page_id long, url string, html string"))
    row = archive.captures.first()
    data = gzip.open(f"{archive.folder.removeprefix('file://')}/{row.file}").read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"\r\n\r\nhello\r\n\r\n" in data


def test_small_payloads_are_never_revisits(spark, rows):
    got = warc.read_all(warc.write(spark.createDataFrame(rows, PAGES), least_bytes=10_000)).collect()
    assert {r.record_type for r in got} == {"response"}


def test_empty(spark):
    archive = warc.write(spark.createDataFrame([], PAGES))
    assert warc.read_all(archive).collect() == [] and archive.captures.collect() == []


def test_every_page_is_found(spark):
    assert warc.op9_warc(spark, SMALL).select("page_id").distinct().count() == table(spark, SMALL, "pages").count()
