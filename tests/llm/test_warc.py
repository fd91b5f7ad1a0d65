import base64
import gzip
import hashlib

import pytest
from llm_rows import ordered
from pyspark.sql import functions as F

from cargolens.llm import warc

SCHEMA = "page_id long, url string, html string"
BIG = "é" * 30_000 + "\r\n\r\nWARC/1.1\r\n" * 900
PAGES = [
    (1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same"), (7, "u\r\nx", BIG), (8, "u", BIG), (9, "u", "only"),
    (10, "u", None), (11, "u", ""), (12, None, None), (13, "u", "twice"), (13, "v", "twice"), (None, "u", "same"), (None, "v", "same"), (None, "v", "same"), (14, "u", "0\r\n\r\n"),
]


def brute(pages):
    last = {}
    for page, _, html in pages:
        if page is not None:
            last[html or ""] = max(page, last.get(html or "", page))
    out = []
    for page, _, html in pages:
        body = (html or "").encode()
        to = None if page is None or last[html or ""] == page else last[html or ""]
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if to is None else "revisit", to, None))
    return out


def test_archives_read_back(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA).withColumns({"origin": F.lit("x"), "payload": F.lit(1), "sha": F.lit(2), "last": F.lit(3)})
    pages = pages.unionByName(spark.createDataFrame([(13, "v", "other")], SCHEMA), allowMissingColumns=True)
    got = warc.archived(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "fault"]
    assert ordered(got.collect()) == ordered(brute([*PAGES, (13, "v", "other")]))
    assert got.count() == len(PAGES) + 1
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_repeats_come_back_in_turns(spark, monkeypatch):
    monkeypatch.setattr(warc, "BACK_AT_ONCE", 7)
    pages = spark.range(40).selectExpr("id % 2 as page_id", "'u' as url", "repeat('x', cast(id % 2 as int)) as html").unionByName(spark.createDataFrame(PAGES, SCHEMA))
    counts = {r["page_id"]: r["count"] for r in warc.archived(pages).groupBy("page_id").count().collect()}
    assert counts[0] == 20 and counts[1] == 21 and sum(counts.values()) == 40 + len(PAGES)


def test_payloads_come_back_whole(spark, tmp_path):
    pages = spark.createDataFrame([p for p in PAGES if p[0] is not None], SCHEMA)
    warc.write(warc.revisits(pages), str(tmp_path / "w"), segment=1000)
    rows = warc.reassembled(warc.read_segments(spark, str(tmp_path / "w"))).where("type = 'response'").collect()
    own = {p[0]: (p[2] or "").encode() for p in PAGES}
    assert all(bytes(r.payload) == own[r.page_id] and r.fault is None for r in rows)
    files = list((tmp_path / "w").glob("*.gz"))
    records = [x for f in files for x in warc.parsed(gzip.decompress(f.read_bytes()))]
    cut = [f for f, _ in records if "warc-segment-number" in f]
    assert len(cut) > 70 and all(len(b) <= 1000 for f, b in records if f in cut)


def segments_of(spark, records):
    rows = [warc._segment(f, b) for r in records for f, b in warc.parsed(r + b"\r\n\r\n")]
    return spark.createDataFrame(rows, warc.SEGMENTS)


def test_faults_are_named(spark):
    whole = warc.records(1, "u", b"x" * 5000, None, segment=1000)
    assert len(whole) > 4

    def fault(records):
        return [r.fault for r in warc.reassembled(segments_of(spark, records)).collect()]

    assert fault(whole) == [None]
    assert fault(whole[::-1]) == [None]
    assert fault([*whole, whole[2]]) == [None]
    assert fault([*whole[:2], *whole[3:]]) == ["segment missing or repeated"]
    assert fault(whole[:-1]) == ["segments differ from the total length"]
    assert fault(whole[1:]) == ["first segment missing"]
    other = warc.records(1, "u", b"y" * 5000, None, segment=1000)
    mixed = [w.replace(warc.record_id(f"page:1:{warc.digest(b'y' * 5000)}"), warc.record_id(f"page:1:{warc.digest(b'x' * 5000)}")) for w in other]
    assert fault([*whole[:3], mixed[3], *whole[4:]]) == ["payload differs from its digest or length"]


@pytest.mark.parametrize("payload", [b"", b"a", b"ab" * 10_000, b"0\r\n\r\n"])
def test_chunked_framing(payload):
    assert warc.unchunked(warc.chunked(payload, 7)) == payload
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\n\r\n" + payload) == payload


@pytest.mark.parametrize("body", [b"", b"5\r\nab", b"zz\r\nab\r\n0\r\n\r\n", b"2\r\nabc\r\n0\r\n\r\n", b"2\r\nab\r\n"])
def test_broken_framing_is_refused(body):
    with pytest.raises(ValueError):
        warc.unchunked(body)


@pytest.mark.parametrize("data", [b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab", b"nonsense", b"WARC/1.1\r\nno end"])
def test_broken_records_are_refused(data):
    with pytest.raises(ValueError):
        list(warc.parsed(data))
