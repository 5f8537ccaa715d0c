"""WARC archives: round trip, damaged and segmented records."""

import gzip
import glob

import brute
from gaugeflow.llm import warc

PAGES = "page_id long, url string, html string, record string"


def test_round_trip(spark, tmp_path):
    big = "é漢" * 40_000
    rows = [
        (5, "http://a", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "http://c\r\nX: y", None), (2, "http://d WARC/1.1", ""),
        (4, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\nWARC/1.1\r\n" * 3), (6, "u", "ends with WARC/1.1"), (7, "u", big), (8, "u", big), (10, "u", "\r\n\r\n"),
        (11, "u", "a\x00b\x85c d\r\n"), (11, "u", "a\x00b\x85c d\r\n"), (None, "u", "null id"), (None, "u", "same"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(3)
    found = warc.archive_round_trip(df, str(tmp_path / "w"), chunk_bytes=1000).collect()
    assert len(found) == len(rows)
    data = lambda html: (html or "").encode()
    first = {}
    for i, _, html in rows:
        first[data(html)] = min(first.get(data(html), i if i is not None else 99), i if i is not None else 99)
    responses = {}
    for r in found:
        payload = next(data(h) for i, _, h in rows if i == r.id and brute.base32_sha1(data(h)) == r.digest)
        assert r.bytes == len(payload)
        if r.type == "response":
            responses[payload] = responses.get(payload, 0) + 1
            assert r.refers_to is None and r.id in (first[payload], None)
        else:
            assert r.type == "revisit" and r.refers_to == first[payload]
    assert responses == {p: 1 for p in first}
    text = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "w" / "*.gz")))
    assert text.count(b"WARC-Type: continuation") > 100 and text.startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_empty_and_small_payloads(spark, tmp_path):
    df = spark.createDataFrame([], PAGES)
    assert warc.archive_round_trip(df, str(tmp_path / "none")).count() == 0
    df = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abc", ""), (4, "u", "abc", "")], PAGES)
    found = {r.id: (r.type, r.refers_to) for r in warc.archive_round_trip(df, str(tmp_path / "small"), revisit_bytes=3).collect()}
    assert found == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_pieces_join_to_the_payload():
    for data in (b"", b"x", "é".encode() * 999, b"WARC/1.1\r\n" * 50, b"WARC/1.1"):
        parts = [bytes(p) for p in warc.pieces(memoryview(data), 64)]
        assert b"".join(parts) == data and all(b"WARC/1.1\r\n" not in p + b"\r\n" for p in parts)
