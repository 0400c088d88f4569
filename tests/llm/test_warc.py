import gzip
import hashlib

import pytest

from claimweave.llm import warc
from claimweave.llm.common import work_path

SCHEMA = "page_id long, url string, html string, row int, payload string"


def test_round_trip_of_odd_pages(spark):
    long = "ö€𝄞x\r\n" * 20000
    trap = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n0\r\n\r\n" * 5
    rows = [
        (1, "http://a/ b\r\nX: y", long, 0, "z"), (2, None, long, 0, "z"), (3, "u", None, 0, None), (4, "u", "", 0, None),
        (5, "u", trap, 0, None), (6, "u", "s" * 99, 0, None), (7, "u", "s" * 99, 0, None), (8, "u", "t" * 100, 0, None),
        (9, "u", "t" * 100, 0, None), (None, "u", "t" * 100, 0, None), (10, "u", "t" * 100, 0, None),
    ]
    path = work_path(spark, "t")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path, segment=1000)
    read = warc.read_archives(spark, path)
    got = {r.page_id: r for r in warc.page_digests(read).collect()}
    assert len(got) == len(rows)
    for page_id, _, html, *_ in rows:
        payload = (html or "").encode()
        assert got[page_id].payload_bytes == len(payload)
        assert got[page_id].payload_digest == hashlib.sha256(payload).hexdigest()
    assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {2: 1, 9: 8, None: 8, 10: 8}
    payloads = {r.page_id: r.payload for r in read.collect()}
    assert bytes(payloads[1]) == long.encode() and bytes(payloads[5]) == trap.encode() and payloads[2] is None
    kinds = warc.read_records(spark, path).groupBy("kind").count().collect()
    assert {r.kind for r in kinds} == {"response", "continuation", "revisit"}


def test_empty_table(spark):
    path = work_path(spark, "t")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.page_digests(warc.read_archives(spark, path)).count() == 0


def test_broken_input_is_refused(spark):
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"nothing"))
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabc\r\n0\r\n\r\n")
    two = gzip.compress(b"WARC/1.1\r\nContent-Length: 1\r\n\r\na\r\n\r\n") + gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    assert [b for _, b in warc.parse_records(two)] == [b"a", b""]
    parts = [("response", "r", 1, "u", None, None, None, 1, None, bytearray(b"a")), ("continuation", "c", None, "u", None, None, "r", 3, 3, bytearray(b"b"))]
    with pytest.raises(Exception, match="not whole"):
        warc.reassemble(spark.createDataFrame(parts, warc._RECORD)).collect()


def test_a_repeated_page_id_with_other_payloads(spark):
    a, b = "a" * 150, "b" * 150
    path = work_path(spark, "t")
    warc.write_archives(spark.createDataFrame([(5, "u", a), (5, "u", b), (7, "u", a), (8, "u", b)], "page_id long, url string, html string"), path)
    got = {(r.page_id, r.payload_digest, r.refers_to) for r in warc.page_digests(warc.read_archives(spark, path)).collect()}
    da, db = (hashlib.sha256(x.encode()).hexdigest() for x in (a, b))
    assert got == {(5, da, None), (5, db, None), (7, da, 5), (8, db, 5)}
