import hashlib
import io

import pytest

from voicegrain.llm import warc
from voicegrain.llm.common import new_path


def brute(rows, least=0):
    firsts = {}
    for page_id, html in rows:
        p = (html or "").encode()
        if len(p) >= least and page_id is not None:
            firsts[p] = min(page_id, firsts.get(p, page_id))
    out = []
    for page_id, html in rows:
        p = (html or "").encode()
        first = firsts.get(p, page_id)
        revisit = first != page_id
        out.append((page_id, len(p), warc.base32_sha1(p), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, None), (2, ""), (3, "é€𐍈" * 3000), (4, "é€𐍈" * 3000), (5, "WARC/1.1\r\nContent-Length: 5\r\n\r\n\r\n\r\n" * 40), (6, "x" * 16384), (7, "\n"),
        (7, "\n"), (9, "\r\n\r\n"), (9, "other"), (None, "other"), (None, "alone"), (12, "0\r\n\r\n" * 2000)]


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 64, "chunk_bytes": 16}, {"min_payload": 10}])
def test_round_trip(spark, options):
    rows = [x for x in ROWS if options.get("segment_bytes") != 64 or len(x[1] or "") < 12_001]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nx", t, 0) for i, t in rows], "page_id long, url string, html string, digest int")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, **options).collect()]
    assert sorted(got, key=str) == brute(rows, options.get("min_payload", 0))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_come_back_and_damage_is_seen(spark):
    pages = spark.createDataFrame([(1, "u", "é" * 50_000), (2, "v", "short")], "page_id long, url string, html string")
    path = new_path(spark, "warc-test")
    warc.write_archives(pages, path)
    back = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert back[1].payload == ("é" * 50_000).encode() and back[1].n_segments > 3 and back[1].complete and back[1].intact
    assert back[2].payload == b"short" and back[2].url == "v"
    records = warc.read_records(spark, path)
    lost = {r.page_id: r for r in warc.decode(warc.reassemble(records.where("number is null or number <> 2"))).collect()}
    assert not lost[1].complete and not lost[1].intact and lost[2].complete
    again = warc.decode(warc.reassemble(records.union(records.where("number > 1")))).where("page_id = 1").collect()
    assert len(again) == 1 and again[0].complete


def test_parse_and_dechunk():
    text = warc._record("response", "urn:x", [("A", "b")], b"body\r\n\r\n") + "\n"
    (fields, block), = warc.parse(io.BytesIO(text.encode()))
    assert fields["a"] == "b" and block == b"body\r\n\r\n"
    assert warc.dechunk(b"3;x=1\r\nabc\r\nA\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    with pytest.raises(ValueError):
        warc.dechunk(b"3\r\nabcd\r\n0\r\n\r\n")
    assert warc.base32_sha1(b"") == __import__("base64").b32encode(hashlib.sha1(b"").digest()).decode()
