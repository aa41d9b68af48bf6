import gzip
import hashlib
import io
import zlib

import pytest

from cairn.llm import warc as W

SCHEMA = "page_id long, url string, html string, archive string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", None) for r in rows], SCHEMA)


BIG = "<p>" + "é" * 700
ROWS = [
    (1, "http://a/1", BIG),
    (5, "http://a/5 b\r\nX: y", BIG),
    (3, None, BIG),
    (5, "http://a/5", BIG),
    (None, "http://nobody", BIG),
    (7, "http://a/7", "short"),
    (8, "http://a/8", "short"),
    (9, "http://a/9", None),
    (10, "http://a/10", ""),
    (11, "http://a/11", "x" * 1000),
    (12, "http://a/12", "x" * 1000),
    (13, "http://a/13", "y" * 999),
    (14, "http://a/14", "y" * 999),
    (15, "http://a/15", "z\r\n\r\n" * 60_000),
]


def brute(rows):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and i is not None and i != best[h or ""]
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", best[h or ""] if again else None))
    return sorted(out, key=repr)


def test_round_trip_against_brute_force(spark):
    got = W.read_archives(W.write_archives(pages(spark, ROWS))).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute(ROWS)
    payloads = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert payloads[15] == ROWS[-1][2].encode() and payloads[9] == b""
    assert all(bytes(r.payload) == b"" for r in got if r.record_type == "revisit")


def test_several_archives_from_a_task(spark, monkeypatch):
    monkeypatch.setattr(W, "RECORDS", 3)
    archives = W.write_archives(pages(spark, ROWS).coalesce(1))
    assert archives.count() >= 4
    assert sorted((tuple(r)[:5] for r in W.read_archives(archives, payloads=False).collect()), key=repr) == brute(ROWS)


def test_no_pages(spark):
    assert W.read_archives(W.write_archives(pages(spark, []))).collect() == []


def archive(n=5):
    return b"".join(W.record_bytes(k, f"http://a/{k}", f"page {k} ".encode() * 50, None) for k in range(n))


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_pieces_of_any_size(piece):
    got = list(W.records(io.BytesIO(archive()), piece))
    assert [r.payload for r in got] == [f"page {k} ".encode() * 50 for k in range(5)]
    assert all(r.sha1 == hashlib.sha1(r.payload).hexdigest() for r in got)


def test_members_stand_alone():
    raw = archive(3)
    whole = gzip.decompress(raw)
    assert whole.count(b"WARC/1.1\r\n") == 3
    first = zlib.decompressobj(31)
    assert first.decompress(raw).endswith(b"\r\n\r\n") and first.eof and first.unused_data


def _member(text: bytes) -> bytes:
    return gzip.compress(text)


@pytest.mark.parametrize(
    "bad",
    [
        archive()[:-10],
        b"not gzip at all",
        _member(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n"),
        _member(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nlonger\r\n\r\n"),
        _member(b"WARC/1.1\r\nContent-Length: x\r\n\r\n\r\n\r\n"),
        _member(b"HTTP/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
        _member(gzip.decompress(archive(1)).replace(b"page 0", b"page 1")),
        _member(b"no head ends here"),
    ],
)
def test_damage_is_an_error(bad):
    with pytest.raises(W.WarcError):
        list(W.records(io.BytesIO(bad)))


def test_heads_cannot_be_forged():
    (r,) = W.records(io.BytesIO(W.record_bytes(1, "http://a/\r\nWARC-Type: metadata", b"x", None)))
    assert r.fields["warc-type"] == "response" and "\r" not in r.fields["warc-target-uri"]
