"""Archives: an exact round trip, damaged segments, and revisits."""

import hashlib
import random

import pytest

from kpispark.llm.warc import (_page_row, archive_round_trip, chunked, page_records, parse, plain_bytes, read_archives, unchunked,
                               write_archives)

from .fixtures import EDGE

SCHEMA = "page_id long, url string, html string, original long, digest string"


def pages():
    rnd = random.Random(3)
    big = "".join(rnd.choice("aé漢🙂<p>\r\n\r\n0\r\nWARC/1.1\r\n") for _ in range(60_000))
    texts = [*EDGE, big, big, "r" * 1000, "r" * 1000, "r" * 1000, "s" * 999, "s" * 999, "é" * 500, "é" * 500, "WARC/1.1\r\n\r\n" * 300]
    return [(i * 2, None if i % 4 == 0 else f"http://x/{i}\r\nEvil: 1 é", t, 5, "d") for i, t in enumerate(texts)]


def plain(rows):
    last = {}
    for p, _, t, *_ in rows:
        raw = (t or "").encode()
        if len(raw) >= 1000:
            last[raw] = max(last.get(raw, p), p)
    out = []
    for p, _, t, *_ in rows:
        raw = (t or "").encode()
        ref = last.get(raw, p)
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "response" if ref == p else "revisit", None if ref == p else ref))
    return sorted(out)


def test_round_trip(spark):
    rows = pages()
    got = archive_round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert all(r["intact"] for r in got) and max(r["segments"] for r in got) >= 5
    assert sorted(tuple(r)[:5] for r in got) == plain(rows)


def test_small_segments_and_nulls(spark, tmp_path):
    rows = [*pages(), (None, None, "no id", None, None), (2, "u", "", None, None), (2, "u", "", None, None)]
    folder = str(tmp_path / "a")
    write_archives(spark.createDataFrame(rows, SCHEMA), folder, segment_bytes=100)
    got = read_archives(spark, folder).collect()
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    assert sum(r["page_id"] is None for r in got) == 1


def test_empty_table(spark):
    assert archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunked_framing():
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        raw = ("é" * n).encode()[:n * 2]
        assert unchunked(chunked(raw)) == raw
    assert unchunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc", b"zz\r\n", b"3\r\nabcX"):
        with pytest.raises(ValueError):
            unchunked(bad)


def test_damage_is_told(spark, tmp_path):
    import gzip
    records = page_records(7, "http://x", b"q" * 5000, None, "0", 1000)
    folders = {}
    for name, kept in {"whole": records[::-1], "gap": records[:2] + records[3:], "short": records[:-1]}.items():
        (tmp_path / name).mkdir()
        data = "".join(r + "\r\n\r\n" for r in kept).encode()
        assert len(list(parse(data))) == len(kept)
        (tmp_path / name / "x.gz").write_bytes(gzip.compress(data))
        folders[name] = read_archives(spark, str(tmp_path / name)).first()["intact"]
    assert folders == {"whole": True, "gap": False, "short": False}
    assert not _page_row(1, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab", None, 1)["intact"]


def test_a_gzip_member_for_every_record(spark, tmp_path):
    import gzip
    payloads = {7: b"q" * 5000, 8: "é漢🙂".encode() * 400, 9: b""}
    records = [r for p, raw in payloads.items() for r in page_records(p, f"http://x/{p}", raw, None, "0", 1000)]
    (tmp_path / "members").mkdir()
    (tmp_path / "members" / "a.warc.gz").write_bytes(b"".join(gzip.compress((r + "\r\n\r\n").encode("utf-8", "surrogateescape")) for r in records))
    (tmp_path / "members" / "b.warc.gz").write_bytes(gzip.compress(
        (page_records(10, "http://x/10", b"one member", None, "0")[0] + "\r\n\r\n").encode()) + b"\0" * 9)
    got = {r.page_id: r for r in read_archives(spark, str(tmp_path / "members")).collect()}
    assert {p: bytes(r.payload) for p, r in got.items()} == payloads | {10: b"one member"}
    assert all(r.intact and r.uri == f"http://x/{p}" for p, r in got.items()) and got[7].segments == 6
    with pytest.raises(ValueError, match="cut short"):
        plain_bytes(gzip.compress(b"whole")[:-9])


def test_archives_are_deleted(spark):
    from kpispark import session
    before = len(session._WRITTEN)
    archive_round_trip(spark.createDataFrame(pages()[:3], SCHEMA)).collect()
    assert any("warc-" in path for _, path in session._WRITTEN[before:])
