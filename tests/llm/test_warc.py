
import hashlib
import io

import pytest

from quern.llm import warc


def members(payloads):
    return b"".join(warc.member(warc.record("response", f"urn:page:{i}", "http://x/", "2024-01-01T00:00:00Z", p), 6) for i, p in enumerate(payloads))


def test_reader_in_small_blocks(monkeypatch):
    payloads = [b"", b"\r\n\r\n", b"WARC/1.1\r\n" * 300, bytes(range(256)) * 4000]
    for block in (1, 7, 1 << 18):
        monkeypatch.setattr(warc, "_BLOCK", block)
        if block > 1:
            assert [r["payload"] for r in warc.parse(members(payloads))] == payloads
        else:
            assert [r["payload"] for r in warc.parse(members(payloads[:2]))] == payloads[:2]


def test_damage_is_seen():
    good = members([b"abc" * 1000, b"def" * 1000])
    with pytest.raises((EOFError, ValueError)):
        warc.parse(good[:-9])
    raw = warc.record("response", "urn:page:1", "u", "d", b"hello")
    for bad in (raw.replace(b"hello", b"hellO"), raw.replace(b"Content-Length: 5\r\n", b"Content-Length: 6\r\n"), raw + b"x", b"x" + raw):
        with pytest.raises((EOFError, ValueError)):
            warc.parse(warc.member(bad, 6))
    with pytest.raises(ValueError):
        warc.parse(warc.member(raw + raw, 6))


def test_round_trip(spark):
    big, same = "é" * 5000, "x" * 1000
    rows = [(1, "http://a\r\n", big, "k"), (2, "u", big, None), (3, None, same, ""), (9, "u", same, ""), (4, "u", "small", ""), (5, "u", "small", ""), (6, "u", None, ""), (-8, "u", "", ""), (None, "u", same, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")
    got = sorted((tuple(r) for r in warc.page_records(df).collect()), key=str)
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        best = max((j for j, _, g, _ in rows if (g or "") == (h or "") and j is not None), default=i) if len(data) >= 1000 else i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if best == i else "revisit", None if best == i else best))
    assert got == sorted(want, key=str)
    assert warc.page_records(df.where("false")).count() == 0


def test_manifest_and_payloads(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i}" * 10) for i in range(50)], "page_id long, url string, html string")
    manifest = warc.write_archives(df, f"file://{tmp_path}/w", files=3)
    assert sum(r.records for r in manifest.collect()) == 50
    got = warc.read_archives(manifest).collect()
    assert {bytes(r.payload).decode() for r in got} == {f"page {i}" * 10 for i in range(50)} and not [r for r in got if r.error]
    path = manifest.first().path
    data = open(path.removeprefix("file://"), "rb").read()
    open(path.removeprefix("file://"), "wb").write(data[:-20])
    assert len([r for r in warc.read_archives(manifest).collect() if r.error]) == 1
