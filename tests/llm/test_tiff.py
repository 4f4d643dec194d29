import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from quern.llm import tiff


@pytest.mark.parametrize("seed", range(6))
def test_codecs_round_trip(seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 3, 127, 128, 129, 5000, 60000):
        data = bytes(rng.choice(b"aaab\xff") if seed % 2 else rng.randrange(256) for _ in range(n))
        assert tiff.unpack_packbits(tiff.pack_packbits(data), n) == data
        assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_lzw_known_stream():
    # codes of 9 bits each: clear, 7, 258, 8, 8, 258, 6, 6, 261, 262, 259, end
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.unpack_lzw(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_pages_of_every_kind():
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, (h, w, s), dtype=np.uint8) for h, w, s in ((1, 1, 1), (70, 33, 3), (17, 192, 4))]
    for form, predictor, tile, order in itertools.product((tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS), (1, 2), (None, (16, 32)), "<>"):
        data = tiff.write(images, form, predictor, 16, tile, order)
        got = list(tiff.pages(data))
        assert len(got) == 3
        for a, b in zip(images, got):
            assert np.array_equal(a, b.pixels) and (b.compression, b.predictor) == (form, predictor)


def test_rows_and_errors(spark):
    data = tiff.write([np.full((2, 3, 1), k, np.uint8) for k in (1, 2)])
    loop = bytearray(data)
    at = int.from_bytes(data[4:8], "little")
    n = int.from_bytes(data[at : at + 2], "little")
    loop[at + 2 + 12 * n : at + 6 + 12 * n] = data[4:8]
    rows = [(1, bytearray(data)), (2, bytearray(b"junk")), (3, None), (4, loop), (5, bytearray(b""))]
    got = {(r.doc_id, r.page): r for r in tiff.read_pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1, 0].pixels == b"\x01" * 6 and got[1, 1].pixels == b"\x02" * 6 and got[1, 1].error is None
    assert got[2, 0].error and got[5, 0].error and "loop" in [r.error for k, r in got.items() if k[0] == 4 and r.error][0]
    assert not [k for k in got if k[0] == 3]


def test_query_digests(spark):
    rows = [(1, "é" * 700, "x"), (2, None, None), (3, "", ""), (4, "z" * 576, ""), (None, "z" * 300000, ""), (4, "z" * 576, "")]
    got = tiff.store_and_read(spark.createDataFrame(rows, "doc_id long, text string, media string")).collect()
    assert len(got) == 6
    for r in got:
        data = next((t or "").encode() for i, t, _ in rows if i == r.doc_id)
        full = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(full)) and r.payload_sha256 == hashlib.sha256(full).hexdigest() and r.tail_crc32 == zlib.crc32(full[-32:]) and r.feature
    assert tiff.store_and_read(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_are_spread_over_all_layouts(spark):
    rows = [(i, f"text {i} é " * (i % 200)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stored = tiff.text_images(df)
    found = tiff.read_pages(stored).collect()
    assert {r.compression for r in found} == {tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS}
    assert {r.predictor for r in found} == {1, 2} and {r.page for r in found} == {0, 1, 2} and not any(r.error for r in found)
    joined = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.page)):
        joined[r.doc_id] = joined.get(r.doc_id, b"") + bytes(r.pixels)
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    got = {r.doc_id: r for r in tiff.media_digests(stored).collect()}
    for i, t in rows:
        data = t.encode()
        assert joined[i] == data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        assert (got[i].media_bytes, got[i].media_sha256) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        image = np.frombuffer(joined[i], np.uint8).reshape(-1, 3)
        pages = [p for p in found if p.doc_id == i]
        assert len(got[i].feature.split(";")) == len(pages)
        if len(pages) == 1:
            size, means, _ = got[i].feature.split(":")
            assert size == f"192x{len(image) // 192}" and means == ",".join(str(int(m)) for m in image.astype(int).sum(0) * 1000 // len(image))
