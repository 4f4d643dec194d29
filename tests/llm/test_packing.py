
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import packing
from quern.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def fits(pieces, capacity):
    """Every piece is placed, sequences are gapless from 0 and no longer than the capacity."""
    by = {}
    for length, seq, offset in pieces:
        by.setdefault(seq, []).append((offset, length))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        ok = [i for i, f in enumerate(free) if f >= n]
        if ok:
            free[min(ok, key=lambda i: free[i])] -= n
        else:
            free.append(capacity - n)
    return len(free)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    hist = {n: lengths.count(n) for n in set(lengths)}
    runs, opened = packing.plan(hist, 20)
    placed = [(n, s + (r - a) // each, off + (r - a) % each * n) for n, a, b, s, each, off in runs for r in range(a, b + 1)]
    assert sorted(p[0] for p in placed) == sorted(lengths)
    for n in hist:
        assert sorted(r for m, a, b, *_ in runs if m == n for r in range(a, b + 1)) == list(range(hist[n]))
    assert fits(placed, 20) == opened == best_fit(lengths, 20)


def test_pack_against_the_library(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "Été", "x1y"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 3, 3, 17, 200]))), "q") for i in range(120)] + [(200, None, None), (None, "a b", "z"), (7, "a b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = packing.pack(df, PATH, capacity=64, end_id=1, buckets=3).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want.append((i, k, at, len(part), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in part))))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert fits([(r.length, r.sequence_id, r.offset) for r in got], 64) == best_fit([w[3] for w in want], 64)
    assert packing.pack(df.where("false"), PATH).count() == 0
