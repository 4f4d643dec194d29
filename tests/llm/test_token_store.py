
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quern.llm import token_store
from quern.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def test_encoder_equals_the_library():
    ours = token_store.ByteLevelEncoder(PATH, cache=40)
    rng = random.Random(8)
    texts = ["".join(rng.choice("aab  \n\t.é'sS漢🙂1\x85\xa0") for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["", " ", "a", " a b", "it's we're  a", "x <|endoftext|> y<|endoftext|>", "a\n  b", "a \n b", "a  ", "tab\t x"]
    for t in texts:
        assert np.frombuffer(ours.encode_packed(t), "<u4").tolist() == ours.library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("seed", range(8))
def test_re_pair_round_trip(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 60, 300)
    ids = rng.integers(0, [3, 40, 5000, 2][seed % 4], lengths.sum()).astype(np.uint16)
    if seed % 3 == 0:
        ids[:] = 7
    seq, left, right, sizes = token_store.re_pair(ids, np.cumsum(lengths) - 1, 50257, least=2, rounds=20)
    g = token_store.Grammar(seq, left, right, sizes, 50257)
    assert np.array_equal(g.tokens(), ids)
    assert len(seq) <= len(ids)
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        assert np.array_equal(g.tokens(a, b), ids[a:b])
    bounds = set(np.cumsum(lengths).tolist())
    assert bounds <= set(g.upto.tolist())  # no symbol crosses a document's end


def test_frequent_pairs_are_replaced_most_frequent_first():
    ids = np.array([1, 2] * 50 + [3, 4] * 20 + [5], np.uint16)
    seq, left, right, sizes = token_store.re_pair(ids, np.array([len(ids) - 1]), 100, least=5, rounds=1)
    assert (left[0], right[0], sizes[0]) == (1, 2, 2) and len(seq) <= 75


def test_runs_halve_and_no_frequent_pair_is_left():
    ids = np.full(8192, 7, np.uint16)
    seq, left, right, sizes = token_store.re_pair(ids, np.array([8191]), 50257)
    assert len(seq) <= 24 and np.array_equal(token_store.Grammar(seq, left, right, sizes, 50257).tokens(), ids)
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 12, 20_000).astype(np.uint16)
    for first, limit in ((50257, 1 << 16), (70000, 1 << 31)):
        seq, left, right, sizes = token_store.re_pair(ids, np.array([len(ids) - 1]), first, limit=limit)
        pairs = list(zip(seq.tolist(), seq.tolist()[1:]))
        assert max(Counter(pairs).values()) < 8 and first + len(left) < limit
        assert np.array_equal(token_store.Grammar(seq, left, right, sizes, first).tokens(), ids)


def test_wide_end_id_and_closed_shards(spark):
    rows = [(i // 2, f"the of x {i} the of x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    t = Tokenizer.from_file(PATH)
    manifest = token_store.write_store(df, PATH, 70000, token_store.scratch(spark, "tokens"), shards=2, shard_tokens=100)
    assert manifest.count() > 3
    got = sorted((tuple(r) for r in token_store.read_store(manifest, ids=True).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [i for i, _ in rows]
    assert sorted(r[4] for r in got) == sorted(t.encode(x, add_special_tokens=False).ids + [70000] for _, x in rows)
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()


def test_store(spark):
    rng = random.Random(1)
    rows = [(i * 3 - 50, " ".join(rng.choice(["the", "of", "né", "x"]) for _ in range(rng.randint(0, 40))), "k") for i in range(100)]
    rows += [(1000, None, None), (None, "null id", ""), (1001, "z y " * 40000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = sorted(token_store.round_trip(df, PATH, 2, shards=4).collect(), key=lambda r: r.start)
    t, at = Tokenizer.from_file(PATH), 0
    for r, (i, x, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_store.round_trip(df.where("false"), PATH, 2).count() == 0
