import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import quality


def grams(text, order):
    data = b"\0" * (order - 1) + text
    return [int.from_bytes(data[i : i + order], "big") for i in range(len(text))]


def test_ngrams_of_many_texts():
    rng = random.Random(1)
    for order in (1, 2, 5):
        texts = [bytes(rng.choice(b"abc\xff") for _ in range(rng.choice([1, 1, 2, 9]))) for _ in range(40)]
        assert quality.ngrams(texts, order).tolist() == [g for t in texts for g in grams(t, order)]
    assert quality.ngrams([b""], 3).tolist() == []


def brute(counts, order):
    """Interpolated modified Kneser-Ney, written from its definition: p(context, byte)."""
    tables = {order: {k: c for k, c in counts.items() if c}}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g & (1 << 8 * n) - 1 for g in tables[n + 1])
    levels = {}
    for n, t in tables.items():
        d = quality.discounts([sum(c == k for c in t.values()) for k in (1, 2, 3, 4)])
        total, held = Counter(), defaultdict(float)
        for g, c in t.items():
            total[g >> 8] += c
            held[g >> 8] += d[min(c, 3) - 1]
        levels[n] = t, d, total, held

    def p(g, n):
        if n == 0:
            return 1 / 256
        t, d, total, held = levels[n]
        low = p(g & (1 << 8 * (n - 1)) - 1, n - 1)
        if not total[g >> 8]:
            return low
        c = t.get(g, 0)
        return (max(c - (d[min(c, 3) - 1] if c else 0), 0) + held[g >> 8] * low) / total[g >> 8]

    return p


@pytest.mark.parametrize("order", [2, 3])
def test_model_against_its_definition(spark, order):
    rng = random.Random(order)
    train = [bytes(rng.choice(b"abcdea b") for _ in range(60)) for _ in range(25)]
    other = [b"zebra ab", b"abc"]
    counts = Counter(g for t in train for g in grams(t, order))
    context = grams(b"abc", order)[-1] >> 8
    everything = {**dict.fromkeys((g for t in other for g in grams(t, order)), 0), **{context << 8 | w: 0 for w in range(256)}, **counts}
    table = spark.createDataFrame([(g, everything[g]) for g in everything], "g long, c long")
    got = {r.g: math.exp(-r.nll) for r in quality.probabilities(table, order).collect()}
    p = brute(everything, order)
    assert set(got) == set(everything)
    for g in everything:
        assert got[g] == pytest.approx(p(g, order), rel=1e-9)
    assert sum(got[context << 8 | w] for w in range(256)) == pytest.approx(1)


def sample(n=400):
    rng = random.Random(9)
    words = ["the", "river", "of", "stone", "walks", "and", "sings", "over", "morning", "fields"]
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        text = " ".join(w) if good else " ".join(x.upper() + rng.choice(["###", "$$$", "!!"]) for x in w)
        docs.append((i, text, "en" if i % 3 else None, "src", 1))
        if i % 2:
            labels.append((i, int(good), 0))
        elif i % 8 == 0:
            labels.append((i, 0, 0))
    docs += [(1000, None, "en", "", 0), (1001, "", "xx", "", 0), (None, "the river", "en", "", 0), (1, docs[1][1], "en", "", 0), (1002, "the stone " * 20000, "en", "", 0)]
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = sample()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, kept string, score long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.classify(df, lab, least=10).collect()
    assert len(out) == len(docs)
    unseen = {i for i in range(400)} - {r[0] for r in labels}
    for r in out:
        if r.doc_id is None or r.doc_id >= 400:
            assert r.kept
        elif r.doc_id in unseen:
            assert r.kept == (r.doc_id % 4 != 0), r
    assert {r.n_bytes for r in out if r.doc_id in (1000, 1001)} == {0}
    assert quality.keep(df, lab, least=10).columns == df.columns
    none = quality.classify(df, lab.where("false")).collect()
    assert len(none) == len(docs) and all(r.kept for r in none)
    assert quality.classify(df.where("false"), lab).count() == 0


def test_scores_are_sums_over_the_text(spark):
    docs, labels = sample(60)
    df = spark.createDataFrame(docs[:60], "doc_id long, text string, lang string, kept string, score long").select("doc_id", "text", "lang").fillna("")
    counts = Counter(g for d in docs[:60] for g in grams(d[1].encode(), 3))
    table = quality.probabilities(spark.createDataFrame(list(counts.items()), "g long, c long"), 3)
    p = brute(counts, 3)
    for r in quality.scores(df, table, 3, 1).collect():
        want = -sum(math.log(p(g, 3)) for g in grams(docs[r.doc_id][1].encode(), 3))
        assert np.isclose(r.nll, want) and r.n_bytes == len(docs[r.doc_id][1].encode())


def test_rare_language_has_its_own_threshold(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["the", "river", "of", "stone", "and"]) for _ in range(40)), "en") for i in range(600)]
    docs += [(1000 + i, "".join(rng.choice("бвгджзклмнпрст") for _ in range(150)), "ru") for i in range(60)]
    docs += [(2000 + i, "".join(rng.choice("#$%&*+=<>") for _ in range(150)), "en") for i in range(20)]
    docs += [(3000, "".join(rng.choice("αβγδεζηθ") for _ in range(150)), "el")]
    labels = [(i, 1, 0) for i in [*range(500), *range(1000, 1030)]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(r.kept for i, r in out.items() if 1000 <= i < 1060 or i == 3000)
    assert not any(out[i].kept for i in range(2000, 2020))
    assert out[0].threshold < out[1000].threshold < out[3000].threshold == math.inf
