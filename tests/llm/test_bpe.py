
import hashlib
import random

import pytest
from tokenizers import Tokenizer

from quern.llm import bpe
from quern.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
LETTERS = "aAbBeEtThHéÉêßİΣσς'sS.,!?*#&|<>0123456789 \n\t\x1c\x85 ́Å漢字🙂‍ "


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(5)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return out + ["", " ", "<|endoftext|>a <|startoftext|>b", "a" * 500, "the " * 20 + "x" * 300 + "y", "don't I'LL we'Re"]


def test_equals_the_library(theirs):
    ours = bpe.ForcedBoundaryBPE(PATH, cache=50)
    for x in texts():
        ids = theirs.encode(x, add_special_tokens=False).ids
        assert ours.encode(x) == ids
        assert ours.encode_packed(x) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_cuts_hold():
    ours = bpe.ForcedBoundaryBPE(PATH)
    assert ours.cuts("thé") == [] or all(0 < i < 3 for i in ours.cuts("thé"))
    joined = "".join(map(ours.letters.__getitem__, "qxzj漢字".encode()))
    assert ours.cuts(joined)
    for i in ours.cuts(joined):
        assert not any(joined[i - 1 : i + 1] in t for t in ours.vocab)


def test_query_columns(spark, theirs):
    rows = [(1, "Hello  wörld", "x"), (2, None, "y"), (None, "", None), (1, "Hello  wörld", "x"), (3, "ab " * 30000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    got = sorted((tuple(r) for r in bpe.digests(df, PATH).collect()), key=str)
    want = []
    for i, x, _ in rows:
        ids = theirs.encode(x or "", add_special_tokens=False).ids
        text = theirs.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert {r.decoded for r in bpe.round_trip(df, PATH).collect()} >= {"", theirs.decode(theirs.encode("Hello  wörld", add_special_tokens=False).ids, skip_special_tokens=False)}
    assert bpe.digests(df.where("false"), PATH).count() == 0
