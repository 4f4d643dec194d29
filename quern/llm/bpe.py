"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be inside an encoded token, because
each merge result is itself a vocabulary token. Every such pair in a word therefore marks a cut
that is certain; the fragments between cuts are encoded independently and concatenated.

``ForcedBoundaryBPE`` reads a ``tokenizers`` JSON file of the word-end kind (NFC, lower case,
white space removed, words by pattern, byte-level letters, ``</w>``) and encodes as that library
does with ``add_special_tokens=False``; normalisation of non-ASCII pieces is done by the library's own
normaliser object. White space separates pieces that can't influence each other, so pieces are
looked up in a two-generation cache of bounded size; the cache changes speed, never results.
"""

from __future__ import annotations

import array
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.workers import held
from quern.session import ship

#: White space as the tokenizer's pattern has it; str.split() also cuts at U+001C to U+001F.
_SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = "\x1c\x1d\x1e\x1f"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: visible Latin-1 bytes as they are, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class TwoGenerationCache(dict):
    """A dict that makes missing values and keeps those that it was asked for twice; what occurs once leaves a mark only.

    Two generations of ``limit`` entries are held at most; ``turn``, called between texts, starts a new
    generation when the present one is full, and what is used goes along.
    """

    MARKS = (1 << 23) - 1

    def __init__(self, make, limit: int = 500_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}
        self.seen, self.marked = bytearray(self.MARKS + 1), 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            mark = hash(key) & self.MARKS
            if not self.seen[mark]:
                self.seen[mark] = 1
                self.marked += 1
                return value
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        if self.marked > self.MARKS // 8:
            self.seen, self.marked = bytearray(self.MARKS + 1), 0


class ForcedBoundaryBPE:
    def __init__(self, path: str, cache: int = 500_000, library: bool = False):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tokenizer = Tokenizer.from_file(path)
        self._normalizer, self._model = tokenizer.normalizer, tokenizer.model if library else None
        model = spec["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.letters = byte_letters()
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        inside = set()
        for t in self.vocab:
            t = t.removesuffix(self.end)
            inside.update(zip(t, t[1:]))
        self.inside = inside
        self._fragments = TwoGenerationCache(self._merge, cache // 2)
        self._pieces = TwoGenerationCache(self._piece, cache)
        self._packed = TwoGenerationCache(self._pack, cache)
        self._words_packed = TwoGenerationCache(lambda w: array.array("I", self.word(w)).tobytes(), cache // 2)

    # One piece without white space.
    def _piece(self, piece: str) -> tuple[int, ...]:
        out: list[int] = []
        for part in self._special.split(piece) if "<|" in piece else (piece,):
            if part in self.special:
                out.append(self.special[part])
            else:
                for w in self._words(part):
                    out += self.word(w)
        return tuple(out)

    def _pack(self, piece: str) -> bytes:
        """Packed ids of a piece. Letters with final marks are two words of the pattern: no need to search."""
        if piece.isascii() or (max(piece) < "\u0250" and "\u0130" not in piece):
            piece = piece.lower()
            bare = piece.rstrip(".,!?;:")
            if bare.isalpha():
                mark = piece[len(bare) :]
                return self._words_packed[bare] + self._words_packed[mark] if mark else self._words_packed[bare]
        return array.array("I", self._piece(piece)).tobytes()

    def _words(self, part: str) -> list[str]:
        if part.isascii() or (max(part) < "\u0250" and "\u0130" not in part):
            # Below U+0250 every text is in normal form C and lower case is one letter for one letter.
            part = part.lower()
            return [part] if part.isalpha() else self._word.findall(part)
        return self._word.findall(self._normalizer.normalize_str(part))

    def word(self, word: str) -> tuple[int, ...]:
        letters = word if word.isalpha() and word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        if self._model:
            return [t.id for t in self._model.tokenize(letters)]
        if self.inside.issuperset(zip(letters, letters[1:])):
            return self._fragments[letters + self.end]
        last, out = 0, []
        for at in self.cuts(letters):
            out += self._fragments[letters[last:at]]
            last = at
        return (*out, *self._fragments[letters[last:] + self.end])

    def cuts(self, letters: str) -> list[int]:
        """Places between two letters that no vocabulary token has next to each other."""
        inside = self.inside
        return [i for i, p in enumerate(zip(letters, letters[1:]), 1) if p not in inside]

    def _merge(self, key: str) -> tuple[int, ...]:
        """Ranked merging of one fragment; ``key`` ends with the word-end mark if the fragment ends its word."""
        if key.endswith(self.end) and len(key) > len(self.end):
            at = len(key) - len(self.end) - 1
            parts = [*map(self.vocab.__getitem__, key[:at]), self.vocab[key[at:]]]
        else:
            parts = list(map(self.vocab.__getitem__, key))
        if len(parts) > 64:
            return self._merge_long(parts)
        rank, none = self.ranks.get, 1 << 30
        order = [rank(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while order and (best := min(order)) < none:
            i = order.index(best)
            parts[i] = new = self.merged[best]
            del parts[i + 1], order[i]
            if i:
                order[i - 1] = rank(parts[i - 1] << 32 | new, none)
            if i < len(order):
                order[i] = rank(new << 32 | parts[i + 1], none)
        return tuple(parts)

    def _merge_long(self, parts: list[int]) -> tuple[int, ...]:
        """The same order of merges (rank, then place) with a heap and links: n log n for long runs."""
        import heapq

        rank, n = self.ranks.get, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (r := rank(parts[x] << 32 | parts[after[x]])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[after[x]]))
        return tuple(p for p in parts if p >= 0)

    def split(self, text: str) -> list[str]:
        return [p for p in _SPACES.split(text) if p] if any(c in text for c in _ODD) else text.split()

    def encode(self, text: str | None) -> list[int]:
        self._pieces.turn()
        self._fragments.turn()
        return list(chain.from_iterable(map(self._pieces.__getitem__, self.split(text or ""))))

    def encode_packed(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        self._packed.turn()
        self._words_packed.turn()
        self._fragments.turn()
        return b"".join(map(self._packed.__getitem__, self.split(text or "")))

    def decode(self, ids: list[int]) -> str:
        """As ``decode(ids, skip_special_tokens=False)`` of a file without a decoder: tokens joined by one space."""
        return " ".join(map(self.tokens.__getitem__, ids))


def load(path: str, library: bool = False) -> ForcedBoundaryBPE:
    """One encoder for each Python worker and file; with ``library`` it leaves the merges of a word to the library."""
    return held(("forced", path, library), lambda: ForcedBoundaryBPE(path, library=library))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded for every row. Null text counts as empty; an id that is null or repeated stays as it is."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for b in batches:
            ids = [bpe.encode(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": ids, "decoded": [bpe.decode(i) for i in ids]})

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``round_trip`` with ids and text reduced to digests inside the task, so that neither crosses to the JVM."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        names = {i: str(i) for i in bpe.tokens}
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b["text"]:
                ids = bpe.encode(t)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
