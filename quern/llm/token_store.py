"""Binary token store: ids by the ``tokenizers`` library, grammar-compressed by Re-Pair.

Documents are range-partitioned by id; each range becomes shard files of bounded size. In a shard, frequent pairs of
neighbouring symbols are replaced by nonterminals, round after round: a round counts all pairs, takes
the most frequent ones, replaces their occurrences that don't overlap (in a run of one symbol every second
pair), and the next round counts again, until no pair is frequent or the symbols are used up. No pair crosses a document's end.

File format (little-endian): magic ``QTS1``; the numbers of documents, rules and symbols and the first
nonterminal as unsigned 64-bit; ids of documents (signed 64-bit, with one byte each for null), tokens
of each document (64-bit); left and right symbol and expansion length of each rule (32-bit); the
sequence as 16-bit symbols, or 32-bit where the vocabulary needs it. Lengths of the expansions give
random access: any token range is decoded from the symbols that cover it alone.

Pieces of text (cut before single spaces, where the tokenizer's pattern always cuts) are encoded by the
library once and then looked up in a bounded cache; texts where a cut could matter are encoded whole.

Defined results: null text counts as empty and gives the end id alone; null ids come first; rows that
repeat an id are separate documents, next to each other. An empty table gives no shard and no row.
"""

from __future__ import annotations

import array
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.bpe import TwoGenerationCache, byte_letters
from quern.llm.files import open_shared
from quern.llm.workers import held
from quern.session import materialize, scratch, ship

MAGIC = b"QTS1"


class _Unsafe(Exception):
    """The text can't be cut at that space."""


class ByteLevelEncoder:
    """Ids of a byte-level tokenizer file, as the library's ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, cache: int = 800_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        self._model, self._split = self.library.model, self.library.pre_tokenizer
        self._pieces = TwoGenerationCache(self._piece, cache)
        self._words = TwoGenerationCache(self._word, cache // 8)
        self._letters = byte_letters()
        self._space, self._break = self._letters[32], self._letters[10]

    def _word(self, letters: str) -> bytes:
        """Packed ids of one pre-token in byte letters."""
        return array.array("I", [t.id for t in self._model.tokenize(letters)]).tobytes()

    def _part(self, part: str, lead: str) -> bytes:
        """A part without white space, after a space or nothing. Letters and final marks need no pattern."""
        bare = part.rstrip(".,!?;:")
        if bare.isalpha():
            letters = bare if bare.isascii() else "".join(map(self._letters.__getitem__, bare.encode()))
            mark = part[len(bare) :]
            return self._words[lead + letters] + self._words[mark] if mark else self._words[lead + letters]
        return b"".join(self._words[w] for w, _ in self._split.pre_tokenize_str(" " + part if lead else part))

    def _piece(self, piece: str) -> bytes:
        """Packed ids of a piece with the space before it. White space at its ends makes the cut unsafe: that raises."""
        bare = piece.rstrip(".,!?;:")
        if bare.isalpha():
            letters = bare if bare.isascii() else "".join(map(self._letters.__getitem__, bare.encode()))
            mark = piece[len(bare) :]
            return self._word(self._space + letters) + self._words[mark] if mark else self._word(self._space + letters)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Unsafe
        if "<|" in piece:
            return array.array("I", self.library.encode(" " + piece, add_special_tokens=False).ids).tobytes()
        first, *more = piece.split("\n")
        if all(part and not part[0].isspace() and not part[-1].isspace() for part in (first, *more)):
            out = self._part(first, self._space)
            for part in more:  # one line break between other characters is a token of its own
                out += self._words[self._break] + self._part(part, "")
            return out
        return b"".join(self._words[w] for w, _ in self._split.pre_tokenize_str(" " + piece))

    def encode_packed(self, text: str | None) -> bytes:
        first, *pieces = (text or "").split(" ")
        self._pieces.turn()
        self._words.turn()
        if first and not first[-1].isspace():
            try:
                return array.array("I", self.library.encode(first, add_special_tokens=False).ids).tobytes() + b"".join(map(self._pieces.__getitem__, pieces))
            except _Unsafe:
                pass
        return array.array("I", self.library.encode(text or "", add_special_tokens=False).ids).tobytes()


def load(path: str) -> ByteLevelEncoder:
    return held(("bytes", path), lambda: ByteLevelEncoder(path))


# --- Re-Pair ---


def _frequent(keys: np.ndarray, least: int, most: int) -> np.ndarray:
    """The pairs that occur ``least`` times or more, most frequent first (ties: smaller key), ``most`` at most."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(keys)))
    ok = np.flatnonzero(counts >= least)
    order = ok[np.argsort(-counts[ok], kind="stable")][:most]
    return keys[starts[order]]


_SLOTS = 1 << 16


def re_pair(ids: np.ndarray, ends: np.ndarray, first: int, least: int = 8, rounds: int | None = None, limit: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compresses ``ids`` (all below ``first``); ``ends`` are the places of each document's last id.

    Returns the sequence, and left, right and expansion length of each rule. Symbols stay below
    ``limit``; up to 2^16 a pair of them is a 32-bit key. Without ``rounds`` it goes on until no pair occurs
    ``least`` times or the symbols are used up.
    """
    wide = limit > 1 << 16
    kind = np.uint64 if wide else np.uint32
    shift = kind(32 if wide else 16)
    seq = ids.astype(np.uint32 if wide else np.uint16)
    ends = np.asarray(ends, np.int64)
    left, right = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    following, done = first, 0
    while rounds is None or done < rounds:
        done += 1
        room = limit - following
        if room <= 0 or len(seq) < 2:
            break
        keys = seq[:-1].astype(kind) << shift | seq[1:]
        inside = np.ones(len(keys), bool)
        inside[ends[:-1]] = False
        pairs = _frequent(keys[inside], least, _SLOTS // 16)
        if not len(pairs):
            break
        # One slot for each hash value; of pairs with the same slot the most frequent one is taken now.
        slot_of = lambda k: (k * kind(2654435761) >> kind(12) & kind(_SLOTS - 1)).astype(np.uint16)
        _, taken = np.unique(slot_of(pairs), return_index=True)
        pairs = pairs[np.sort(taken)]
        table, rank = np.full(_SLOTS, ~kind(0), kind), np.full(_SLOTS, len(pairs), np.int32)
        slots = slot_of(pairs)
        table[slots], rank[slots] = pairs, np.arange(len(pairs), dtype=np.int32)
        at = slot_of(keys)
        hit = np.flatnonzero((table[at] == keys) & inside)
        order = rank[at[hit]]
        # In a run of one symbol every second pair is taken; of other neighbours that overlap, the better rank.
        touch = np.diff(hit) == 1
        same = touch & (order[:-1] == order[1:])
        if same.any():
            places = np.arange(len(hit))
            runs = np.maximum.accumulate(np.where(np.concatenate([[False], same]), 0, places))
            order[(places - runs) & 1 == 1] = len(pairs)
        stay = np.ones(len(hit), bool)
        stay[1:] &= ~(touch & (order[:-1] < order[1:]))
        stay[:-1] &= ~(touch & (order[1:] < order[:-1]))
        # A pair that lost nearly all its places to better ones waits; the best one never does.
        often = np.bincount(order[stay], minlength=len(pairs) + 1) >= least // 2
        often[0], often[len(pairs)] = True, False
        often[np.flatnonzero(often)[room:]] = False
        stay &= often[order]
        hit, order = hit[stay], order[stay]
        taken = np.zeros(len(pairs), bool)
        taken[order] = True
        used = np.flatnonzero(taken)
        seq[hit] = (following + np.cumsum(taken) - 1).astype(seq.dtype)[order]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq = seq[keep]
        ends = ends - np.searchsorted(hit, ends, "left")  # what is taken before or at an end moves it
        chosen = pairs[used]
        left.append((chosen >> shift).astype(np.uint32))
        right.append((chosen & kind((1 << int(shift)) - 1)).astype(np.uint32))
        following += len(used)
    lefts, rights = np.concatenate(left), np.concatenate(right)
    sizes = np.ones(following, np.int64)
    at_rule = first
    for l, r in zip(left, right):  # a round's rules use symbols of earlier rounds only
        sizes[at_rule : at_rule + len(l)] = sizes[l] + sizes[r]
        at_rule += len(l)
    return seq, lefts, rights, sizes[first:].astype(np.uint32)


class Grammar:
    """Expansion of symbols; every token range can be decoded by itself."""

    def __init__(self, seq: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, first: int):
        self.seq, self.first = seq, first
        single = np.arange(first, dtype="<u4").tobytes()
        flat = [single[x : x + 4] for x in range(0, len(single), 4)]
        for l, r in zip(left.tolist(), right.tolist()):
            flat.append(flat[l] + flat[r])
        self.flat = np.frombuffer(b"".join(flat), "<u4")
        self.sizes = np.concatenate([np.ones(first, np.int64), sizes.astype(np.int64)])
        self.places = np.cumsum(self.sizes) - self.sizes
        self.upto = np.concatenate([[0], np.cumsum(self.sizes[seq])])

    def tokens(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = int(self.upto[-1]) if stop is None else min(stop, int(self.upto[-1]))
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self.upto, start, "right") - 1, np.searchsorted(self.upto, stop, "left")
        part = self.seq[a:b]
        sizes = self.sizes[part]
        base = np.cumsum(sizes) - sizes
        index = np.repeat(self.places[part] - base, sizes) + np.arange(int(sizes.sum()))
        return self.flat[index][start - int(self.upto[a]) : stop - int(self.upto[a])]


# --- shards ---


def shard_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, first: int, least: int) -> bytes:
    limit = 1 << 16 if first < 1 << 16 else 1 << 31
    seq, left, right, sizes = re_pair(ids, np.cumsum(lengths) - 1, first, least, None, limit)
    null = np.array([d is None for d in doc_ids], np.uint8)
    own = np.array([0 if d is None else d for d in doc_ids], np.int64)
    head = MAGIC + struct.pack("<4Q", len(own), len(left), len(seq), first)
    return head + b"".join(x.tobytes() for x in (null, own, lengths.astype(np.int64), left.astype(np.uint32), right.astype(np.uint32), sizes.astype(np.uint32), seq))


class Shard:
    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("no token shard")
        docs, rules, symbols, first = struct.unpack_from("<4Q", data, 4)
        at = 36

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        null, own, self.lengths = part("u1", docs), part("<i8", docs), part("<i8", docs)
        self.doc_ids = [None if n else i for n, i in zip(null.tolist(), own.tolist())]
        left, right, sizes = part("<u4", rules), part("<u4", rules), part("<u4", rules)
        self.grammar = Grammar(part("<u2" if first < 1 << 16 else "<u4", symbols), left, right, sizes, first)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def blocks(self, tokens: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about so many tokens."""
        a = 0
        while a < len(self.starts):
            z = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + tokens)))
            yield a, z
            a = z

    def document(self, k: int) -> np.ndarray:
        return self.grammar.tokens(int(self.starts[k]), int(self.starts[k] + self.lengths[k]))


def write_store(docs: DataFrame, path: str, end_id: int, folder: str, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", least: int = 8, shard_tokens: int = 6_000_000) -> DataFrame:
    """Writes the shards; the manifest (part, shard, path, documents, tokens, bytes, first_token), in order of ids by part and shard.

    ``shards`` ranges of ids are dealt to tasks; a task closes a shard with the document that fills ``shard_tokens``.
    """
    spark = docs.sparkSession
    ship(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder = load(path)
        first = max(encoder.size, end_id + 1)
        kind = np.uint16 if first < 1 << 16 else np.uint32
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        closed = size = 0

        def shard() -> pd.DataFrame:
            data = shard_bytes(doc_ids, np.array(lengths), np.concatenate(parts), first, least)
            uri = f"{folder}/shard-{uuid.uuid4().hex}.qts"
            with open_shared(uri, True) as f:
                f.write(data)
            return pd.DataFrame({"part": [TaskContext.get().partitionId()], "shard": [closed], "path": [uri], "documents": [len(doc_ids)], "tokens": [size], "bytes": [len(data)]})

        for b in batches:
            for doc_id, text in zip(b["doc_id"].astype("object"), b["text"]):
                packed = np.frombuffer(encoder.encode_packed(text) + end, "<u4")
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                lengths.append(len(packed))
                parts.append(packed.astype(kind))
                size += len(packed)
                if size >= shard_tokens:
                    yield shard()
                    doc_ids, lengths, parts, closed, size = [], [], [], closed + 1, 0
        if doc_ids:
            yield shard()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ranges = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    manifest = materialize(ranges.mapInPandas(run, "part int, shard int, path string, documents long, tokens long, bytes long"), "token-manifest")
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", before(Window.orderBy("part")).alias("upto"))  # one row a task
    return manifest.withColumn("inside", before(Window.partitionBy("part").orderBy("shard"))).join(parts, "part").withColumn("first_token", F.col("upto") + F.col("inside")).drop("upto", "inside")


def read_store(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, and the ids themselves if asked for."""
    spark = manifest.sparkSession
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, first in zip(b["path"], b["first_token"]):
                with open_shared(path) as f:
                    shard = Shard(f.read())
                for a, z in shard.blocks():
                    at = int(shard.starts[a])
                    block = shard.grammar.tokens(at, int(shard.starts[z - 1] + shard.lengths[z - 1]))
                    rows = []
                    for d in range(a, z):
                        tokens = block[int(shard.starts[d]) - at :][: int(shard.lengths[d])]
                        row = (shard.doc_ids[d], int(first + shard.starts[d]), len(tokens), zlib.crc32(tokens.tobytes()))
                        rows.append((*row, tokens.tolist()) if ids else row)
                    out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
                    yield out.astype({"doc_id": "Int64"})

    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("path", "first_token").repartition(n).mapInPandas(run, schema)


def round_trip(docs: DataFrame, path: str, end_id: int, **options) -> DataFrame:
    return read_store(write_store(docs, path, end_id, scratch(docs.sparkSession, "tokens"), **options))
