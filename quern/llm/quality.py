"""Quality by perplexity: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

1. *Counts.* Each task counts the distinct n-grams of its texts, and how often they occur in trusted
   training texts; the sums, sharded by n-gram, are the count table and the list of n-grams to be scored.
   Everything trusted is counted: the table grows with the corpus.
2. *Model.* Lower orders come from the table itself (continuation counts: distinct left extensions).
   The three discounts of each order come from its counts of counts, four numbers an order.
   Probabilities are interpolated from the lowest order up by joins on context and suffix, all
   sharded by the n-gram; a context that was never seen hands on the lower order.
3. *Scores.* Each task packs its documents into blocks (``block_mb`` of text, compressed), one row each. A
   block asks for its distinct n-grams, the sharded table answers by a join, and block and answers meet
   again: the rows that travel are distinct n-grams for each block, not occurrences, nothing is broadcast,
   and a task holds a compressed block, its answers and 1 MB of its texts.
4. *Thresholds.* One fifth of the trusted documents is held out of training. For each language, the
   threshold is ``slack`` above the mean of their scores and an excess over it: the ``quantile`` of the language's
   own excesses, drawn towards that of all languages' as if ``least`` further documents had it (mergeable sketches).
   So a language is measured by itself at every size. A score is the mean negative log probability, drawn
   towards the held-out mean as if ``prior`` further bytes had it, so that a short text isn't rejected for a few rare letters.

Trusted ids are broadcast up to ``broadcast_ids`` (8 bytes each) and joined by shuffle beyond.

Defined results: null or empty text has n_bytes 0, score and perplexity of the held-out mean, and is kept. A
null language is a language of its own. A language without held-out text has no threshold: its documents are kept.
Without trusted text every document is kept. A score that equals its threshold is kept. Ids may be null or
repeat: each row is scored and decided by itself; a null id is never trusted. Other columns are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.workers import release, trim
from quern.session import discard, materialize, ship

_CHUNK = 1 << 20  # bytes of text that are turned into n-grams at once


def _windows(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """The n-gram ending at each byte of ``data``, where texts begin at ``starts``; zeros stand before a text."""
    out = data.astype(np.int64)
    for j in range(1, order):
        before = np.zeros(len(data), np.int64)
        before[j:] = data[:-j]
        for k in range(j):
            at = starts + k
            before[at[at < len(data)]] = 0
        out |= before << 8 * j
    return out


def ngrams(texts: list[bytes], order: int) -> np.ndarray:
    """The n-grams ending at each byte of each text, as integers; zero bytes stand before a text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return _windows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, order)


def _spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (no nulls among them), and the place of each text's start and of the end."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None or places[-1] == places[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(places[-1] - places[0]), int(places[0])), places - places[0]


def _runs(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``_CHUNK`` bytes."""
    a, n = 0, len(places) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(places, places[a] + _CHUNK)))
        yield a, min(z, n)
        a = min(z, n)


class _Counter:
    """Distinct keys and summed counts of what was added."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._new.append((keys, counts))
        if len(self._new) >= 8:
            self.settle()

    def settle(self) -> _Counter:
        if self._new:
            counts = np.concatenate([self.counts, *(c for _, c in self._new)])
            keys = np.concatenate([self.keys, *(k for k, _ in self._new)])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.intp)
            self.keys, self.counts = keys[first], np.add.reduceat(counts[order], first) if len(first) else counts
            self._new.clear()
        return self


_DOC = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text_hash", pa.int64()), ("text", pa.string())])


def _rows(b: pa.RecordBatch, schema: pa.Schema) -> list[pa.RecordBatch]:
    """The columns of ``schema``, with 32-bit offsets."""
    return pa.Table.from_batches([b]).select(schema.names).cast(schema).combine_chunks().to_batches()


def count_table(docs: DataFrame, order: int) -> DataFrame:
    """(g, c): every n-gram of ``docs`` (text, train) and its count in texts with ``train`` set (0 where it is only elsewhere)."""
    schema = pa.schema([("text", pa.string()), ("train", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen = _Counter()
        for b in batches:
            for r in _rows(b, schema):
                data, places = _spans(r.column("text"))
                learn = r.column("train").to_numpy(zero_copy_only=False)
                for a, z in _runs(places):
                    grams = _windows(data[places[a] : places[z]], places[a:z] - places[a], order)
                    flags = np.repeat(learn[a:z], np.diff(places[a : z + 1]))
                    for flag in (True, False):
                        mine = grams[flags == flag]
                        if len(mine):
                            keys, counts = np.unique(mine, return_counts=True)
                            seen.add(keys, counts if flag else np.zeros(len(keys), np.int64))
            if len(seen.keys) > 2_000_000:
                seen.settle()
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys), pa.array(seen.counts)], names=["g", "c"])
                seen = _Counter()
        if len(seen.settle().keys):
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys), pa.array(seen.counts)], names=["g", "c"])
        del seen
        trim()

    return docs.select("text", "train").mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def blocks(docs: DataFrame, block_mb: int) -> DataFrame:
    """A row a block: block, docs (rows packed as a compressed Arrow stream in runs of about 1 MB).

    ``docs`` has doc_id, lang, text_hash and text (not null). A block ends with the run that fills it.
    """
    limit = block_mb << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, size, sink, out = TaskContext.get().partitionId() << 32, 0, None, None

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])

        for b in batches:
            for r in _rows(b, _DOC):
                _, places = _spans(r.column("text"))
                for a, z in _runs(places):
                    if out is None:
                        sink = pa.BufferOutputStream()
                        out = pa.ipc.new_stream(sink, _DOC, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5)))
                    out.write_batch(r.slice(a, z - a))
                    size += int(places[z] - places[a])
                    if size >= limit:
                        yield closed()
                        at, size, out = at + 1, 0, None
        if out is not None:
            yield closed()
        sink = out = None
        trim()

    return docs.select(*_DOC.names).mapInArrow(run, "block long, docs binary")


def _low(g: Column | str, n: int) -> Column:
    """The last ``n`` bytes."""
    g = F.col(g) if isinstance(g, str) else g
    return g.bitwiseAND(F.lit((1 << 8 * n) - 1)) if n else F.lit(0).cast("bigint")


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the counts of counts n1..n4 (Chen and Goodman); mild constants where a table is too small."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


def probabilities(table: DataFrame, order: int) -> DataFrame:
    """(g, nll), written: negative log probability of the last byte of each n-gram in ``table`` (a written table) after the others."""
    levels = {order: table}
    for n in range(order - 1, 0, -1):
        known = levels[n + 1].groupBy(_low("g", n).alias("g")).agg(F.count(F.when(F.col("c") > 0, 1)).alias("c"))
        levels[n] = materialize(known, f"counts{n}")
    p: DataFrame | None = None
    for n in range(1, order + 1):
        t = levels[n]
        d1, d2, d3 = discounts(list(t.agg(*[F.count(F.when(F.col("c") == k, 1)) for k in (1, 2, 3, 4)]).first()))
        d = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        contexts = t.where("c > 0").groupBy(F.shiftright("g", 8).alias("context")).agg(F.sum("c").alias("total"), F.sum(d).alias("held"))
        own = F.when(F.col("c") > 0, F.greatest(F.col("c") - d, F.lit(0.0))).otherwise(0.0).alias("own")
        rows = t.select("g", F.shiftright("g", 8).alias("context"), _low("g", n - 1).alias("suffix"), own).join(contexts, "context", "left")
        rows = rows.withColumn("lower", F.lit(1.0 / 256)) if p is None else rows.join(p.select(F.col("g").alias("suffix"), F.col("p").alias("lower")), "suffix")
        mine = F.coalesce((F.col("own") + F.col("held") * F.col("lower")) / F.col("total"), "lower")
        now = materialize(rows.select("g", mine.alias("p")) if n < order else rows.select("g", (-F.log(mine)).alias("nll")), f"p{n}")
        discard(*([p] if p is not None else []), *([t] if n < order else []))
        p = now
    return p


def scores(docs: DataFrame, known: DataFrame, order: int, block_mb: int) -> DataFrame:
    """doc_id, lang, text_hash, n_bytes, nll (sum) of every row; ``known`` has (g, nll) of all their n-grams.

    The blocks are dealt out once; asking and scoring read that one exchange. A block that was packed
    anew and otherwise (rows of ``docs`` in another order after a loss) would meet answers that don't fit: that raises.
    """
    ship(docs.sparkSession)
    if "text_hash" not in docs.columns:
        docs = docs.withColumn("text_hash", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks(docs, block_mb).repartition(parts, "block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, stored in zip(b.column(0).to_pylist(), b.column(1)):
                found = _Counter()
                for r in pa.ipc.open_stream(stored.as_buffer()):
                    data, places = _spans(r.column("text"))
                    for a, z in _runs(places):
                        keys = np.unique(_windows(data[places[a] : places[z]], places[a:z] - places[a], order))
                        found.add(keys, np.zeros(len(keys), np.int64))
                keys = found.settle().keys
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block, np.int64)), pa.array(keys)], names=["asking", "g"])
                del found, keys
                trim()

    answers = dealt.mapInArrow(ask, "asking long, g long").join(known, "g").select("asking", "g", "nll")

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        keys, values = answers.column("g").to_numpy(), answers.column("nll").to_numpy()
        by_key = np.argsort(keys)
        keys, values = keys[by_key], values[by_key]
        out = []
        for stored in rows.column("docs"):
            for r in pa.ipc.open_stream(stored.as_buffer()):
                data, places = _spans(r.column("text"))
                sizes = np.diff(places)
                sums = np.zeros(len(sizes))
                for a, z in _runs(places):
                    grams = _windows(data[places[a] : places[z]], places[a:z] - places[a], order)
                    if not len(grams):
                        continue
                    at = np.searchsorted(keys, grams)
                    if len(keys) == 0 or not np.array_equal(keys[np.minimum(at, len(keys) - 1)], grams):
                        raise RuntimeError("an n-gram of the block has no answer")
                    some = np.flatnonzero(sizes[a:z])
                    sums[a + some] = np.add.reduceat(values[at], places[a + some] - places[a])
                out.append(pa.RecordBatch.from_arrays([r.column("doc_id"), r.column("lang"), r.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(sums)], names=["doc_id", "lang", "text_hash", "n_bytes", "nll"]))
        del keys, values, by_key
        trim()
        return pa.Table.from_batches(out).combine_chunks()

    return dealt.groupBy("block").cogroup(answers.groupBy("asking")).applyInArrow(score, "doc_id long, lang string, text_hash long, n_bytes long, nll double")


def classify(docs: DataFrame, labels: DataFrame, order: int = 5, quantile: float = 0.99, slack: float = 0.02, prior: float = 64.0, least: int = 50, block_mb: int = 24, broadcast_ids: int = 4_000_000, broadcast_langs: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, lang, text_hash, n_bytes, score, perplexity (of a byte), threshold (of the score), kept."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    trusted = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0").select("doc_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5))
    learn = trusted.where(fold > 0).select(F.col("doc_id").alias("__id"), F.lit(True).alias("__train"))
    near = F.broadcast if trusted.count() <= broadcast_ids else lambda df: df
    flagged = docs.join(near(learn), F.col("doc_id") == F.col("__id"), "left").select("text", F.coalesce("__train", F.lit(False)).alias("train"))
    table = materialize(count_table(flagged, order), "counts")
    known = probabilities(table, order)
    discard(table)
    rated = materialize(scores(docs, known, order, block_mb), "scores")
    discard(known)

    held = rated.where("n_bytes > 0").join(near(trusted.where(fold == 0)), "doc_id", "left_semi")
    whole = held.agg(F.sum("nll"), F.sum("n_bytes")).first()
    mean = whole[0] / whole[1] if whole[1] else 0.0
    score = (F.col("nll") + F.lit(prior * mean)) / (F.col("n_bytes") + F.lit(prior))
    at = F.percentile_approx("excess", quantile, 10_000)
    means = held.withColumn("score", score).groupBy("lang").agg(F.avg("score").alias("mean"))
    few = F.broadcast if means.count() <= broadcast_langs else lambda df: df  # a common language isn't dealt by its name
    held = held.withColumn("score", score).join(few(means), "lang").withColumn("excess", F.col("score") - F.col("mean"))
    top = held.agg(at).first()[0] or 0.0
    limits = held.groupBy("lang").agg(at.alias("own"), F.first("mean").alias("mean"), F.count(F.lit(1)).alias("n"))
    limits = limits.select("lang", (F.col("mean") + (F.col("n") * F.col("own") + least * top) / (F.col("n") + least)).alias("limit"))
    out = rated.withColumn("score", score).join(few(limits), "lang", "left")
    threshold = F.coalesce(F.col("limit"), F.lit(math.inf)) * (1 + slack)
    perplexity = F.exp(F.when(F.col("n_bytes") > 0, F.col("nll") / F.col("n_bytes")).otherwise(mean))
    return out.select("doc_id", "lang", "text_hash", "n_bytes", "score", perplexity.alias("perplexity"), threshold.alias("threshold"), ((F.col("n_bytes") == 0) | (F.col("score") <= threshold)).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, each by its own language and text, whatever its id."""
    id_col, text_col, lang_col = (options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("lang_col", "lang")))
    gone = classify(docs, labels, **options).where("not kept").select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), F.col("text_hash").alias("__hash")).distinct()
    mine = [docs[id_col].cast("bigint"), F.coalesce(docs[lang_col], F.lit("")), F.xxhash64(F.coalesce(docs[text_col], F.lit("")))]
    same = [a.eqNullSafe(gone[b]) for a, b in zip(mine, ("__id", "__lang", "__hash"))]
    return docs.join(gone, same[0] & same[1] & same[2], "left_anti")
