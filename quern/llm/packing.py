"""Best-fit packing planned on the histogram of piece lengths.

1. Tokenise every text, append the end id, cut only what is longer than a sequence, and keep one
   row per piece: (doc_id, piece, start, length, crc). Tokens themselves don't travel.
2. Histogram of lengths: at most ``capacity`` rows, whatever the size of the corpus. Best-fit
   decreasing runs on these counts: all pieces of one length are placed at once, into groups of
   equally filled sequences. The plan is a list of runs (length, ranks) -> (sequences, offset).
3. Each piece gets its rank within its length and takes the planned slot of that rank by a join.
   A length that holds a third of all pieces is ranked in ``buckets`` independent parts whose
   sizes are summed first, so no task ever sees all pieces of a length.

The plan has few runs: each placement uses up whole groups and splits one at most. It is broadcast
up to ``broadcast_rows`` runs and joined without a hint beyond.

Defined results: null text counts as empty and gives one piece that holds the end id alone. Null or
repeated ids are packed like any other, each row on its own. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import bpe
from quern.session import materialize, ship

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, first_rank long, last_rank long, first_sequence long, per_sequence long, first_offset long"


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ship(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe.load(path, library=True)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                packed = encoder.encode_packed(text) + end
                if len(packed) <= 4 * capacity:
                    rows.append((doc_id, 0, 0, len(packed) // 4, zlib.crc32(packed)))
                else:
                    for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                        part = packed[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": b["doc_id"].dtype})

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts. Runs as in ``PLAN`` and the number of sequences.

    Open sequences are held as groups (first, count) of the same free space. The fullest group
    that still fits a length takes as many pieces a sequence as fit, for after the first piece the
    sequence is the tightest fit again.
    """
    groups: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []  # the keys of groups, ascending
    runs: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def put(space: int, first: int, count: int) -> None:
        if space > 0 and count > 0:
            if space not in groups:
                groups[space] = []
                insort(spaces, space)
            groups[space].append((first, count))

    def place(length: int, rank: int, todo: int, space: int, first: int, count: int) -> int:
        """Puts up to ``todo`` pieces into the group; returns how many, and files what is left of the group."""
        each = space // length
        full = min(count, todo // each)
        if full:
            runs.append((length, rank, rank + full * each - 1, first, each, capacity - space))
            put(space - each * length, first, full)
        used = full * each
        rest = min(todo - used, each) if full < count else 0
        if rest:
            runs.append((length, rank + used, rank + used + rest - 1, first + full, rest, capacity - space))
            put(space - rest * length, first + full, 1)
        put(space, first + full + bool(rest), count - full - bool(rest))
        return used + rest

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo and (at := bisect_left(spaces, length)) < len(spaces):
            space = spaces[at]
            mine = groups.pop(space)
            spaces.pop(at)
            while todo and mine:
                done = place(length, rank, todo, space, *mine.pop())
                todo, rank = todo - done, rank + done
            for g in mine:
                put(space, *g)
        if todo:
            new = -(-todo // (capacity // length))
            place(length, rank, todo, capacity, opened, new)
            opened += new
    return runs, opened


def assign(piece_rows: DataFrame, capacity: int, buckets: int | None = None, broadcast_rows: int = 200_000) -> DataFrame:
    """The pieces with sequence_id and offset. ``piece_rows`` must be cheap to read again (a written table)."""
    spark = piece_rows.sparkSession
    buckets = buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    histogram = {r["length"]: r["n"] for r in piece_rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    slots = spark.createDataFrame(runs, PLAN).withColumnRenamed("length", "plan_length")

    rows = piece_rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("local", F.row_number().over(inside) - 1).join(sizes, ["length", "bucket"]).withColumn("rank", F.col("local") + F.col("base"))
    slots = F.broadcast(slots) if len(runs) <= broadcast_rows else slots
    k = F.col("rank") - F.col("first_rank")
    placed = ranked.join(slots, (F.col("length") == F.col("plan_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    return placed.select(
        *piece_rows.columns,
        (F.col("first_sequence") + F.floor(k / F.col("per_sequence"))).cast("bigint").alias("sequence_id"),
        (F.col("first_offset") + k % F.col("per_sequence") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return assign(materialize(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces"), capacity, buckets)
