"""Exact de-duplication by skew-safe combining (DataFrame functions only).

1. *Local*: the partial aggregation of the first group-by collapses equal contents inside every
   map task, so a group that holds a third of all rows leaves each task as one row per salt.
2. *Salted*: groups are merged by (digest, content, salt); a hot group is spread over ``salts`` tasks.
3. *Global*: the salt winners, at most ``salts`` per group, are merged by (digest, content).

The content itself is part of the grouping key at each stage, so a digest collision can't join
different texts. The winner travels as one decimal (code points first, then the smallest id), a
type that hash aggregation updates in place; there is no sort of texts.

Defined results: null text counts as empty, empty texts form one group. A null id is never
preferred to another id. Rows that repeat an id within one group share that group's decision in
``duplicate_groups``; ``deduplicate`` leaves one row of each group all the same. Columns besides the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import materialize

#: [\x20\x09-\x0D]
_WHITE = " \t\n\x0b\f\r"
_TOP = 2**63
_STEP = 10**20


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _WHITE, "")


def _dec(n: int, digits: int) -> Column:
    return F.lit(str(n)).cast(f"decimal({digits},0)")


def _rank(text: Column, doc_id: Column) -> Column:
    """code points * 10^20 + (0 for a null id, else 2^63 - id): the greatest is the row that stays."""
    ident = F.coalesce(_dec(_TOP, 20) - doc_id.cast("decimal(20,0)"), _dec(0, 20))
    return (F.length(F.coalesce(text, F.lit(""))).cast("decimal(11,0)") * _dec(_STEP, 21) + ident).cast("decimal(38,0)")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    text, doc_id = docs[text_col], docs[id_col].cast("bigint")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), normalized(text).alias("content")).select(
        "doc_id", "content", F.sha2("content", 256).alias("digest"), _rank(F.col("text"), F.col("doc_id")).alias("rank"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")
    )
    salted = rows.groupBy("digest", "content", "salt").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    best = salted.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"))
    ident = F.col("rank") % _dec(_STEP, 38)
    winners = best.select(
        F.col("digest"), F.xxhash64("content").alias("second"), F.length("content").alias("size"), "group_size",
        F.when(ident > 0, (_dec(_TOP, 38) - ident).cast("bigint")).alias("keep_id"),
    )
    # Inner join on plain keys: adaptive execution splits the side of a hot digest.
    out = rows.select("doc_id", "digest", F.xxhash64("content").alias("second"), F.length("content").alias("size")).join(winners, ["digest", "second", "size"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row of each group, with its own columns: of rows that repeat the id that stays (or of a group of null ids), any one."""
    kept = duplicate_groups(docs, id_col, text_col, salts).where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.count(F.lit(1)).alias("__n"))
    kept = materialize(kept, "winners")
    same = lambda side: docs[id_col].cast("bigint").eqNullSafe(side["__id"]) & (F.sha2(normalized(docs[text_col]), 256) == side["__sha"])
    once, more = kept.where("__n = 1"), kept.where("__n > 1")
    if more.isEmpty():
        return docs.join(once, same(once), "left_semi")
    repeated = docs.join(more, same(more)).dropDuplicates(["__id", "__sha"]).select(*[docs[c] for c in docs.columns])
    return docs.join(once, same(once), "left_semi").unionAll(repeated)
