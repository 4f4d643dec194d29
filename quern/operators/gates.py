"""Candidate gates: an ordered chain in which the first failure names the reject."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.predicates import LEAKAGE_PATTERNS, leaks
from quern.registry import Registry

#: name -> (config) -> (column: why the row fails, null where it passes)
GATES: Registry[Callable[[dict], Column]] = Registry("gate")


@GATES.register("correctness")
def _correctness(cfg: dict) -> Column:
    """Rows that are still ungraded (null) fail as ungraded; ``run_gates`` fills them first where it is given ``grade``."""
    return F.when(F.col("correct").isNull(), "ungraded").when(~F.col("correct"), "incorrect")


@GATES.register("no_external_context")
def _external(cfg: dict) -> Column:
    return F.when(F.col("external_context").isNotNull(), "external_context")


@GATES.register("length")
def _length(cfg: dict) -> Column:
    total = F.col(cfg["length_column"]) if "length_column" in cfg else F.size("prompt_token_ids") + F.size("anchor_token_ids") + F.size("continuation_token_ids")
    return F.when(total > cfg["max_total_len"], "too_long")


@GATES.register("leakage_rules")
def _leakage(cfg: dict) -> Column:
    return F.when(leaks(cfg.get("text_column", "continuation_text"), cfg.get("patterns", LEAKAGE_PATTERNS)), "pattern")


#: The one gate with a memory: of equal contents the first that reached it passes.
DEDUP = "dedup"


def run_gates(candidates: DataFrame, gates: list[str], cfg: dict, ordinal: list[str], content: list[str] | None = None, grade: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds reject_key (``gate:reason``, null where all gates pass).

    ``grade`` fills ``correct`` of the rows that have none (lazily: graded rows never reach it), for example
    ``seams.graded`` with a verifier.

    Stateless gates are one CASE column. The duplicate gate sees only rows that got as far as it, so
    the chain is cut there: rows that failed before keep their key and take no part in the ranking.
    """
    unknown = [g for g in gates if g != DEDUP and g not in GATES]
    if unknown:
        raise KeyError(f"unknown gates {unknown}; known: {[*GATES.names(), DEDUP]}")
    if grade is not None:
        graded = grade(candidates.where("correct is null")).select(*candidates.columns)
        candidates = candidates.where("correct is not null").unionByName(graded)
    out = candidates.withColumn("reject_key", F.lit(None).cast("string"))
    for g in gates:
        if g == DEDUP:
            alive = F.col("reject_key").isNull()
            w = Window.partitionBy("qid", *(content or ["continuation_token_ids"]), alive).orderBy(*ordinal)
            fails = F.when(alive & (F.row_number().over(w) > 1), "dedup:duplicate")
        else:
            why = GATES[g](cfg)
            fails = F.when(why.isNotNull(), F.concat(F.lit(f"{g}:"), why))
        out = out.withColumn("reject_key", F.coalesce("reject_key", fails))
    return out


def with_quota(gated: DataFrame, order: list, k: int, name: str = "over_quota") -> DataFrame:
    """Survivors beyond ``k`` a question (by ``order``) get ``selection:over_quota`` as their key."""
    alive = F.col("reject_key").isNull()
    w = Window.partitionBy("qid", alive).orderBy(*[F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order])
    return gated.withColumn("reject_key", F.when(alive & (F.row_number().over(w) > k), F.lit(f"selection:{name}")).otherwise(F.col("reject_key")))
