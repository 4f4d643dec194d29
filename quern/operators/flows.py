"""Tables of an improvement round: who is asked, what comes back, what is kept, tried again and merged.

A round is a handful of joins on the question's id. ``improve`` strings them together as passes over
DataFrames: propose, grade, gate, keep, and once more for what is still pending. Proposing and grading are
functions of tables, so that generation stays a seam.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import fixed_fraction, first_crossing
from quern.functions.text import quoted, stable_seed
from quern.operators.joins import KeyMismatch, replaced, require_same_keys, require_unique
from quern.operators.ranking import keep_k
from quern.registry import Registry
from quern.session import materialize

# --- requests and their answers ---


def rollout_requests(questions: DataFrame, n: int, seed: int, iteration: int) -> DataFrame:
    """``n`` requests a question: sample_idx 0..n-1 and a seed of the run, the round and the question (a text id)."""
    own = stable_seed(seed, "rollout", iteration, quoted(F.col("qid").cast("string")))
    return questions.withColumn("seed", own).withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def scored_positions(scores: DataFrame, logprobs: str, score_from: Column) -> DataFrame:
    """One row a scored token: index i of the array is position max(1, score_from) + i; nulls are kept."""
    rest = [c for c in scores.columns if c != logprobs]
    first = F.greatest(F.lit(1), score_from)
    return scores.select(*rest, first.alias("__first"), F.posexplode(logprobs).alias("__i", "logprob")).select(*rest, (F.col("__first") + F.col("__i")).alias("position"), "logprob")


def with_verdicts(rollouts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rollouts with their verdict, one for one; a missing, surplus or repeated key is an error."""
    keys = ["qid", "sample_idx"]
    require_unique(verdicts, keys)
    require_same_keys(rollouts, verdicts, keys)
    return rollouts.join(verdicts, keys)


# --- anchors and gold ---

#: name -> (params) -> column of the anchor's length; expects n_tokens, and step_means and bounds where steps decide.
ANCHOR_POLICIES: Registry[Callable[[dict], Column]] = Registry("anchor policy")


@ANCHOR_POLICIES.register("fixed_fraction")
def _fraction(params: dict) -> Column:
    n = F.col("n_tokens")
    return F.greatest(F.lit(0), fixed_fraction(n, params.get("fraction", 0.3), params.get("min_tokens", 32), params.get("max_tokens", 2048)))


@ANCHOR_POLICIES.register("none")
def _none(params: dict) -> Column:
    return F.lit(0)


@ANCHOR_POLICIES.register("privileged_divergence")
def _divergence(params: dict) -> Column:
    """The end of the step before the one whose divergence crosses; 0 with fewer than three steps or no step allowed."""
    means, bounds = F.col("step_means"), F.col("bounds")
    least = F.lit(int(params.get("min_steps", 1)))
    most = F.least(F.lit(int(params.get("max_step", 1 << 30))), F.size(means) - 1)
    j = F.greatest(least, F.least(most, first_crossing(means, params.get("c_sigma", 1.0))["j"]))
    return F.when((F.size(means) >= 3) & (most >= least), F.coalesce(F.get(bounds, j - 1), F.lit(0))).otherwise(0)


def anchored(failed: DataFrame, policy: str, params: dict | None = None) -> DataFrame:
    """``failed`` with anchor_len by the named policy."""
    return failed.withColumn("anchor_len", F.coalesce(ANCHOR_POLICIES[policy](params or {}).cast("int"), F.lit(0)))


def with_anchors(unsolved: DataFrame, anchors: DataFrame) -> DataFrame:
    """Unsolved questions that have an anchor."""
    return unsolved.join(anchors, "qid")


def with_gold(questions: DataFrame, gold: DataFrame) -> tuple[DataFrame, int]:
    """(questions that have a gold solution, how many have none); an error where none has one."""
    found = materialize(questions.join(gold.where("trim(gold_solution) <> ''").select("qid", "gold_solution"), "qid", "left"), "with-gold")
    kept = found.where("gold_solution is not null")
    n, missing = found.agg(F.count(F.lit(1)), F.count_if(F.col("gold_solution").isNull())).first()
    if n and missing == n:
        raise KeyMismatch("no question has a gold solution")
    return kept, missing


def with_question(candidates: DataFrame, unsolved: DataFrame, columns: list[str]) -> DataFrame:
    """Candidates with columns of their question; candidates of other questions are left out."""
    return candidates.join(unsolved.select("qid", *columns), "qid")


def with_rank_score(candidates: DataFrame, scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Candidates with their score; what was never scored gets +inf and comes last."""
    return candidates.join(scores.select(*keys, score), keys, "left").withColumn(score, F.coalesce(F.col(score).cast("double"), F.lit(float("inf"))))


# --- what comes back ---


def judged(rows: DataFrame, verdicts: DataFrame, keys: list[str], reason: str = "leak_judge") -> DataFrame:
    """Rows with reject_reason where the judge's verdict (a boolean ``leaks``) says so; earlier reasons and rows without a verdict stay."""
    both = rows.join(verdicts.select(*keys, F.col("leaks").alias("__leaks")), keys, "left")
    return both.withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.col("__leaks"), reason))).drop("__leaks")


def with_regenerated(original: DataFrame, regenerated: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The regenerated array where there is one that isn't empty, else the original one."""
    new = regenerated.select(*keys, F.col(column).alias("__new"))
    return original.join(new, keys, "left").withColumn(column, F.when(F.size("__new") > 0, F.col("__new")).otherwise(F.col(column))).drop("__new")


def pending(asked: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """What has no accepted answer yet."""
    return asked.join(accepted.select(*keys).distinct(), keys, "left_anti")


def final_stage(rows: DataFrame, last: str, only_final: bool = True) -> DataFrame:
    """The rows of the last stage where only those are wanted."""
    return rows.where(F.col("stage") == last) if only_final else rows


# --- training tables ---


def training_table(solved: DataFrame, improved: DataFrame) -> DataFrame:
    """Both kinds of rows in one table, with ``source``; columns that one of them lacks are null."""
    return solved.withColumn("source", F.lit("solved")).unionByName(improved.withColumn("source", F.lit("improved")), allowMissingColumns=True)


def membership(merged: DataFrame, old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: merged rows, and how many of them were in the old and in the new table."""
    flag = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    both = merged.join(flag(old, "__old"), keys, "left").join(flag(new, "__new"), keys, "left")
    return both.agg(F.count(F.lit(1)).alias("n_merged"), F.count_if("__old").alias("n_old"), F.count_if("__new").alias("n_new"))


def within_length(rows: DataFrame, length: Column, most: int) -> DataFrame:
    """Rows of at most ``most`` tokens; an error where none is left of some."""
    kept = rows.where(length <= most)
    if kept.isEmpty() and not rows.isEmpty():
        raise ValueError(f"no row has {most} tokens or fewer")
    return kept


def without_empty(rows: DataFrame, column: str) -> DataFrame:
    """Drops an optional column in which every value is null or blank."""
    return rows.drop(column) if rows.where(F.trim(F.col(column).cast("string")) != "").isEmpty() else rows


def ordered(rows: DataFrame, *columns: str) -> DataFrame:
    """A total order for writing: range-partitioned files, each sorted."""
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def four_digits(rows: DataFrame, *columns: str) -> DataFrame:
    """Figures of reports as they are written."""
    return rows.withColumns({c: F.round(c, 4) for c in columns})


# --- whole rounds ---

#: name -> (unsolved, propose) -> candidates of one pass
OPERATORS: Registry[Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame]] = Registry("operator")


@OPERATORS.register("resample")
def _resample(unsolved: DataFrame, propose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Whole responses anew, whatever anchors there are."""
    return propose(unsolved.withColumn("anchor_len", F.lit(0)))


@OPERATORS.register("prefix_continue")
def _continue(unsolved: DataFrame, propose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Continuations of the questions that have an anchor."""
    return propose(unsolved.where("anchor_len > 0"))


@OPERATORS.register("refit")
def _refit(unsolved: DataFrame, propose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A second pass over the questions whose first candidates are all wrong replaces those candidates."""
    first = materialize(propose(unsolved.withColumn("refit", F.lit(False))), "first-pass")
    again = materialize(pending(unsolved, first.where("correct"), ["qid"]), "refit")
    second = propose(again.withColumn("refit", F.lit(True)))
    return replaced(first, second, ["qid"], again)


def improve(unsolved: DataFrame, operator: str, propose: Callable[[DataFrame], DataFrame], gate: Callable[[DataFrame], DataFrame], order: list, k: int, passes: int = 2) -> DataFrame:
    """Kept candidates (``k`` a question by ``order``) with the pass that made them; later passes see what is still pending."""
    out: DataFrame | None = None
    asked = unsolved
    for number in range(passes):
        accepted = gate(OPERATORS[operator](asked, propose)).where("reject_key is null").withColumn("pass", F.lit(number))
        accepted = materialize(keep_k(accepted, ["qid"], order, k), "accepted")
        out = accepted if out is None else out.unionByName(accepted)
        asked = pending(asked, accepted, ["qid"])
        if number + 1 < passes:
            asked = materialize(asked, "pending")
            if asked.isEmpty():
                break
    return out
