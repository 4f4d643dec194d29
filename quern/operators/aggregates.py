"""Pass rates, benchmark summaries, funnel and curve statistics. All are map-side combined group-bys of bounded output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.arrays import pass_at_k
from quern.functions.predicates import not_truncated, stopped


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def difficulty(c: Column | str, frontier_min: int = 1, solved_min: int = 3) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c >= solved_min, "solved").when(c >= frontier_min, "frontier").otherwise("cliff")


def question_stats(samples: DataFrame, frontier_min: int = 1, solved_min: int = 3) -> DataFrame:
    """Per question: n, c (correct and not truncated), c_raw, pass rates, n_truncated, class."""
    raw = F.col("raw_correct") if "raw_correct" in samples.columns else F.col("correct")
    done = not_truncated()
    clean = F.col("correct") & done if "raw_correct" not in samples.columns else F.col("correct")
    out = samples.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_if(clean).alias("c"), F.count_if(raw).alias("c_raw"), F.count_if(~done).alias("n_truncated"))
    return out.select("qid", "n", "c", "c_raw", (F.col("c") / F.col("n")).alias("pass_rate"), (F.col("c_raw") / F.col("n")).alias("raw_pass_rate"), "n_truncated", difficulty("c", frontier_min, solved_min).alias("class"))


def histogram(stats: DataFrame, column: str = "c") -> DataFrame:
    return stats.groupBy(column).agg(F.count(F.lit(1)).alias("n_questions"))


def dense_histogram(stats: DataFrame, k: int, column: str = "c") -> DataFrame:
    """Every value 0..k, with zero rows filled in and the share of all questions."""
    spark = stats.sparkSession
    every = spark.range(k + 1).select(F.col("id").alias(column))
    counts = every.join(histogram(stats, column), column, "left").withColumn("n_questions", F.coalesce("n_questions", F.lit(0)))
    total = F.sum("n_questions").over(Window.partitionBy())
    return counts.withColumn("share", ratio(F.col("n_questions"), total)).withColumn("class", difficulty(column))


def class_summary(stats: DataFrame, k_column: str = "n") -> DataFrame:
    """One row: questions by class, solve and all-correct rates (clean and raw), mean pass rate."""
    n = F.count(F.lit(1))
    flag = lambda c: F.count_if(c)
    return stats.agg(
        n.alias("n_questions"), flag(F.col("class") == "cliff").alias("n_cliff"), flag(F.col("class") == "frontier").alias("n_frontier"), flag(F.col("class") == "solved").alias("n_solved"),
        ratio(flag(F.col("c") > 0), n).alias("solve_rate"), ratio(flag(F.col("c_raw") > 0), n).alias("raw_solve_rate"),
        ratio(flag(F.col("c") == F.col(k_column)), n).alias("all_correct_rate"), F.avg("pass_rate").alias("mean_pass_rate"), F.sum("n_truncated").alias("n_truncated"),
    )


def partition_stats(samples: DataFrame, cliff_max_correct: int = 0) -> DataFrame:
    """One row over all questions: solved, unsolved and both, accuracies, correct samples that were cut."""
    q = samples.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("raw"), F.count_if(F.col("correct") & stopped()).alias("clean"))
    solved, unsolved = F.col("clean") >= 1, F.col("clean") <= cliff_max_correct
    out = q.agg(F.count(F.lit(1)).alias("n_questions"), F.count_if(solved).alias("n_solved"), F.count_if(unsolved).alias("n_unsolved"), F.count_if(solved & unsolved).alias("n_overlap"), F.sum("n").alias("n"), F.sum("raw").alias("raw"), F.sum("clean").alias("clean"))
    return out.select("n_questions", "n_solved", "n_unsolved", "n_overlap", ratio(F.col("n_solved"), F.col("n_questions")).alias("solve_rate"), ratio(F.col("raw"), F.col("n")).alias("sample_accuracy"), ratio(F.col("clean"), F.col("n")).alias("clean_sample_accuracy"), F.coalesce(F.col("raw") - F.col("clean"), F.lit(0)).alias("n_truncated_correct"))


def conserved(stats: Column | None = None) -> Column:
    """solved + unsolved - both = all."""
    return F.col("n_solved") + F.col("n_unsolved") - F.col("n_overlap") == F.col("n_questions")


def pass_at_k_means(stats: DataFrame, ks: list[int]) -> DataFrame:
    """(k, pass_at_k): mean over questions with at least k samples."""
    rows = stats.select("n", "c", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where(F.col("n") >= F.col("k"))
    return rows.groupBy("k").agg(F.avg(pass_at_k("n", "c", F.col("k"))).alias("pass_at_k"), F.count(F.lit(1)).alias("n_questions"))


def majority_vote(samples: DataFrame, answer: Column, keys: tuple[str, ...] = ("qid",), order: str = "sample_idx") -> DataFrame:
    """The most frequent answer of each question; the one seen first wins ties. ``answer`` is null where there is none."""
    votes = samples.withColumn("__a", answer).where("__a is not null").groupBy(*keys, "__a").agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.col("votes").desc(), "first")
    return votes.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*keys, F.col("__a").alias("majority"), "votes")


def benchmark_summary(samples: DataFrame, gold: DataFrame | None = None, answer: Column | None = None) -> DataFrame:
    """One row: micro accuracy over samples, format and truncation rates, and the majority vote's accuracy."""
    n = F.count(F.lit(1))
    out = samples.agg(F.count_distinct("qid").alias("n_questions"), n.alias("n_samples"), ratio(F.count_if("correct"), n).alias("avg_at_n"), ratio(F.count_if("formatted"), n).alias("format_rate"), ratio(F.count_if(~not_truncated()), n).alias("truncated_rate"))
    if gold is None:
        return out
    voted = gold.join(majority_vote(samples, answer), "qid", "left").agg(ratio(F.count_if(F.col("majority").eqNullSafe(F.col("gold"))), n).alias("maj_at_n"))
    return out.crossJoin(F.broadcast(voted))  # one row each


def holdout_eval(samples: DataFrame) -> DataFrame:
    """Macro averages over questions: greedy (first sample), any and mean of k, raw and clean, truncated rate."""
    clean = F.col("correct") & not_truncated()
    q = samples.groupBy("qid").agg(F.min_by("correct", "sample_idx").alias("greedy"), F.bool_or("correct").alias("any_raw"), F.bool_or(clean).alias("any_clean"), F.avg(F.col("correct").cast("int")).alias("mean_raw"), F.avg(clean.cast("int")).alias("mean_clean"), F.avg((~not_truncated()).cast("int")).alias("cut"))
    return q.agg(F.count(F.lit(1)).alias("n_questions"), F.avg(F.col("greedy").cast("int")).alias("pass_at_1"), F.avg(F.col("any_raw").cast("int")).alias("any_raw"), F.avg(F.col("any_clean").cast("int")).alias("any_clean"), F.avg("mean_raw").alias("mean_raw"), F.avg("mean_clean").alias("mean_clean"), F.avg("cut").alias("truncated_rate"))


def cliff_stats(unsolved: DataFrame, candidates: DataFrame, n_total: int | None = None) -> DataFrame:
    """One row: unsolved questions, how many have a correct candidate, sorted histogram of correct counts (zeros kept)."""
    c = candidates.groupBy("qid").agg(F.count_if(F.coalesce("correct", F.lit(False))).alias("c"))
    q = unsolved.select("qid").distinct().join(c, "qid", "left").select(F.coalesce("c", F.lit(0)).alias("c"))
    h = q.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    ratio_all = ratio(F.sum("n"), F.lit(n_total)) if n_total else F.lit(None).cast("double")
    return h.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), ratio(F.sum(F.when(F.col("c") > 0, F.col("n"))), F.sum("n")).alias("conversion_rate"), ratio_all.alias("ratio"), F.sort_array(F.collect_list(F.struct("c", "n"))).alias("histogram"))


def filter_report(candidates: DataFrame, reject: str = "reject_key") -> DataFrame:
    n = F.count(F.lit(1))
    kept = F.col(reject).isNull()
    return candidates.agg(n.alias("n_candidates"), F.count_if(kept).alias("n_kept"), F.count_distinct(F.when(kept, F.col("qid"))).alias("n_questions_improved"), ratio(F.count_if(kept), n).alias("yield"))


def rejects(candidates: DataFrame, reject: str = "reject_key") -> DataFrame:
    return candidates.where(F.col(reject).isNotNull()).groupBy(reject).agg(F.count(F.lit(1)).alias("n"))


def score_report(scores: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Mean, nearest-rank percentiles and maximum."""
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")
    return scores.groupBy(*(by or [])).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max(column).alias("max"))


def dataset_stats(examples: DataFrame) -> DataFrame:
    return examples.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("input_ids")).alias("mean_len"))


def anchor_stats(anchors: DataFrame) -> DataFrame:
    """One row; the mean fraction is over all nonempty anchors, also those without a base length."""
    full = F.col("anchor_len") > 0
    part = F.when(full & (F.col("base_response_len") > 0), F.col("anchor_len") / F.col("base_response_len"))
    return anchors.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(full).alias("n_nonempty"), F.avg(F.when(full, F.col("anchor_len"))).alias("mean_len"), F.try_divide(F.sum(part), F.count_if(full)).alias("mean_frac"), F.avg(F.when(full, F.col("threshold_crossed").cast("int"))).alias("threshold_crossed_rate"), F.avg(F.when(full, F.col("j_anchor"))).alias("mean_j_anchor"))


def empty_reasons(anchors: DataFrame) -> DataFrame:
    return anchors.where("anchor_len = 0").groupBy(F.coalesce("reason", F.lit("policy_zero")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def alpha_curve(samples: DataFrame, requested: int | None = None) -> DataFrame:
    """P of each (question, alpha): correct finished samples over samples asked for."""
    n = F.lit(requested) if requested else F.count(F.lit(1))
    ok = F.count_if(F.col("correct") & not_truncated()) if "finish_reason" in samples.columns else F.count_if("correct")
    return samples.groupBy("qid", "alpha").agg(ratio(ok, n).alias("p_hat"))


def alpha_star(curve: DataFrame, tau: float, key: str = "qid") -> DataFrame:
    """The smallest alpha whose P reaches tau, else 1."""
    return curve.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("p_hat") >= tau, F.col("alpha"))), F.lit(1.0)).alias("alpha_star"))


def chunk_alpha_star(curve: DataFrame, chunk_of: DataFrame, tau: float) -> DataFrame:
    """Alpha by the mean P of a chunk of questions, handed to each of its questions."""
    means = curve.join(chunk_of, "qid").groupBy("chunk", "alpha").agg(F.avg("p_hat").alias("p_hat"))
    return chunk_of.join(alpha_star(means, tau, "chunk"), "chunk").select("qid", "chunk", "alpha_star")


def alpha_survival(curve: DataFrame, tau: float) -> DataFrame:
    return curve.groupBy("alpha").agg(F.avg("p_hat").alias("p_hat_mean"), F.count_if(F.col("p_hat") >= tau).alias("n_survive"))


def alpha_star_histogram(stars: DataFrame, candidates: DataFrame) -> DataFrame:
    """(alpha_star, n) over questions that have candidates."""
    return stars.join(candidates.select("qid").distinct(), "qid", "left_semi").groupBy("alpha_star").agg(F.count(F.lit(1)).alias("n"))


def class_counts(joined: DataFrame) -> DataFrame:
    """(difficulty, n) of a joined table."""
    return joined.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"))


def at_alpha_star(candidates: DataFrame, stars: DataFrame) -> DataFrame:
    return candidates.join(stars.select("qid", F.col("alpha_star").alias("alpha")), ["qid", "alpha"])


def selection_stats(scores: DataFrame) -> DataFrame:
    """One row over scored candidates: all, kept, and the mean of each question's best."""
    scored = scores.where("c is not null")
    at = lambda q, c: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c})")
    best = scored.groupBy("qid").agg(F.min("c").alias("m")).agg(F.avg("m").alias("c_min_per_question_mean"))
    return scored.agg(F.count(F.lit(1)).alias("n_scored"), F.avg("c").alias("c_mean_all"), at(0.5, "c").alias("c_median_all"), F.avg(F.when(F.col("kept"), F.col("c"))).alias("c_mean_kept"), F.count_if("kept").alias("n_kept_scored"), at(0.5, "s_tail").alias("s_tail_p50"), at(0.95, "s_tail").alias("s_tail_p95")).crossJoin(F.broadcast(best))  # one row each


def funnel(stages: list[tuple[str, DataFrame]], denominator: str) -> DataFrame:
    """(position, stage, n, share of the stage named ``denominator``)."""
    rows = None
    for k, (name, df) in enumerate(stages):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("position"), F.lit(name).alias("stage"), "n")
        rows = one if rows is None else rows.unionByName(one)
    base = F.max(F.when(F.col("stage") == denominator, F.col("n"))).over(Window.partitionBy())
    return rows.withColumn("share", ratio(F.col("n"), base))


def newly_resolved(candidates: DataFrame) -> DataFrame:
    """Questions by the first stage in which they have a correct candidate."""
    return candidates.where("correct").groupBy("qid").agg(F.min("stage").alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n_resolved"))


def band_stats(probes: DataFrame, low: float, high: float) -> DataFrame:
    n = F.count(F.lit(1))
    kept = (F.col("p") > low) & (F.col("p") < high)
    return probes.agg(n.alias("n_probed"), F.count_if(kept).alias("n_kept"), F.count_if(F.col("p") <= low).alias("n_all_wrong"), F.count_if(F.col("p") >= high).alias("n_all_right"), ratio(F.count_if(kept), n).alias("yield"), F.avg("p").alias("mean_rate"))


def probe_counts(questions: DataFrame, samples: DataFrame, m: int) -> DataFrame:
    """Correct samples of each question over the m that were asked for; questions without samples have 0."""
    c = samples.groupBy("qid").agg(F.count_if("correct").alias("c"))
    return questions.select("qid").join(c, "qid", "left").select("qid", F.coalesce("c", F.lit(0)).alias("c")).withColumn("p", F.col("c") / F.lit(m))


def early_stop(probes: DataFrame, criterion: str, threshold: float) -> DataFrame:
    """One row: value and stop. ``any``: share of questions with a correct sample; ``mean``: mean P."""
    value = ratio(F.count_if(F.col("c") > 0), F.count(F.lit(1))) if criterion == "any" else F.coalesce(F.avg("p"), F.lit(0.0))
    return probes.agg(value.alias("value")).withColumn("stop", F.col("value") >= threshold)


def length_stats(df: DataFrame, length: Column) -> DataFrame:
    return df.agg(F.min(length).alias("min_len"), F.avg(length).alias("mean_len"), F.max(length).alias("max_len"))


def context_needed(requests: DataFrame, default_new: int) -> DataFrame:
    return requests.agg(F.max(F.size("prompt_token_ids") + F.coalesce("max_tokens", F.lit(default_new))).alias("context"))


def reward_summary(curve: DataFrame) -> DataFrame:
    return curve.agg(F.count(F.lit(1)).alias("n_steps"), F.avg("frac_reward_zero_std").alias("zero_advantage_mean"), F.avg("clipped_ratio").alias("clipped_ratio_mean"), F.min_by("reward", "step").alias("reward_first"), F.max_by("reward", "step").alias("reward_last"), F.max("reward").alias("reward_best"))


def bridge_stats(log: DataFrame) -> DataFrame:
    """Counts along the acceptance cascade of bridge samples."""
    return log.agg(F.count(F.lit(1)).alias("n_generated"), F.count_if("correct").alias("n_correct"), F.count_if("leak_rule").alias("n_leak_rule"), F.count_if("leak_judge").alias("n_leak_judge"), F.count_distinct(F.when(F.col("pass") > 0, F.col("qid"))).alias("n_retried"), F.count_if("kept").alias("n_kept"), ratio(F.count_if("kept"), F.count(F.lit(1))).alias("yield"))


def response_tokens(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.sum(F.size("input_ids") - F.col("prompt_len")).alias("response_tokens"))


def metrics_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """(iter, key, value) rows as one row an iteration; ``names`` fixes the columns, so there is one pass."""
    return long.groupBy("iter").pivot("key", names).agg(F.max("value"))
