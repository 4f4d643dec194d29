"""The engine's query catalogue, each with an equivalent DuckDB statement where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog import query
from quern.functions import arrays as A
from quern.functions import predicates as P
from quern.functions import text as T
from quern.operators import aggregates as G
from quern.operators import gates, joins
from quern.operators import ranking as K
from quern.plans import fixtures as X
from quern.session import read_table


def r8(df, *names):
    """Doubles rounded for comparison."""
    return df.withColumns({n: F.round(n, 8) for n in names})


def kv(c) -> F.Column:
    """Text of a number as it enters a stable hash."""
    return F.col(c).cast("string")


H = lambda seed, c: f"left(sha256(encode('{seed}') || '\\x00'::BLOB || encode({c}::VARCHAR) || '\\x00'::BLOB), 16)"
CLS = "CASE WHEN c >= 3 THEN 'solved' WHEN c >= 1 THEN 'frontier' ELSE 'cliff' END"


def stats(s, d):
    return G.question_stats(X.samples(s, d))


# --- pass rates ---


@query("passrate_question_stats", f"WITH {X.S} SELECT qid, n, c, c_raw, round(c / n::DOUBLE, 8) AS pass_rate, round(c_raw / n::DOUBLE, 8) AS raw_pass_rate, n_truncated, {CLS} AS class FROM q")
def _(s, d):
    return r8(stats(s, d), "pass_rate", "raw_pass_rate")


@query("passrate_histogram", f"WITH {X.S} SELECT c, count(*) AS n_questions FROM q GROUP BY c")
def _(s, d):
    return G.histogram(stats(s, d))


@query("passrate_dense_histogram", f"WITH {X.S}, h AS (SELECT k AS c, count(qid) AS n_questions FROM range(9) t(k) LEFT JOIN q ON q.c = k GROUP BY k) SELECT c, n_questions, round(n_questions / sum(n_questions) OVER ()::DOUBLE, 8) AS share, {CLS} AS class FROM h")
def _(s, d):
    return r8(G.dense_histogram(stats(s, d), 8), "share")


@query("passrate_class_summary", f"""WITH {X.S}, k AS (SELECT *, {CLS} AS class FROM q) SELECT count(*) AS n_questions, count(*) FILTER (WHERE class='cliff') AS n_cliff, count(*) FILTER (WHERE class='frontier') AS n_frontier, count(*) FILTER (WHERE class='solved') AS n_solved,
round(count(*) FILTER (WHERE c > 0) / count(*)::DOUBLE, 8) AS solve_rate, round(count(*) FILTER (WHERE c_raw > 0) / count(*)::DOUBLE, 8) AS raw_solve_rate, round(count(*) FILTER (WHERE c = n) / count(*)::DOUBLE, 8) AS all_correct_rate, round(avg(c / n::DOUBLE), 8) AS mean_pass_rate, sum(n_truncated)::BIGINT AS n_truncated FROM k""")
def _(s, d):
    return r8(G.class_summary(stats(s, d)), "solve_rate", "raw_solve_rate", "all_correct_rate", "mean_pass_rate")


@query("pass_at_k", f"""WITH {X.S}, k AS (SELECT unnest([1, 2, 4]) AS k), v AS (SELECT k, CASE WHEN n - c < k THEN 1.0::DOUBLE WHEN c = 0 THEN 0.0::DOUBLE ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - k / i::DOUBLE)) END AS p FROM q, k WHERE n >= k)
SELECT k, round(avg(p), 8) AS pass_at_k, count(*) AS n_questions FROM v GROUP BY k""")
def _(s, d):
    return r8(G.pass_at_k_means(stats(s, d), [1, 2, 4]), "pass_at_k")


@query("k_ladder", f"WITH {X.S}, m AS (SELECT DISTINCT n FROM q) SELECT n, array_to_string(list_sort(list_distinct(list_append(list_filter([1, 2, 4, 8, 16, 32, 64], lambda p: p <= n), n))), ',') AS ladder FROM m")
def _(s, d):
    return stats(s, d).select("n").distinct().select("n", F.array_join(F.array_sort(A.k_ladder("n")).cast("array<string>"), ",").alias("ladder"))


@query("benchmark_summary", f"""WITH {X.S}, v AS (SELECT qid, extracted, count(*) AS votes FROM s GROUP BY ALL), f AS (SELECT qid, extracted AS majority FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY votes DESC, extracted) = 1),
m AS (SELECT count(*) FILTER (WHERE majority = gold) / count(*)::DOUBLE AS maj_at_n FROM (SELECT DISTINCT qid, 'R' AS gold FROM s) JOIN f USING (qid))
SELECT count(DISTINCT qid) AS n_questions, count(*) AS n_samples, round(count(*) FILTER (WHERE correct) / count(*)::DOUBLE, 8) AS avg_at_n, round(count(*) FILTER (WHERE n_tokens > 5) / count(*)::DOUBLE, 8) AS format_rate, round(count(*) FILTER (WHERE finish_reason = 'length') / count(*)::DOUBLE, 8) AS truncated_rate, round(any_value(maj_at_n), 8) AS maj_at_n FROM s, m""")
def _(s, d):
    rows = X.samples(s, d).withColumns({"formatted": F.col("n_tokens") > 5, "sample_idx": F.ascii("extracted")})
    gold = rows.select("qid").distinct().withColumn("gold", F.lit("R"))
    return r8(G.benchmark_summary(rows, gold, F.col("extracted")), "avg_at_n", "format_rate", "truncated_rate", "maj_at_n")


@query("majority_vote_exact", f"WITH {X.R}, v AS (SELECT qid, extracted, count(*) AS votes, min(sample_idx) AS f FROM r GROUP BY ALL) SELECT qid, extracted AS majority, votes FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY votes DESC, f) = 1")
def _(s, d):
    return G.majority_vote(X.rollouts(s, d), F.col("extracted"))


@query("majority_vote_equivalent", f"WITH {X.R}, v AS (SELECT qid, lower(extracted) AS e, count(*) AS votes, min(sample_idx) AS f, min_by(extracted, sample_idx) AS majority FROM r GROUP BY ALL) SELECT qid, majority, votes FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY votes DESC, f) = 1")
def _(s, d):
    from quern import seams

    return seams.majority_equivalent(X.rollouts(s, d))


@query("holdout_eval", f"""WITH {X.R}, q AS (SELECT qid, arg_min(correct, sample_idx)::INT AS g, bool_or(correct)::INT AS ar, bool_or(correct AND finish_reason <> 'length')::INT AS ac, avg(correct::INT) AS mr, avg((correct AND finish_reason <> 'length')::INT) AS mc, avg((finish_reason = 'length')::INT) AS cut FROM r GROUP BY qid)
SELECT count(*) AS n_questions, round(avg(g), 8) AS pass_at_1, round(avg(ar), 8) AS any_raw, round(avg(ac), 8) AS any_clean, round(avg(mr), 8) AS mean_raw, round(avg(mc), 8) AS mean_clean, round(avg(cut), 8) AS truncated_rate FROM q""")
def _(s, d):
    return r8(G.holdout_eval(X.rollouts(s, d)), "pass_at_1", "any_raw", "any_clean", "mean_raw", "mean_clean", "truncated_rate")


# --- partition ---


@query("partition_stats", f"""WITH {X.S}, k AS (SELECT qid, count(*) AS n, count(*) FILTER (WHERE correct) AS raw, count(*) FILTER (WHERE correct AND finish_reason = 'stop') AS clean FROM s GROUP BY qid)
SELECT count(*) AS n_questions, count(*) FILTER (WHERE clean >= 1) AS n_solved, count(*) FILTER (WHERE clean <= 1) AS n_unsolved, count(*) FILTER (WHERE clean = 1) AS n_overlap, round(count(*) FILTER (WHERE clean >= 1) / count(*)::DOUBLE, 8) AS solve_rate, round(sum(raw) / sum(n)::DOUBLE, 8) AS sample_accuracy, round(sum(clean) / sum(n)::DOUBLE, 8) AS clean_sample_accuracy, (sum(raw) - sum(clean))::BIGINT AS n_truncated_correct FROM k""")
def _(s, d):
    return r8(G.partition_stats(X.samples(s, d), 1), "solve_rate", "sample_accuracy", "clean_sample_accuracy")


@query("partition_solved_keep_k", f"WITH {X.R} SELECT qid, sample_idx, n_tokens, final_answer FROM r JOIN (SELECT o_orderkey AS qid, o_orderstatus AS final_answer FROM orders) USING (qid) WHERE correct AND finish_reason = 'stop' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n_tokens, sample_idx) <= 2")
def _(s, d):
    done = X.rollouts(s, d).where(F.col("correct") & P.stopped()).select("qid", "sample_idx", "n_tokens")
    kept = K.keep_k(done, ["qid"], ["n_tokens", "sample_idx"], 2)
    return kept.join(X.questions(s, d).select("qid", "final_answer"), "qid")


@query("partition_unsolved", f"WITH {X.R} SELECT qid, string_agg(sample_idx::VARCHAR, ',' ORDER BY sample_idx) AS failed FROM r GROUP BY qid HAVING count(*) FILTER (WHERE correct AND finish_reason = 'stop') = 0")
def _(s, d):
    ok = F.col("correct") & P.stopped()
    q = X.rollouts(s, d).groupBy("qid").agg(F.count_if(ok).alias("c"), F.sort_array(F.collect_list(F.when(~ok, F.col("sample_idx")))).alias("f"))
    return q.where("c = 0").select("qid", F.array_join(F.col("f").cast("array<string>"), ",").alias("failed"))


@query("key_mismatch", "SELECT o_orderkey AS qid, 'left' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'right' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def _(s, d):
    return joins.key_differences(X.questions(s, d), X.samples(s, d), ["qid"])


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return joins.duplicate_keys(read_table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("failed_rollouts", f"WITH {X.R}, u AS (SELECT qid FROM r GROUP BY qid HAVING count(*) FILTER (WHERE correct AND finish_reason = 'stop') = 0) SELECT qid, sample_idx, n_tokens FROM r SEMI JOIN u USING (qid)")
def _(s, d):
    rows = X.rollouts(s, d)
    groups = rows.groupBy("qid").agg(F.count_if(F.col("correct") & P.stopped()).alias("c"), F.collect_list("sample_idx").alias("failed")).where("c = 0")
    return joins.exploded_lookup(groups, "failed", rows, "qid", "sample_idx").select("qid", "sample_idx", "n_tokens")


# --- gates and selection ---

GATED = """, g AS (SELECT *, CASE WHEN correct IS NULL THEN 'correctness:ungraded' WHEN NOT correct THEN 'correctness:incorrect' WHEN external_context IS NOT NULL THEN 'no_external_context:external_context' WHEN n_total > 4000 THEN 'length:too_long' END AS k1 FROM c),
h AS (SELECT *, CASE WHEN k1 IS NULL AND row_number() OVER (PARTITION BY qid, continuation_text, k1 IS NULL ORDER BY attempt_idx) > 1 THEN 'dedup:duplicate' END AS k2 FROM g),
k AS (SELECT *, coalesce(k1, k2, CASE WHEN regexp_matches(lower(continuation_text), '\\breference solution\\b|\\bas given\\b|\\bthe hint\\b') THEN 'leakage_rules:pattern' END) AS reject_key FROM h)"""
LEAKS = (r"\breference solution\b", r"\bas given\b", r"\bthe hint\b")


def gated(s, d):
    cfg = {"max_total_len": 4000, "length_column": "n_total", "patterns": LEAKS}
    return gates.run_gates(X.candidates(s, d), ["correctness", "no_external_context", "length", "dedup", "leakage_rules"], cfg, ["attempt_idx"], ["continuation_text"])


@query("gate_rejects", f"WITH {X.C()}{GATED} SELECT reject_key, count(*) AS n FROM k WHERE reject_key IS NOT NULL GROUP BY ALL")
def _(s, d):
    return G.rejects(gated(s, d))


@query("filter_report", f"WITH {X.C()}{GATED} SELECT count(*) AS n_candidates, count(*) FILTER (WHERE reject_key IS NULL) AS n_kept, count(DISTINCT qid) FILTER (WHERE reject_key IS NULL) AS n_questions_improved, round(count(*) FILTER (WHERE reject_key IS NULL) / count(*)::DOUBLE, 8) AS yield FROM k")
def _(s, d):
    return r8(G.filter_report(gated(s, d)), "yield")


@query("kept_shortest", f"WITH {X.C('source')} SELECT qid, attempt_idx, n_total FROM c WHERE correct QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n_total, attempt_idx) <= 4")
def _(s, d):
    return K.keep_k(X.candidates(s, d, "source").where("correct").select("qid", "attempt_idx", "n_total"), ["qid"], ["n_total", "attempt_idx"], 4)


@query("quota_rejects", f"WITH {X.C('source')}, g AS (SELECT qid, CASE WHEN correct IS NULL THEN 'correctness:ungraded' WHEN NOT correct THEN 'correctness:incorrect' WHEN row_number() OVER (PARTITION BY qid, coalesce(correct, false) ORDER BY n_total, attempt_idx) > 3 THEN 'selection:over_quota' END AS reject_key FROM c) SELECT reject_key, count(*) AS n FROM g WHERE reject_key IS NOT NULL GROUP BY ALL")
def _(s, d):
    g = gates.run_gates(X.candidates(s, d, "source"), ["correctness"], {}, ["attempt_idx"])
    return G.rejects(gates.with_quota(g, ["n_total", "attempt_idx"], 3))


@query("kept_hash_random", f"WITH {X.C('source')} SELECT qid, attempt_idx FROM c WHERE correct QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {H(7, 'attempt_idx')}, attempt_idx) <= 2")
def _(s, d):
    rows = X.candidates(s, d, "source").where("correct").select("qid", "attempt_idx")
    return K.group_hash_quota(rows, ["qid"], 2, T.stable_hash(7, kv("attempt_idx")), ["attempt_idx"])


@query("leakage_flags", "SELECT doc_id, regexp_matches(lower(text), '\\bthe hint\\b|\\bas given\\b|\\bgiven solution\\b|\\breference solution\\b|\\bprovided solution\\b|\\bmodel solution\\b|\\bofficial solution\\b|주어진 풀이|참고 풀이|\\baccording to the (solution|reference)\\b') AS leaks FROM documents")
def _(s, d):
    return read_table(s, d, "documents").select("doc_id", P.leaks("text").alias("leaks"))


@query("judge_verdicts", "SELECT CASE WHEN upper(trim(text)) LIKE 'YES%' THEN 'reject' WHEN upper(trim(text)) LIKE 'NO%' THEN 'keep' ELSE 'unparsed' END AS verdict, count(*) AS n FROM conversations GROUP BY ALL")
def _(s, d):
    return read_table(s, d, "conversations").groupBy(F.coalesce(P.judge_verdict("text"), F.lit("unparsed")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


# --- scores ---

SCORED = f"""WITH {X.L}, o AS (SELECT qid, attempt_idx, list_transform(token_logprobs, lambda x: -x) AS u FROM l), t AS (SELECT *, list_reverse_sort(u) AS v, greatest(1, ceil(0.1::DOUBLE * len(u)))::INT AS k FROM o),
sc AS (SELECT qid, attempt_idx, list_sum(u) / len(u) AS s_mean, list_sum(v[1:k]) / k AS s_tail FROM t), f AS (SELECT *, s_mean + s_tail AS c FROM sc)"""


def scored(s, d):
    return X.logprobs(s, d).withColumn("z", A.tail_score("token_logprobs", None, 0.1, 1.0, 0.0)).select("qid", "attempt_idx", F.size("token_logprobs").alias("n"), "z.s_mean", "z.s_tail", "z.c")


@query("cvar_scores", SCORED + " SELECT qid, attempt_idx, round(s_mean, 8) AS s_mean, round(s_tail, 8) AS s_tail, round(c, 8) AS c FROM f")
def _(s, d):
    return r8(scored(s, d).drop("n"), "s_mean", "s_tail", "c")


@query("divergence_tail", f"""WITH {X.L}, b AS (SELECT a.attempt_idx, list_transform(list_zip(b.token_logprobs, a.token_logprobs), lambda p: p[1] - p[2]) AS g FROM l a JOIN l b ON b.attempt_idx = a.attempt_idx + 1), t AS (SELECT attempt_idx, list_reverse_sort(g) AS v, greatest(1, ceil(0.1::DOUBLE * len(g)))::INT AS k FROM b)
SELECT attempt_idx, round(list_sum(v[1:k]) / k, 8) AS d_tail FROM t""")
def _(s, d):
    a = X.logprobs(s, d)
    b = a.select((F.col("attempt_idx") - 1).alias("attempt_idx"), F.col("token_logprobs").alias("reference"))
    z = A.tail_score("token_logprobs", "reference", 0.1, 1.0, 1.0)
    return r8(a.join(b, "attempt_idx").select("attempt_idx", z["d_tail"].alias("d_tail")), "d_tail")


@query("kept_min_c", SCORED + " SELECT qid, attempt_idx FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN attempt_idx % 5 <> 0 THEN round(c, 9) END NULLS LAST, attempt_idx) <= 2")
def _(s, d):
    c = F.when(F.col("attempt_idx") % 5 != 0, F.round("c", 9)).alias("c")  # what can't be scored comes last
    return K.keep_k(scored(s, d).select("qid", "attempt_idx", c), ["qid"], ["c", "attempt_idx"], 2).select("qid", "attempt_idx")


@query("score_percentiles", SCORED + " SELECT qid, count(c) AS n, round(avg(c), 8) AS mean, round(quantile_disc(c, 0.5), 8) AS p50, round(quantile_disc(c, 0.9), 8) AS p90, round(quantile_disc(c, 0.95), 8) AS p95, round(quantile_disc(c, 0.99), 8) AS p99, round(max(c), 8) AS max FROM f GROUP BY qid")
def _(s, d):
    return r8(G.score_report(scored(s, d), "c", ["qid"]), "mean", "p50", "p90", "p95", "p99", "max")


@query("sequence_scores", f"WITH {X.L}, z AS (SELECT attempt_idx, token_logprobs[5:] AS t FROM l) SELECT attempt_idx, round(list_sum(t), 8) AS total, round(list_sum(t) / len(t), 8) AS mean, len(t) AS n FROM z")
def _(s, d):
    z = X.logprobs(s, d).select("attempt_idx", A.sequence_score("token_logprobs", 4).alias("z")).select("attempt_idx", "z.total", "z.mean", F.col("z.n").cast("bigint").alias("n"))
    return r8(z, "total", "mean")


@query("logprob_gate", f"WITH {X.L} SELECT attempt_idx, attempt_idx % 7 <> 0 AND list_sum(token_logprobs) / len(token_logprobs) >= -0.1 AS passes FROM l")
def _(s, d):
    known = F.when(F.col("attempt_idx") % 7 != 0, F.col("token_logprobs"))
    return X.logprobs(s, d).select("attempt_idx", P.mean_at_least(known, -0.1).alias("passes"))


@query("selection_stats", SCORED + """, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(c, 9), attempt_idx) <= 2 AS kept FROM f), m AS (SELECT avg(m) AS cm FROM (SELECT min(c) AS m FROM f GROUP BY qid))
SELECT count(*) AS n_scored, round(avg(c), 8) AS c_mean_all, round(quantile_disc(c, 0.5), 8) AS c_median_all, round(avg(c) FILTER (WHERE kept), 8) AS c_mean_kept, count(*) FILTER (WHERE kept) AS n_kept_scored, round(quantile_disc(s_tail, 0.5), 8) AS s_tail_p50, round(quantile_disc(s_tail, 0.95), 8) AS s_tail_p95, round(any_value(cm), 8) AS c_min_per_question_mean FROM k, m""")
def _(s, d):
    rows = scored(s, d).withColumn("rc", F.round("c", 9))
    kept = K.ranked(rows, ["qid"], ["rc", "attempt_idx"], "rank").withColumn("kept", F.col("rank") <= 2)
    return r8(G.selection_stats(kept), "c_mean_all", "c_median_all", "c_mean_kept", "s_tail_p50", "s_tail_p95", "c_min_per_question_mean")


@query("step_threshold", f"""WITH {X.L}, m AS (SELECT attempt_idx, list_transform(range(8), lambda j: list_sum(token_logprobs[j * 8 + 1 : j * 8 + 8]) / 8) AS m FROM l), e AS (SELECT attempt_idx, m, list_sum(m) / 8 AS mu, sqrt(list_sum(list_transform(m, lambda x: (x - list_sum(m) / 8) ** 2)) / 8) AS sd FROM m),
u AS (SELECT attempt_idx, unnest(range(8)) AS j, unnest(m) AS x, unnest(list_concat([NULL], m[1:7])) AS y, mu, sd FROM e)
SELECT attempt_idx, coalesce(min(j) FILTER (WHERE x > mu + sd), arg_max(j, struct_pack(a := x - y, b := -j)) FILTER (WHERE y IS NOT NULL))::BIGINT AS j, coalesce(bool_or(x > mu + sd), false) AS crossed FROM u GROUP BY attempt_idx""")
def _(s, d):
    bounds = F.array(*[F.lit(8 * k) for k in range(1, 9)])
    z = X.logprobs(s, d).select("attempt_idx", A.first_crossing(A.step_means("token_logprobs", bounds), 1.0).alias("z"))
    return z.select("attempt_idx", F.col("z.j").cast("bigint").alias("j"), F.col("z.crossed").alias("crossed"))


@query("position_signal", f"WITH {X.L} SELECT a.attempt_idx, round(list_sum(list_transform(list_zip(b.token_logprobs, a.token_logprobs), lambda p: p[1] - p[2])), 8) AS total FROM l a JOIN l b ON b.attempt_idx = a.attempt_idx + 1")
def _(s, d):
    a = X.logprobs(s, d)
    b = a.select((F.col("attempt_idx") - 1).alias("attempt_idx"), F.col("token_logprobs").alias("p"))
    g = a.join(b, "attempt_idx").select("attempt_idx", A.position_signal("p", "token_logprobs", F.size("token_logprobs")).alias("g"))
    return r8(g.select("attempt_idx", F.aggregate("g", F.lit(0.0), lambda t, x: t + x).alias("total")), "total")


@query("union_topk_kl", f"""WITH {X.L}, z AS (SELECT a.attempt_idx, unnest(range(6)) AS t, a.token_logprobs AS p, b.token_logprobs AS q FROM l a JOIN l b ON b.attempt_idx = a.attempt_idx + 1),
w AS (SELECT attempt_idx, t, exp(CASE WHEN t < 4 THEN p[t + 1] ELSE -5.0 END) AS a, exp(CASE WHEN t >= 2 THEN q[t + 1] ELSE -5.0 END) AS b FROM z), n AS (SELECT *, a / sum(a) OVER (PARTITION BY attempt_idx) AS pa, b / sum(b) OVER (PARTITION BY attempt_idx) AS pb FROM w) SELECT attempt_idx, round(sum(pa * ln(pa / pb)), 8) AS kl FROM n GROUP BY ALL""")
def _(s, d):
    a = X.logprobs(s, d)
    b = a.select((F.col("attempt_idx") - 1).alias("attempt_idx"), F.col("token_logprobs").alias("q"))
    top = lambda c, lo, hi: F.map_from_arrays(F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda i: i.cast("string")), F.slice(c, lo + 1, hi - lo + 1))
    return r8(a.join(b, "attempt_idx").select("attempt_idx", A.union_kl(top("token_logprobs", 0, 3), top("q", 2, 5), -5.0).alias("kl")), "kl")


# --- anchors and bases ---


@query("anchor_fixed_fraction", f"WITH {X.S} SELECT qid, sum(n_tokens)::BIGINT AS base_len, least(greatest(round_even(0.3::DOUBLE * sum(n_tokens), 0)::BIGINT, 32), 60, sum(n_tokens))::BIGINT AS anchor_len FROM s GROUP BY qid")
def _(s, d):
    q = X.samples(s, d).groupBy("qid").agg(F.sum("n_tokens").alias("base_len"))
    return q.select("qid", "base_len", A.fixed_fraction(F.col("base_len"), 0.3, 32, 60).cast("bigint").alias("anchor_len"))


@query("base_first_failed", f"WITH {X.R} SELECT qid, min(sample_idx) AS base_sample_idx FROM r WHERE NOT (correct AND finish_reason = 'stop') GROUP BY qid")
def _(s, d):
    return X.rollouts(s, d).where(~(F.col("correct") & P.stopped())).groupBy("qid").agg(F.min("sample_idx").cast("bigint").alias("base_sample_idx"))


@query("base_longest", f"WITH {X.R} SELECT qid, sample_idx AS base_sample_idx, n_tokens FROM r WHERE NOT correct QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n_tokens DESC, sample_idx) = 1")
def _(s, d):
    kept = K.keep_k(X.rollouts(s, d).where(~F.col("correct")), ["qid"], [F.col("n_tokens").desc(), "sample_idx"], 1)
    return kept.select("qid", F.col("sample_idx").cast("bigint").alias("base_sample_idx"), "n_tokens")


@query("base_min_nll", f"WITH {X.L}, m AS (SELECT qid, attempt_idx, CASE WHEN attempt_idx % 7 <> 0 THEN round(list_sum(token_logprobs) / len(token_logprobs), 9) END AS ml FROM l) SELECT qid, attempt_idx FROM m QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ml DESC NULLS LAST, attempt_idx) = 1")
def _(s, d):
    m = X.logprobs(s, d).withColumn("ml", F.when(F.col("attempt_idx") % 7 != 0, F.round(A.mean("token_logprobs"), 9)))
    return K.keep_k(m, ["qid"], [F.col("ml").desc_nulls_last(), "attempt_idx"], 1).select("qid", "attempt_idx")


@query("control_pairing", "WITH p AS (SELECT *, row_number() OVER (ORDER BY n_chars, doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT a.doc_id, b.doc_id AS partner FROM p a JOIN p b ON b.r = a.r % a.n + 1 WHERE a.n > 1")
def _(s, d):
    rows = read_table(s, d, "documents").select("doc_id", "n_chars")
    return K.cyclic_neighbour(rows, ["n_chars", "doc_id"], "doc_id", "partner").select("doc_id", "partner")


@query("anchor_stats", f"WITH {X.S}, a AS (SELECT qid, CASE WHEN c = 0 THEN least(n_tok, 20) ELSE 0 END AS al, n_tok AS bl, c_raw > 0 AS cr, n AS j FROM (SELECT q.*, t.n_tok FROM q JOIN (SELECT qid, sum(n_tokens) AS n_tok FROM s GROUP BY qid) t USING (qid))) SELECT count(*) AS n_total, count(*) FILTER (WHERE al > 0) AS n_nonempty, round(avg(al) FILTER (WHERE al > 0), 8) AS mean_len, round(sum(al / bl::DOUBLE) FILTER (WHERE al > 0) / count(*) FILTER (WHERE al > 0), 8) AS mean_frac, round(avg(cr::INT) FILTER (WHERE al > 0), 8) AS threshold_crossed_rate, round(avg(j) FILTER (WHERE al > 0), 8) AS mean_j_anchor FROM a")
def _(s, d):
    tok = X.samples(s, d).groupBy("qid").agg(F.sum("n_tokens").alias("base_response_len"))
    a = stats(s, d).join(tok, "qid").select(F.when(F.col("c") == 0, F.least("base_response_len", F.lit(20))).otherwise(0).alias("anchor_len"), "base_response_len", (F.col("c_raw") > 0).alias("threshold_crossed"), F.col("n").alias("j_anchor"))
    return r8(G.anchor_stats(a), "mean_len", "mean_frac", "threshold_crossed_rate", "mean_j_anchor")


@query("empty_anchor_reasons", "SELECT CASE WHEN trim(coalesce(final, '')) = '' THEN 'no_gold' WHEN steps < 2 THEN 'too_few_steps' WHEN win IS NULL THEN 'no_valid_window' ELSE 'none' END AS reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE lang END AS final, len(string_split(text, chr(10))) AS steps, CASE WHEN n_chars > 500 THEN n_chars END AS win FROM documents) GROUP BY ALL")
def _(s, d):
    rows = read_table(s, d, "documents").select(F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("lang")).alias("gold"), F.size(F.split("text", "\n")).alias("steps"), F.when(F.col("n_chars") > 500, F.col("n_chars")).alias("win"))
    return rows.groupBy(F.coalesce(P.empty_anchor_reason("gold", "steps", "win"), F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# --- alpha curves ---


@query("alpha_curve", f"WITH {X.A} SELECT qid, round(alpha, 8) AS alpha, round(p_hat, 8) AS p_hat FROM p")
def _(s, d):
    return r8(G.alpha_curve(X.alphas(s, d)), "alpha", "p_hat")


@query("alpha_star", f"WITH {X.A} SELECT qid, coalesce(min(alpha) FILTER (WHERE p_hat >= 0.5), 1.0)::DOUBLE AS alpha_star FROM p GROUP BY qid")
def _(s, d):
    return G.alpha_star(G.alpha_curve(X.alphas(s, d)), 0.5)


@query("alpha_star_chunks", f"WITH {X.A}, k AS (SELECT qid, (row_number() OVER (ORDER BY qid) - 1) // 8 AS chunk FROM (SELECT DISTINCT qid FROM p)), m AS (SELECT chunk, alpha, avg(p_hat) AS ph FROM p JOIN k USING (qid) GROUP BY ALL), st AS (SELECT chunk, coalesce(min(alpha) FILTER (WHERE ph >= 0.5), 1.0)::DOUBLE AS alpha_star FROM m GROUP BY chunk) SELECT qid, chunk, alpha_star FROM k JOIN st USING (chunk)")
def _(s, d):
    curve = G.alpha_curve(X.alphas(s, d))
    return G.chunk_alpha_star(curve, K.chunks(curve, "qid", 8), 0.5)


@query("alpha_survival", f"WITH {X.A} SELECT round(alpha, 8) AS alpha, round(avg(p_hat), 8) AS p_hat_mean, count(*) FILTER (WHERE p_hat >= 0.5) AS n_survive FROM p GROUP BY ALL")
def _(s, d):
    return r8(G.alpha_survival(G.alpha_curve(X.alphas(s, d)), 0.5), "alpha", "p_hat_mean")


@query("alpha_grid_budget", "SELECT o_orderkey AS qid, alpha, least(64 - n, 16) AS budget FROM (SELECT o_orderkey, length(o_orderpriority) * 6 AS n FROM orders), (SELECT unnest([0.2, 0.6, 1.0])::DOUBLE AS alpha) WHERE 64 - n > 0")
def _(s, d):
    rows = read_table(s, d, "orders").select(F.col("o_orderkey").alias("qid"), (F.length("o_orderpriority") * 6).alias("n"))
    return joins.grid(rows, [0.2, 0.6, 1.0], "alpha").select("qid", "alpha", P.token_budget("n", 64, 16).cast("bigint").alias("budget")).where("budget is not null")


@query("prompt_band", f"WITH {X.A}, b AS (SELECT qid, avg(p_hat) AS p FROM p GROUP BY qid) SELECT count(*) AS n_probed, count(*) FILTER (WHERE p > 0.3 AND p < 0.6) AS n_kept, count(*) FILTER (WHERE p <= 0.3) AS n_all_wrong, count(*) FILTER (WHERE p >= 0.6) AS n_all_right, round(count(*) FILTER (WHERE p > 0.3 AND p < 0.6) / count(*)::DOUBLE, 8) AS yield, round(avg(p), 8) AS mean_rate FROM b")
def _(s, d):
    b = G.alpha_curve(X.alphas(s, d)).groupBy("qid").agg(F.avg("p_hat").alias("p"))
    return r8(G.band_stats(b, 0.3, 0.6), "yield", "mean_rate")


# --- data sets ---


@query("sft_union_lastwins", "WITH u AS (SELECT 0 AS iter, l_orderkey AS qid, l_partkey AS content, l_linenumber AS o, l_suppkey AS v FROM lineitem WHERE l_linenumber <= 4 UNION ALL SELECT 1, l_orderkey, l_partkey, l_linenumber + 100, l_suppkey FROM lineitem WHERE l_linenumber >= 3) SELECT qid, content, iter, v FROM u QUALIFY row_number() OVER (PARTITION BY qid, content ORDER BY iter DESC, o DESC, v DESC) = 1")
def _(s, d):
    li = read_table(s, d, "lineitem")
    part = lambda it, cond, plus: li.where(cond).select(F.lit(it).alias("iter"), F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("content"), F.struct((F.col("l_linenumber") + plus).alias("o"), "l_suppkey").alias("o"), F.col("l_suppkey").alias("v"))
    both = part(0, "l_linenumber <= 4", 0).unionByName(part(1, "l_linenumber >= 3", 100))
    return K.last_wins(both, ["qid", "content"], "iter", "o").select("qid", "content", "iter", "v")


@query("dpo_pairs", f"WITH {X.R}, ch AS (SELECT qid, sample_idx, n_tokens FROM r WHERE correct), rj AS (SELECT qid, min(sample_idx) AS rejected_idx FROM r WHERE NOT correct GROUP BY qid) SELECT qid, sample_idx AS chosen_idx, rejected_idx, n_tokens FROM ch JOIN rj USING (qid) WHERE n_tokens > 10")
def _(s, d):
    rows = X.rollouts(s, d)
    chosen = rows.where(F.col("correct") & (F.col("n_tokens") > 10)).select("qid", F.col("sample_idx").cast("bigint").alias("chosen_idx"), "n_tokens")
    rejected = rows.where(~F.col("correct")).groupBy("qid").agg(F.min("sample_idx").cast("bigint").alias("rejected_idx"))
    return chosen.join(rejected, "qid").select("qid", "chosen_idx", "rejected_idx", "n_tokens")


@query("dataset_stats", "SELECT source, count(*) AS n, round(avg(len(string_split(text, ' '))), 8) AS mean_len FROM documents GROUP BY source")
def _(s, d):
    return r8(G.dataset_stats(read_table(s, d, "documents").select("source", F.split("text", " ").alias("input_ids"))), "mean_len")


@query("pair_first_fit", f"WITH {X.C('source')} SELECT qid, attempt_idx FROM c WHERE n_total <= 2000 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n_total DESC, attempt_idx) = 1")
def _(s, d):
    fit, _ = K.first_that_fits(X.candidates(s, d, "source"), ["qid"], [F.col("n_total").desc(), "attempt_idx"], F.col("n_total"), 2000)
    return fit.select("qid", "attempt_idx")


@query("merge_ranked", f"WITH {X.C('source')}, b AS (SELECT qid, attempt_idx, continuation_text AS t, n_total, attempt_idx % 2 AS age FROM c), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY qid, t ORDER BY age, n_total, attempt_idx) = 1) SELECT qid, attempt_idx FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n_total, attempt_idx) <= 3")
def _(s, d):
    c = X.candidates(s, d, "source").select("qid", "attempt_idx", "continuation_text", "n_total")
    return K.merge_ranked(c.where("attempt_idx % 2 = 0"), c.where("attempt_idx % 2 = 1"), ["qid"], ["continuation_text"], ["n_total", "attempt_idx"], 3).select("qid", "attempt_idx")


@query("reindexed_attempts", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) - 1 AS attempt_idx FROM documents")
def _(s, d):
    return K.reindexed(read_table(s, d, "documents").select("source", "doc_id", "lang"), ["source"], ["lang", "doc_id"], "attempt_idx").select("source", "doc_id", F.col("attempt_idx").cast("bigint").alias("attempt_idx"))


@query("replaced_rows", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (3, 7) UNION ALL SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (3, 7)")
def _(s, d):
    old = read_table(s, d, "customer").select("c_custkey", "c_nationkey")
    new = read_table(s, d, "supplier").where("s_nationkey in (3, 7)").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"))
    return joins.replaced(old, new, ["c_nationkey"], read_table(s, d, "nation").where("n_nationkey in (3, 7)").select(F.col("n_nationkey").alias("c_nationkey")))


@query("round_robin_shards", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS shard FROM orders")
def _(s, d):
    return K.round_robin(read_table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 7)


# --- ingest and curation ---


@query("holdout_split", f"SELECT o_orderkey, {H(13, 'o_orderkey')} AS h, row_number() OVER (ORDER BY {H(13, 'o_orderkey')}, o_orderkey) <= 100 AS held FROM orders")
def _(s, d):
    o = read_table(s, d, "orders").select("o_orderkey")
    train, held = K.holdout_split(o, 100, 13, kv("o_orderkey"), "o_orderkey")
    both = train.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)))
    return both.select("o_orderkey", T.stable_hash(13, kv("o_orderkey")).alias("h"), "held")


@query("hash_sample", f"SELECT o_orderkey FROM orders ORDER BY {H(7, 'o_orderkey')}, o_orderkey LIMIT 50")
def _(s, d):
    return K.hash_sample(read_table(s, d, "orders").select("o_orderkey"), 50, 7, kv("o_orderkey"), "o_orderkey")


def ingested(s, d):
    from quern.sources.tables import ADAPTERS

    p = read_table(s, d, "part")
    raw = p.select(F.col("p_partkey").alias("row_idx"), F.col("p_name").alias("problem"), F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.concat(F.lit("so \\boxed{"), F.col("p_type"), F.lit("}"))).alias("answer"), F.col("p_brand").alias("question_type"), F.array(F.col("p_size") > 25, F.col("p_size") % 2 == 0).alias("verified"))
    return ADAPTERS["general"](raw, {"where": {"question_type": ["Brand#1", "Brand#12", "Brand#13", "Brand#22", "Brand#34"]}, "require_any_true": ["verified"], "require_boxed_gold": True, "exclude_answer_regex": "COPPER", "prefix": "p-"})


INGEST = """WITH m AS (SELECT p_partkey AS row_idx, p_name, p_type, CASE WHEN p_brand NOT IN ('Brand#1','Brand#12','Brand#13','Brand#22','Brand#34') THEN 'where:question_type' WHEN NOT (p_size > 25 OR p_size % 2 = 0) THEN 'any_true:verified' WHEN p_size % 7 = 0 OR trim(p_name) = '' THEN 'empty' WHEN p_type LIKE '%COPPER%' THEN 'answer_regex' END AS drop_reason FROM part)"""


@query("ingest_drop_reasons", INGEST + " SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n FROM m GROUP BY ALL")
def _(s, d):
    return ingested(s, d).drops()


@query("ingest_questions", INGEST + " SELECT 'p-' || left(sha256(encode('''' || trim(p_name) || '''') || '\\x00'::BLOB), 16) AS qid, row_idx, p_type AS final_answer FROM m WHERE drop_reason IS NULL QUALIFY row_number() OVER (PARTITION BY trim(p_name) ORDER BY row_idx) = 1")
def _(s, d):
    return ingested(s, d).questions.select("qid", "row_idx", "final_answer")


@query("dedup_first", "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) = 1")
def _(s, d):
    return K.first_wins(read_table(s, d, "documents").select("lang", "text", "doc_id"), ["lang", "text"], ["doc_id"]).select("lang", "doc_id")


@query("curation_join", """WITH st AS (SELECT c_custkey AS qid, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS row_idx, c_name || '  ' AS question FROM customer), src AS (SELECT c_custkey AS row_idx, c_name AS question, c_acctbal FROM customer)
SELECT qid, coalesce(st.row_idx, f.row_idx) AS row_idx, round(s.c_acctbal, 8) AS c_acctbal FROM st LEFT JOIN (SELECT question, min(row_idx) AS row_idx FROM src GROUP BY question) f ON f.question = trim(st.question) LEFT JOIN src s ON s.row_idx = coalesce(st.row_idx, f.row_idx)""")
def _(s, d):
    c = read_table(s, d, "customer")
    st = c.select(F.col("c_custkey").alias("qid"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).alias("known"), T.collapse_spaces(F.concat("c_name", F.lit("  "))).alias("question"))
    src = c.select(F.col("c_custkey").alias("row_idx"), T.collapse_spaces("c_name").alias("question"), "c_acctbal")
    found = joins.with_fallback(st, src.withColumn("known", F.col("row_idx")), src, ["known"], ["question"], "row_idx")
    out = found.join(src.withColumnRenamed("question", "theirs"), "row_idx", "left")
    return r8(joins.require_equal(out, F.col("question"), F.col("theirs"), "curation").select("qid", "row_idx", "c_acctbal"), "c_acctbal")


@query("overriding_join", "SELECT s_suppkey, coalesce(c_acctbal, s_acctbal) AS s_acctbal FROM supplier LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS c_acctbal FROM customer) ON c_custkey = s_suppkey")
def _(s, d):
    right = read_table(s, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("s_acctbal"))
    return joins.overriding(read_table(s, d, "supplier").select("s_suppkey", "s_acctbal"), right, ["s_suppkey"])


@query("backfill_update", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND c_mktsegment IS NOT NULL THEN c_mktsegment ELSE s_name END AS s_name FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey")
def _(s, d):
    new = read_table(s, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("  ").alias("s_name"))
    return joins.update_column(read_table(s, d, "supplier").select("s_suppkey", "s_name"), new, ["s_suppkey"], "s_name")


@query("benchmark_questions", "SELECT printf('bench-probe-%04d', item_id) AS qid, trim(text) AS question, item_id::VARCHAR AS final_answer FROM benchmark")
def _(s, d):
    from quern.sources.tables import ADAPTERS

    raw = read_table(s, d, "benchmark").select(F.col("item_id").alias("row_idx"), F.col("text").alias("problem"), F.col("item_id").alias("answer"))
    return ADAPTERS["benchmark"](raw, {"name": "probe"})


# --- text ---


@query("last_boxed", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN '\\frac{' || p_size || '}{2}' END AS answer FROM part")
def _(s, d):
    p = read_table(s, d, "part")
    text = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("a \\boxed{no} b \\boxed{"), F.col("p_type"), F.lit("} end"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("x \\boxed{\\frac{"), F.col("p_size"), F.lit("}{2}}."))).when(F.col("p_size") % 4 == 2, F.lit("no box")).otherwise(F.lit("\\boxed{a} then \\boxed{open {"))
    return p.select("p_partkey", T.last_boxed(text).alias("answer"))


@query("normalized_answers", "SELECT p_partkey, trim(lower(replace(replace('$ ' || p_name || '$', '$', ''), ' ', ''))) AS answer FROM part")
def _(s, d):
    return read_table(s, d, "part").select("p_partkey", T.normalize_answer(F.concat(F.lit("$ "), "p_name", F.lit("$"))).alias("answer"))


@query("clean_solutions", "SELECT doc_id, sha256(trim(text)) AS text_sha, doc_id % 2 = 0 AS stripped FROM documents")
def _(s, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<think>a</think> hm</think>\n"), "text")).otherwise(F.col("text"))
    return read_table(s, d, "documents").select("doc_id", T.clean_solution(raw).alias("z")).select("doc_id", F.sha2("z.text", 256).alias("text_sha"), F.col("z.stripped").alias("stripped"))


@query("chat_render", "SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def _(s, d):
    return read_table(s, d, "conversations").groupBy("conv_id").agg(T.render_turns("turn", "role", "text").alias("prompt"))


@query("prompt_lengths", "SELECT min(len(string_split(text, ' '))) AS min_len, round(avg(len(string_split(text, ' '))), 8) AS mean_len, max(len(string_split(text, ' '))) AS max_len FROM conversations")
def _(s, d):
    z = G.length_stats(read_table(s, d, "conversations"), F.size(F.split("text", " ")).cast("bigint"))
    return r8(z, "mean_len")


@query("stable_seeds", "SELECT o_orderkey, (('0x' || left(sha256(encode('5') || '\\x00'::BLOB || encode(o_orderkey::VARCHAR) || '\\x00'::BLOB), 8))::BIGINT & 2147483647)::BIGINT AS seed FROM orders")
def _(s, d):
    return read_table(s, d, "orders").select("o_orderkey", T.stable_seed(5, kv("o_orderkey")).alias("seed"))


@query("verdicts_native", "SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 <> 0 AS correct, p_size % 3 <> 0 AS formatted FROM part")
def _(s, d):
    from quern import seams

    p = read_table(s, d, "part")
    answer = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("$"), F.upper("p_name"), F.lit("$"))).otherwise(F.lit("other"))
    text = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("so \\boxed{"), answer, F.lit("}"))).otherwise(F.lit("none"))
    return p.select("p_partkey", seams.verdict_native("p_name", text).alias("z")).select("p_partkey", "z.correct", "z.formatted")


@query("verdicts_udf", "SELECT p_partkey, p_size % 2 = 1 AS correct, p_size || '/2' AS extracted FROM part")
def _(s, d):
    from quern import seams

    p = read_table(s, d, "part").select("p_partkey", F.format_string("\\frac{%d}{4}", (F.col("p_size") * 2 + F.when(F.col("p_size") % 2 == 1, 0).otherwise(1)).cast("int")).alias("gold"), F.format_string("\\boxed{%d/2}", F.col("p_size").cast("int")).alias("text"))
    return seams.verdict(p, "math_strict", F.col("gold"), F.col("text")).select("p_partkey", "verdict.correct", "verdict.extracted")


# --- rounds and rewards ---


@query("rolling_reward", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5 FROM events")
def _(s, d):
    e = read_table(s, d, "events").select("event_id", "user_id", "ts", "value")
    return K.rolling_mean(e, ["user_id"], ["ts", "event_id"], "value", 5, "mean5").select("event_id", F.round("mean5", 6).alias("mean5"))


@query("reward_plateau", """WITH RECURSIVE e AS (SELECT user_id, value / 1000 AS v, row_number() OVER w - 1 AS i, CASE WHEN row_number() OVER w >= 5 THEN sum(value / 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 5 END AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
z AS (SELECT DISTINCT user_id, -1 AS i, NULL::DOUBLE AS best, 0 AS stale, -1 AS stop_at FROM events
  UNION ALL SELECT e.user_id, e.i::INT, CASE WHEN v < 1 AND m IS NOT NULL AND coalesce(m > best + 0.001, true) THEN m ELSE best END, CASE WHEN v >= 1 OR m IS NULL THEN stale WHEN coalesce(m > best + 0.001, true) THEN 0 ELSE stale + 1 END,
    CASE WHEN v >= 1 OR (m <= best + 0.001 AND stale + 1 >= 6) THEN e.i ELSE -1 END::INT FROM z JOIN e ON e.user_id = z.user_id AND e.i = z.i + 1 WHERE z.stop_at < 0)
SELECT user_id, round(best, 8) AS best, stale, stop_at FROM z QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def _(s, d):
    e = read_table(s, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", (F.col("value") / 1000).alias("v")))), lambda x: x["v"]).alias("rewards"))
    return e.select("user_id", K.plateau(F.col("rewards"), 5, 6, 0.001).alias("z")).select("user_id", F.round("z.best", 8).alias("best"), "z.stale", "z.stop_at")


@query("reward_summary", "SELECT count(*) AS n_steps, round(avg(l_discount), 8) AS zero_advantage_mean, round(avg(l_tax), 8) AS clipped_ratio_mean, round(arg_min(l_quantity, l_orderkey * 100000000 + l_partkey * 10 + l_linenumber), 8) AS reward_first, round(arg_max(l_quantity, l_orderkey * 100000000 + l_partkey * 10 + l_linenumber), 8) AS reward_last, max(l_quantity) AS reward_best FROM lineitem")
def _(s, d):
    li = read_table(s, d, "lineitem").select((F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("step"), F.col("l_quantity").alias("reward"), F.col("l_discount").alias("frac_reward_zero_std"), F.col("l_tax").alias("clipped_ratio"))
    return r8(G.reward_summary(li), "zero_advantage_mean", "clipped_ratio_mean", "reward_first", "reward_last")


@query("newly_resolved", f"WITH {X.R}, f AS (SELECT qid, min(sample_idx) AS stage FROM r WHERE correct GROUP BY qid) SELECT stage, count(*) AS n_resolved FROM f GROUP BY stage")
def _(s, d):
    return G.newly_resolved(X.rollouts(s, d).withColumn("stage", F.col("sample_idx").cast("bigint")))


@query("cliff_stats", f"""WITH {X.S}, u AS (SELECT qid FROM q WHERE c = 0), k AS (SELECT u.qid, coalesce(z.c, 0) AS c FROM u LEFT JOIN (SELECT o_orderkey AS qid, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS c FROM orders GROUP BY 1) z USING (qid)), h AS (SELECT c, count(*) AS n FROM k GROUP BY c)
SELECT sum(n)::BIGINT AS count, round(sum(n) FILTER (WHERE c > 0) / sum(n)::DOUBLE, 8) AS conversion_rate, round(sum(n) / 100000.0::DOUBLE, 8) AS ratio, string_agg(c || ':' || n, ',' ORDER BY c) AS histogram FROM h""")
def _(s, d):
    cand = read_table(s, d, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").startswith("1").alias("correct"))
    z = G.cliff_stats(stats(s, d).where("c = 0"), cand, 100000)
    return r8(z.withColumn("histogram", F.array_join(F.transform("histogram", lambda h: F.concat_ws(":", h["c"].cast("string"), h["n"].cast("string"))), ",")), "conversion_rate", "ratio")


@query("funnel", f"WITH {X.S}, a AS (SELECT 0 AS position, 'questions' AS stage, count(*) AS n FROM q UNION ALL SELECT 1, 'cliff', count(*) FROM q WHERE c = 0 UNION ALL SELECT 2, 'rescued', count(*) FROM q WHERE c = 0 AND c_raw > 0) SELECT position, stage, n, round(n / (SELECT n FROM a WHERE stage = 'cliff')::DOUBLE, 8) AS share FROM a")
def _(s, d):
    q = stats(s, d)
    return r8(G.funnel([("questions", q), ("cliff", q.where("c = 0")), ("rescued", q.where("c = 0 and c_raw > 0"))], "cliff"), "share")


@query("bridge_stats", f"WITH {X.S} SELECT count(*) AS n_generated, count(*) FILTER (WHERE correct) AS n_correct, count(*) FILTER (WHERE correct AND n_tokens > 40) AS n_leak_rule, count(*) FILTER (WHERE correct AND n_tokens < 5) AS n_leak_judge, count(DISTINCT qid) FILTER (WHERE n_tokens % 10 = 0) AS n_retried, count(*) FILTER (WHERE correct AND n_tokens BETWEEN 5 AND 40) AS n_kept, round(count(*) FILTER (WHERE correct AND n_tokens BETWEEN 5 AND 40) / count(*)::DOUBLE, 8) AS yield FROM s")
def _(s, d):
    c, n = F.col("correct"), F.col("n_tokens")
    log = X.samples(s, d).withColumns({"leak_rule": c & (n > 40), "leak_judge": c & (n < 5), "pass": F.when(n % 10 == 0, 1).otherwise(0), "kept": c & n.between(5, 40)})
    return r8(G.bridge_stats(log), "yield")


@query("probe_early_stop", f"WITH {X.S}, p AS (SELECT o_orderkey AS qid, coalesce(q.c, 0) AS c FROM orders LEFT JOIN q ON q.qid = o_orderkey), z AS (SELECT count(*) FILTER (WHERE c > 0) / count(*)::DOUBLE AS v FROM p) SELECT round(v, 8) AS value, v >= 0.4 AS stop FROM z")
def _(s, d):
    done = X.samples(s, d).withColumn("correct", F.col("correct") & P.not_truncated())
    return r8(G.early_stop(G.probe_counts(X.questions(s, d), done, 4), "any", 0.4), "value")


@query("weight_totals", "SELECT l_orderkey, sum(l_linenumber * 0.5 + l_quantity::INT * 1.0 - 0.0)::DOUBLE AS total FROM lineitem GROUP BY l_orderkey")
def _(s, d):
    li = read_table(s, d, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    return li.groupBy("l_orderkey").agg(F.sum(A.weight_total(F.lit(3), "l_linenumber", "q", (0.0, 0.5, 1.0))).alias("total"))


@query("region_violations", "SELECT count(*) FILTER (WHERE l_linenumber % 3 = 0) AS n_bad, count(*) AS n FROM lineitem")
def _(s, d):
    from quern.schemas import region_violation

    li = read_table(s, d, "lineitem").select(F.sequence(F.lit(1), F.lit(6)).alias("input_ids"), F.lit(2).alias("prompt_len"), F.lit(1).alias("anchor_len"), F.when(F.col("l_linenumber") % 3 == 0, 2).otherwise(3).alias("completion_len"), F.lit("improved").alias("source"))
    return li.agg(F.count_if(region_violation()).alias("n_bad"), F.count(F.lit(1)).alias("n"))


@query("token_splices", "SELECT p_partkey, p_size + 3 AS n_ids, 2 AS prompt_len, p_size % 5 AS anchor_len, (p_size + 1 - p_size % 5) AS completion_len FROM part")
def _(s, d):
    ids = F.sequence(F.lit(1), F.col("p_size"))
    n = F.col("p_size") % 5
    pair = A.training_pair(F.array(F.lit(7), F.lit(8)), A.prefix(ids, n), A.suffix(ids, n), 0)
    return read_table(s, d, "part").where("p_size > 0").select("p_partkey", pair.alias("z")).select("p_partkey", F.size("z.input_ids").alias("n_ids"), "z.prompt_len", "z.anchor_len", "z.completion_len")


@query("step_bounds", r"""WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[ \t\n\x0b\f\r]?[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+') AS a FROM documents),
u AS (SELECT doc_id, len(a) AS n, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS i FROM p),
w AS (SELECT *, lag(x, 1, '') OVER o AS before, lead(x, 1, '') OVER o AS after, count(*) FILTER (regexp_matches(x, '[^ \t\n\x0b\f\r]')) OVER (PARTITION BY doc_id ORDER BY i) AS solid FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, n, i, solid, contains(x, chr(10) || chr(10)) OR (ends_with(before, chr(10)) AND starts_with(x, chr(10))) AS blank, regexp_matches(x, '[.!?]["'')\]]*[ \t\n\x0b\f\r]') OR (regexp_matches(x, '[.!?]["'')\]]*$') AND regexp_matches(after, '^[ \n\t]')) AS sentence FROM w),
c AS (SELECT doc_id, n, i, solid, 'b' AS kind FROM m WHERE blank AND i < n UNION ALL SELECT doc_id, n, i, solid, 's' FROM m WHERE sentence AND i < n),
k AS (SELECT * FROM c QUALIFY solid > lag(solid, 1, 0) OVER (PARTITION BY doc_id, kind ORDER BY i)),
t AS (SELECT doc_id, max(solid) AS total FROM m GROUP BY doc_id),
f AS (SELECT doc_id, kind, list(i ORDER BY i) AS ends FROM (SELECT k.*, total FROM k JOIN t USING (doc_id)) WHERE solid < total GROUP BY ALL),
r AS (SELECT doc_id, len(a) AS n, list_append(coalesce(b.ends, []), len(a)) AS b, list_append(coalesce(s.ends, []), len(a)) AS s FROM p LEFT JOIN (SELECT * FROM f WHERE kind = 'b') b USING (doc_id) LEFT JOIN (SELECT * FROM f WHERE kind = 's') s USING (doc_id))
SELECT doc_id, CASE WHEN n = 0 THEN '' ELSE array_to_string(CASE WHEN len(b) < 3 AND len(s) > len(b) THEN s ELSE b END, ',') END AS bounds FROM r""")
def _(s, d):
    pieces = F.regexp_extract_all("text", F.lit(r"\s?\S+\s*?(?=\s|$)|\s+"), F.lit(0))
    return read_table(s, d, "documents").select("doc_id", F.array_join(A.step_bounds(pieces).cast("array<string>"), ",").alias("bounds"))


@query("metrics_wide", "SELECT o_custkey % 50 AS iter, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS F, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS O, max(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def _(s, d):
    long = read_table(s, d, "orders").select((F.col("o_custkey") % 50).alias("iter"), F.col("o_orderstatus").alias("key"), F.col("o_totalprice").alias("value"))
    return G.metrics_wide(long, ["F", "O", "P"])
