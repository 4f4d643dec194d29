"""Queries for the tables of an improvement round."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog import query
from quern.functions import arrays as A
from quern.functions import predicates as P
from quern.operators import aggregates as G
from quern.operators import flows, gates
from quern.operators import ranking as K
from quern.plans import fixtures as X
from quern.plans.queries import CLS, r8, stats
from quern.session import read_table

U = "u AS (SELECT qid, min(sample_idx) AS failed, max(n_tokens) AS n_tokens FROM r GROUP BY qid HAVING count(*) FILTER (WHERE correct AND finish_reason = 'stop') = 0)"


def unsolved(s, d):
    r = X.rollouts(s, d)
    solved = F.count_if(F.col("correct") & P.stopped())
    return r.groupBy("qid").agg(F.min("sample_idx").cast("bigint").alias("failed"), F.max("n_tokens").alias("n_tokens"), solved.alias("__c")).where("__c = 0").drop("__c")


@query("rollout_with_verdicts", f"WITH {X.R} SELECT qid, count(*) AS n, count(*) FILTER (WHERE correct AND n_tokens > 20) AS n_long_correct FROM r GROUP BY qid")
def _(s, d):
    r = X.rollouts(s, d)
    both = flows.with_verdicts(r.drop("correct"), r.select("qid", "sample_idx", "correct"))
    return both.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct") & (F.col("n_tokens") > 20)).alias("n_long_correct"))


@query("rollout_requests", r"SELECT p_partkey AS qid, unnest(range(4))::BIGINT AS sample_idx, (('0x' || left(sha256(encode('5') || '\x00'::BLOB || encode(chr(39) || 'rollout' || chr(39)) || '\x00'::BLOB || encode('2') || '\x00'::BLOB || encode(chr(39) || p_partkey || chr(39)) || '\x00'::BLOB), 8))::BIGINT & 2147483647)::BIGINT AS seed FROM part")
def _(s, d):
    return flows.rollout_requests(read_table(s, d, "part").select(F.col("p_partkey").alias("qid")), 4, 5, 2).select("qid", F.col("sample_idx").cast("bigint").alias("sample_idx"), "seed")


@query("scored_positions", f"WITH {X.L}, z AS (SELECT attempt_idx, unnest(token_logprobs) AS lp, unnest(range(len(token_logprobs))) + greatest(1, attempt_idx % 3) AS position FROM l) SELECT position, count(*) AS n, round(sum(lp), 6) AS total FROM z GROUP BY position")
def _(s, d):
    z = flows.scored_positions(X.logprobs(s, d), "token_logprobs", F.col("attempt_idx") % 3)
    return z.groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("logprob"), 6).alias("total"))


@query("anchors_of_unsolved", f"WITH {X.R}, {U} SELECT qid, n_tokens, least(n_tokens, greatest(8, least(30, round_even(0.5::DOUBLE * n_tokens, 0)::BIGINT)))::BIGINT AS anchor_len, o_orderpriority AS domain FROM u JOIN orders ON o_orderkey = qid WHERE o_orderstatus <> 'P'")
def _(s, d):
    a = flows.anchored(unsolved(s, d), "fixed_fraction", {"fraction": 0.5, "min_tokens": 8, "max_tokens": 30})
    q = X.questions(s, d).where("final_answer <> 'P'").select("qid", "domain")
    return flows.with_anchors(q, a).select("qid", "n_tokens", F.col("anchor_len").cast("bigint").alias("anchor_len"), "domain")


@query("divergence_anchor", f"""WITH {X.L}, m AS (SELECT attempt_idx, list_transform(range(8), lambda j: list_sum(token_logprobs[j * 8 + 1 : j * 8 + 8]) / 8) AS m FROM l), e AS (SELECT attempt_idx, m, list_sum(m) / 8 AS mu, sqrt(list_sum(list_transform(m, lambda x: (x - list_sum(m) / 8) ** 2)) / 8) AS sd FROM m),
u AS (SELECT attempt_idx, unnest(range(8)) AS j, unnest(m) AS x, unnest(list_concat([NULL], m[1:7])) AS y, mu, sd FROM e),
c AS (SELECT attempt_idx, coalesce(min(j) FILTER (WHERE x > mu + sd), arg_max(j, struct_pack(a := x - y, b := -j)) FILTER (WHERE y IS NOT NULL)) AS j FROM u GROUP BY attempt_idx)
SELECT attempt_idx, greatest(2, least(5, j))::BIGINT * 8 AS anchor_len FROM c""")
def _(s, d):
    bounds = F.array(*[F.lit(8 * k) for k in range(1, 9)])
    rows = X.logprobs(s, d).select("attempt_idx", bounds.alias("bounds"), A.step_means("token_logprobs", bounds).alias("step_means"))
    return flows.anchored(rows, "privileged_divergence", {"min_steps": 2, "max_step": 5}).select("attempt_idx", F.col("anchor_len").cast("bigint").alias("anchor_len"))


@query("gold_of_unsolved", f"WITH {X.R}, {U}, z AS (SELECT qid, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS gold_solution FROM u LEFT JOIN orders ON o_orderkey = qid) SELECT qid, gold_solution, (SELECT count(*) FROM z WHERE gold_solution IS NULL) AS n_missing FROM z WHERE gold_solution IS NOT NULL")
def _(s, d):
    gold = X.questions(s, d).select("qid", F.when(F.col("final_answer") == "P", " ").otherwise(F.col("domain")).alias("gold_solution"))
    kept, missing = flows.with_gold(unsolved(s, d).select("qid"), gold)
    return kept.select("qid", "gold_solution", F.lit(missing).cast("bigint").alias("n_missing"))


@query("unscored_last", f"WITH {X.R} SELECT qid, sample_idx FROM r LEFT JOIN (SELECT l_orderkey AS qid, max(l_tax) AS t FROM lineitem WHERE l_discount > 0.03 GROUP BY 1) z USING (qid) QUALIFY row_number() OVER (PARTITION BY sample_idx ORDER BY t NULLS LAST, qid) <= 3")
def _(s, d):
    score = read_table(s, d, "lineitem").where("l_discount > 0.03").groupBy(F.col("l_orderkey").alias("qid")).agg(F.max("l_tax").alias("t"))
    rows = X.rollouts(s, d).select("qid", F.col("sample_idx").cast("bigint").alias("sample_idx"))
    return K.keep_k(flows.with_rank_score(rows, score, ["qid"], "t"), ["sample_idx"], ["t", "qid"], 3).select("qid", "sample_idx")


@query("judged_rows", f"WITH {X.C()} SELECT qid, CASE WHEN n_total > 4000 THEN 'length' WHEN external_context = 'toxic' THEN 'leak_judge' END AS reject_reason, count(*) AS n FROM c GROUP BY ALL")
def _(s, d):
    c = X.candidates(s, d).withColumn("reject_reason", F.when(F.col("n_total") > 4000, "length"))
    verdicts = read_table(s, d, "labels").select(F.col("doc_id").alias("attempt_idx"), (F.col("toxic") == 1).alias("leaks"))
    return flows.judged(c, verdicts, ["attempt_idx"]).groupBy("qid", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("questions_of_candidates", f"WITH {X.R}, {U} SELECT qid, sample_idx, failed FROM r JOIN u USING (qid)")
def _(s, d):
    r = X.rollouts(s, d).select("qid", F.col("sample_idx").cast("bigint").alias("sample_idx"))
    return flows.with_question(r, unsolved(s, d), ["failed"])


@query("regenerated_targets", f"WITH {X.L} SELECT attempt_idx, CASE WHEN attempt_idx % 3 = 0 THEN 5 ELSE len(token_logprobs) END::BIGINT AS n FROM l")
def _(s, d):
    a = X.logprobs(s, d).select("attempt_idx", F.col("token_logprobs").alias("target"))
    new = a.where("attempt_idx % 3 <> 2").select("attempt_idx", F.slice("target", F.lit(1), F.when(F.col("attempt_idx") % 3 == 0, 5).otherwise(0)).alias("target"))
    return flows.with_regenerated(a, new, ["attempt_idx"], "target").select("attempt_idx", F.size("target").cast("bigint").alias("n"))


@query("retry_set", f"WITH {X.R}, {U} SELECT qid FROM u WHERE qid NOT IN (SELECT qid FROM r WHERE correct)")
def _(s, d):
    return flows.pending(unsolved(s, d), X.rollouts(s, d).where("correct"), ["qid"]).select("qid")


@query("training_rows", "SELECT source, stage, count(*) AS n FROM (SELECT 'solved' AS source, NULL AS stage FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'improved', o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY ALL")
def _(s, d):
    o = read_table(s, d, "orders")
    rows = flows.training_table(o.where("o_orderstatus = 'F'").select("o_orderkey"), flows.final_stage(o.select("o_orderkey", F.col("o_orderpriority").alias("stage")), "1-URGENT"))
    return rows.groupBy("source", "stage").agg(F.count(F.lit(1)).alias("n"))


@query("merge_membership", "SELECT count(*) AS n_merged, count(*) FILTER (WHERE c_custkey % 2 = 0) AS n_old, count(*) FILTER (WHERE c_custkey % 3 = 0) AS n_new FROM customer")
def _(s, d):
    c = read_table(s, d, "customer")
    return flows.membership(c, c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0"), ["c_custkey"])


@query("trainable_rows", "SELECT doc_id, n_chars FROM documents WHERE n_chars <= 2000")
def _(s, d):
    rows = read_table(s, d, "documents").select("doc_id", "n_chars", F.lit(" ").alias("reasoning"))
    return flows.ordered(flows.without_empty(flows.within_length(rows, F.col("n_chars"), 2000), "reasoning"), "n_chars", "doc_id")


@query("alpha_star_histogram", f"WITH {X.A}, z AS (SELECT qid, coalesce(min(alpha) FILTER (WHERE p_hat >= 0.5), 1.0) AS alpha_star FROM p GROUP BY qid) SELECT round(alpha_star, 8) AS alpha_star, count(*) AS n FROM z WHERE qid IN (SELECT qid FROM a WHERE correct) GROUP BY ALL")
def _(s, d):
    stars = G.alpha_star(G.alpha_curve(X.alphas(s, d)), 0.5)
    return r8(G.alpha_star_histogram(stars, X.alphas(s, d).where("correct")), "alpha_star")


@query("joined_class_counts", f"WITH {X.S} SELECT {CLS} AS difficulty, count(*) AS n FROM q JOIN orders ON o_orderkey = qid GROUP BY 1")
def _(s, d):
    q = stats(s, d).select("qid", F.when(F.col("c") >= 3, "solved").when(F.col("c") >= 1, "frontier").otherwise("cliff").alias("difficulty"))
    return G.class_counts(q.join(X.questions(s, d), "qid"))


@query("four_digit_report", "SELECT l_returnflag, round(avg(l_extendedprice * l_discount), 4) AS mean FROM lineitem GROUP BY l_returnflag")
def _(s, d):
    return flows.four_digits(read_table(s, d, "lineitem").groupBy("l_returnflag").agg(F.avg(F.col("l_extendedprice") * F.col("l_discount")).alias("mean")), "mean")


@query("refit_round", f"WITH {X.R}, f AS (SELECT qid FROM r GROUP BY qid HAVING count(*) FILTER (WHERE correct AND sample_idx < 2) = 0), c AS (SELECT r.qid, sample_idx, correct, f.qid IS NOT NULL AS refit FROM r LEFT JOIN f USING (qid) WHERE (f.qid IS NULL AND sample_idx < 2) OR (f.qid IS NOT NULL AND sample_idx >= 2)) SELECT qid, sample_idx, refit FROM c WHERE correct QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sample_idx) = 1")
def _(s, d):
    r = X.rollouts(s, d).select("qid", F.col("sample_idx").cast("bigint").alias("sample_idx"), "correct")
    asked = r.select("qid").distinct()
    propose = lambda u: r.join(u, "qid").where(F.when(F.col("refit"), F.col("sample_idx") >= 2).otherwise(F.col("sample_idx") < 2))
    gate = lambda c: gates.run_gates(c, ["correctness"], {}, ["sample_idx"])
    return flows.improve(asked, "refit", propose, gate, ["sample_idx"], 1, passes=1).select("qid", "sample_idx", "refit")
