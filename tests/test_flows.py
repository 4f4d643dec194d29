"""Tables of an improvement round on small hand-written cases."""

import pytest
from pyspark.sql import functions as F

from quern.operators import flows, gates
from quern.operators.joins import KeyMismatch
from quern.sources import tables as S


def test_verdicts_are_one_for_one(spark):
    r = spark.createDataFrame([(1, 0), (1, 1)], "qid long, sample_idx long")
    ok = spark.createDataFrame([(1, 0, True), (1, 1, False)], "qid long, sample_idx long, correct boolean")
    assert flows.with_verdicts(r, ok).count() == 2
    for bad in (ok.limit(1), ok.unionByName(ok)):
        with pytest.raises(KeyMismatch):
            flows.with_verdicts(r, bad)


def test_anchor_policies(spark):
    rows = spark.createDataFrame([(1, 1000, [0.0, 0.0, 9.0, 0.0], [3, 6, 9, 12]), (2, 10, [1.0, 1.0], [5, 10]), (3, 40, [1.0, 2.0, 5.0, 5.5], [4, 8, 12, 16])], "qid long, n_tokens int, step_means array<double>, bounds array<int>")
    got = {p: {r.qid: r.anchor_len for r in flows.anchored(rows, p).collect()} for p in flows.ANCHOR_POLICIES.names()}
    assert got == {"fixed_fraction": {1: 300, 2: 10, 3: 32}, "none": {1: 0, 2: 0, 3: 0}, "privileged_divergence": {1: 6, 2: 0, 3: 12}}
    with pytest.raises(KeyError):
        flows.anchored(rows, "nothing")


def test_gold_is_counted_and_needed(spark):
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    kept, missing = flows.with_gold(q, spark.createDataFrame([(1, "g"), (2, " ")], "qid long, gold_solution string"))
    assert ([r.qid for r in kept.collect()], missing) == ([1], 1)
    with pytest.raises(KeyMismatch):
        flows.with_gold(q, spark.createDataFrame([], "qid long, gold_solution string"))


def test_rounds_see_what_is_pending(spark):
    unsolved = spark.createDataFrame([(1, 5), (2, 0), (3, 4)], "qid long, anchor_len int")
    answers = spark.createDataFrame([(1, 0, False), (1, 1, True), (2, 0, True), (3, 0, False)], "qid long, sample_idx long, correct boolean")
    gate = lambda c: gates.run_gates(c, ["correctness"], {}, ["sample_idx"])
    seen = []

    def propose(u):
        seen.append(sorted(r.qid for r in u.collect()))
        return u.join(answers, "qid")

    out = flows.improve(unsolved, "prefix_continue", propose, gate, ["sample_idx"], 1)
    assert [(r.qid, r.sample_idx, r["pass"]) for r in out.collect()] == [(1, 1, 0)] and seen == [[1, 3], [3]]
    again = flows.improve(unsolved, "resample", propose, gate, ["sample_idx"], 1, passes=1)
    assert sorted(r.qid for r in again.collect()) == [1, 2]


def test_small_steps(spark):
    df = spark.createDataFrame([(1, "a", 0.123456), (2, " ", None)], "k long, t string, x double")
    assert "t" in flows.without_empty(df, "t").columns and "t" not in flows.without_empty(df.where("k = 2"), "t").columns
    assert [r.x for r in flows.four_digits(df, "x").orderBy("k").collect()] == [0.1235, None]
    with pytest.raises(ValueError):
        flows.within_length(df, F.col("k"), 0)
    assert [r.k for r in flows.ordered(df, "x", "k").collect()] == [1, 2]
    assert flows.within_length(df.where("false"), F.col("k"), 0).count() == 0


def test_benchmark_resolution(spark):
    assert S.resolve_benchmark({"name": "math500_hard", "adapter_args": {"min_level": 4}}) == ("benchmark", {"name": "math500_hard", "hf_name": "HuggingFaceH4/MATH-500", "split": "test", "min_level": 4})
    assert S.resolve_benchmark({"name": "own", "adapter": "local_jsonl"}) == ("local_jsonl", {"name": "own"})
    with pytest.raises(KeyError):
        S.resolve_benchmark({"name": "unknown"})
    raw = spark.createDataFrame([("q1", "What?", "1", 0)], "qid string, question string, final_answer string, row_idx long")
    assert [r.qid for r in S.benchmark_questions(raw, {"name": "own", "adapter": "local_jsonl"}).collect()] == ["bench-own-q1"]
