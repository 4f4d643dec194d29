"""Values that fix the meaning of functions, aggregates, gates and rankings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quern import seams
from quern.functions import arrays as A
from quern.functions import predicates as P
from quern.functions import text as T
from quern.operators import aggregates as G
from quern.operators import gates, joins
from quern.operators import ranking as K
from quern.plans import runs
from quern.registry import Registry
from quern.sources import tables as S


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def arr(values, kind="double"):
    return F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>")


@pytest.mark.parametrize("values,f,want", [(range(1, 11), 0.1, 10), ([1, 3, 2], 0.5, 2.5), ([5], 0.3, 5), ([2, 4, 6], 1, 4), ([2, 2, 2], 0.5, 2), ([], 0.5, None)])
def test_cvar(spark, values, f, want):
    assert one(spark, A.cvar(arr(values), f)) == want


def test_boxed(spark):
    rows = [("\\boxed{42}", "42"), ("a \\boxed{\\frac{1}{2}} b", "\\frac{1}{2}"), ("\\boxed{1} and \\boxed{2}", "2"), ("none", None), ("\\boxed{1} \\boxed{open {", None), ("\\boxed{}", "")]
    got = spark.createDataFrame(rows, "t string, want string").select(T.last_boxed("t").alias("v"), "want").collect()
    assert [r.v for r in got] == [r.want for r in got]
    assert [seams.boxed(t) for t, _ in rows] == [w for _, w in rows]


def test_text(spark):
    assert one(spark, T.clean_solution(F.lit("a</think>b</think> c "))) == ("c", True)
    assert one(spark, T.clean_solution(F.lit(" plain "))) == ("plain", False)
    assert one(spark, T.normalize_answer(F.lit(" $ A b$ "))) == "ab"
    assert one(spark, T.collapse_spaces(F.lit(" a \n\u00a0 b "))) == "a b"
    assert one(spark, T.last_code_block(F.lit("x```lean\none```y```lean\n two ```z"))) == "two"
    assert one(spark, T.ensure_boxed(F.lit(" 3/4 "))) == "\\boxed{3/4}"
    assert one(spark, T.dollar_wrap(F.lit(" x "))) == "$x$" and one(spark, T.dollar_wrap(F.lit("$x$"))) == "$x$"
    assert one(spark, T.namespaced(F.lit("q"))) == "bench-q"
    assert one(spark, T.render_question(F.lit("Q"), "<{question}|{gold}>", gold=F.lit("G"))) == "<Q|G>"
    assert [one(spark, T.format_alpha(F.lit(x))) for x in (1.0, 0.5, 0.05)] == ["1", "0.5", "0.05"]
    import hashlib

    assert one(spark, T.stable_hash(7, T.quoted(F.lit("é")))) == hashlib.sha256(b"7\0'\xc3\xa9'\0").hexdigest()[:16]


def test_pass_at_k(spark):
    for n in (1, 4, 7):
        for c in range(n + 1):
            for k in range(1, n + 1):
                want = 1 - math.comb(n - c, k) / math.comb(n, k) if n - c >= k else 1.0
                assert one(spark, A.pass_at_k(F.lit(n), F.lit(c), k)) == pytest.approx(want)
    assert one(spark, A.k_ladder(F.lit(6))) == [1, 2, 4, 6] and one(spark, A.k_ladder(F.lit(4))) == [1, 2, 4]


@pytest.mark.parametrize(
    "pieces,want",
    [
        (["a", "b\n\n", "c", "d\n\n", "e", "f"], [2, 4, 6]),
        (["a", "b\n", "\nc", "d", "e\n\n", "f"], [3, 5, 6]),
        (["a", "\n\n", "\n\n", "b"], [2, 4]),
        (["a", "b\n\n", "c", "\n\n"], [2, 4]),
        (["One", ".", " Two", ". ", "Three", "!"], [2, 4, 6]),
        (["a"], [1]),
        ([], []),
    ],
)
def test_steps(spark, pieces, want):
    assert one(spark, A.step_bounds(arr(pieces, "string"))) == want


def test_array_functions(spark):
    assert one(spark, A.step_means(arr([1, None, 4, 4]), arr([2, 4], "int"))) == [1, 4]
    assert one(spark, A.step_means(arr([None, None, 2]), arr([2, 3], "int"))) == [0, 2]
    assert [one(spark, A.fixed_fraction(F.lit(n), f, lo, hi)) for n, f, lo, hi in ((1000, 0.3, 32, 2048), (50, 0.3, 32, 2048), (10, 0.3, 32, 2048), (10000, 0.3, 32, 2048))] == [300, 32, 10, 2048]
    assert one(spark, A.ensure_end(arr([1, 2], "int"), 2)) == [1, 2] and one(spark, A.ensure_end(arr([], "int"), 2)) == [2]
    assert one(spark, A.suffix(arr([1, 2, 3], "int"), 2)) == [3] and one(spark, A.suffix(arr([1], "int"), 4)) == []
    assert one(spark, A.first_crossing(arr([0, 0, 0, 9]), 1.0)) == (3, True)
    assert one(spark, A.first_crossing(arr([1, 1.1, 1.5, 1.4]), 9.0)) == (2, False)
    assert one(spark, A.region_weights(F.lit(2), F.lit(1), F.lit(2))) == [0, 0, 0, 1, 1]
    same = F.create_map(F.lit("a"), F.lit(-1.0), F.lit("b"), F.lit(-2.0))
    assert one(spark, A.union_kl(same, same, -20.0)) == pytest.approx(0)
    assert one(spark, A.union_kl(same, F.create_map(F.lit("a"), F.lit(-2.0), F.lit("b"), F.lit(-0.1)), -20.0)) > 0.5
    s = one(spark, A.tail_score(arr([-0.1] * 9 + [-3.0]), None, 0.1, 1.0, 0.0))
    assert s["c"] == pytest.approx(3.39) and s["d_tail"] is None
    s = one(spark, A.tail_score(arr([-0.1]), arr([-0.05]), 0.1, 1.0, 1.0))
    assert s["d_tail"] == pytest.approx(0.05)
    assert one(spark, A.tail_score(arr([]), None, 0.1, 1.0, 0.0))["c"] is None
    assert one(spark, A.pad_right(arr([1], "int"), 3, 0)) == [1, 0, 0]


def test_gates(spark):
    rows = [(1, "the given solution says", True, None, 1), (2, "clean", True, None, 1), (3, "clean", True, None, 1), (4, "clean", None, None, 1), (5, "참고 풀이", True, None, 1), (6, "x", True, "ctx", 1), (7, "long", True, None, 99), (8, "was given 5 candies", False, None, 1)]
    df = spark.createDataFrame([("q", *r) for r in rows], "qid string, attempt_idx long, continuation_text string, correct boolean, external_context string, n long")
    out = gates.run_gates(df, ["correctness", "no_external_context", "length", "dedup", "leakage_rules"], {"max_total_len": 10, "length_column": "n"}, ["attempt_idx"], ["continuation_text"])
    got = {r.attempt_idx: r.reject_key for r in out.collect()}
    assert got == {1: "leakage_rules:pattern", 2: None, 3: "dedup:duplicate", 4: "correctness:ungraded", 5: "leakage_rules:pattern", 6: "no_external_context:external_context", 7: "length:too_long", 8: "correctness:incorrect"}
    with pytest.raises(KeyError):
        gates.run_gates(df, ["nope"], {}, ["attempt_idx"])


def test_cliff_and_alpha(spark):
    unsolved = spark.createDataFrame([(k,) for k in range(3)], "qid long")
    cand = spark.createDataFrame([(0, True), (0, True), (1, False), (2, False), (2, None)], "qid long, correct boolean")
    r = G.cliff_stats(unsolved, cand, 10).first()
    assert (r["count"], r["ratio"], [tuple(h) for h in r["histogram"]]) == (3, 0.3, [(0, 2), (2, 1)])
    assert G.cliff_stats(unsolved.limit(0), cand).first()["count"] == 0
    curve = spark.createDataFrame([(1, 0.05, 0.0), (1, 0.1, 0.3), (1, 1.0, 0.5), (2, 0.5, 0.25), (2, 1.0, 1.0), (3, 0.5, 0.1), (3, 1.0, 0.2)], "qid long, alpha double, p_hat double")
    assert {r.qid: r.alpha_star for r in G.alpha_star(curve, 0.25).collect()} == {1: 0.1, 2: 0.5, 3: 1.0}


def test_rankings(spark):
    df = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "b"), (2, 0, 1, "c")], "k long, g long, o long, v string")
    assert {r.k: (r.v, tuple(r.position)) for r in K.last_wins(df, ["k"], "g", "o").collect()} == {1: ("b", (0, 0)), 2: ("c", (0, 1))}
    n = spark.range(5).withColumn("len", F.lit(1))
    assert {r.id: r.nxt for r in K.cyclic_neighbour(n, ["len", "id"], "id", "nxt").collect()} == {0: 1, 1: 2, 2: 3, 3: 4, 4: 0}
    assert K.cyclic_neighbour(n.limit(1), ["id"], "id", "nxt").count() == 0
    assert [sorted(r.chunk for r in K.chunks(n, "id", s).collect()) for s in (2, 10)] == [[0, 0, 1, 1, 2], [0] * 5]
    train, held = K.holdout_split(n, 2, 3, F.col("id").cast("string"), "id")
    assert held.count() == 2 and train.count() == 3 and K.holdout_split(n, 0, 3, F.col("id").cast("string"), "id")[1].count() == 0
    z = one(spark, K.plateau(arr([0.1, 0.2, 0.2, 0.2, 0.2]), 1, 2, 0.0))
    assert (z["best"], z["stop_at"]) == (0.2, 3)


def test_joins(spark):
    a, b = spark.range(4).withColumnRenamed("id", "k"), spark.range(1, 5).withColumnRenamed("id", "k")
    assert {(r.k, r.side) for r in joins.key_differences(a, b, ["k"]).collect()} == {(0, "left"), (4, "right")}
    with pytest.raises(joins.KeyMismatch):
        joins.require_same_keys(a, b, ["k"])
    with pytest.raises(ValueError):
        joins.require_equal(a, F.col("k"), F.lit(1), "test")
    assert joins.flagged(a, b, ["k"], "f").where("f").count() == 3


def test_majority(spark):
    df = spark.createDataFrame([("q", k, x) for k, x in enumerate(["\\frac{1}{2}", "1/2", "3", "3", "4"])] + [("z", 0, None)], "qid string, sample_idx int, extracted string")
    assert [tuple(r) for r in seams.majority_equivalent(df).collect()] == [("q", "\\frac{1}{2}", 2)]
    assert [tuple(r) for r in G.majority_vote(df, F.col("extracted")).collect()] == [("q", "3", 2)]


def test_verifiers(spark):
    df = spark.createDataFrame([("1/2", "so \\boxed{0.5}"), ("2", "no box 2"), ("A", "\\boxed{$a$}"), (None, None)], "g string, t string")
    assert [r.verdict.correct for r in seams.verdict(df, "math_strict", "g", "t").collect()] == [True, False, True, False]
    assert [r.reward for r in seams.reward(df.withColumn("a", F.lit(None).cast("string")), "math_strict", "g", "a", "t").collect()] == [1.0, 0.0, 1.0, 0.0]


def test_model_seam(spark):
    req = spark.createDataFrame([(f"r{k}", k) for k in range(10)], "rid string, x long")
    out = seams.run_model(req, lambda b: b.assign(y=b["x"] * 2)[["rid", "y"]], "rid string, y long", 3)
    assert sorted(r.y for r in seams.complete(req, out).collect()) == list(range(0, 20, 2))
    with pytest.raises(joins.KeyMismatch):
        seams.run_model(req.unionAll(req), lambda b: b, "rid string, x long")


def test_ingest(spark):
    rows = [(0, "p", "Yes", [True]), (1, "p2", "No", [True]), (2, "p3", "B", [True]), (3, "p4", "\\text{True}", [True]), (4, "p5", "e", [True]), (5, "p6", "927", [True]), (6, "p7", "1", [False]), (7, "", "1", [True]), (8, "p5", "e", [True])]
    raw = spark.createDataFrame(rows, "row_idx long, problem string, answer string, verified array<boolean>")
    got = S.ADAPTERS["general"](raw, {"exclude_answer_regex": S.PRESETS["deepmath"]["exclude_answer_regex"], "require_any_true": ["verified"]})
    assert {r.reason: r.n for r in got.drops().collect()} == {"answer_regex": 4, "any_true:verified": 1, "empty": 1, "kept": 3}
    assert sorted((r.row_idx, r.final_answer) for r in got.questions.collect()) == [(4, "e"), (5, "927")]
    with pytest.raises(ValueError):
        S.ADAPTERS["general"](raw, {"where": {"absent": ["x"]}})
    a = {r.qid for r in S.ADAPTERS["general"](raw, {"n": 2, "seed": 7}).questions.collect()}
    assert a == {r.qid for r in S.ADAPTERS["general"](raw.orderBy(F.desc("row_idx")), {"n": 2, "seed": 7}).questions.collect()}
    assert S.expand_preset({"preset": "openr1", "where": {}})["where"] == {}


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("q1", "é?", "2", None, None)], "qid string, question string, final_answer string, domain string, meta map<string,string>")
    assert S.write_jsonl(df, f"file://{tmp_path}/q") == 1
    back = S.read_jsonl(spark, f"file://{tmp_path}/q", "question").collect()
    assert back[0].domain == "math" and back[0].question == "é?"


def test_predicates(spark):
    df = spark.createDataFrame([(True, "stop", [True, False]), (False, "length", []), (None, "other", None)], "b boolean, finish_reason string, a array<boolean>")
    got = df.select(P.listed(df, "b", ["True"]).alias("l"), P.any_true(df, "a").alias("t"), P.stopped().alias("s"), P.not_truncated().alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, True, True, True), (False, False, False, False), (False, False, False, True)]
    assert one(spark, P.token_budget(F.lit(10), 16, 4)) == 4 and one(spark, P.token_budget(F.lit(16), 16, 4)) is None


def test_runs(tmp_path):
    c = runs.load_config({"samples": "4"}, {"filter.per_question": 2})
    assert c.samples == 4 and c.filter.per_question == 2
    with pytest.raises(ValueError):
        runs.load_config({"nope": 1})
    ran = []
    stages = [("a", lambda p, k: ran.append(k) or p.write_text("x") or 1)]
    assert runs.loop(c, tmp_path, stages) == ["0/a"] and runs.loop(c, tmp_path, stages) == [] and ran == [0]
    with pytest.raises(ValueError):
        runs.loop(runs.load_config({"samples": 5}), tmp_path, stages)
    assert runs.route_metrics({"a": 1, "b": [1, 2], "c": True})["summary"] == {"c": True}
    with pytest.raises(ValueError):
        runs.exactly_one(a=1, b=2)
    with pytest.raises(ValueError):
        runs.batch_shape(3, 2, 1, 1)


def test_registry():
    r = Registry("thing")
    r.register("a")(1)
    with pytest.raises(ValueError):
        r.register("a")(2)
    with pytest.raises(KeyError, match="known"):
        r["b"]


def test_streaming(spark, tmp_path):
    from quern.streaming.pass_rate import windowed_pass_rate, write_metrics

    rows = [("q", k, k % 2 == 0, "stop", f"2024-01-01 00:{k:02d}:00") for k in range(20)] + [("q", 99, True, "stop", "2024-01-01 03:00:00")]
    spark.createDataFrame(rows, "qid string, sample_idx int, correct boolean, finish_reason string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("qid string, sample_idx int, correct boolean, finish_reason string, ts timestamp").parquet(f"{tmp_path}/in")
    write_metrics(windowed_pass_rate(stream, "10 minutes", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert sorted((r.n, r.c) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(10, 5), (10, 5)]


def test_cyclic_neighbour_without_one_task(spark):
    n = spark.createDataFrame([(i, i * 7 % 100, None if i == 50 else i) for i in range(100)], "id long, at long, value long")
    out = K.cyclic_neighbour(n, ["at", "id"], "value", "nxt")
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    ids = [r.id for r in n.orderBy("at", "id").collect()]
    assert {r.id: r.nxt for r in out.collect()} == {a: None if b == 50 else b for a, b in zip(ids, ids[1:] + ids[:1])}


@pytest.mark.parametrize(
    "rewards,window,patience,gain,want",
    [
        ([0.1, 0.3, 0.3, 0.305], 1, 2, 0.01, (0.3, 2, 3)),
        ([1.0], 1, 3, 0.01, (None, 0, 0)),
        ([0.1, 1.0, 0.2], 3, 3, 0.0, (None, 0, 1)),
        ([0.5, 0.1, 0.1, 0.1], 3, 2, 0.0, (0.7 / 3, 1, -1)),
        ([], 2, 1, 0.0, (None, 0, -1)),
    ],
)
def test_plateau(spark, rewards, window, patience, gain, want):
    z = one(spark, K.plateau(arr(rewards), window, patience, gain))
    assert (z["best"] if want[0] is None else pytest.approx(z["best"])) == want[0] and (z["stale"], z["stop_at"]) == want[1:]


def test_quoted_is_repr(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab'\"\\\n\r\t\x00\x1b\x7f\xa0\xad é漢\u200b\u2028\u3000🙂\U000e0001$") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts += [r"\frac{1}{2}", "it's", 'say "it\'s"', ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.quoted("t").alias("q")).collect()
    for r in got:
        assert r.q == repr(r.t)


def test_very_small_probabilities(spark):
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    assert one(spark, A.union_kl(m({"a": -0.1, "b": -900.0}), m({"a": -0.1, "c": -900.0}), -950.0)) == pytest.approx(0)
    assert one(spark, A.union_kl(m({"a": -900.0}), m({"a": -900.0}), -900.0)) == pytest.approx(0)
    p, q = {"a": math.log(0.9), "b": math.log(0.1)}, {"a": math.log(0.5), "b": math.log(0.5)}
    assert one(spark, A.union_kl(m(p), m(q), -20.0)) == pytest.approx(0.9 * math.log(1.8) + 0.1 * math.log(0.2))


def test_nulls_never_win_and_lookups_never_multiply(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 0.5), (1, 3, 0.1)], "qid long, attempt_idx long, c double")
    assert [r.attempt_idx for r in K.keep_k(df, ["qid"], ["c", "attempt_idx"], 2).orderBy("attempt_idx").collect()] == [2, 3]
    assert not one(spark, P.mean_at_least(F.lit(None).cast("array<double>"), -5)) and one(spark, P.mean_at_least(arr([-1.0, None]), -5))
    left = spark.createDataFrame([(1, "x")], "k long, t string")
    twice = spark.createDataFrame([(1, "b"), (1, "a")], "k long, v string")
    assert [r.v for r in joins.with_fallback(left, twice, spark.createDataFrame([("x", "z")], "t string, v string"), ["k"], ["t"], "v").collect()] == ["a"]


def test_ungraded_rows_are_graded_lazily(spark):
    rows = [(1, 0, "5", "", "\\boxed{5}", None), (1, 1, "5", "", "\\boxed{6}", None), (1, 2, "5", "", "never read", True)]
    df = spark.createDataFrame(rows, "qid long, attempt_idx long, gold string, anchor_text string, continuation_text string, correct boolean")
    out = gates.run_gates(df, ["correctness"], {}, ["attempt_idx"], grade=seams.graded("math_strict", "gold"))
    assert {r.attempt_idx: r.reject_key for r in out.collect()} == {0: None, 1: "correctness:incorrect", 2: None}
    assert seams.as_number("1e999999999") is None and seams.as_number("1e3") == 1000


def test_refit_rows_replace_also_where_they_gave_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "q long, v string")
    new = spark.createDataFrame([(2, "B")], "q long, v string")
    redone = spark.createDataFrame([(2,), (3,)], "q long")
    assert sorted(map(tuple, joins.replaced(old, new, ["q"], redone).collect())) == [(1, "a"), (2, "B")]
