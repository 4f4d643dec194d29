"""Functions of arrays (token ids, log probabilities, steps) as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def known(a: Column | str) -> Column:
    """The elements that aren't null."""
    return F.filter(_c(a), lambda x: x.isNotNull())


def mean(a: Column | str) -> Column:
    """Mean of the known elements; null without any."""
    k = known(a)
    return F.when(F.size(k) > 0, _sum(k.cast("array<double>")) / F.size(k))


def cvar(values: Column | str, fraction: float) -> Column:
    """Mean of the largest max(1, ceil(fraction * n)) values; null for an empty array."""
    a = F.sort_array(known(values).cast("array<double>"), asc=False)
    k = F.greatest(F.lit(1), F.ceil(F.lit(float(fraction)) * F.size(a)).cast("int"))
    return F.when(F.size(a) > 0, _sum(F.slice(a, F.lit(1), k)) / k)


def pass_at_k(n: Column | str, c: Column | str, k: int | Column) -> Column:
    """1 - C(n-c, k) / C(n, k) without big numbers; 1 where fewer than k samples are wrong."""
    n, c, k = _c(n).cast("int"), _c(c).cast("int"), k if isinstance(k, Column) else F.lit(k)
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda p, i: p * (1 - k / i))
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(1 - product)


def k_ladder(least: Column | str) -> Column:
    """Powers of two up to ``least``, and ``least`` itself."""
    n = _c(least).cast("int")
    powers = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda e: F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), e).cast("int")), lambda p: p <= n)
    return F.array_distinct(F.concat(powers, F.array(n)))


def ensure_end(ids: Column | str, end: int) -> Column:
    """Appends the end id unless it is there."""
    a = _c(ids)
    return F.when(F.coalesce(F.try_element_at(a, F.lit(-1)) == end, F.lit(False)), a).otherwise(F.concat(a, F.array(F.lit(end))))


def prefix(ids: Column | str, n: Column | int) -> Column:
    return F.slice(_c(ids), F.lit(1), n if isinstance(n, Column) else F.lit(n))


def suffix(ids: Column | str, n: Column | int) -> Column:
    """What follows the first ``n`` elements."""
    a = _c(ids)
    n = n if isinstance(n, Column) else F.lit(n)
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def training_pair(prompt: Column | str, anchor: Column | str, continuation: Column | str, end: int) -> Column:
    """struct<input_ids, prompt_len, anchor_len, completion_len>; lengths sum to the size of input_ids."""
    p, a, c = _c(prompt), F.coalesce(_c(anchor), F.array().cast("array<int>")), ensure_end(continuation, end)
    return F.struct(F.concat(p, a, c).alias("input_ids"), F.size(p).alias("prompt_len"), F.size(a).alias("anchor_len"), F.size(c).alias("completion_len"))


def region_weights(prompt_len: Column | str, anchor_len: Column | str, completion_len: Column | str, weights: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> Column:
    """One weight for each token by region."""
    return F.concat(*[F.array_repeat(F.lit(float(w)), _c(n).cast("int")) for w, n in zip(weights, (prompt_len, anchor_len, completion_len))])


def weight_total(prompt_len: Column | str, anchor_len: Column | str, completion_len: Column | str, weights: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> Column:
    """Sum of the weights after the shift by one position: the first token predicts nothing."""
    p, a, c = _c(prompt_len), _c(anchor_len), _c(completion_len)
    first = F.when(p > 0, weights[0]).when(a > 0, weights[1]).when(c > 0, weights[2]).otherwise(0.0)
    return p * weights[0] + a * weights[1] + c * weights[2] - first


def pad_right(ids: Column | str, length: int, value: int) -> Column:
    a = _c(ids)
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(a), F.lit(0))))


def sequence_score(logprobs: Column | str, score_from: Column | int = 0) -> Column:
    """struct<total, mean, n> over known log probabilities from position max(1, score_from); the first position has none."""
    start = F.greatest(F.lit(1), score_from if isinstance(score_from, Column) else F.lit(score_from))
    part = known(suffix(logprobs, start)).cast("array<double>")
    n = F.size(part)
    return F.struct(_sum(part).alias("total"), F.when(n > 0, _sum(part) / n).alias("mean"), n.alias("n"))


def paired(a: Column | str, b: Column | str) -> Column:
    """array<struct<a, b>> of positions where both are known, up to the shorter one."""
    return F.filter(F.zip_with(_c(a), _c(b), lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda p: p["a"].isNotNull() & p["b"].isNotNull())


def tail_score(student: Column | str, reference: Column | str | None, fraction: float, tail: float, divergence: float) -> Column:
    """struct<s_mean, s_tail, d_tail, c>: mean and tail of the surprise, tail of the log ratio, and their weighted sum.

    All null where nothing can be scored; d_tail is null without a reference and then counts as 0.
    """
    surprise = F.transform(known(student).cast("array<double>"), lambda x: -x)
    s_mean, s_tail = mean(surprise), cvar(surprise, fraction)
    d_tail = cvar(F.transform(paired(reference, student), lambda p: p["a"].cast("double") - p["b"]), fraction) if reference is not None else F.lit(None).cast("double")
    c = s_mean + F.lit(float(tail)) * s_tail + F.coalesce(F.lit(float(divergence)) * d_tail, F.lit(0.0))
    return F.struct(s_mean.alias("s_mean"), s_tail.alias("s_tail"), d_tail.alias("d_tail"), c.alias("c"))


def step_means(signal: Column | str, bounds: Column | str) -> Column:
    """Mean of the known signal in each step (ends exclusive); an empty step has 0."""
    g, b = _c(signal), _c(bounds)
    return F.transform(b, lambda end, i: F.coalesce(mean(F.slice(g, F.when(i == 0, 0).otherwise(F.get(b, i - 1)) + 1, F.greatest(end - F.when(i == 0, 0).otherwise(F.get(b, i - 1)), F.lit(0)))), F.lit(0.0)))


def first_crossing(means: Column | str, sigmas: float) -> Column:
    """struct<j, crossed>: the first step whose mean exceeds mean + sigmas * population deviation, else the largest rise (first of equals)."""
    m = _c(means).cast("array<double>")
    sums = F.aggregate(m, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("xx")), lambda s, x: F.struct((s["x"] + x).alias("x"), (s["xx"] + x * x).alias("xx")))

    def crossing(z: Column) -> Column:
        m, n, mu = z["m"], F.size(z["m"]), z["mu"]
        places = F.transform(m, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        over = F.filter(places, lambda p: p["x"] > mu + F.lit(float(sigmas)) * z["sd"])
        rises = F.transform(F.slice(places, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda p: F.struct((p["x"] - F.get(m, p["i"] - 1)).alias("rise"), (-p["i"]).alias("i")))
        return F.struct(F.coalesce(F.get(over, F.lit(0))["i"], -F.array_max(rises)["i"]).alias("j"), (F.size(over) > 0).alias("crossed"))

    def moments(z: Column) -> Column:
        mu = z["s"]["x"] / F.size(z["m"])
        return F.struct(z["m"].alias("m"), mu.alias("mu"), F.sqrt(F.greatest(z["s"]["xx"] / F.size(z["m"]) - mu * mu, F.lit(0.0))).alias("sd"))

    # One-element arrays bind what is used several times, so it is computed once.
    bound = F.transform(F.array(F.struct(m.alias("m"), sums.alias("s"))), moments)
    return F.when(F.size(m) > 0, F.get(F.transform(bound, crossing), F.lit(0)))


def boundary(bounds: Column | str, j: Column, least: int, most: int) -> Column:
    """The token length before step ``j``, held between the bounds of ``least`` and ``most`` steps."""
    b = _c(bounds)
    k = F.least(F.greatest(j, F.lit(least)), F.lit(most), F.size(b) - 1)
    return F.when(k >= 1, F.get(b, k - 1))


def fixed_fraction(n: Column | str, fraction: float, least: int, most: int) -> Column:
    """round-half-even(fraction * n) held between least and most, and by n."""
    n = _c(n)
    return F.least(F.greatest(F.rint(F.lit(float(fraction)) * n).cast("int"), F.lit(least)), F.lit(most), n.cast("int"))


def union_kl(p: Column | str, q: Column | str, floor: float) -> Column:
    """KL(p || q) of two top-K maps token -> log probability on the union of their tokens; missing ones get ``floor``, both are normalised.

    Everything stays in logarithms, shifted by the largest, so very small probabilities count as they are.
    """
    p, q = _c(p), _c(q)
    tokens = F.array_sort(F.array_union(F.map_keys(p), F.map_keys(q)))

    def normal(m: Column) -> Column:
        raw = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(m, t).cast("double"), F.lit(float(floor))))
        total = lambda r: F.array_max(r) + F.log(_sum(F.transform(r, lambda x: F.exp(x - F.array_max(r)))))
        bound = F.transform(F.array(raw), lambda r: F.struct(r.alias("r"), total(r).alias("z")))
        return F.get(F.transform(bound, lambda z: F.transform(z["r"], lambda x: x - z["z"])), F.lit(0))

    return _sum(F.zip_with(normal(p), normal(q), lambda a, b: F.exp(a) * (a - b)))


def position_signal(privileged: Column | str, base: Column | str, size: Column | str) -> Column:
    """Difference of two log probability arrays at positions 0..size-1; null where one of them has none."""
    return F.transform(F.sequence(F.lit(0), _c(size) - 1), lambda i: F.get(_c(privileged), i) - F.get(_c(base), i))


def step_bounds(pieces: Column | str, least_steps: int = 3) -> Column:
    """Ends (exclusive) of the steps of token pieces: after blank lines, or after sentences where blank lines give
    fewer than ``least_steps`` steps and sentences give more.

    A step of white space alone belongs to the one before it. The last end is the number of pieces. One pass:
    one-element arrays bind what is used several times, so it is computed once.
    """

    def mark(a: Column) -> Column:
        before = lambda i: F.coalesce(F.get(a, i - 1), F.lit(""))
        after = lambda i: F.coalesce(F.get(a, i + 1), F.lit(""))
        blank = lambda x, i: F.contains(x, F.lit("\n\n")) | (before(i).endswith("\n") & x.startswith("\n"))
        sentence = lambda x, i: x.rlike(r"[.!?][\"')\]]*\s") | (x.rlike(r"[.!?][\"')\]]*$") & after(i).rlike(r"^[ \n\t]"))
        marks = F.transform(a, lambda x, i: F.struct((i + 1).alias("end"), x.rlike(r"\S").alias("solid"), blank(x, i).alias("blank"), sentence(x, i).alias("sentence")))
        return F.get(F.transform(F.array(marks), choose), F.lit(0))

    def choose(marks: Column) -> Column:
        n = F.size(marks)

        def closed(name: str) -> Column:
            """A place counts if something solid stands between it and the last one that counted."""

            def step(s: Column, m: Column) -> Column:
                solid = s["solid"] | m["solid"]
                ends = m[name] & solid & (m["end"] < n)
                return F.struct(F.when(ends, F.concat(s["kept"], F.array(m["end"]))).otherwise(s["kept"]).alias("kept"), (solid & ~ends).alias("solid"))

            def finish(s: Column) -> Column:
                rest = F.when(s["solid"], s["kept"]).otherwise(F.slice(s["kept"], F.lit(1), F.greatest(F.size(s["kept"]) - 1, F.lit(0))))
                return F.concat(rest, F.array(n))

            return F.aggregate(marks, F.struct(F.array().cast("array<int>").alias("kept"), F.lit(False).alias("solid")), step, finish)

        both = F.array(F.struct(closed("blank").alias("b"), closed("sentence").alias("s")))
        chosen = F.transform(both, lambda z: F.when((F.size(z["b"]) < least_steps) & (F.size(z["s"]) > F.size(z["b"])), z["s"]).otherwise(z["b"]))
        return F.when(n > 0, F.get(chosen, F.lit(0))).otherwise(F.array().cast("array<int>"))

    return F.get(F.transform(F.array(_c(pieces)), mark), F.lit(0))
