"""Row predicates, each a native boolean column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import last_boxed, strip

#: Phrases that show a text has seen the reference solution. Fixed values.
LEAKAGE_PATTERNS = (
    "주어진 풀이",
    "참고 풀이",
    r"\breference solution\b",
    r"\bgiven solution\b",
    r"\bprovided solution\b",
    r"\bmodel solution\b",
    r"\bofficial solution\b",
    r"\bas given\b",
    r"\bthe hint\b",
    r"\baccording to the (solution|reference)\b",
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stopped(finish_reason: Column | str = "finish_reason") -> Column:
    """The strict form of finished: the reason is ``stop``."""
    return F.coalesce(_c(finish_reason) == "stop", F.lit(False))


def not_truncated(finish_reason: Column | str = "finish_reason") -> Column:
    """The wide form of finished: any reason but ``length``."""
    return F.coalesce(_c(finish_reason) != "length", F.lit(True))


def first_present(df: DataFrame, names: list[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; there are {df.columns}")


def in_domain(column: Column | str | None, domain: str) -> Column:
    """Equal without regard to case; true where the table has no such column."""
    return F.lit(True) if column is None else F.lower(F.coalesce(_c(column), F.lit(""))) == domain.lower()


def listed(df: DataFrame, column: str, allowed) -> Column:
    """Text form of the value is one of ``allowed`` (one value or several); null reads as None, booleans as True and False."""
    allowed = [allowed] if isinstance(allowed, (str, int, float, bool)) else list(allowed)
    shown = F.col(column).cast("string")
    if dict(df.dtypes)[column] == "boolean":
        shown = F.initcap(shown)
    return F.coalesce(shown, F.lit("None")).isin([str(a) for a in allowed])


def any_true(df: DataFrame, column: str) -> Column:
    """True where a flag is set: one flag or an array of them; an empty array has none."""
    if dict(df.dtypes)[column].startswith("array"):
        return F.coalesce(F.exists(F.col(column), lambda x: F.coalesce(x.cast("boolean"), F.lit(False))), F.lit(False))
    return F.coalesce(F.col(column).cast("boolean"), F.lit(False))


def blank(x: Column | str) -> Column:
    return F.coalesce(strip(x), F.lit("")) == ""


def matches(x: Column | str, pattern: str) -> Column:
    return F.coalesce(_c(x).rlike(pattern), F.lit(False))


def unboxed(x: Column | str) -> Column:
    return last_boxed(x).isNull()


def at_least_level(x: Column | str, level: int) -> Column:
    return F.coalesce(_c(x).cast("int"), F.lit(0)) >= level


def leaks(x: Column | str, patterns=LEAKAGE_PATTERNS) -> Column:
    return reduce(lambda a, b: a | b, [matches(x, f"(?i){p}") for p in patterns], F.lit(False))


def judge_verdict(reply: Column | str) -> Column:
    """reject where the reply starts with YES, keep with NO, else unparsed (kept and counted)."""
    said = F.upper(strip(reply))
    return F.when(said.startswith("YES"), "reject").when(said.startswith("NO"), "keep").otherwise("unparsed")


def in_band(p: Column | str, low: float, high: float) -> Column:
    """Strictly between: groups that are all wrong or all right are left out."""
    return (_c(p) > low) & (_c(p) < high)


def token_budget(prompt_len: Column | str, most_total: int, most_new: int) -> Column:
    """Tokens left for an answer; null where there is no room."""
    room = F.lit(most_total) - _c(prompt_len)
    return F.when(room > 0, F.least(room, F.lit(most_new)))


def empty_anchor_reason(gold: Column | str, steps: Column | str, window: Column | str) -> Column:
    return F.when(blank(gold), "no_gold").when(_c(steps) < 2, "too_few_steps").when(_c(window).isNull(), "no_valid_window")


def drop_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds; null where none does."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def mean_at_least(values: Column | str, least: float) -> Column:
    """The mean of the known values reaches ``least``; without any it does not."""
    from quern.functions.arrays import mean

    return F.coalesce(mean(values) >= F.lit(float(least)), F.lit(False))
