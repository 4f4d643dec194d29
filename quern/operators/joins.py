"""Guarded joins: key checks both ways, fallbacks, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class KeyMismatch(ValueError):
    """Keys of two tables differ."""


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are on one side only, with ``side``."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def require_same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    found = key_differences(left, right, keys).limit(5).collect()
    if found:
        raise KeyMismatch(f"keys without a partner, for example {[tuple(r) for r in found]}")


def require_found(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> None:
    found = left.select(*keys).join(right.select(*keys), keys, "left_anti").limit(5).collect()
    if found:
        raise KeyMismatch(f"{what} not found, for example {[tuple(r) for r in found]}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> None:
    found = duplicate_keys(df, keys).limit(5).collect()
    if found:
        raise KeyMismatch(f"repeated keys, for example {[tuple(r) for r in found]}")


def exploded_lookup(groups: DataFrame, index_array: str, rows: DataFrame, key: str, index: str) -> DataFrame:
    """Rows named by each group's array of indices; indices without a row are left out."""
    return groups.select(key, F.explode(index_array).alias(index)).join(rows, [key, index])


def flagged(df: DataFrame, chosen: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A boolean column: the key is in ``chosen``."""
    return df.join(chosen.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def replaced(old: DataFrame, new: DataFrame, keys: list[str], redone: DataFrame) -> DataFrame:
    """Rows of ``new`` in place of all old rows whose keys are in ``redone``, also where the second pass gave nothing."""
    return old.join(redone.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def with_fallback(left: DataFrame, first: DataFrame, second: DataFrame, first_on: list[str], second_on: list[str], value: str) -> DataFrame:
    """``value`` by the first lookup, else by the second (the smallest value of a key in either, so rows never multiply)."""
    a = first.groupBy(*first_on).agg(F.min(value).alias("__a"))
    b = second.groupBy(*second_on).agg(F.min(value).alias("__b"))
    return left.join(a, first_on, "left").join(b, second_on, "left").withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")


def count_differences(df: DataFrame, a: Column, b: Column) -> int:
    return df.where(~a.eqNullSafe(b)).count()


def require_equal(df: DataFrame, a: Column, b: Column, what: str) -> DataFrame:
    """The rows, or an error before anything is written where the two differ."""
    if n := count_differences(df, a, b):
        raise ValueError(f"{what}: {n} rows were joined to another row's text")
    return df


def update_column(df: DataFrame, updates: DataFrame, keys: list[str], column: str) -> DataFrame:
    """New values where they aren't blank; other rows as they were."""
    new = updates.select(*keys, F.nullif(F.trim(column), F.lit("")).alias("__new"))
    return df.join(new, keys, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def overriding(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Left join in which columns of the right side replace those of the same name where they aren't null."""
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    r = right.select(*keys, *[F.col(c).alias(f"__r_{c}") if c in shared else F.col(c) for c in right.columns if c not in keys])
    out = left.join(r, keys, how)
    for c in shared:
        out = out.withColumn(c, F.coalesce(f"__r_{c}", c)).drop(f"__r_{c}")
    return out


def grid(left: DataFrame, values: list, name: str) -> DataFrame:
    """Every row with every value of a short list."""
    return left.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
