"""First and last wins, quotas, samples and splits: rankings with a total order, so results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import stable_hash
from quern.session import materialize


def _cols(cols) -> list[Column]:
    """Names order ascending, nulls last: what can't be scored never wins."""
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in cols]


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*_cols(order))))


def keep_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group. Spark cuts groups before the shuffle (WindowGroupLimit), so hot keys stay small."""
    return ranked(df, keys, order, "__rank").where(F.col("__rank") <= k).drop("__rank")


def first_wins(df: DataFrame, keys: list[str], ordinal: list) -> DataFrame:
    return keep_k(df, keys, ordinal, 1)


def last_wins(df: DataFrame, keys: list[str], generation: str, ordinal: str) -> DataFrame:
    """Of each key the row of the last generation; ``position`` is where the key first came up."""
    w = Window.partitionBy(*keys)
    placed = df.withColumn("position", F.min(F.struct(generation, ordinal)).over(w))
    return keep_k(placed, keys, [F.col(generation).desc(), F.col(ordinal).desc()], 1)


def hash_order(seed: int | str, qid: Column) -> Column:
    """A pseudo-random order that depends on seed and key only. ``qid`` is the text that enters the hash."""
    return stable_hash(seed, qid)


def hash_sample(df: DataFrame, n: int, seed: int, qid: Column, tie: str) -> DataFrame:
    """``n`` rows by hash order, all where there are fewer: a top-n, no full sort."""
    return df.withColumn("__h", hash_order(seed, qid)).orderBy("__h", tie).limit(n).drop("__h")


def holdout_split(df: DataFrame, n: int, seed: int, qid: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """(train, holdout): the first ``n`` keys by hash order are held out; none where n <= 0."""
    if n <= 0:
        return df, df.limit(0)
    held = hash_sample(df, n, seed, qid, key)
    return df.join(held.select(key), key, "left_anti"), held


def group_hash_quota(df: DataFrame, keys: list[str], k: int, order_hash: Column, tie: list) -> DataFrame:
    """A seeded random choice of ``k`` rows a group that doesn't depend on the order of rows."""
    return keep_k(df.withColumn("__h", order_hash), keys, ["__h", *tie], k).drop("__h")


def first_that_fits(df: DataFrame, keys: list[str], order: list, length: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(best row within the budget of each group, groups in which no row fits)."""
    fit = keep_k(df.where(length <= most), keys, order, 1)
    return fit, df.select(*keys).distinct().join(fit.select(*keys), keys, "left_anti")


def merge_ranked(old: DataFrame, new: DataFrame, keys: list[str], content: list[str], order: list, k: int) -> DataFrame:
    """Old and new rows, equal contents once (the old one stays), ranked again and cut to ``k`` a group."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    return keep_k(first_wins(both, [*keys, *content], ["__age", *order]), keys, order, k).drop("__age")


def reindexed(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """A new gapless number from 0 in each group."""
    return ranked(df, keys, order, name).withColumn(name, F.col(name) - 1)


def chunks(df: DataFrame, key: str, size: int) -> DataFrame:
    """Sorted distinct keys in chunks of ``size``. Ranges are numbered by a two-level count, not by one task."""
    return numbered(df.select(key).distinct(), [key], "__n").select(key, F.floor(F.col("__n") / size).alias("chunk"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A gapless global number from 0 by ``order``: rows are range-partitioned, sizes of ranges are summed, rows numbered inside."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *_cols(order)).withColumn("__part", F.spark_partition_id())
    sizes = ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__part").orderBy(*_cols(order))
    return ranges.withColumn("__local", F.row_number().over(inside) - 1).join(F.broadcast(base), "__part").withColumn(name, F.col("__local") + F.col("__base")).drop("__part", "__local", "__base")


def round_robin(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    return numbered(df, order, "__n").withColumn("shard", F.col("__n") % shards).drop("__n")


def cyclic_neighbour(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Each row's next row by ``order``, the first for the last; no rows where there are fewer than two. No task sees all rows."""
    placed = materialize(numbered(df, order, "__n"), "cycle")
    n = placed.count()
    following = placed.select(F.pmod(F.col("__n") - 1, F.lit(max(n, 1))).alias("__n"), F.col(value).alias(name))
    return placed.join(following, "__n").where(F.lit(n > 1)).drop("__n")


def rolling_mean(df: DataFrame, keys: list[str], order: list, value: str, window: int, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*keys).orderBy(*_cols(order)).rowsBetween(1 - window, 0)))


def plateau(rewards: Column, window: int, patience: int, least_gain: float) -> Column:
    """struct<best, stale, stop_at> of a reward series: the first place to stop (-1: none), and the state there.

    A reward of 1 stops at once. Else the mean of the last ``window`` rewards is compared with the best such
    mean so far (null until the first full window); ``patience`` rounds without gain stop.
    """
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("stale"), F.lit(-1).alias("stop_at"), F.array().cast("array<double>").alias("held"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        held = F.slice(F.concat(s["held"], F.array(x.cast("double"))), F.greatest(F.size(s["held"]) + 2 - window, F.lit(1)), F.lit(window))
        now = F.aggregate(held, F.lit(0.0), lambda a, v: a + v) / window
        solved, judged = x >= 1.0, F.size(held) >= window
        gain = F.coalesce(now > s["best"] + least_gain, F.lit(True))
        best = F.when(judged & gain & ~solved, now).otherwise(s["best"])
        stale = F.when(~judged | solved, s["stale"]).when(gain, 0).otherwise(s["stale"] + 1)
        stop = F.when(solved | (judged & ~gain & (stale >= patience)), s["i"]).otherwise(-1)
        following = F.struct(best.alias("best"), stale.alias("stale"), stop.alias("stop_at"), held.alias("held"), (s["i"] + 1).alias("i"))
        return F.when(s["stop_at"] >= 0, s).otherwise(following)

    return F.aggregate(rewards, start, step, lambda s: F.struct(s["best"].alias("best"), s["stale"].alias("stale"), s["stop_at"].alias("stop_at")))
