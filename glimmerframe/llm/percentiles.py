"""Percentiles of very large columns from mergeable sketches.

A sketch is a hierarchy of randomised compactors: a full level is sorted, every other value (odd or even at random) moves up with twice the weight, the
rest is dropped; two sketches merge level by level. Sketches are built in the map tasks and merged after the shuffle, so a group with a third of
all rows costs one sketch per task, and stored sketches of days or loads combine without their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERCENTS = (1, 5, 25, 50, 75, 95, 99)
SIZE = 1600


def rank_error(k: int = SIZE) -> float:
    """Published bound: with probability 0.99 a percentile's true rank is off by at most this share of the rows. Groups of fewer than k rows are exact."""
    return 2.296 / k**0.9021


def sketches(df: DataFrame, keys: list[str], value: str, k: int = SIZE) -> DataFrame:
    """(keys, n, lowest, highest, sketch binary): one mergeable sketch of the finite, non-null values of each group.

    Null keys are a group of their own; groups without a finite value give no row; repeated rows count as often as they stand there; an empty table
    gives an empty result. Memory per group is bounded by k, whatever the group's size.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") < float("inf")))
    return v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("lowest"), F.max("__v").alias("highest"), F.kll_sketch_agg_double("__v", k).alias("sketch"))


def combine(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones, without reading a value again."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.kll_merge_agg_double("sketch").alias("sketch"))


def percentiles(parts: DataFrame, keys: list[str], percents: tuple[float, ...] = PERCENTS, k: int = SIZE) -> DataFrame:
    """(keys, n, rank_error, pXX ..., pXX_low, pXX_high ...): percentiles of sketches, with the values at both ends of the rank-error interval.

    rank_error is 0 where the sketch still holds every value (n < k). A percentile is the least value whose rank reaches the percentage.
    """
    e = F.when(F.col("n") < k, F.lit(0.0)).otherwise(F.lit(rank_error(k)))
    out = parts.withColumn("rank_error", e)
    named = []
    for p in percents:
        label, q = f"p{p:g}".replace(".", "_"), p / 100
        exact, low, high = (F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, r)))) for r in (q, q - rank_error(k), q + rank_error(k)))
        named += [exact.alias(label), F.when(F.col("n") < k, exact).otherwise(low).alias(f"{label}_low"), F.when(F.col("n") < k, exact).otherwise(high).alias(f"{label}_high")]
    return out.select(*keys, "n", "rank_error", *named)


def hold(df: DataFrame, made: DataFrame, keys: list[str], value: str, percents: tuple[float, ...] = PERCENTS) -> DataFrame:
    """(keys, n, holds) of percentiles made from df: whether the true rank of every percentile is off by at most the stated rank error, by counting all values of the group on either side."""
    v = df.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") < float("inf")))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    labels = {p: f"p{p:g}".replace(".", "_") for p in percents}
    counts = [F.sum((F.col("__v") < F.col(x)).cast("long")).alias(f"__b{i}") for i, x in enumerate(labels.values())] + [F.sum((F.col("__v") <= F.col(x)).cast("long")).alias(f"__u{i}") for i, x in enumerate(labels.values())]
    c = made.join(v, same).groupBy(*keys).agg(F.max("n").alias("n"), F.max("rank_error").alias("__e"), F.count("*").alias("__all"), *counts)
    slack = F.col("__e") * F.col("n") + 1
    good = F.col("n") == F.col("__all")
    for i, p in enumerate(labels):
        good &= (F.col(f"__b{i}") <= F.col("n") * p / 100 + slack) & (F.col(f"__u{i}") >= F.col("n") * p / 100 - slack)
    return c.select(*keys, "n", good.alias("holds"))
