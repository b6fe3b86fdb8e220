"""Exact quantiles per group, whatever the group's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(value: Column) -> Column:
    """A number that never falls as value rises; equal for values within about 0.4 % of each other."""
    size = F.floor(F.ln(F.abs(value)) * 256) + 200_000
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float = 0.5, name: str = "quantile") -> DataFrame:
    """(keys, name): the q-quantile of the finite, non-null values of each group, interpolated linearly between the two nearest ranks.

    No group is gathered: values are counted by bucket, the bucket that holds the wanted rank is found from these counts, and only its values are counted
    one by one, keyed by group and bucket, so that a group with a third of all rows is spread over its buckets. Groups without a finite value give
    no row; null keys are groups of their own.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") < float("inf")))
    rows = rows.withColumn("__b", bucket(F.col("__v")))
    by = Window.partitionBy(*keys)
    counts = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    ranked = counts.select("*", F.sum("__n").over(by.orderBy("__b")).alias("__upto"), F.sum("__n").over(by).alias("__all"))
    rank = (F.col("__all") - 1) * F.lit(q)
    low, high = F.floor(rank), F.ceil(rank)
    wanted = ranked.filter((F.col("__upto") > low) & (F.col("__upto") - F.col("__n") <= high))
    wanted = wanted.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__wb"), (F.col("__upto") - F.col("__n")).alias("__base"), low.alias("__low"), high.alias("__high"), (rank - low).alias("__part"))
    same = F.col("__b") == F.col("__wb")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    exact = rows.join(wanted, same).groupBy(*keys, "__b", "__base", "__low", "__high", "__part", "__v").agg(F.count("*").alias("__n"))
    at = F.col("__base") + F.sum("__n").over(Window.partitionBy(*keys, "__b").orderBy("__v"))
    exact = exact.withColumn("__at", at)

    def holds(rank: str) -> Column:
        return F.max(F.when((F.col("__at") > F.col(rank)) & (F.col("__at") - F.col("__n") <= F.col(rank)), F.col("__v")))

    ends = exact.groupBy(*keys).agg(holds("__low").alias("__lo"), holds("__high").alias("__hi"), F.max("__part").alias("__part"))
    return ends.select(*keys, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__part")).alias(name))
