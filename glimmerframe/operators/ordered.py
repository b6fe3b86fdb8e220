"""Ordered work over one source without gathering the source.

Rows of a source are cut into blocks of fixed duration. A block is small and is sorted in one task; what a block must know of its neighbours (the few rows
before and after it) comes from a table of block edges, which has a handful of rows per block. A source with a third of all rows is thus
spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SECONDS, STRETCH = 600, 1000


def micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def block_of(at: Column, seconds: int = BLOCK_SECONDS) -> Column:
    return F.floor(at / F.lit(seconds * 1_000_000)).cast("long")


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows (source, block, at, ...) with each block in one partition."""
    return rows.repartition("source", "block")


def one_per_moment(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row of each (source, block, at): the greatest by fields, in order, nulls counting as least. Uses the partitioning of in_blocks."""
    best = rows.groupBy("source", "block", "at").agg(F.max(F.struct(*fields)).alias("__m"))
    return best.select("source", "block", "at", *[F.col(f"__m.{f}").alias(f) for f in fields])


def edges(rows: DataFrame, fields: list[str], k: int) -> DataFrame:
    """(source, block, before, after): up to k rows before the block's first and after its last, nearest first, as arrays of structs of fields.

    In two levels: blocks look along their stretch of STRETCH blocks, stretches along their source, so that one task sees a source's stretches at most.
    """
    inside = Window.partitionBy("source", "block").orderBy("at")
    rows = rows.select("source", "block", F.struct("at", *fields).alias("__s"), F.row_number().over(inside).alias("__rn"), F.count("*").over(Window.partitionBy("source", "block")).alias("__n"))
    ends = rows.filter((F.col("__rn") <= k) | (F.col("__rn") > F.col("__n") - k))
    some = lambda c: F.collect_list(F.when(c, F.col("__s")))
    b = ends.groupBy("source", "block").agg(F.sort_array(some(F.col("__rn") <= k)).alias("first"), F.sort_array(some(F.col("__rn") > F.col("__n") - k), False).alias("last"))
    b = b.withColumn("stretch", F.coalesce(F.floor(F.col("block") / STRETCH), F.lit(0)))  # never null, so that no filter on it parts the plans that share rows

    def along(units: DataFrame, keys: list[str], order: str) -> DataFrame:
        by = Window.partitionBy(*keys).orderBy(order)
        none = F.slice("first", 1, 0)
        near = lambda step, c: F.slice(F.flatten(F.array(*[F.coalesce(step(c, i).over(by), none) for i in range(1, k + 1)])), 1, k)
        return units.withColumn("before", near(F.lag, "last")).withColumn("after", near(F.lead, "first"))

    b = along(b, ["source", "stretch"], "block")
    whole = lambda own, more: F.slice(F.concat(own, more), 1, k)
    s = b.groupBy("source", "stretch").agg(F.min_by(whole("first", "after"), "block").alias("first"), F.max_by(whole("last", "before"), "block").alias("last"))
    s = along(s, ["source"], "stretch").select("source", "stretch", F.col("before").alias("__b"), F.col("after").alias("__a"))
    return b.join(s, ["source", "stretch"]).select("source", "block", whole("before", "__b").alias("before"), whole("after", "__a").alias("after"))
