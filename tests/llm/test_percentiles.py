import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmerframe.llm import percentiles as P


def test_small_groups_are_exact_and_odd_values_are_left_out(spark):
    rows = [("a", float(v)) for v in [5, 1, 4, 2, 3, 3]] + [("a", float("nan")), ("a", float("inf")), ("a", None), ("b", None), (None, 7.0)]
    df = spark.createDataFrame(rows, "n string, x double").withColumnRenamed("n", "g")
    got = {r.g: r for r in P.percentiles(P.sketches(df, ["g"], "x"), ["g"]).collect()}
    assert set(got) == {"a", None} and got["a"].n == 6 and got["a"].rank_error == 0
    assert (got["a"].p1, got["a"].p50, got["a"].p99, got["a"].p50_low, got["a"].p50_high) == (1.0, 3.0, 5.0, 3.0, 3.0)
    assert got[None].p50 == 7.0
    assert P.percentiles(P.sketches(df.limit(0), ["g"], "x"), ["g"]).collect() == []


@pytest.mark.parametrize("skewed", [False, True])
def test_rank_error_of_combined_sketches(spark, skewed):
    df = spark.range(0, 300_000, 1, 8).select((F.col("id") % (7 if not skewed else 2)).alias("load"), (F.randn(3) * F.when(F.rand(4) < 0.5, 1).otherwise(100)).alias("x"))
    df = df.select("load", F.round("x", 3).alias("x"))
    values = np.sort(np.array([r.x for r in df.select("x").collect()]))
    day = P.sketches(df, ["load"], "x", 400)
    one = P.combine(day.withColumn("all", F.lit(1)), ["all"])
    r = P.percentiles(one, ["all"], k=400).collect()[0]
    assert r.n == 300_000 and r.rank_error == P.rank_error(400)
    for p in P.PERCENTS:
        a, b = np.searchsorted(values, r[f"p{p}"], "left") / 300_000, np.searchsorted(values, r[f"p{p}"], "right") / 300_000
        assert a - 2 * r.rank_error <= p / 100 <= b + 2 * r.rank_error
        assert r[f"p{p}_low"] <= r[f"p{p}"] <= r[f"p{p}_high"]
    assert r.p50_low <= np.quantile(values, 0.5) <= r.p50_high


def test_hold_counts_the_true_ranks(spark):
    from pyspark.sql import functions as F

    from glimmerframe.llm import percentiles as P

    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 3 == 2, F.lit(None)).otherwise(F.col("id") % 3).alias("m"), (F.col("id") * 7919 % 10_007).cast("double").alias("x"))
    made = P.percentiles(P.sketches(df, ["k", "m"], "x"), ["k", "m"])
    got = P.hold(df, made, ["k", "m"], "x").collect()
    assert sorted(r.n for r in got) == [6666, 6667, 6667] and all(r.holds for r in got)
    off = made.withColumn("p50", F.col("p50") * 1.05)
    assert not any(r.holds for r in P.hold(df, off, ["k", "m"], "x").collect())
