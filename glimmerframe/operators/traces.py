"""Operators on long traces (cell, t, value): one row per cell and frame, null where a reading is missing.

Rows of null cell or t are no frames and drop out wherever cells or frames are matched. Frame windows are windows of time: a frame whose window lacks a
reading has no window value. They are evaluated in blocks of frames with a halo, so a cell with a third of all rows is spread over many tasks;
per-cell figures are partial aggregates joined back, never a window over a whole cell.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmerframe.config import CONFIG
from glimmerframe.functions.quantiles import exact_quantile

BLOCK_FRAMES = 50_000


def cast(df: DataFrame, cell: str = "cell", t: str = "t", value: str = "value") -> DataFrame:
    return df.select(F.col(cell).alias("cell"), F.col(t).cast("long").alias("t"), F.col(value).cast("double").alias("value"))


def halo(df: DataFrame, before: int, after: int, block: int) -> DataFrame:
    """Frames in blocks (column __block), with those up to before frames ahead of and after frames behind a block repeated in it (__own tells them apart)."""
    own = F.floor(F.col("t") / block)
    reached = F.sequence(F.floor((F.col("t") - after) / block), F.floor((F.col("t") + before) / block))
    return df.withColumn("__own", own).withColumn("__block", F.explode(reached))


def near(df: DataFrame, before: int, after: int, named: Callable[[Callable], dict[str, Column]], block: int = BLOCK_FRAMES) -> DataFrame:
    """df with columns computed over frames t - before .. t + after. named gets over(a, b) -> window and returns the columns."""
    by = Window.partitionBy("cell", "__block").orderBy("t")
    out = halo(df, before, after, block).withColumns(named(lambda a, b: by.rangeBetween(a, b)))
    return out.filter(F.col("__block") == F.col("__own")).drop("__block", "__own")


def by_blocks(df: DataFrame, before: int, after: int, run: Callable[[np.ndarray, dict[str, float]], np.ndarray], figures: tuple[str, ...] = (), block: int = BLOCK_FRAMES) -> DataFrame:
    """(cell, t, value): run(values, figures) over blocks of frames with their halo, as arrays of consecutive frames (NaN where a reading is missing); figures are columns of one value a cell.

    For windows whose width is a cell's own, and for sums that no window function states. A result that is not finite is null.
    """
    kind = df.schema["cell"].dataType.simpleString()
    wide = halo(df.select("cell", "t", "value", *figures), before, after, block)

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = table["t"].to_numpy()
        first = t.min()
        x = np.full(t.max() - first + 1, np.nan)
        x[t - first] = table["value"].to_numpy(zero_copy_only=False)
        y = np.asarray(run(x, {f: table[f][0].as_py() for f in figures}), float)
        own = table.filter(pc.equal(table["__own"], key[1]))
        out = y[own["t"].to_numpy() - first]
        return pa.table([own["cell"], own["t"], pa.array(out, mask=~np.isfinite(out))], ["cell", "t", "value"])

    return wide.groupBy("cell", "__block").applyInArrow(one, f"cell {kind}, t long, value double")


def window_moments(x: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, sum, sum of squares) of the readings among frames i - before .. i + after of an array, for every i."""
    good = np.isfinite(x)
    v = np.where(good, x, 0.0)
    sums = np.cumsum(np.concatenate([np.zeros((3, 1)), [good, v, v * v]], 1), 1)
    i = np.arange(len(x))
    return tuple(sums[:, np.minimum(i + after + 1, len(x))] - sums[:, np.maximum(i - before, 0)])


def per_cell(df: DataFrame, *aggregates: Column, by: tuple[str, ...] = ("cell",)) -> DataFrame:
    """df joined with aggregates of each cell."""
    return df.join(df.groupBy(*by).agg(*aggregates), list(by))


def with_quantiles(df: DataFrame, value: str, by: tuple[str, ...] = ("cell",), **named: float) -> DataFrame:
    """df joined with exact quantiles (name=q) of a column per cell."""
    for name, q in named.items():
        df = df.join(exact_quantile(df, list(by), value, q, name), list(by), "left")
    return df


def moving_mean(df: DataFrame, k: int, name: str = "mean", value: str = "value") -> DataFrame:
    """Centred mean over k frames (k even: one more after than before); null at the edges and beside missing readings."""
    before, after = (k - 1) // 2, k // 2
    return near(df, before, after, lambda over: {name: F.when(F.count(value).over(over(-before, after)) == k, F.avg(value).over(over(-before, after)))})


def steps(df: DataFrame, name: str = "step", value: str = "value") -> DataFrame:
    """The change from the frame before; null for a cell's first frame and beside missing readings."""
    return near(df, 1, 0, lambda over: {name: F.col(value) - F.max(value).over(over(-1, -1))})


def trace_stats(df: DataFrame) -> DataFrame:
    """(cell, n, mean, sd, lowest, highest, median, range) of the readings."""
    base = df.groupBy("cell").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    return base.join(exact_quantile(df, ["cell"], "value", name="median"), "cell", "left").withColumn("range", F.col("highest") - F.col("lowest"))


def subtract_background(df: DataFrame, background: DataFrame) -> DataFrame:
    """value minus the frame's mean background; background: (t, bg), any number of rows a frame, nulls skipped. Frames without background stay as they are."""
    mean = background.groupBy("t").agg(F.avg("bg").alias("__bg"))
    return df.join(mean, "t", "left").withColumn("value", F.col("value") - F.coalesce("__bg", F.lit(0.0))).drop("__bg")


def normalise(df: DataFrame, method: str = "mean") -> DataFrame:
    """value by mean (value / mean), zscore or minmax of its cell; null where the divisor is 0."""
    if method == "mean":
        return per_cell(df, F.avg("value").alias("__m")).withColumn("value", F.try_divide("value", "__m")).drop("__m")
    if method == "zscore":
        return per_cell(df, F.avg("value").alias("__m"), F.stddev_samp("value").alias("__s")).withColumn("value", F.try_divide(F.col("value") - F.col("__m"), F.col("__s"))).drop("__m", "__s")
    if method == "minmax":
        return per_cell(df, F.min("value").alias("__a"), F.max("value").alias("__b")).withColumn("value", F.try_divide(F.col("value") - F.col("__a"), F.col("__b") - F.col("__a"))).drop("__a", "__b")
    raise ValueError("method must be mean, zscore or minmax")


def detrend(df: DataFrame) -> DataFrame:
    """value minus the least-squares line of its cell over t."""
    y, x = F.col("value"), F.when(F.col("value").isNotNull(), F.col("t").cast("double"))
    fit = per_cell(df, F.regr_slope(y, x).alias("__b"), F.avg(x).alias("__x"), F.avg(y).alias("__y"))
    return fit.withColumn("value", F.col("value") - F.col("__y") - F.coalesce("__b", F.lit(0.0)) * (F.col("t") - F.col("__x"))).drop("__b", "__x", "__y")


def smooth(df: DataFrame, k: int = 5) -> DataFrame:
    return moving_mean(df, k, "__m").withColumn("value", F.col("__m")).drop("__m")


def outliers(df: DataFrame, method: str = "iqr", threshold: float = CONFIG.outlier_factor) -> DataFrame:
    """df with outlier boolean, false where the value is missing.

    iqr: beyond the quartiles by threshold interquartile ranges; zscore: |z| above threshold; mad: |x - median| above threshold
    (unscaled) median absolute deviations.
    """
    if method == "iqr":
        f = with_quantiles(df, "value", __a=0.25, __b=0.75)
        fence = (F.col("__b") - F.col("__a")) * threshold
        mark, extra = (F.col("value") < F.col("__a") - fence) | (F.col("value") > F.col("__b") + fence), ["__a", "__b"]
    elif method == "zscore":
        f = per_cell(df, F.avg("value").alias("__m"), F.stddev_samp("value").alias("__s"))
        mark, extra = F.abs(F.try_divide(F.col("value") - F.col("__m"), F.col("__s"))) > threshold, ["__m", "__s"]
    elif method == "mad":
        f = with_quantiles(df, "value", __m=0.5).withColumn("__d", F.abs(F.col("value") - F.col("__m")))
        f = with_quantiles(f, "__d", __s=0.5)
        mark, extra = F.try_divide("__d", "__s") > threshold, ["__m", "__d", "__s"]
    else:
        raise ValueError("method must be iqr, zscore or mad")
    return f.withColumn("outlier", F.coalesce(mark, F.lit(False))).drop(*extra)


def without_outliers(df: DataFrame, method: str = "iqr", threshold: float = CONFIG.outlier_factor) -> DataFrame:
    """Outliers become missing."""
    return outliers(df, method, threshold).withColumn("value", F.when(~F.col("outlier"), F.col("value"))).drop("outlier")


def preprocess(df: DataFrame, chain: tuple[str, ...] = ("outliers", "detrend", "normalise", "smooth")) -> DataFrame:
    """The named steps in order: outliers (iqr) to missing, detrend, normalise (zscore), smooth (5 frames)."""
    known = {"outliers": without_outliers, "detrend": detrend, "normalise": lambda d: normalise(d, "zscore"), "smooth": smooth}
    for step in chain:
        df = known[step](df)
    return df


def preprocessing_quality(processed: DataFrame, original: DataFrame) -> DataFrame:
    """(quality): the mean over cells of mean/sd after by before, at most 1."""
    snr = lambda d, n: d.groupBy("cell").agg(F.try_divide(F.avg("value"), F.stddev_samp("value")).alias(n))
    both = snr(processed, "p").join(snr(original, "o"), "cell")
    return both.agg(F.least(F.lit(1.0), F.avg(F.try_divide("p", "o"))).alias("quality"))


def temporal_outliers(df: DataFrame, method: str = "iqr", threshold: float = CONFIG.outlier_factor) -> DataFrame:
    """(cell, warnings): frames whose absolute step exceeds the upper fence of the signed steps (iqr), or whose step has |z| above threshold."""
    s = steps(df).filter(F.col("step").isNotNull())
    if method == "iqr":
        f = with_quantiles(s, "step", __a=0.25, __b=0.75)
        mark = F.abs("step") > F.col("__b") + threshold * (F.col("__b") - F.col("__a"))
    else:
        f = per_cell(s, F.avg("step").alias("__m"), F.stddev_samp("step").alias("__s"))
        mark = F.abs(F.try_divide(F.col("step") - F.col("__m"), F.col("__s"))) > threshold
    return f.groupBy("cell").agg(F.sum(F.when(mark, 1).otherwise(0)).alias("warnings"))


def missing_runs(df: DataFrame) -> DataFrame:
    """(cell, longest): the longest run of missing readings; 0 for a cell without any."""
    gone = df.filter(F.col("value").isNull())
    runs = gone.withColumn("__r", F.col("t") - F.row_number().over(Window.partitionBy("cell").orderBy("t"))).groupBy("cell", "__r").agg(F.count("*").alias("n"))
    longest = runs.groupBy("cell").agg(F.max("n").alias("longest"))
    return df.select("cell").distinct().join(longest, "cell", "left").select("cell", F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))


def quality_control(df: DataFrame) -> DataFrame:
    """(cell, n, missing, longest, snr, short, too_many_missing, long_gap, low_snr): figures of a cell and the warnings they give."""
    base = df.groupBy("cell").agg(F.count("*").alias("n"), F.avg(F.col("value").isNull().cast("int")).alias("missing"), F.try_divide(F.avg("value"), F.stddev_samp("value")).alias("snr"))
    q = base.join(missing_runs(df), "cell")
    return q.select("cell", "n", "missing", "longest", "snr", (F.col("n") < CONFIG.least_length).alias("short"), (F.col("missing") > CONFIG.most_missing).alias("too_many_missing"), (F.col("longest") > CONFIG.longest_gap).alias("long_gap"), F.coalesce(F.col("snr") < CONFIG.least_snr, F.lit(False)).alias("low_snr"))


def correction_quality(raw: DataFrame, corrected: DataFrame) -> DataFrame:
    """(cell, snr_raw, snr_corrected, improvement, stability, outlier_fraction, score, passed).

    stability: sd of the 50-frame moving mean, null for shorter cells; score: mean of min(improvement / 50, 1), max(0, 1 - stability / 0.1) and max(0, 1 -
    outlier_fraction / 0.05); passed at 0.8 and more, not where the score is missing.
    """
    snr = lambda d, n: d.groupBy("cell").agg(F.try_divide(F.avg("value"), F.stddev_samp("value")).alias(n))
    stable = moving_mean(corrected, 50, "m").groupBy("cell").agg(F.stddev_samp("m").alias("stability"))
    out = outliers(corrected).groupBy("cell").agg(F.avg(F.col("outlier").cast("int")).alias("outlier_fraction"))
    q = snr(raw, "snr_raw").join(snr(corrected, "snr_corrected"), "cell").join(stable, "cell", "left").join(out, "cell", "left")
    q = q.withColumn("improvement", F.try_divide(F.col("snr_corrected") - F.col("snr_raw"), F.col("snr_raw")) * 100)
    floor = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))
    parts = (F.least(F.lit(1.0), F.col("improvement") / 50), floor(1 - F.col("stability") / 0.1), floor(1 - F.col("outlier_fraction") / 0.05))
    score = (F.when(F.col("improvement").isNotNull(), parts[0]) + parts[1] + parts[2]) / 3
    return q.withColumn("score", score).withColumn("passed", F.coalesce(F.col("score") >= 0.8, F.lit(False)))


def soft_denoise(df: DataFrame, threshold: str = "universal") -> DataFrame:
    """value as a clipped 5-frame mean plus the soft-thresholded rest; threshold sqrt(2 ln n) * median |step| / 0.6745 (universal) or 2 sd of the rest."""
    f = near(df, 2, 2, lambda over: {"__m": F.avg("value").over(over(-2, 2)), "__d": F.abs(F.col("value") - F.max("value").over(over(-1, -1)))})
    f = f.withColumn("__r", F.col("value") - F.col("__m"))
    if threshold == "universal":
        f = per_cell(with_quantiles(f, "__d", __q=0.5), F.count("value").alias("__n"))
        tau = F.sqrt(2 * F.ln(F.greatest(F.col("__n"), F.lit(1)))) * F.coalesce("__q", F.lit(0.0)) / 0.6745
    else:
        f = per_cell(f, F.stddev_samp("__r").alias("__q"))
        tau = 2 * F.col("__q")
    shrunk = F.signum("__r") * F.greatest(F.abs("__r") - tau, F.lit(0.0))
    return f.withColumn("value", F.col("__m") + shrunk).select("cell", "t", "value")


def validate(df: DataFrame) -> DataFrame:
    """(rows, missing, infinite, below, above): what the trace checks look at, over all readings in one aggregation; infinite values are an error, values below -1000 or above 10000 a warning."""
    v = F.col("value")
    flag = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return df.agg(F.count("*").alias("rows"), flag(v.isNull()).alias("missing"), flag(F.abs(v) == float("inf")).alias("infinite"), flag(v < -1000).alias("below"), flag((v > 10000) & ~F.isnan(v)).alias("above"))


def long_from_wide(df: DataFrame, key: str = "t", pattern: str = r"^Cell_") -> DataFrame:
    """(cell string, t, value) from one column per cell."""
    import re

    cells = [c for c in df.columns if re.search(pattern, c)]
    return df.select(key, *[F.col(c).cast("double") for c in cells]).unpivot([key], cells, "cell", "value").select("cell", F.col(key).cast("long").alias("t"), "value")


def wide_from_long(df: DataFrame, cells: list) -> DataFrame:
    """One column per cell of the given ones, one row per t."""
    return df.groupBy("t").pivot("cell", cells).agg(F.max("value"))
