"""Spike detectors on traces (cell, t, value) with frames 1, 2, ... in every cell: each gives (cell, t, fit, spike).

Greedy rules (merging, refractory periods) run over candidates only, in islands: where two candidates are further apart than the rule reaches, its state
starts anew, so an island is folded without its cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmerframe.operators.traces import by_blocks, near, normalise, per_cell, window_moments, with_quantiles

EVENT = "struct<t:bigint,a:double>"


def islands(candidates: DataFrame, gap: int) -> DataFrame:
    """(cell, events): candidates (cell, t, a) in order, in arrays that end where the next candidate is more than gap frames away."""
    by = Window.partitionBy("cell").orderBy("t")
    starts = F.when(F.col("t") - F.lag("t").over(by) <= gap, 0).otherwise(1)
    numbered = candidates.withColumn("__new", starts).withColumn("__i", F.sum("__new").over(by))
    return numbered.groupBy("cell", "__i").agg(F.array_sort(F.collect_list(F.struct("t", F.col("a").cast("double").alias("a")))).alias("events"))


def _folded(candidates: DataFrame, gap: int, step) -> DataFrame:
    empty = F.array().cast(f"array<{EVENT}>")
    kept = F.aggregate("events", empty, step)
    return islands(candidates, gap).select("cell", F.explode(kept).alias("e")).select("cell", "e.t", "e.a")


def keep_first(candidates: DataFrame, least: int) -> DataFrame:
    """Candidates (cell, t, a) at least `least` frames after the last kept one."""
    return _folded(candidates, least - 1, lambda kept, e: F.when((F.size(kept) == 0) | (e["t"] - F.element_at(kept, -1)["t"] >= least), F.array_append(kept, e)).otherwise(kept))


def merge(candidates: DataFrame, reach: int = 3) -> DataFrame:
    """Candidates (cell, t, a) merged: one within reach frames of the current event takes its place if it is larger, one further away opens the next event."""

    def step(kept: Column, e: Column) -> Column:
        last = F.element_at(kept, -1)
        replaced = F.array_append(F.slice(kept, 1, F.size(kept) - 1), e)
        return F.when((F.size(kept) == 0) | (e["t"] - last["t"] > reach), F.array_append(kept, e)).when(e["a"] > last["a"], replaced).otherwise(kept)

    return _folded(candidates, reach, step)


def mark(df: DataFrame, spikes: DataFrame, fit: Column | None = None) -> DataFrame:
    """(cell, t, fit, spike): every frame of df, spike 1.0 where spikes has it."""
    found = spikes.select("cell", "t", F.lit(1.0).alias("__s"))
    fit = F.lit(None).cast("double") if fit is None else fit
    return df.join(found, ["cell", "t"], "left").select("cell", "t", fit.alias("fit"), F.coalesce("__s", F.lit(0.0)).alias("spike"))


def leaky(df: DataFrame, decay: Column, block: int) -> DataFrame:
    """df (cell, t, value, spike) with fit: c[1] = value[1], c[i] = c[i - 1] * exp(-decay[i - 1]) + spike[i - 1]; decay in terms of the earlier frame.

    A block of frames turns what comes into it, c, into a * c + b; the blocks of a cell are chained by these two numbers each, so nothing is forgotten however far back.
    """
    kind = df.schema["cell"].dataType.simpleString()
    wide = df.withColumn("__d", decay).withColumn("__block", F.floor((F.col("t") - 1) / block))
    by = Window.partitionBy("cell", "__block").orderBy("t")
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.withColumn("__sum", F.coalesce(F.sum("__d").over(past), F.lit(0.0)))
    wide = wide.withColumn("__c", F.coalesce(F.sum(F.col("spike") * F.exp(F.col("__sum") + F.col("__d"))).over(past), F.lit(0.0)) * F.exp(-F.col("__sum")))
    end = F.exp(-(F.col("__sum") + F.col("__d")))
    blocks = wide.groupBy("cell", "__block").agg(F.max_by(end, "t").alias("a"), F.max_by(F.col("__c") * F.exp(-F.col("__d")) + F.col("spike"), "t").alias("b"), F.max(F.when(F.col("t") == 1, F.col("value"))).alias("first"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, into = [], [], []
            for i, parts in enumerate(batch.column(1).to_pylist()):
                c = 0.0
                for p in parts:
                    c = c if p["first"] is None else p["first"]
                    rows.append(i)
                    number.append(p["__block"])
                    into.append(c)
                    c = p["a"] * c + p["b"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int64()), pa.array(into, pa.float64())], ["cell", "__block", "__into"])

    # some numbers a block of each cell
    numbers = blocks.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("__block", "a", "b", "first"))).alias("parts"))
    chained = numbers.mapInArrow(chain, f"cell {kind}, __block long, __into double")
    wide = wide.join(chained, ["cell", "__block"])
    return wide.withColumn("fit", F.col("__c") + F.col("__into") * F.exp(-F.col("__sum"))).drop("__block", "__d", "__sum", "__c", "__into")


def ar1_fit(df: DataFrame, spikes: DataFrame, tau: float = 10.0) -> DataFrame:
    """(cell, t, fit, spike): every spike adds one, the sum decays by exp(-1 / tau) a frame."""
    marked = df.join(mark(df, spikes).drop("fit"), ["cell", "t"])
    return leaky(marked, F.lit(1.0 / tau), max(1, int(200 * tau))).select("cell", "t", "fit", "spike")


def concentration(df: DataFrame, spikes: DataFrame) -> DataFrame:
    """(cell, t, fit, spike): a frame after a spike is one higher than it, any other frame exp(-1) of the one before."""
    marked = df.join(mark(df, spikes).drop("fit"), ["cell", "t"])
    return leaky(marked, F.lit(1.0) - F.col("spike"), 300).select("cell", "t", "fit", "spike")


def detrended(df: DataFrame) -> DataFrame:
    """df with a: value minus its 21-frame mean, where that is missing minus the cell's median."""
    f = near(df, 10, 10, lambda over: {"__m": F.when(F.count("value").over(over(-10, 10)) == 21, F.avg("value").over(over(-10, 10)))})
    return with_quantiles(f, "value", __q=0.5).withColumn("a", F.col("value") - F.coalesce("__m", "__q")).drop("__m", "__q")


def oasis_events(df: DataFrame, factor: float = 0.1) -> DataFrame:
    """(cell, t, a): merged events of frames more than factor sds of the detrended trace above it."""
    f = per_cell(detrended(df), F.stddev_samp("a").alias("__s"))
    return merge(f.filter(F.col("a") > factor * F.col("__s")).select("cell", "t", "a"), 3)


def oasis(df: DataFrame, factor: float = 0.1) -> DataFrame:
    """Threshold on the detrended trace, merging, first-order decay fit. Cells of fewer than 21 frames go to fallback()."""
    n = df.groupBy("cell").agg(F.count("*").alias("__n"))
    long = df.join(n.filter(F.col("__n") >= 21).select("cell"), "cell", "left_semi")
    short = df.join(n.filter(F.col("__n") < 21).select("cell"), "cell", "left_semi")
    return ar1_fit(long, oasis_events(long, factor)).unionByName(fallback(short))


def fallback(df: DataFrame) -> DataFrame:
    """spike where the value exceeds two sds of its cell; fit is the 5-frame mean, the value itself at the edges."""
    f = near(df, 2, 2, lambda over: {"__m": F.when(F.count("value").over(over(-2, 2)) == 5, F.avg("value").over(over(-2, 2)))})
    f = per_cell(f, F.stddev_samp("value").alias("__s"))
    return f.select("cell", "t", F.coalesce("__m", "value").alias("fit"), F.coalesce((F.col("value") > 2 * F.col("__s")).cast("double"), F.lit(0.0)).alias("spike"))


def difference(df: DataFrame, threshold: float = 2.5, refractory: int = 3) -> DataFrame:
    """spike where the step of the z-score exceeds the threshold, with a refractory period; no fit."""
    z = normalise(df, "zscore")
    d = near(z, 1, 0, lambda over: {"a": F.col("value") - F.max("value").over(over(-1, -1))})
    return mark(df, keep_first(d.filter(F.col("a") > threshold).select("cell", "t", "a"), refractory))


def local_threshold(df: DataFrame) -> DataFrame:
    """spike where the value exceeds the mean plus two sds of the frames around it (a fifth of ten percent of the trace each way, at most 25), first of every group within 5 frames; no fit."""

    def above(x: np.ndarray, figures: dict[str, float]) -> np.ndarray:
        half, x = int(min(50, figures["__n"] // 10)) // 2, x - (np.nanmean(x) if np.isfinite(x).any() else 0.0)
        n, s, q = window_moments(x, half, half)
        with np.errstate(all="ignore"):
            return np.where(x > s / n + 2 * np.sqrt(np.maximum(0.0, (q - s * s / n) / (n - 1))), x, np.nan)

    found = by_blocks(per_cell(df, F.count("*").alias("__n")), 25, 25, above, ("__n",)).filter(F.col("value").isNotNull())
    return mark(df, keep_first(found.select("cell", "t", F.col("value").alias("a")), 6))


def peaks(df: DataFrame, least: float | None = None) -> DataFrame:
    """(cell, t, a): strict local maxima, at least `least` high if given."""
    f = near(df, 1, 1, lambda over: {"__l": F.max("value").over(over(-1, -1)), "__r": F.max("value").over(over(1, 1))})
    c = f.filter((F.col("value") > F.col("__l")) & (F.col("value") > F.col("__r")))
    return (c if least is None else c.filter(F.col("value") >= least)).select("cell", "t", F.col("value").alias("a"))


def high_peaks(df: DataFrame, q: float = 0.8) -> DataFrame:
    """spike at local maxima above the q-quantile of their cell's maxima; no fit."""
    return mark(df, with_quantiles(peaks(df), "a", __q=q).filter(F.col("a") > F.col("__q")))


def gated_threshold(df: DataFrame, window: int = 20) -> DataFrame:
    """spike where the z-score, scaled by 1 + 0.1 slope + 0.05 lag-1 autocorrelation of the window that begins there, exceeds the mean plus two sds around.

    The last window - 1 frames count as 0.
    """
    w, last = window, window - 1
    z = normalise(df, "zscore")
    z = near(z, 0, 1, lambda over: {"__p": F.col("value") * F.max("value").over(over(1, 1)), "__tx": F.col("t") * F.col("value")})
    s = near(z, 0, last, lambda over: {"__n": F.count("value").over(over(0, last)), "__s": F.sum("value").over(over(0, last)), "__q": F.sum(F.col("value") * F.col("value")).over(over(0, last)), "__k": F.sum("__tx").over(over(0, last)), "__c": F.sum("__p").over(over(0, last - 1)), "__e": F.max("value").over(over(last, last))})
    m = F.col("__s") / w
    slope = (F.col("__k") - F.col("t") * F.col("__s") - (last / 2) * F.col("__s")) / (w * (w * w - 1) / 12)
    acf = F.try_divide(F.col("__c") - m * (2 * F.col("__s") - F.col("value") - F.col("__e")) + last * m * m, F.col("__q") - w * m * m)
    y = s.select("cell", "t", F.when(F.col("__n") == w, F.col("value") * (1 + 0.1 * slope + 0.05 * acf)).otherwise(F.lit(0.0)).alias("value"))
    half = window // 2
    y = near(y, half, half, lambda over: {"__m": F.avg("value").over(over(-half, half)), "__d": F.stddev_samp("value").over(over(-half, half))})
    return concentration(df, y.filter(F.col("value") > F.col("__m") + 2 * F.col("__d")).select("cell", "t"))


EDGE, PEAK = (-1.0, -1.0, 0.0, 1.0, 1.0), (-1.0, -0.5, 0.0, 0.5, 1.0)


def convolution(df: DataFrame, kernel: tuple[float, ...]) -> DataFrame:
    """value as the kernel's weighted sum of the frames around; near a cell's first frame the kernel begins at that frame."""
    h = len(kernel) // 2
    at = {o: F.max("value") for o in range(-h, h + 1)}
    f = near(df, h, h, lambda over: {f"__{o + h}": c.over(over(o, o)) for o, c in at.items()})
    weights = F.array(*[F.lit(k) for k in kernel])
    shift = F.least(F.col("t") - 1, F.lit(h))
    total = F.lit(0.0)
    for o in range(-h, h + 1):
        place = (F.lit(o + 1) + shift).cast("int")
        total += F.when(F.col(f"__{o + h}").isNotNull() & (place >= 1) & (place <= len(kernel)), F.col(f"__{o + h}") * F.get(weights, place - 1)).otherwise(F.lit(0.0))
    return f.select("cell", "t", total.alias("value"))


def conv_threshold(df: DataFrame) -> DataFrame:
    """spike where 0.4 edge + 0.3 smooth + 0.3 peak response of the z-score, cut at 0, exceeds its 90th percentile, with a refractory period of 3 frames."""
    kernel = tuple(0.4 * e + 0.3 / 5 + 0.3 * p for e, p in zip(EDGE, PEAK))
    y = convolution(normalise(df, "zscore"), kernel).withColumn("a", F.greatest("value", F.lit(0.0)))
    return concentration(df, keep_first(with_quantiles(y, "a", __q=0.9).filter(F.col("a") > F.col("__q")).select("cell", "t", "a"), 3))


def attention(df: DataFrame, window: int = 30) -> DataFrame:
    """(cell, t, value): banded attention. 0.6 of the mean weighted by nearness and similarity, 0.4 of the mean of three: by nearness in half the window, by distance from the cell's mean, and by recency.

    The band is a matrix of frames by 2 * window + 1 neighbours, for a block of frames at a time.
    """
    z = per_cell(normalise(df, "zscore"), F.sum(F.abs("value")).alias("__g"))
    w, half = window, window // 2
    gap = np.abs(np.arange(-w, w + 1))
    near_w, near_h = np.exp(-gap / w), np.where(gap <= half, np.exp(-gap / max(half, 1)), 0.0)

    def attend(x: np.ndarray, figures: dict[str, float]) -> np.ndarray:
        band = np.lib.stride_tricks.sliding_window_view(np.pad(x, w, constant_values=np.nan), 2 * w + 1)
        out = np.empty(len(x))
        for a in range(0, len(x), 20_000):
            b, own = band[a : a + 20_000], x[a : a + 20_000, None]
            there = np.isfinite(b)
            v = np.where(there, b, 0.0)

            def mean(weight: np.ndarray, v: np.ndarray = v, there: np.ndarray = there) -> np.ndarray:
                weight = weight * there
                return (weight * v).sum(1) / weight.sum(1)

            with np.errstate(all="ignore"):
                # recency counts from the first frame of the band that is there
                age = np.where(np.arange(2 * w + 1) <= w, np.arange(2 * w + 1) - np.argmax(there, 1)[:, None] + 1, 0)
                own_part = np.nan_to_num(np.abs(own[:, 0]) / figures["__g"] * own[:, 0]) if figures["__g"] else 0.0
                out[a : a + 20_000] = 0.6 * mean(near_w / (1 + np.abs(v - own))) + 0.4 * (mean(np.broadcast_to(near_h, b.shape)) + own_part + mean(age.astype(float))) / 3
        return out

    return by_blocks(z, window, window, attend, ("__g",))


def attention_threshold(df: DataFrame, window: int = 30) -> DataFrame:
    """spike where attention() exceeds its 90th percentile."""
    a = with_quantiles(attention(df, window), "value", __q=0.9)
    return concentration(df, a.filter(F.col("value") > F.col("__q")).select("cell", "t"))


def mean_threshold(df: DataFrame, sds: float = 2.0) -> DataFrame:
    """spike where the value exceeds the cell's mean plus so many sds; no fit."""
    f = per_cell(df, F.avg("value").alias("__m"), F.stddev_samp("value").alias("__s"))
    return mark(df, f.filter(F.col("value") > F.col("__m") + sds * F.col("__s")).select("cell", "t"))


def rolling_threshold(df: DataFrame, window: int | None = None) -> DataFrame:
    """spike where the value exceeds the centred rolling mean plus two rolling sds; no fit. The rolling sd is the root of the mean, over the window, of the squared distances of frames from their own rolling means.

    window: frames, by default a twentieth of the cell's, at least 5 and at most 50; frames without a full window of full windows are none.
    """
    most = window or 50

    def above(x: np.ndarray, figures: dict[str, float]) -> np.ndarray:
        w = window or max(5, min(50, int(figures["__n"]) // 20))
        before, after = (w - 1) // 2, w // 2
        x = x - (np.nanmean(x) if np.isfinite(x).any() else 0.0)
        n, s, _ = window_moments(x, before, after)
        d = (x - np.where(n == w, s / w, np.nan)) ** 2
        k, q, _ = window_moments(d, before, after)
        with np.errstate(all="ignore"):
            return np.where((k == w) & (x > s / w + 2 * np.sqrt(q / w)), 1.0, np.nan)

    found = by_blocks(per_cell(df, F.count("*").alias("__n")), most, most, above, ("__n",)).filter(F.col("value").isNotNull())
    return mark(df, found.select("cell", "t"))


def sliding_windows(df: DataFrame, size: int = 20) -> DataFrame:
    """(cell, t, values): the readings of frames t .. t + size - 1, for every t whose window is whole and lacks none."""
    f = near(df, 0, size - 1, lambda over: {"values": F.collect_list("value").over(over(0, size - 1))})
    return f.filter(F.size("values") == size).select("cell", "t", "values")


def window_features(df: DataFrame, size: int = 20) -> DataFrame:
    """(cell, t, mean, sd, trend, autocorr) of the whole window that begins at t: mean, sample sd, least-squares slope, lag-1 autocorrelation."""
    w, last = size, size - 1
    z = near(df, 0, 1, lambda over: {"__p": F.col("value") * F.max("value").over(over(1, 1)), "__tx": F.col("t") * F.col("value")})
    s = near(z, 0, last, lambda over: {"__n": F.count("value").over(over(0, last)), "__s": F.sum("value").over(over(0, last)), "sd": F.stddev_samp("value").over(over(0, last)), "__q": F.sum(F.col("value") * F.col("value")).over(over(0, last)), "__k": F.sum("__tx").over(over(0, last)), "__c": F.sum("__p").over(over(0, last - 1)), "__e": F.max("value").over(over(last, last))})
    m = F.col("__s") / w
    slope = (F.col("__k") - F.col("t") * F.col("__s") - (last / 2) * F.col("__s")) / (w * (w * w - 1) / 12)
    acf = F.try_divide(F.col("__c") - m * (2 * F.col("__s") - F.col("value") - F.col("__e")) + last * m * m, F.col("__q") - w * m * m)
    return s.filter(F.col("__n") == w).select("cell", "t", m.alias("mean"), "sd", slope.alias("trend"), acf.alias("autocorr"))


def lags(df: DataFrame, most: int = 5) -> DataFrame:
    """(cell, t, lag_1 .. lag_most): the readings of the frames before, for frames that have all of them."""
    f = near(df, most, 0, lambda over: {f"lag_{i}": F.max("value").over(over(-i, -i)) for i in range(1, most + 1)})
    return f.select("cell", "t", *[f"lag_{i}" for i in range(1, most + 1)]).dropna()


def spike_probability(df: DataFrame, interval: int = 5) -> DataFrame:
    """(cell, t, probability): 0.8 at frames above mean plus two sds that are more than interval frames after the last such one, 0.3 at the others of these, else 0.1."""
    f = mean_threshold(df).filter(F.col("spike") > 0).select("cell", "t", F.lit(1.0).alias("a"))
    kept = keep_first(f, interval + 1).select("cell", "t", F.lit(0.8).alias("__k"))
    return df.select("cell", "t").join(f, ["cell", "t"], "left").join(kept, ["cell", "t"], "left").select("cell", "t", F.coalesce("__k", F.when(F.col("a").isNotNull(), F.lit(0.3)), F.lit(0.1)).alias("probability"))


DETECTORS = {"oasis": oasis, "caiman": oasis, "suite2p": difference, "deep": gated_threshold, "thresholded": local_threshold, "peaks": high_peaks, "conv": conv_threshold, "attention": attention_threshold, "mean": mean_threshold, "rolling": rolling_threshold, "fallback": fallback}


def infer_spikes(df: DataFrame, method: str = "oasis") -> DataFrame:
    """(cell, t, fit, spike) by a named detector."""
    if method not in DETECTORS:
        raise ValueError(f"method must be one of {', '.join(DETECTORS)}")
    return DETECTORS[method](df)


def spike_metrics(spikes: DataFrame) -> DataFrame:
    """(cell, n_spikes, rate, mean_isi, cv_isi) of (cell, t, spike); the last two null without two (cv: three) spikes."""
    isi = spikes.filter(F.col("spike") > 0).select("cell", (F.col("t") - F.lag("t").over(Window.partitionBy("cell").orderBy("t"))).cast("double").alias("isi"))
    isi = isi.groupBy("cell").agg(F.avg("isi").alias("mean_isi"), F.try_divide(F.stddev_samp("isi"), F.avg("isi")).alias("cv_isi"))
    base = spikes.groupBy("cell").agg(F.sum(F.when(F.col("spike") > 0, 1).otherwise(0)).alias("n_spikes"), F.avg(F.when(F.col("spike") > 0, 1.0).otherwise(0.0)).alias("rate"))
    return base.join(isi, "cell", "left")


def validate_spikes(df: DataFrame, spikes: DataFrame) -> DataFrame:
    """(cell, n_spikes, rate, min_interval, mean_amplitude, too_many, too_close): counts with the warnings above half the frames and below 3 frames between spikes."""
    s = df.join(spikes.select("cell", "t", "spike"), ["cell", "t"])
    gap = s.filter(F.col("spike") > 0).select("cell", "value", (F.col("t") - F.lag("t").over(Window.partitionBy("cell").orderBy("t"))).alias("g"))
    gap = gap.groupBy("cell").agg(F.min("g").alias("min_interval"), F.avg("value").alias("mean_amplitude"))
    base = s.groupBy("cell").agg(F.sum(F.when(F.col("spike") > 0, 1).otherwise(0)).alias("n_spikes"), F.avg(F.when(F.col("spike") > 0, 1.0).otherwise(0.0)).alias("rate"))
    return base.join(gap, "cell", "left").select("cell", "n_spikes", "rate", "min_interval", "mean_amplitude", (F.col("rate") > 0.5).alias("too_many"), F.coalesce(F.col("min_interval") < 3, F.lit(False)).alias("too_close"))


def spike_report(df: DataFrame, spikes: DataFrame) -> DataFrame:
    """(cell, n_spikes, rate, violation_rate, weak_rate, quality): intervals below 5 frames, spikes below 0.1 of the value, and the score
    0.4 max(0, 1 - |rate - 0.02| / 0.02) + 0.3 max(0, 1 - violation_rate) + 0.3 max(0, 1 - weak_rate)."""
    s = df.join(spikes.select("cell", "t", "spike"), ["cell", "t"])
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("cell").orderBy("t"))
    own = s.filter(F.col("spike") > 0).withColumn("g", gap).groupBy("cell").agg(F.avg(F.when(F.col("g").isNotNull(), (F.col("g") < 5).cast("int"))).alias("v"), F.avg((F.col("value") < 0.1).cast("int")).alias("w"))
    base = s.groupBy("cell").agg(F.sum(F.when(F.col("spike") > 0, 1).otherwise(0)).alias("n_spikes"), F.avg(F.when(F.col("spike") > 0, 1.0).otherwise(0.0)).alias("rate")).join(own, "cell", "left")
    zero = F.lit(0.0)
    quality = 0.4 * F.greatest(zero, 1 - F.abs(F.col("rate") - 0.02) / 0.02) + 0.3 * F.greatest(zero, 1 - F.col("violation_rate")) + 0.3 * F.greatest(zero, 1 - F.col("weak_rate"))
    return base.select("cell", "n_spikes", "rate", F.coalesce("v", zero).alias("violation_rate"), F.coalesce("w", zero).alias("weak_rate")).withColumn("quality", quality)
