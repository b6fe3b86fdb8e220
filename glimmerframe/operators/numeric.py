"""Grouped numeric operators: one trace or one small matrix at a time in NumPy, everything around it in Spark.

A group is one cell's trace or one recording's matrix; its size is the operator's own input size. Columns are selected before the call, so only what
the kernel needs crosses to Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmerframe.config import CONFIG
from glimmerframe.functions import kernels as K
from glimmerframe.operators import traces as T
from glimmerframe.session import spread


def _seed(*key) -> np.random.Generator:
    """A generator that depends on the group's key and the seed only, so that a task that is run again gives the same."""
    import hashlib

    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little"))


def per_trace(df: DataFrame, run: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(cell, t, value) with value from run(t, value) over each cell in order of t; missing readings are NaN there and null here."""
    kind = df.schema["cell"].dataType.simpleString()

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("t")
        out = run(p["t"].to_numpy(), p["value"].to_numpy(float))
        return p.assign(value=pd.Series(out, index=p.index).where(np.isfinite(out)))[["cell", "t", "value"]]

    return spread(df.select("cell", "t", "value"), "cell").groupBy("cell").applyInPandas(one, f"cell {kind}, t long, value double")


HELD_ROWS = 100_000


def whole_traces(df: DataFrame, run: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """run(rows, starts) over rows (cell, t, value) of whole cells in order of t, many cells at a time; starts are the cells' first rows.

    For short traces, where a call of Python for every cell costs more than what is done in it. At most one cell is held beyond some rows.
    """
    by = Window.partitionBy("cell").orderBy("t")
    rows = spread(df.select("cell", F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value")), "cell").withColumn("__first", F.row_number().over(by) == 1)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            starts = np.flatnonzero(batch.column("__first").to_numpy(zero_copy_only=False))
            if n >= HELD_ROWS and len(starts):
                yield whole([*held, batch.slice(0, starts[-1])])
                batch, held, n = batch.slice(starts[-1]), [], 0
            held.append(batch)
            n += batch.num_rows
        if n:
            yield whole(held)

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        return run(table.drop_columns("__first"), np.flatnonzero(table["__first"].to_numpy()))

    return rows.mapInArrow(stream, schema)


def _pieces(t: np.ndarray, y: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(which, at, whole): pieces and the places of their rows, as many pieces of one size as there are together where no frame or reading is missing (whole), else one by one."""
    size, gap = np.diff(np.append(starts, len(y))), np.append(False, np.diff(t) != 1)
    gap[starts] = False
    like = ~np.logical_or.reduceat(gap | ~np.isfinite(y), starts)
    for n in np.unique(size[like]):
        which = np.flatnonzero(like & (size == n))
        yield which, starts[which, None] + np.arange(n), True
    for i in np.flatnonzero(~like):
        yield np.array([i]), np.arange(starts[i], starts[i] + size[i])[None], False


def fitted(t: np.ndarray, y: np.ndarray, starts: np.ndarray, spans: tuple[float, ...]) -> list[np.ndarray]:
    """K.loess of each piece of y for each span; starts are the pieces' first places. Pieces that have readings at the same consecutive frames are fitted together."""
    out = [np.empty(len(y)) for _ in spans]
    for _, at, whole in _pieces(t, y, starts):
        if whole and at.shape[1] >= 3:
            for a in np.unique(t[at[:, 0]]):
                like = at[t[at[:, 0]] == a]
                for o, fit in zip(out, K.local_fits(t[like[0]].astype(float), y[like], spans)):
                    o[like] = fit
        else:
            for one in at:
                for o, span in zip(out, spans):
                    o[one] = K.loess(t[one], y[one], span)
    return out


SURFACES = {"direct": K.loess, "interpolate": K.loess_interpolated}


def loess_baseline(df: DataFrame, span: float = CONFIG.span, surface: str = "direct") -> DataFrame:
    """The local quadratic fit at every frame (direct), or at a few vertices with interpolation between them (interpolate: for long traces)."""
    if surface not in SURFACES:
        raise ValueError("surface must be direct or interpolate")
    fit = SURFACES[surface]
    return per_trace(df, lambda t, y: fit(t, y, span))


def correct(df: DataFrame, background: DataFrame | None = None, method: str = "modern", span: float = CONFIG.span, normalise: bool = True, surface: str = "direct") -> DataFrame:
    """Background-subtracted, normalised (value / mean, modern only) traces less their LOESS baseline; legacy adds 2 and does not normalise.

    span in [0.01, 1]; cells of null frames keep them; a cell of fewer than three readings has baseline 0.
    """
    if method not in ("modern", "legacy"):
        raise ValueError("method must be modern or legacy")
    if not 0.01 <= span <= 1:
        raise ValueError("span must be between 0.01 and 1")
    if surface not in SURFACES:
        raise ValueError("surface must be direct or interpolate")
    df = df if background is None else T.subtract_background(df, background)
    df = T.normalise(df) if method == "modern" and normalise else df
    add = 0.0 if method == "modern" else 2.0
    if surface != "direct":
        return per_trace(df, lambda t, y: y - SURFACES[surface](t, y, span) + add)

    def corrected(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        t, y = rows["t"].fill_null(0).to_numpy(), np.where(rows["t"].is_null().to_numpy(), np.nan, rows["value"].to_numpy())  # no frame, no value
        out = y - fitted(t, y, starts, (span,))[0] + add
        return pa.RecordBatch.from_arrays([rows["cell"].combine_chunks(), rows["t"].combine_chunks(), pa.array(out, mask=~np.isfinite(out))], ["cell", "t", "value"])

    return whole_traces(df, corrected, f"cell {df.schema['cell'].dataType.simpleString()}, t long, value double")


def in_chunks(df: DataFrame, operator: Callable[[DataFrame], DataFrame], rows: int = CONFIG.chunk_rows) -> DataFrame:
    """operator over chunks of so many frames of each cell, as if each were a cell of its own whose frames begin at 1; frames keep their t."""
    chunk = F.floor((F.col("t") - 1) / rows)
    keyed = df.select(F.struct(F.col("cell").alias("cell"), chunk.cast("long").alias("chunk")).alias("cell"), (F.col("t") - chunk * rows).cast("long").alias("t"), "value")
    out = operator(keyed)
    return out.withColumn("t", F.col("t") + F.col("cell.chunk") * rows).withColumn("cell", F.col("cell.cell"))


def ssa(df: DataFrame, window: int | None = None, k: int | None = None) -> DataFrame:
    """(cell, t, component, value): singular-spectrum components; their sum is the trace if k is not given. Cells with missing readings use the cell's mean there."""
    kind = df.schema["cell"].dataType.simpleString()

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("t")
        y = p["value"].fillna(p["value"].mean()).fillna(0.0).to_numpy(float)
        parts = K.ssa(y, window, k)[1]
        return pd.DataFrame({"cell": np.repeat(p["cell"].iloc[0], parts.size), "t": np.tile(p["t"].to_numpy(), len(parts)), "component": np.repeat(np.arange(1, len(parts) + 1), len(y)), "value": parts.ravel()})

    return spread(df.select("cell", "t", "value"), "cell").groupBy("cell").applyInPandas(one, f"cell {kind}, t long, component int, value double")


def emd(df: DataFrame, most: int = 10) -> DataFrame:
    """(cell, t, component, value): modes 1.., and component 0 for the rest; the sum is the trace."""
    kind = df.schema["cell"].dataType.simpleString()

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("t")
        y = p["value"].fillna(p["value"].mean()).fillna(0.0).to_numpy(float)
        parts = K.emd(y, most)
        names = [*range(1, len(parts)), 0]
        return pd.DataFrame({"cell": np.repeat(p["cell"].iloc[0], parts.size), "t": np.tile(p["t"].to_numpy(), len(parts)), "component": np.repeat(names, len(y)), "value": parts.ravel()})

    return spread(df.select("cell", "t", "value"), "cell").groupBy("cell").applyInPandas(one, f"cell {kind}, t long, component int, value double")


def haar_denoise(df: DataFrame, levels: int = 3, noise: float = 0.1) -> DataFrame:
    return per_trace(df, lambda t, y: K.haar(np.nan_to_num(y, nan=np.nanmean(y) if np.isfinite(y).any() else 0.0), levels, noise))


MATRIX = "part string, i int, j int, value double"


def per_matrix(df: DataFrame, key: str, run: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """(key, part, i, j, value) from run over each recording's frames x cells matrix (missing 0); rows in order of t, columns in order of cell."""
    kind = df.schema[key].dataType.simpleString()

    def one(p: pd.DataFrame) -> pd.DataFrame:
        m = p.pivot_table(index="t", columns="cell", values="value", aggfunc="max").fillna(0.0).to_numpy(float)
        out = []
        for part, x in run(m).items():
            i, j = np.indices(x.shape)
            out.append(pd.DataFrame({key: p[key].iloc[0], "part": part, "i": i.ravel() + 1, "j": j.ravel() + 1, "value": x.ravel()}))
        return pd.concat(out)

    return spread(df.select(key, "cell", "t", "value"), key).groupBy(key).applyInPandas(one, f"{key} {kind}, {MATRIX}")


def robust_pca(df: DataFrame, key: str) -> DataFrame:
    """Parts low_rank and sparse of each matrix."""
    return per_matrix(df, key, lambda m: dict(zip(("low_rank", "sparse"), K.robust_pca(m))))


def nmf(df: DataFrame, key: str, rank: int = 3, method: str = "multiplicative") -> DataFrame:
    """Parts w (frames x rank) and h (rank x cells)."""
    return per_matrix(df, key, lambda m: dict(zip("wh", K.nmf(m, rank, method=method))))


def ica(df: DataFrame, key: str, k: int = 2, method: str = "fastica") -> DataFrame:
    """Parts sources (frames x k) and unmixing (k x cells); method fastica, infomax or pca."""
    return per_matrix(df, key, lambda m: dict(zip(("sources", "unmixing"), K.ica(m, k, method=method))))


def bootstrap_counts(df: DataFrame, draws: int = CONFIG.bootstraps, confidence: float = CONFIG.confidence, seed: int = 1) -> DataFrame:
    """(cell, frames, count_low, count_high, rate_low, rate_high): percentile intervals of the oasis detector's spike count and rate over resamples of frames with replacement.

    All draws of a cell are detected together; missing readings are left out, cells of less than two readings have no interval.
    """
    kind = df.schema["cell"].dataType.simpleString()
    ends = [(1 - confidence) / 2, (1 + confidence) / 2]

    def one(p: pd.DataFrame) -> pd.DataFrame:
        y = p.dropna(subset=["value"]).sort_values("t")["value"].to_numpy(float)
        g, counts = _seed(seed, "bootstrap", p["cell"].iloc[0]), []
        for a in range(0, draws if len(y) > 1 else 0, max(1, 4_000_000 // max(1, len(y)))):
            some = min(draws - a, max(1, 4_000_000 // len(y)))
            counts.append(K.oasis_counts(y[g.integers(0, len(y), (some, len(y)))]))
        low, high = np.quantile(np.concatenate(counts), ends) if counts else (np.nan, np.nan)
        n = max(len(y), 1)
        return pd.DataFrame({"cell": p["cell"].iloc[:1], "frames": [len(y)], "count_low": [low], "count_high": [high], "rate_low": [low / n], "rate_high": [high / n]})

    return spread(df.select("cell", "t", "value"), "cell").groupBy("cell").applyInPandas(one, f"cell {kind}, frames long, count_low double, count_high double, rate_low double, rate_high double")


def bootstrap_by(df: DataFrame, detector: Callable[[DataFrame], DataFrame], draws: int = CONFIG.bootstraps, confidence: float = CONFIG.confidence, seed: int = 1) -> DataFrame:
    """(cell, count_low, count_high, rate_low, rate_high): as bootstrap_counts, for any detector.

    Each resample is a cell of its own for the detector, so the work is spread over cells x draws.
    """
    sized = df.join(df.groupBy("cell").agg(F.count("*").alias("__n")), "cell")
    slots = sized.select("cell", "t", "__n").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    pick = F.pmod(F.xxhash64("cell", "t", "draw", F.lit(seed)), F.col("__n")) + 1
    source = df.withColumn("pick", F.row_number().over(Window.partitionBy("cell").orderBy("t")).cast("long")).select("cell", "pick", "value")
    resampled = slots.withColumn("pick", pick).join(source, ["cell", "pick"]).select(F.struct("cell", "draw").alias("cell"), "t", "value", "__n")
    marked = detector(resampled.select("cell", "t", "value")).groupBy("cell").agg(F.sum("spike").alias("n"), F.avg("spike").alias("r"))
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    q = marked.groupBy(F.col("cell.cell").alias("cell")).agg(F.percentile("n", F.array(F.lit(low), F.lit(high))).alias("c"), F.percentile("r", F.array(F.lit(low), F.lit(high))).alias("f"))
    return q.select("cell", F.get("c", F.lit(0)).alias("count_low"), F.get("c", F.lit(1)).alias("count_high"), F.get("f", F.lit(0)).alias("rate_low"), F.get("f", F.lit(1)).alias("rate_high"))


def metric(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """(by, score) over corrected traces: snr (mean over cells of mean / sd), baseline_stability (minus the mean sd of the 50-frame mean) or spike_detection."""
    if name == "snr":
        return df.groupBy(*by, "cell").agg(F.try_divide(F.avg("value"), F.stddev_samp("value")).alias("s")).groupBy(*by).agg(F.avg("s").alias("score"))
    if name == "baseline_stability":
        keyed = df.withColumn("cell", F.struct(*by, "cell"))
        return T.moving_mean(keyed, 50, "m").groupBy("cell").agg(F.stddev_samp("m").alias("s")).groupBy(*[F.col(f"cell.{b}").alias(b) for b in by]).agg((-F.avg("s")).alias("score"))
    if name == "spike_detection":
        cell = df.groupBy(*by, "cell").agg(F.stddev_samp("value").alias("__s"))
        rate = df.join(cell, [*by, "cell"]).groupBy(*by, "cell").agg(F.avg((F.col("value") > 2 * F.col("__s")).cast("int")).alias("r"))
        good = F.when(F.col("r").between(0.001, 0.1), 1 - F.abs(F.col("r") - 0.02) / 0.02).otherwise(F.lit(0.0))
        return rate.groupBy(*by).agg(F.avg(good).alias("score"))
    raise ValueError("metric must be snr, baseline_stability or spike_detection")


def folds(df: DataFrame, k: int = CONFIG.cv_folds) -> DataFrame:
    """df with fold 0..k-1: contiguous stretches of floor(n / k) frames of a cell, the last one with what is left."""
    n = df.groupBy("cell").agg(F.count("*").alias("__n"))
    size = F.greatest(F.lit(1), F.floor(F.col("__n") / k))
    return df.join(n, "cell").withColumn("fold", F.least(F.floor((F.col("t") - 1) / size), F.lit(k - 1)).cast("int")).drop("__n")


def _sd(x: np.ndarray) -> np.ndarray:
    """Sample standard deviation of each row without its NaN; NaN for fewer than two; exactly 0 for equal values."""
    good = ~np.isnan(x)
    n = good.sum(1)
    d = np.where(good, x - x[np.arange(len(x)), good.argmax(1)][:, None], 0.0)
    return np.where(n > 1, np.sqrt(np.where(good, (d - (d.sum(1) / n)[:, None]) ** 2, 0.0).sum(1) / (n - 1)), np.nan)


def _scores(x: np.ndarray, means: np.ndarray, target: str) -> np.ndarray:
    """metric() of each row of x (NaN where a reading is missing); means: the 50-frame means of each of the rows."""
    with np.errstate(all="ignore"):
        if target == "baseline_stability":
            return -_sd(means) if means.shape[1] else np.full(len(x), np.nan)
        good, s = ~np.isnan(x), _sd(x)
        n = good.sum(1)
        if target == "snr":  # the sum in order of frames, as its rounding is all that is left where a fit is a line through all readings
            return np.where(s > 0, np.cumsum(np.where(good, x, 0.0), 1)[:, -1] / n / s, np.nan)
        r = np.where(n > 1, (x > 2 * s[:, None]).sum(1) / n, np.nan)
        return np.where((r >= 0.001) & (r <= 0.1), 1 - np.abs(r - 0.02) / 0.02, 0.0)


def _means(x: np.ndarray, k: int = 50) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, k, 1).mean(2) if x.shape[1] >= k else np.empty((len(x), 0))


METRICS = ("snr", "baseline_stability", "spike_detection")


def fold_scores(df: DataFrame, k: int, names: list[str], run: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(fold, names): the mean over cells of what run(t, value, starts) gives for each of the folds() of a cell, pieces x names (NaN: none). Only a row a piece leaves Python."""

    def scored(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        size = np.diff(np.append(starts, rows.num_rows))
        n, cell = np.repeat(size, size), np.repeat(np.arange(len(size)), size)
        frame = ~rows["t"].is_null().to_numpy()
        t, y, n, cell = rows["t"].filter(pa.array(frame)).to_numpy(), rows["value"].to_numpy()[frame].copy(), n[frame], cell[frame]
        fold = np.minimum((t - 1) // np.maximum(1, n // k), k - 1)
        first = np.flatnonzero(np.append(True, (np.diff(cell) != 0) | (np.diff(fold) != 0))[: len(t)])
        found = run(t, y, first) if len(t) else np.empty((0, len(names)))
        return pa.RecordBatch.from_arrays([pa.array(fold[first]), *[pa.array(c, mask=np.isnan(c)) for c in found.T]], ["fold", *names])

    done = whole_traces(df.filter(F.col("cell").isNotNull()), scored, "fold long, " + ", ".join(f"{c} double" for c in names))
    return done.groupBy("fold").agg(*[F.avg(c).alias(c) for c in names])


def span_scores(df: DataFrame, targets: tuple[str, ...] = ("snr",), spans: tuple[float, ...] = CONFIG.span_grid, k: int = CONFIG.cv_folds) -> DataFrame:
    """(target, span, score, best): the mean over folds of the metrics of each fold corrected with each span; best marks a metric's highest (least span of equals).

    Every fold of a cell is corrected once for all metrics. A row has every span, so that equal spans stay equal in sums.
    """
    if set(targets) - set(METRICS):
        raise ValueError("metric must be snr, baseline_stability or spike_detection")
    spans = tuple(map(float, spans))
    names = [f"s{i}" for i in range(len(targets) * len(spans))]

    def run(t: np.ndarray, y: np.ndarray, starts: np.ndarray) -> np.ndarray:
        for _, at, _ in _pieces(t, y, starts):
            with np.errstate(all="ignore"):
                mean = np.nanmean(y[at], 1, keepdims=True) if np.isfinite(y[at]).any() else np.nan
                y[at] = np.where(mean == 0, np.nan, y[at] / mean)
        fits, found = fitted(t, y, starts, spans), np.empty((len(starts), len(names)))
        for which, at, whole in _pieces(t, y, starts):
            for j, f in enumerate(fits):
                x = y[at] - f[at]
                if whole:
                    means = _means(x)
                else:  # of frames without a gap
                    parts = np.split(x[0], np.flatnonzero((np.diff(t[at[0]]) != 1) | np.isnan(x[0][1:]) | np.isnan(x[0][:-1])) + 1)
                    means = np.concatenate([_means(r[None]) for r in parts], 1)
                for i, target in enumerate(targets):
                    found[which, i * len(spans) + j] = _scores(x, means, target)
        return found

    mean = fold_scores(df, k, names, run).agg(*[F.avg(c).alias(c) for c in names])
    score = mean.select(F.explode(F.array(*[F.struct(F.lit(m).alias("target"), F.lit(x).alias("span"), F.col(names[i * len(spans) + j]).alias("score")) for i, m in enumerate(targets) for j, x in enumerate(spans)])).alias("e")).select("e.*")
    top = Window.partitionBy("target").orderBy(F.desc_nulls_last("score"), "span")  # a row a span
    return score.select("target", "span", "score", (F.row_number().over(top) == 1).alias("best"))


def rate_scores(df: DataFrame, k: int = CONFIG.cv_folds) -> DataFrame:
    """(fold, s): the mean over cells of the spike-rate score (1 - |rate - 0.02| / 0.02, 0 outside 0.001 to 0.1) of the oasis detector in each fold."""

    def run(t: np.ndarray, y: np.ndarray, starts: np.ndarray) -> np.ndarray:
        found = np.empty((len(starts), 1))
        for which, at, _ in _pieces(t, y, starts):
            r = K.oasis_counts(y[at], frames=t[at[0]] - t[at[0, 0]]) / at.shape[1]
            found[which, 0] = np.where((r < 0.001) | (r > 0.1), 0.0, 1 - np.abs(r - 0.02) / 0.02)
        return found

    return fold_scores(df, k, ["s"], run)


def optimise_span(df: DataFrame, target: str = "snr", spans: tuple[float, ...] = CONFIG.span_grid, k: int = CONFIG.cv_folds) -> DataFrame:
    """(span, score, best): span_scores of one metric."""
    return span_scores(df, (target,), spans, k).drop("target")


def _drawn(draws: int, burn: int) -> None:
    if draws < 1 or burn < 0:
        raise ValueError("draws must be 1 at least, burn not below 0")


def sample_spikes(df: DataFrame, model: str = "gaussian", draws: int = 1000, burn: int = 100, seed: int = 1) -> DataFrame:
    """(cell, t, draw, param, value): posterior spike probability per frame (t set, draw null) and parameter draws (t null)."""
    _drawn(draws, burn)
    if model not in ("gaussian", "poisson", "hierarchical"):
        raise ValueError("model must be gaussian, poisson or hierarchical")
    kind = df.schema["cell"].dataType.simpleString()

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna(subset=["value"]).sort_values("t")
        if len(p) < 10:
            return pd.DataFrame({"cell": [], "t": [], "draw": [], "param": [], "value": []})
        s = K.spike_sampler(p["value"].to_numpy(float), model, draws, burn, _seed(seed, model, p["cell"].iloc[0]))
        frames = pd.DataFrame({"cell": p["cell"], "t": p["t"].astype("Int64"), "draw": pd.array([None] * len(p), "Int64"), "param": "spike_probability", "value": s["spike_probability"]})
        rows = [pd.DataFrame({"cell": p["cell"].iloc[0], "t": pd.array([None] * draws, "Int64"), "draw": pd.array(range(1, draws + 1), "Int64"), "param": k, "value": s[k]}) for k in ("mean", "spread", "amplitude", "spikes")]
        return pd.concat([frames, *rows])

    return spread(df.select("cell", "t", "value"), "cell").groupBy("cell").applyInPandas(one, f"cell {kind}, t long, draw long, param string, value double")


def readings(df: DataFrame) -> DataFrame:
    """(cell, n, total, centre, spread): count, sum, mean and population variance of each cell's readings, in as many parts as Python work needs."""
    y = F.col("value").cast("double")
    y = F.when(~F.isnan(y), y)
    # by cell alone the parts would be those of the aggregation, which are merged as small ones
    return spread(df.groupBy("cell").agg(F.count(y).alias("n"), F.sum(y).alias("total"), F.avg(y).alias("centre"), F.var_pop(y).alias("spread")), "cell", "n")


def normal_posterior(df: DataFrame, draws: int = 1000, burn: int = 100, seed: int = 1) -> DataFrame:
    """(cell, n, centre, spread, draw, mean, variance): joint posterior draws of a cell's mean and variance beside the count, mean and population variance of its readings.

    Draws follow from these three figures, so no trace goes to Python, and what is asked of draws and readings together needs no join.
    """
    _drawn(draws, burn)
    kind = df.schema["cell"].dataType.simpleString()
    names, figures = ["cell", "n", "centre", "spread", "draw", "mean", "variance"], ("n", "centre", "spread")
    some = max(1, 400_000 // (draws + burn))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, some):
                part = batch.slice(a, some)
                x = [part.column(c).to_numpy(zero_copy_only=False) for c in figures]
                m, v = K.normal_draws(*x, draws, burn, [_seed(seed, "gaussian", c) for c in part.column("cell").to_pylist()])
                row = np.repeat(np.arange(part.num_rows), draws)
                yield pa.RecordBatch.from_arrays([part.column("cell").take(pa.array(row)), *[pa.array(c[row]) for c in x], pa.array(np.tile(np.arange(1, draws + 1), part.num_rows)), pa.array(m.ravel()), pa.array(v.ravel())], names)

    return readings(df).filter("n > 0").select("cell", *figures).mapInArrow(drawn, f"cell {kind}, n long, centre double, spread double, draw long, mean double, variance double")


def estimate_parameters(df: DataFrame, model: str = "gaussian", draws: int = 1000, burn: int = 100, seed: int = 1) -> DataFrame:
    """(cell, draw, param, value): posterior draws of mean and variance (gaussian) or of the rate, Gamma(1 + sum, 1 + n) (poisson)."""
    if model != "poisson":
        return normal_posterior(df, draws, burn, seed).unpivot(["cell", "draw"], ["mean", "variance"], "param", "value")
    _drawn(draws, burn)
    kind = df.schema["cell"].dataType.simpleString()

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (cell, n, total) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cell", "n", "total")))):
                rate = _seed(seed, model, cell).gamma(1 + max(total or 0.0, 0.0), 1 / (1 + n), draws)
                yield pa.RecordBatch.from_arrays([batch.column("cell").take(pa.array(np.full(draws, i))), pa.array(np.arange(1, draws + 1)), pa.array(["rate"] * draws), pa.array(rate)], ["cell", "draw", "param", "value"])

    return readings(df).select("cell", "n", "total").mapInArrow(drawn, f"cell {kind}, draw long, param string, value double")


def posterior_summary(draws: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.025, 0.5, 0.975)) -> DataFrame:
    """(by, n, mean, sd, lower, median, upper) of the finite draws; the three are the first, second and last of the quantiles."""
    v = draws.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    q = F.percentile("value", F.array(*[F.lit(x) for x in (quantiles[0], quantiles[min(1, len(quantiles) - 1)], quantiles[-1])]))
    s = v.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), q.alias("q"))
    return s.select(*by, "n", "mean", "sd", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("lower", "median", "upper"))])


def compare_groups(draws: DataFrame, a, b, param: str, ratio: bool = False) -> DataFrame:
    """(mean, lower, upper, p_greater) of the difference (or ratio) of a parameter's draws in two cells, joined on the draw."""
    x = draws.filter((F.col("param") == param) & (F.col("cell") == a)).select("draw", F.col("value").alias("x"))
    y = draws.filter((F.col("param") == param) & (F.col("cell") == b)).select("draw", F.col("value").alias("y"))
    d = x.join(y, "draw").select((F.try_divide("x", "y") if ratio else F.col("x") - F.col("y")).alias("d"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    return d.agg(F.avg("d").alias("mean"), F.get(q, F.lit(0)).alias("lower"), F.get(q, F.lit(1)).alias("upper"), F.avg((F.col("d") > (1.0 if ratio else 0.0)).cast("int")).alias("p_greater"))


def proportion_draws(df: DataFrame, above: float, draws: int = 1000, seed: int = 1) -> DataFrame:
    """(cell, draw, param, value): draws of the share of readings above a limit, Beta(1 + hits, 1 + misses); param proportion. For compare_groups."""
    _drawn(draws, 0)
    kind = df.schema["cell"].dataType.simpleString()
    counts = df.filter(F.col("value").isNotNull()).groupBy("cell").agg(F.count("*").alias("n"), F.sum((F.col("value") > above).cast("long")).alias("hits"))

    def one(it):
        for p in it:
            for cell, n, hits in zip(p["cell"], p["n"], p["hits"]):
                yield pd.DataFrame({"cell": cell, "draw": np.arange(1, draws + 1), "param": "proportion", "value": _seed(seed, "proportion", cell).beta(1 + hits, 1 + n - hits, draws)})

    return counts.mapInPandas(one, f"cell {kind}, draw long, param string, value double")


def frame_uncertainty(df: DataFrame, model: str = "gaussian", draws: int = 1000, burn: int = 100, confidence: float = CONFIG.confidence, seed: int = 1) -> DataFrame:
    """(cell, t, probability, sd, lower, upper): per frame the share of draws with a spike, the sd of that indicator, and the interval of its draws."""
    p = sample_spikes(df, model, draws, burn, seed).filter(F.col("t").isNotNull()).select("cell", "t", F.col("value").alias("probability"))
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    # draws of an indicator are ones and zeros: its quantiles follow from the share of ones
    edge = lambda q: F.when(1 - F.col("probability") <= q, 1.0).otherwise(0.0)
    return p.select("cell", "t", "probability", F.sqrt(F.col("probability") * (1 - F.col("probability"))).alias("sd"), edge(low).alias("lower"), edge(high).alias("upper"))


def population(df: DataFrame) -> DataFrame:
    """(t, cells, mean, variance): what a model over all cells starts from, per frame over the cells that have a reading there."""
    return df.filter(F.col("value").isNotNull()).groupBy("t").agg(F.count("*").alias("cells"), F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"))


def information_criteria(df: DataFrame, means: DataFrame) -> DataFrame:
    """(cell, log_likelihood, aic, bic, dic) of a normal model at given (cell, mean, variance); k = n + 2 parameters, dic = -2 ll."""
    j = df.filter(F.col("value").isNotNull()).join(means, "cell")
    ll = -0.5 * F.ln(2 * F.pi() * F.col("variance")) - (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean")) / (2 * F.col("variance"))
    s = j.groupBy("cell").agg(F.sum(ll).alias("log_likelihood"), F.count("*").alias("__n"))
    k = F.col("__n") + 2
    return s.select("cell", "log_likelihood", (2 * k - 2 * F.col("log_likelihood")).alias("aic"), (k * F.ln("__n") - 2 * F.col("log_likelihood")).alias("bic"), (-2 * F.col("log_likelihood")).alias("dic"))


def predictive_check(df: DataFrame, draws: DataFrame, replicates: int = 100, seed: int = 1) -> DataFrame:
    """(cell, p_mean, p_variance): shares of replicated traces, drawn from posterior (mean, variance) draws, whose mean and variance reach the observed ones."""
    obs = df.groupBy("cell").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("value").alias("n"))
    d = draws.filter(F.col("draw") <= replicates).groupBy("cell", "draw").pivot("param", ["mean", "variance"]).agg(F.max("value"))
    kind = df.schema["cell"].dataType.simpleString()

    def one(p: pd.DataFrame) -> pd.DataFrame:
        g = _seed(seed, "ppc", p["cell"].iloc[0])
        y = g.normal(p["mean"].to_numpy()[:, None], np.sqrt(p["variance"].to_numpy())[:, None], (len(p), int(p["n"].iloc[0])))
        return pd.DataFrame({"cell": p["cell"].iloc[:1], "p_mean": [(y.mean(1) >= p["m"].iloc[0]).mean()], "p_variance": [(y.var(1, ddof=1) >= p["v"].iloc[0]).mean()]})

    return spread(d.join(obs, "cell"), "cell").groupBy("cell").applyInPandas(one, f"cell {kind}, p_mean double, p_variance double")


def synthetic(spark, cells: int = 5, frames: int = 1000, spike_prob: float = 0.02, seed: int = 1) -> DataFrame:
    """(cell string, t, value): cells Cell_1.. (random walk, noise, decaying spikes) and backgrounds BG_1..BG_3 (slower walk, less noise); the same for a seed.

    Every trace is a group of its own; up to 1000 cells, 10 to 100000 frames, spike probability 0.001 to 0.1.
    """
    for name, value, low, high in (("cells", cells, 1, 1000), ("frames", frames, 10, 100_000), ("spike_prob", spike_prob, 0.001, 0.1)):
        if not low <= value <= high:
            raise ValueError(f"{name} must be between {low} and {high}")
    names = [f"Cell_{i + 1}" for i in range(cells)] + [f"BG_{i + 1}" for i in range(3)]
    base = spark.createDataFrame([(n,) for n in names], "cell string")

    def one(p: pd.DataFrame) -> pd.DataFrame:
        name = p["cell"].iloc[0]
        g, back = _seed(seed, name), name.startswith("BG_")
        if back:  # one walk goes on through the three backgrounds
            first = (int(name[3:]) - 1) * frames
            y = _seed(seed, "BG").normal(0, 0.001, 3 * frames).cumsum()[first : first + frames] + g.normal(0, 0.02, frames)
        else:
            y = g.normal(0, 0.01, frames).cumsum() + g.normal(0, 0.05, frames)
        if not back:
            amplitude = (g.random(frames) < spike_prob) * g.uniform(0.5, 2, frames)
            y += np.convolve(amplitude, np.concatenate([[0], np.exp(-np.arange(1, 51) / 10)]))[:frames]
        return pd.DataFrame({"cell": name, "t": np.arange(1, frames + 1), "value": y})

    return base.groupBy("cell").applyInPandas(one, "cell string, t long, value double")


def synthetic_preset(spark) -> DataFrame:
    """The common example: 10 cells of 500 frames, spike probability 0.02, seed 123."""
    return synthetic(spark, 10, 500, 0.02, 123)
