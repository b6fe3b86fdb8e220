"""Batches, clusters and anomalies of feature tables (sample, feature, batch, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmerframe.functions import kernels as K
from glimmerframe.functions.quantiles import exact_quantile


def anova(df: DataFrame) -> DataFrame:
    """(feature, f): one-way F statistic of each feature over batches; null without rest or with one batch."""
    g = df.groupBy("feature", "batch").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("v"))
    s = g.join(g.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand")), "feature")
    s = s.groupBy("feature").agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.count("*").alias("k"), F.sum("n").alias("n"))
    return s.select("feature", F.try_divide(F.try_divide(F.col("b"), F.nullif(F.col("k") - 1, F.lit(0))), F.nullif(F.try_divide(F.col("w"), F.nullif(F.col("n") - F.col("k"), F.lit(0))), F.lit(0.0))).alias("f"))


def batch_score(df: DataFrame) -> DataFrame:
    """(score): mean F over features."""
    return anova(df).agg(F.avg("f").alias("score"))


def batch_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before, after, improvement, percent): scores of a table before and after correction."""
    both = batch_score(before).withColumnRenamed("score", "before").join(F.broadcast(batch_score(after).withColumnRenamed("score", "after")))
    gain = F.col("before") - F.col("after")
    return both.select("before", "after", gain.alias("improvement"), (F.try_divide(gain, F.col("before")) * 100).alias("percent"))


def cosine_normalise(df: DataFrame) -> DataFrame:
    """Each sample scaled to length one; null for a sample of zeros."""
    length = df.groupBy("sample").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("__l"))
    return df.join(length, "sample").withColumn("value", F.try_divide("value", "__l")).drop("__l")


def centre_and_scale(df: DataFrame, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """Every feature centred and scaled within its batch; noise adds normal noise of that sd, the same for a seed, sample and feature."""
    s = df.groupBy("batch", "feature").agg(F.avg("value").alias("__m"), F.stddev_samp("value").alias("__s"))
    value = F.try_divide(F.col("value") - F.col("__m"), F.nullif("__s", F.lit(0.0)))
    if noise:
        u = [(F.pmod(F.xxhash64("sample", "feature", F.lit(seed), F.lit(i)), F.lit(1 << 52)) + 1).cast("double") / float(1 << 52) for i in (1, 2)]
        value += noise * F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * F.pi() * u[1])
    return df.join(s, ["batch", "feature"]).withColumn("value", value).drop("__m", "__s")


def mnn_like(df: DataFrame, noise: float = 0.0) -> DataFrame:
    """Cosine-normalised samples, centred and scaled per batch; no neighbour search."""
    return centre_and_scale(cosine_normalise(df), noise)


def combat(df: DataFrame, mean_only: bool = False) -> DataFrame:
    """Empirical-Bayes location and scale correction of batches (published parametric method), no covariates.

    Per-feature and per-batch moments are aggregated in Spark; only these (features x batches rows) enter the iteration, batch by batch. Features without
    spread stay as they are.
    """
    g = df.groupBy("feature", "batch").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("v"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("vs"))
    f = g.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("pooled"))
    stats = g.join(f, "feature").filter(F.col("pooled") > 0).withColumn("gamma", (F.col("m") - F.col("grand")) / F.sqrt("pooled")).withColumn("delta", F.col("vs") / F.col("pooled"))

    def shrink(p: pd.DataFrame) -> pd.DataFrame:
        gamma, delta, n = (p[c].to_numpy(float) for c in ("gamma", "delta", "n"))
        mean, t2 = gamma.mean(), gamma.var(ddof=1) if len(gamma) > 1 else 0.0
        if mean_only:
            star, scale = (t2 * gamma + mean) / (t2 + 1), np.ones(len(p))
        else:
            d, s2 = delta.mean(), delta.var(ddof=1) if len(delta) > 1 else 0.0
            a, b = ((2 * s2 + d * d) / s2, (d * s2 + d**3) / s2) if s2 > 0 else (np.inf, np.inf)
            star, scale = gamma.copy(), delta.copy()
            for _ in range(1000):
                new = (n * t2 * gamma + scale * mean) / (n * t2 + scale) if t2 > 0 else np.full(len(p), mean)
                rest = (n - 1) * delta + n * (gamma - new) ** 2
                wide = (b + rest / 2) / (n / 2 + a - 1) if np.isfinite(a) else np.full(len(p), d)
                change = max(np.abs(new - star).max(), np.abs(wide - scale).max())
                star, scale = new, wide
                if change < 1e-8:
                    break
        return p.assign(star=star, scale=scale)[["feature", "batch", "star", "scale", "grand", "pooled"]]

    kinds = {c: df.schema[c].dataType.simpleString() for c in ("feature", "batch")}
    est = stats.select("feature", "batch", "gamma", "delta", "n", "grand", "pooled").groupBy("batch").applyInPandas(shrink, f"feature {kinds['feature']}, batch {kinds['batch']}, star double, scale double, grand double, pooled double")
    z = (F.col("value") - F.col("grand")) / F.sqrt("pooled")
    fixed = (z - F.col("star")) / F.sqrt(F.greatest("scale", F.lit(1e-12))) * F.sqrt("pooled") + F.col("grand")
    return df.join(est, ["feature", "batch"], "left").withColumn("value", F.coalesce(fixed, "value")).drop("star", "scale", "grand", "pooled")


def vectors(df: DataFrame, size: int) -> DataFrame:
    """(sample, batch, x): features 1..size of a sample as an array, missing ones 0."""
    held = df.groupBy("sample", "batch").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    return held.select("sample", "batch", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0))).alias("x"))


def moments(v: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance) of arrays x: partial sums in the tasks, one row of size * (size + 1) numbers of each reaches the reducer; size is bounded by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            x = np.array(batch.column(0).flatten()).reshape(-1, size)
            n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pa.RecordBatch.from_pydict({"i": np.arange(size + 1), "n": np.full(size + 1, n), "s": [*q.tolist(), s.tolist()]})

    parts = v.select("x").mapInArrow(run, "i long, n long, s array<double>").groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(j))).alias(f"c{j}") for j in range(size)])
    rows = {r.i: r for r in parts.collect()}
    n = rows[size].n if rows else 0
    if n < 2:
        return n, np.zeros(size), np.eye(size)
    s, q = (np.array([[rows[i][f"c{j}"] for j in range(size)] for i in k]) for k in ([size], range(size)))
    mean = s[0] / n
    return n, mean, (q - n * np.outer(mean, mean)) / (n - 1)


def pca_harmonise(df: DataFrame, size: int, k: int = 32, literal: bool = False) -> DataFrame:
    """(sample, feature, batch, value): standardised samples projected on k components, scores z-scored within each batch of more than one sample, and projected back.

    literal adds the centre before multiplying by the scale, as the published heuristic does, instead of the inverse of standardising.
    """
    v = vectors(df, size)
    _, mean, cov = moments(v, size)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    values, axes = np.linalg.eigh(cov / np.outer(sd, sd))
    held = v.sparkSession.sparkContext.broadcast((mean, sd, axes[:, np.argsort(-values)[: min(k, size)]]))
    kinds = {c: df.schema[c].dataType.simpleString() for c in ("sample", "batch")}

    def forward(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, sd, axes = held.value
        for p in it:
            z = (np.array(p["x"].to_list()).reshape(-1, size) - mean) / sd @ axes
            yield p.assign(x=list(z))

    scores = v.mapInPandas(forward, f"sample {kinds['sample']}, batch {kinds['batch']}, x array<double>")
    flat = scores.select("sample", "batch", F.posexplode("x").alias("j", "y"))
    s = flat.groupBy("batch", "j").agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s"), F.count("*").alias("n"))
    z = flat.join(s, ["batch", "j"]).withColumn("y", F.when(F.col("n") > 1, F.coalesce(F.try_divide(F.col("y") - F.col("m"), F.nullif("s", F.lit(0.0))), F.lit(0.0))).otherwise(F.col("y")))
    back = z.groupBy("sample", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "y"))), lambda e: e["y"]).alias("x"))

    def backward(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, sd, axes = held.value
        for p in it:
            y = np.array(p["x"].to_list()).reshape(-1, axes.shape[1]) @ axes.T
            yield p.assign(x=list((y + mean) * sd if literal else y * sd + mean))

    out = back.mapInPandas(backward, f"sample {kinds['sample']}, batch {kinds['batch']}, x array<double>")
    return out.select("sample", "batch", F.posexplode("x").alias("j", "value")).select("sample", (F.col("j") + 1).cast("long").alias("feature"), "batch", "value")


def pca_scores(df: DataFrame, size: int, k: int = 2) -> DataFrame:
    """(sample, component, value): centred samples on their k leading components; a component's largest loading is positive."""
    v = vectors(df, size)
    _, mean, cov = moments(v, size)
    values, axes = np.linalg.eigh(cov)
    axes = axes[:, np.argsort(-values)[:k]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    held = v.sparkSession.sparkContext.broadcast((mean, axes))
    kind = df.schema["sample"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes = held.value
        width = axes.shape[1]
        for batch in batches:
            y = (np.array(batch.column(1).flatten()).reshape(-1, size) - mean) @ axes
            rows = pa.array(np.repeat(np.arange(len(y)), width))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(y))), pa.array(y.ravel())], ["sample", "component", "value"])

    return v.select("sample", "x").mapInArrow(project, f"sample {kind}, component int, value double")


def kmeans(df: DataFrame, size: int, k: int = 3, seed: int = 1) -> DataFrame:
    """(sample, cluster): k-means on the feature arrays."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors(df, size).select("sample", array_to_vector("x").alias("features"))
    return KMeans(k=k, seed=seed).fit(v).transform(v).select("sample", F.col("prediction").alias("cluster"))


def component_kmeans(df: DataFrame, size: int, k: int = 5, components: int = 32, seed: int = 1) -> DataFrame:
    """(sample, cluster): k-means on the leading components of the features, each brought to mean 0 and sd 1."""
    s = df.groupBy("feature").agg(F.avg("value").alias("__m"), F.stddev_samp("value").alias("__s"))
    z = df.join(s, "feature").withColumn("value", F.coalesce(F.try_divide(F.col("value") - F.col("__m"), F.nullif("__s", F.lit(0.0))), F.lit(0.0))).drop("__m", "__s")
    top = min(components, size)
    scores = pca_scores(z, size, top).select("sample", F.col("component").cast("long").alias("feature"), F.lit(0).alias("batch"), "value")
    return kmeans(scores, top, k, seed)


def ward_clusters(df: DataFrame, size: int, k: int, by: str = "batch") -> DataFrame:
    """(by, sample, cluster): Ward linkage of the samples of each group, a quadratic method for groups of up to some thousand samples."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in ("sample", by)}

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("sample")
        x = np.array(p["x"].to_list())
        d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0)) if len(p) < 200 else np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0))
        return pd.DataFrame({by: p[by], "sample": p["sample"], "cluster": K.ward(d, k)})

    return vectors(df, size).groupBy(by).applyInPandas(one, f"{by} {kinds[by]}, sample {kinds['sample']}, cluster int")


def anomaly_scores(df: DataFrame, method: str = "iqr", size: int | None = None) -> DataFrame:
    """(sample, score) in [0, 1]: mean over features of |x - median| / IQR (iqr) or |z| (zscore), 0 for features without spread, or squared Mahalanobis distance."""
    if method == "iqr":
        q = df.select("feature").distinct()
        for name, at in (("a", 0.25), ("m", 0.5), ("b", 0.75)):
            q = q.join(exact_quantile(df, ["feature"], "value", at, name), "feature")
        spread, centre = F.col("b") - F.col("a"), F.col("m")
    elif method == "zscore":
        q = df.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
        spread, centre = F.col("s"), F.col("m")
    elif method == "mahalanobis":
        n, mean, cov = moments(vectors(df, size), size)
        inverse = np.linalg.inv(cov) if n > size and np.linalg.matrix_rank(cov) == size else np.eye(size)
        held = df.sparkSession.sparkContext.broadcast((mean, inverse, n > size))
        kind = df.schema["sample"].dataType.simpleString()

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mean, inverse, squared = held.value
            for p in it:
                d = np.array(p["x"].to_list()).reshape(-1, size) - mean
                s = np.einsum("ij,jk,ik->i", d, inverse, d)
                yield pd.DataFrame({"sample": p["sample"], "raw": s if squared else np.sqrt(s)})

        return _unit(vectors(df, size).mapInPandas(run, f"sample {kind}, raw double"))
    else:
        raise ValueError("method must be iqr, zscore or mahalanobis")
    score = F.when(spread > 0, F.abs(F.col("value") - centre) / spread).otherwise(F.lit(0.0))
    return _unit(df.join(q, "feature").groupBy("sample").agg(F.avg(score).alias("raw")))


def _unit(raw: DataFrame) -> DataFrame:
    ends = raw.agg(F.min("raw").alias("a"), F.max("raw").alias("z"))
    return raw.join(F.broadcast(ends)).select("sample", F.coalesce(F.try_divide(F.col("raw") - F.col("a"), F.nullif(F.col("z") - F.col("a"), F.lit(0.0))), F.col("raw")).alias("score"))


def detection_scores(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(true_positives, precision, recall, f1) of two sets of keys."""
    t, f = (d.select(*keys).distinct().withColumn(n, F.lit(1)) for d, n in ((truth, "__t"), (found, "__f")))
    s = t.join(f, keys, "full").agg(F.coalesce(F.sum(F.col("__t") * F.col("__f")), F.lit(0)).alias("tp"), F.count("__t").alias("nt"), F.count("__f").alias("nf"))
    return s.select(F.col("tp").alias("true_positives"), F.try_divide("tp", "nf").alias("precision"), F.try_divide("tp", "nt").alias("recall"), F.try_divide(2 * F.col("tp"), F.col("nt") + F.col("nf")).alias("f1"))


def compare_models(truth: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """(model, true_positives, precision, recall, f1): detection_scores of every model's (cell, t, spike) against true (cell, t)."""
    parts = [detection_scores(truth, f.filter(F.col("spike") > 0), ["cell", "t"]).select(F.lit(name).alias("model"), "*") for name, f in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked(df: DataFrame, k: int) -> DataFrame:
    """The k largest values of each sample, as a top-k report: (sample, rank, feature, value)."""
    by = Window.partitionBy("sample").orderBy(F.desc("value"), "feature")
    return df.withColumn("rank", F.row_number().over(by).cast("long")).filter(F.col("rank") <= k).select("sample", "rank", "feature", "value")
