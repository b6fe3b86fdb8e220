"""Whole analyses in one call, composed of the operators of the other modules. Every table in a result is a DataFrame; nothing is collected."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmerframe.config import CONFIG
from glimmerframe.functions import kernels as K
from glimmerframe.functions.quantiles import exact_quantile
from glimmerframe.operators import network as N
from glimmerframe.operators import numeric, samples
from glimmerframe.operators import spikes as S
from glimmerframe.operators import traces as T
from glimmerframe.session import cut

# Messages that users of the analyses match on.
POOR_CORRECTION = "Consider adjusting correction parameters or using different method"
POOR_SPIKES = "Consider adjusting spike detection parameters or method"
ALL_GOOD = "Analysis quality is good, no major issues detected"

MEASURES = {"correlation": N.correlation, "mutual_info": N.mutual_information, "granger": lambda df, **how: N.granger(df, **how).withColumnRenamed("f", "w"), "transfer_entropy": N.transfer_entropy}
DIRECTED = ("granger", "transfer_entropy")


def functional_connectivity(df: DataFrame, method: str = "correlation", threshold_method: str = "percentile", value: float = 0.95, **how) -> dict[str, DataFrame]:
    """edges: every pair's measure; connections: those that pass the threshold; nodes: all cells; summary: graph_summary of the connections, a pair counting once whichever direction passed."""
    if method not in MEASURES:
        raise ValueError(f"method must be one of {', '.join(MEASURES)}")
    edges, nodes, directed = MEASURES[method](df, **how), N.nodes_of(df), method in DIRECTED
    kept = N.threshold(edges, nodes, threshold_method, value, directed)
    plain = kept.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max_by("w", F.abs("w")).alias("w")) if directed else kept
    return {"edges": edges, "connections": kept, "nodes": nodes, "summary": N.graph_summary(plain, nodes)}


def graph_metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree, strength, two_step, closeness)."""
    return N.degrees(edges, nodes).join(N.closeness(edges, nodes), "node", "left")


def causality(df: DataFrame, methods: tuple[str, ...] = ("pcmci", "ccm"), max_lag: int = 5, alpha: float = 0.05) -> DataFrame:
    """(method, src, dst, w) of lagged links (pcmci), cross-correlation peaks (ccm) and the largest lagged correlation of a pair (granger)."""
    run = {
        "pcmci": lambda: N.lagged_links(df, max_lag, alpha).select("src", "dst", "w"),
        "ccm": lambda: N.cross_correlation_peak(df).select("src", "dst", "w"),
        "granger": lambda: N.lagged_correlation(df, max_lag).groupBy("src", "dst").agg(F.max(F.abs("r")).alias("w")),
    }
    if not methods or set(methods) - set(run):
        raise ValueError(f"methods must be some of {', '.join(run)}")
    parts = [run[m]().select(F.lit(m).alias("method"), "src", "dst", "w") for m in methods]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def window_communities(edges: DataFrame, wins: DataFrame, nodes: DataFrame, n_cells: int, resolution: float = 1.0) -> DataFrame:
    """(win, node, community): Ward clusters of each window's cells by 1 - |w| (missing edges at 1), max(2, min(5, round(n / (10 resolution)))) of them. One small matrix a window is worked on at a time."""
    k = max(2, min(5, round(n_cells / (10 * resolution))))
    kind = nodes.schema["node"].dataType.simpleString()
    cells = wins.select("win").join(F.broadcast(nodes.agg(F.sort_array(F.collect_list("node")).alias("names"))))  # one row of names
    linked = edges.groupBy("win").agg(F.collect_list(F.struct("src", "dst", "w")).alias("links"))

    def one(it):
        for p in it:
            for win, names, links in zip(p["win"], p["names"], p["links"]):
                at = {v: i for i, v in enumerate(names)}
                d = np.ones((len(names), len(names)))
                for e in links if links is not None else ():
                    d[at[e["src"]], at[e["dst"]]] = d[at[e["dst"]], at[e["src"]]] = 1 - abs(e["w"])
                np.fill_diagonal(d, 0)
                yield pd.DataFrame({"win": win, "node": names, "community": K.ward(d, k)})

    return cells.join(linked, "win", "left").mapInPandas(one, f"win long, node {kind}, community int")


def statistical_analysis(raw: DataFrame, corrected: DataFrame, spikes: DataFrame, least: float = 0.8) -> DataFrame:
    """(correction_quality, spike_quality, overall_quality, passed, recommendations): mean scores over cells, their mean, whether it reaches least, and what to do.

    Recommendations follow from a correction quality below 0.6, and from any cell with over 10 % of intervals violated, over 30 % of weak spikes or a rate outside 0.001 to 0.1.
    """
    q = T.correction_quality(raw, corrected).agg(F.avg("score").alias("correction_quality"))
    odd = (F.col("violation_rate") > 0.1) | (F.col("weak_rate") > 0.3) | (F.col("rate") < 0.001) | (F.col("rate") > 0.1)
    s = S.spike_report(corrected, spikes).agg(F.avg("quality").alias("spike_quality"), F.coalesce(F.max(odd), F.lit(False)).alias("odd"))
    both = q.join(F.broadcast(s)).withColumn("overall_quality", (F.col("correction_quality") + F.col("spike_quality")) / 2)
    told = F.filter(F.array(F.when(F.col("correction_quality") < 0.6, POOR_CORRECTION), F.when(F.col("odd"), POOR_SPIKES)), lambda x: x.isNotNull())
    return both.select("correction_quality", "spike_quality", "overall_quality", F.coalesce(F.col("overall_quality") >= least, F.lit(False)).alias("passed"), F.when(F.size(told) == 0, F.array(F.lit(ALL_GOOD))).otherwise(told).alias("recommendations"))


def validation_report(df: DataFrame, lowest: float = -10.0, highest: float = 10.0) -> DataFrame:
    """One row: (readings, cells, missing, missing_percent, infinite, outlier_cells, lowest, highest, passed, quality, issues, report).

    issues: what is wrong (missing or infinite readings, values outside lowest..highest) and, as a hint only, cells with outliers by quartile fences; passed: nothing is wrong; report: the row as JSON.
    """
    v = F.col("value")
    base = df.agg(F.count("*").alias("readings"), F.countDistinct("cell").alias("cells"), F.count(F.when(v.isNull(), 1)).alias("missing"), F.count(F.when(F.abs(v) == float("inf"), 1)).alias("infinite"), F.min(v).alias("lowest"), F.max(v).alias("highest"))
    out = T.outliers(df).groupBy("cell").agg(F.max("outlier").alias("o")).agg(F.count(F.when(F.col("o"), 1)).alias("outlier_cells"))
    r = base.join(F.broadcast(out)).withColumn("missing_percent", F.coalesce(F.try_divide(100 * F.col("missing"), "readings"), F.lit(0.0)))
    wrong = {"missing": F.col("missing") > 0, "infinite": F.col("infinite") > 0, "range": (F.col("lowest") < lowest) | (F.col("highest") > highest), "empty": F.col("readings") == 0}
    hint = F.when(F.col("outlier_cells") > 0, F.lit("outliers"))
    issues = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in wrong.items()], hint), lambda x: x.isNotNull())
    r = r.withColumn("issues", issues).withColumn("passed", F.size(F.array_remove("issues", "outliers")) == 0).withColumn("quality", F.col("passed").cast("double"))
    names = ["readings", "cells", "missing", "missing_percent", "infinite", "outlier_cells", "lowest", "highest", "passed", "quality", "issues"]
    return r.select(*names, F.to_json(F.struct(*names)).alias("report"))


def missing_fields(metadata: DataFrame, required: tuple[str, ...] = ("experiment_id", "date", "animal_id")) -> DataFrame:
    """metadata with missing: the required fields that are absent or null in a row."""
    gone = [F.when(F.col(f).isNull() if f in metadata.columns else F.lit(True), F.lit(f)) for f in required]
    return metadata.withColumn("missing", F.filter(F.array(*gone), lambda x: x.isNotNull()))


def curate(df: DataFrame, auto_preprocess: bool = True, **rules) -> dict[str, DataFrame]:
    """report: validation_report; data: the traces, preprocessed where the report passed (decided inside the plan), with outliers as missing readings."""
    report = validation_report(df, **rules)
    passed = F.broadcast(report.select(F.col("passed").alias("__passed")))
    data = df
    if auto_preprocess:
        done = T.preprocess(df).select("cell", "t", F.col("value").alias("__done"))
        data = df.join(done, ["cell", "t"]).join(passed).select("cell", "t", F.when(F.col("__passed"), F.col("__done")).otherwise(F.col("value")).alias("value"))
    return {"report": report, "data": T.without_outliers(data)}


def batch_quality_control(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, qc_pass, mean_snr) of traces (dataset, cell, t, value): whether a data set has readings and none infinite, and the mean over its cells of mean / sd."""
    cell = df.groupBy(dataset, "cell").agg(F.try_divide(F.avg("value"), F.stddev_samp("value")).alias("snr"), F.count("value").alias("n"), F.count(F.when(F.abs("value") == float("inf"), 1)).alias("bad"))
    return cell.groupBy(dataset).agg(((F.sum("n") > 0) & (F.sum("bad") == 0)).alias("qc_pass"), F.avg("snr").alias("mean_snr"))


def optimise_threshold(df: DataFrame, method: str = "oasis", grid: tuple[float, ...] = CONFIG.threshold_grid, k: int = CONFIG.cv_folds, apply: bool = False) -> DataFrame:
    """(threshold, mean_score, sd_score, best): the spike-rate score (1 - |rate - 0.02| / 0.02, 0 outside 0.001 to 0.1) of each fold, mean over cells, then over folds.

    As users of the method know it, thresholds are tried but not applied, so all tie and the first wins; apply=True detects by mean plus threshold sds instead.
    """
    keyed = numeric.folds(df, k).select(F.struct("cell", "fold").alias("cell"), "t", "value")
    first = keyed.groupBy("cell").agg(F.min("t").alias("__a"))
    keyed = keyed.join(first, "cell").select("cell", (F.col("t") - F.col("__a") + 1).alias("t"), "value")

    def scored(spikes: DataFrame) -> DataFrame:
        rate = spikes.groupBy("cell").agg(F.avg((F.col("spike") > 0).cast("int")).alias("r"))
        s = F.when((F.col("r") < 0.001) | (F.col("r") > 0.1), 0.0).otherwise(1 - F.abs(F.col("r") - 0.02) / 0.02)
        return over_folds(rate.groupBy("cell.fold").agg(F.avg(s).alias("s")))

    def over_folds(folds: DataFrame) -> DataFrame:
        return folds.agg(F.avg("s").alias("mean_score"), F.stddev_samp("s").alias("sd_score"))

    if apply:
        parts = [scored(S.mean_threshold(keyed, x)).withColumn("threshold", F.lit(float(x))) for x in grid]
    else:
        # oasis takes each fold as an array: its plan over frames holds hundreds of exchanges
        one = over_folds(numeric.rate_scores(df, k)) if S.DETECTORS.get(method) is S.oasis else scored(S.infer_spikes(keyed, method))
        parts = [one.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in grid])))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    top = Window.orderBy(F.desc_nulls_last("mean_score"), "threshold")  # a row a threshold
    return out.select("threshold", "mean_score", "sd_score", (F.row_number().over(top) == 1).alias("best"))


def auto_optimise(df: DataFrame, metrics: tuple[str, ...] = ("snr", "baseline_stability"), methods: tuple[str, ...] = ("oasis", "caiman")) -> DataFrame:
    """(what, name, setting, score): the span of the metric with the higher score, and the detector and threshold with the higher score on traces corrected with that span.

    The span is one number and is fetched before the second search.
    """
    spans = numeric.span_scores(df, tuple(metrics)).filter("best").select(F.lit("correction").alias("what"), F.col("target").alias("name"), F.col("span").alias("setting"), "score")
    best = spans.orderBy(F.desc_nulls_last("score"), "name").limit(1).collect()
    corrected = numeric.correct(df, span=best[0].setting if best else CONFIG.span)
    found = df.sparkSession.createDataFrame(best, spans.schema)
    tried, known = None, {}
    for m in methods:  # names of one detector share its search
        known.setdefault(S.DETECTORS.get(m, m), []).append(m)
    corrected = cut(corrected) if len(known) > 1 else corrected
    for same in known.values():
        s = optimise_threshold(corrected, same[0]).filter("best").select(F.lit("spikes").alias("what"), F.explode(F.array(*map(F.lit, same))).alias("name"), F.col("threshold").alias("setting"), F.col("mean_score").alias("score"))
        tried = s if tried is None else tried.unionByName(s)
    return found.unionByName(tried.orderBy(F.desc_nulls_last("score"), "name").limit(1))


def correct_batches(df: DataFrame, method: str = "combat", size: int | None = None, **how) -> DataFrame:
    """(sample, feature, batch, value) corrected by combat, mnn or deep (principal components; needs size, the number of features)."""
    run: dict[str, Callable[..., DataFrame]] = {"combat": samples.combat, "mnn": samples.mnn_like, "deep": lambda d, **h: samples.pca_harmonise(d, size, **h)}
    if method not in run:
        raise ValueError(f"method must be one of {', '.join(run)}")
    return run[method](df, **how).select("sample", "feature", "batch", "value")


def batch_aware(df: DataFrame, method: str = "combat", analyses: dict[str, Callable[[DataFrame], DataFrame]] | None = None, **how) -> dict[str, DataFrame]:
    """corrected: the table; report: batch effects before and after; and the result of every analysis of the corrected table under its name."""
    fixed = correct_batches(df, method, **how)
    return {"corrected": fixed, "report": samples.batch_report(df, fixed)} | {name: run(fixed) for name, run in (analyses or {}).items()}


def held_out_batch(df: DataFrame, test_batch, method: str = "combat", **how) -> DataFrame:
    """(method, test_batch, train_samples, test_samples, reduction): the measured share by which the batch effect of all other batches falls when they are corrected without the test batch."""
    train = df.filter(~F.col("batch").eqNullSafe(F.lit(test_batch)))
    n = df.select("sample", "batch").distinct().agg(F.count(F.when(~F.col("batch").eqNullSafe(F.lit(test_batch)), 1)).alias("train_samples"), F.count(F.when(F.col("batch").eqNullSafe(F.lit(test_batch)), 1)).alias("test_samples"))
    r = batch_aware(train, method, **how)["report"].select((F.col("percent") / 100).alias("reduction"))
    return n.join(F.broadcast(r)).select(F.lit(method).alias("method"), F.lit(test_batch).alias("test_batch"), "train_samples", "test_samples", "reduction")


def analysis_summary(df: DataFrame, spikes: DataFrame) -> DataFrame:
    """One row: (cells, frames, spikes, mean_rate, mean_snr, median_value)."""
    cell = df.groupBy("cell").agg(F.count("*").alias("n"), F.try_divide(F.avg("value"), F.stddev_samp("value")).alias("snr"))
    a = cell.agg(F.count("*").alias("cells"), F.max("n").alias("frames"), F.avg("snr").alias("mean_snr"))
    rate = spikes.groupBy("cell").agg(F.sum("spike").alias("s"), F.avg("spike").alias("r")).agg(F.sum("s").cast("long").alias("spikes"), F.avg("r").alias("mean_rate"))
    median = exact_quantile(df.withColumn("k", F.lit(1)), ["k"], "value", name="median_value").select("median_value")
    return a.join(F.broadcast(rate)).join(F.broadcast(median)).select("cells", "frames", "spikes", "mean_rate", "mean_snr", "median_value")
