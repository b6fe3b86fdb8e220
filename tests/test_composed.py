import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from glimmerframe.functions import kernels as K
from glimmerframe.operators import composed as C
from glimmerframe.operators import images, numeric, spikes, traces
from glimmerframe.sources import files


def frame(spark, **cells):
    rows = [(c, i + 1, None if v is None else float(v)) for c, values in cells.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cell string, t long, value double")


def pixels(spark, m):
    return spark.createDataFrame([(1, r, c, float(v)) for r, row in enumerate(m) for c, v in enumerate(row)], "frame long, r long, c long, value double")


def test_connectivity_in_one_call(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=120).cumsum()
    df = frame(spark, a=x, b=np.roll(x, 1) + g.normal(size=120) * 0.1, c=g.normal(size=120), d=[1.0] * 120)
    for method in ("correlation", "mutual_info", "granger", "transfer_entropy"):
        found = C.functional_connectivity(df, method, value=0.8)
        assert {tuple(sorted((r.src, r.dst))) for r in found["connections"].collect()} >= {("a", "b")}
        s = found["summary"].first()
        assert s.nodes == 4 and 1 <= s.edges <= 6
    with pytest.raises(ValueError):
        C.functional_connectivity(df, "none")
    assert {r.method for r in C.causality(df, ("ccm", "granger")).collect()} == {"ccm", "granger"}


def test_validation_and_curation(spark):
    df = frame(spark, a=[0.1, 0.2, 0.15, 0.12, 9.0, 0.18], b=[0.3] * 6)
    r = C.validation_report(df).first()
    assert r.passed and r.issues == ["outliers"] and json.loads(r.report)["readings"] == 12
    bad = C.validation_report(df.union(frame(spark, c=[None, 50.0, float("inf")]))).first()
    assert not bad.passed and set(bad.issues) == {"missing", "infinite", "range", "outliers"}
    assert not C.validation_report(df.limit(0)).first().passed
    assert C.curate(df, highest=1.0)["data"].filter("value is null").count() == 1  # not passed: outliers only
    assert C.curate(df)["data"].filter("value is null").count() > 1
    m = spark.createDataFrame([("e", None), (None, "m")], "experiment_id string, animal_id string")
    assert [r.missing for r in C.missing_fields(m).collect()] == [["date", "animal_id"], ["experiment_id", "date"]]
    full = files.metadata(m)
    assert full.schema["imaging_parameters"].dataType.simpleString() == files.IMAGING and "preprocessing_steps" in full.schema["data_processing"].simpleString()
    with pytest.raises(ValueError):
        files.check_memory(df, 10**9)


def test_recommendations(spark):
    df = frame(spark, a=np.random.default_rng(0).normal(size=200))
    r = C.statistical_analysis(df, df, spikes.mean_threshold(df, 0.5)).first()
    assert not r.passed and r.recommendations == [C.POOR_CORRECTION, C.POOR_SPIKES]


def test_thresholds_can_be_applied(spark):
    df = frame(spark, a=np.random.default_rng(0).normal(size=500), b=np.random.default_rng(1).normal(size=500))
    r = C.optimise_threshold(df, grid=(0.5, 2.0), apply=True).collect()
    assert [x.threshold for x in r if x.best] == [2.0]


def test_batches(spark):
    rows = [(s, f, s % 3, float(np.random.default_rng(s * 100 + f).normal() + (s % 3) * 5)) for s in range(30) for f in range(1, 5)]
    df = spark.createDataFrame(rows, "sample long, feature long, batch long, value double")
    for method, how in (("combat", {}), ("mnn", {}), ("deep", {"size": 4})):
        r = C.batch_aware(df, method, {"n": lambda d: d.groupBy().count()}, **how)
        assert r["report"].first().percent > 50 and r["n"].first()[0] == 120
    h = C.held_out_batch(df, 2).first()
    assert (h.train_samples, h.test_samples) == (20, 10) and h.reduction > 0.5


def test_regions(spark):
    ring = [[1, 1, 1, 0], [1, 0, 1, 0], [1, 1, 1, 0], [0, 0, 0, 0]]
    px = pixels(spark, ring)
    filled = {(r.r, r.c): r.value for r in images.fill_holes(px).collect()}
    assert filled[1, 1] == 1 and filled[3, 3] == 0 and sum(filled.values()) == 9
    labels = images.components(images.fill_holes(px))
    assert {(r.r, r.c) for r in images.borders(labels).collect()} == {(r, c) for r in range(3) for c in range(3)} - {(1, 1)}
    d = {(r.r, r.c): r.value for r in images.distance_transform(images.fill_holes(px)).collect()}
    assert d[1, 1] == 2 and d[0, 0] == 3 and d[3, 0] == 0
    assert {(r.r, r.c) for r in images.local_maxima(pixels(spark, [[1, 2], [0, 1]])).collect()} == {(0, 1)}
    q = images.roi_quality(labels, px).first()
    assert q.size == pytest.approx(9 / 13) and q.intensity == pytest.approx(8 / 16) and q.overall == pytest.approx((q.size + q.shape + q.intensity) / 3)
    assert [tuple(r)[1:4] for r in images.roi_table(labels, px).collect()] == [(1, 1.0, 1.0)]
    assert images.kmeans_regions(px, 3.0).select("label").distinct().count() == 2
    for run in (images.fill_holes, images.distance_transform, images.local_maxima, lambda p: images.kmeans_regions(p, 2.0)):
        assert run(px.limit(0)).collect() == []


def test_oasis_counts_are_those_of_the_detector(spark):
    y = np.random.default_rng(3).normal(size=(3, 80))
    df = frame(spark, a=y[0], b=y[1], c=y[2])
    want = {r.cell: r.n for r in spikes.oasis_events(df).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    assert K.oasis_counts(y).tolist() == [want[c] for c in "abc"]
    for r in numeric.bootstrap_counts(df, draws=200).collect():
        assert 0 <= r.count_low < r.count_high <= 80
    some = numeric.bootstrap_by(df, spikes.mean_threshold, draws=5).collect()
    assert len(some) == 3


def test_parameters_are_checked(spark):
    df = frame(spark, a=[1.0] * 20)
    for run in (lambda: numeric.sample_spikes(df, draws=-1), lambda: numeric.sample_spikes(df, "other"), lambda: numeric.estimate_parameters(df, burn=-1), lambda: numeric.proportion_draws(df, 0.5, 0)):
        with pytest.raises(ValueError):
            run()


def test_every_query_with_sql_is_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_background_walk_goes_on(spark):
    b = {(r.cell, r.t): r.value for r in numeric.synthetic(spark, 1, 400).filter("cell like 'BG%'").collect()}
    last, first = np.mean([b["BG_1", t] for t in range(380, 401)]), np.mean([b["BG_2", t] for t in range(1, 22)])
    assert abs(last - first) < 0.03 and traces.trace_stats(numeric.synthetic_preset(spark)).count() == 13


def test_products_of_blocks_and_groups(spark, monkeypatch):
    from glimmerframe.operators import network

    g = np.random.default_rng(8)
    x = g.normal(size=(7, 90)).cumsum(1) + 1e4
    rows = [(f"c{i}", t, None if g.random() < 0.1 else float(x[i, t])) for i in range(7) for t in range(90)] + [("k", t, 5.5) for t in range(90)]
    df = spark.createDataFrame(rows, "cell string, t long, value double")
    held = {c: {t: v for k, t, v in rows if k == c and v is not None} for c in [*(f"c{i}" for i in range(7)), "k"]}

    def r(a, b, lag):
        both = [(held[a][t], held[b][t + lag]) for t in held[a] if t + lag in held[b]]
        return np.corrcoef(*zip(*both))[0, 1]

    for frames, cells in ((1000, 1000), (16, 3), (7, 1)):
        monkeypatch.setattr(network, "FRAMES", frames)
        monkeypatch.setattr(network, "CELLS", cells)
        got = {(e.src, e.dst): e.w for e in network.correlation(df).collect()}
        assert len(got) == 28 and all(w is None for (a, b), w in got.items() if b == "k")
        assert all(w == pytest.approx(r(a, b, 0), abs=1e-9) for (a, b), w in got.items() if b != "k")
        late = {(e.src, e.dst, e.lag): e.r for e in network.lagged_correlation(df, 3).filter("src <> 'k' and dst <> 'k'").collect()}
        assert len(late) == 7 * 6 * 3 and all(w == pytest.approx(r(*k), abs=1e-9) for k, w in late.items())


def test_long_runs_of_spikes_are_not_forgotten(spark):
    n = 1500
    marks = [1.0 if 100 <= i < 1200 or i % 211 == 0 else 0.0 for i in range(1, n + 1)]
    df = frame(spark, a=[2.0] * n)
    at = spark.createDataFrame([("a", i + 1) for i, m in enumerate(marks) if m], "cell string, t long")
    want = [2.0]
    for m in marks[:-1]:
        want.append(want[-1] + 1 if m else want[-1] * np.exp(-1))
    got = [r.fit for r in spikes.concentration(df, at).orderBy("t").collect()]
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_bands_in_blocks_are_those_of_one_block(spark, monkeypatch):
    g = np.random.default_rng(2)
    df = frame(spark, a=g.normal(size=400), b=[None if g.random() < 0.1 else float(v) for v in g.normal(size=90)], c=[1.0] * 12)
    for run in (spikes.attention, spikes.local_threshold, spikes.rolling_threshold):
        whole = {(r.cell, r.t): r[-1] for r in run(df).collect()}
        monkeypatch.setattr(traces.by_blocks, "__defaults__", ((), 64))
        parts = {(r.cell, r.t): r[-1] for r in run(df).collect()}
        monkeypatch.undo()
        assert whole.keys() == parts.keys()
        assert all(v == parts[k] or v == pytest.approx(parts[k], abs=1e-9) for k, v in whole.items())


def test_ward_keeps_the_lowest_merges():
    g = np.random.default_rng(4)
    x = np.concatenate([g.normal(size=(30, 3)) + 20 * i for i in range(4)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert K.ward(d, 4).tolist() == [i + 1 for i in range(4) for _ in range(30)]

    def greedy(d, k):
        d, groups = d**2, [[i] for i in range(len(d))]
        while len(groups) > k:
            cost = lambda a, b: 2 * len(a) * len(b) / (len(a) + len(b)) * (d[np.ix_(a, b)].mean() - d[np.ix_(a, a)].mean() / 2 - d[np.ix_(b, b)].mean() / 2)
            _, i, j = min((cost(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
            groups[i] += groups.pop(j)
        return {frozenset(m) for m in groups}

    y = g.normal(size=(25, 2))
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(2))
    for k in (1, 3, 7, 25):
        labels = K.ward(d, k)
        assert {frozenset(np.flatnonzero(labels == v).tolist()) for v in set(labels)} == greedy(d, k) and labels[0] == 1


def test_interpolated_fit_is_near_the_direct_one(spark):
    t = np.arange(1, 3001)
    y = np.sin(t / 400) + np.random.default_rng(0).normal(size=3000) * 0.1
    y[5::97] = np.nan
    a, b = K.loess(t, y, 0.3), K.loess_interpolated(t, y, 0.3)
    assert np.isnan(b).sum() == np.isnan(y).sum() and np.nanmax(np.abs(a - b)) < 0.02
    line = frame(spark, a=2.0 * t[:200] + 1)
    assert max(abs(r.value - (2 * r.t + 1)) for r in numeric.loess_baseline(line, 0.4, "interpolate").collect()) < 1e-6
    with pytest.raises(ValueError):
        numeric.loess_baseline(line, 0.4, "none")


def test_running_moments_over_batches():
    from glimmerframe.streaming.spikes import running

    v = np.concatenate([np.random.default_rng(1).normal(size=60) + 100, [np.nan, 130.0], np.random.default_rng(2).normal(size=40) + 100])
    want = []
    for i, x in enumerate(v):
        past = v[:i][np.isfinite(v[:i])]
        want.append(bool(np.isfinite(x) and len(past) >= 20 and x > past.mean() + 3 * past.std(ddof=1)))
    held, got = (0, 0.0, 0.0), []
    for a, b in ((0, 7), (7, 7), (7, 61), (61, 62), (62, 102)):
        spike, *held = running(v[a:b], *held, 3.0, 20)
        got += spike.tolist()
    assert got == want and want[61] and held[0] == 101


def test_stream_with_a_watermark(spark, tmp_path):
    from glimmerframe.streaming.spikes import read_stream, running_spikes

    rows = spark.range(1, 401, 1, 4).select((F.col("id") % 3).cast("string").alias("cell"), F.timestamp_seconds(F.col("id") * 60).alias("at"), F.when(F.col("id") == 390, 50.0).otherwise((F.col("id") % 7).cast("double")).alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    q = running_spikes(read_stream(spark, str(tmp_path / "in"), rows.schema), late="2 days", idle_ms=1000).writeStream.format("memory").queryName("late_spikes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("late_spikes").count() == 400 and [r.value for r in spark.table("late_spikes").filter("spike").collect()] == [50.0]
