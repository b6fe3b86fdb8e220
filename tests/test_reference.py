"""Reference operators: SQL equivalents on the small tables, and small cases worked out by hand."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from glimmerframe.functions import kernels as K
from glimmerframe.operators import images, network, numeric, samples, spikes, traces
from glimmerframe.sources import files

TABLES = "/root/testdata/sf0.001"
CHECKED = [
    "oasis_spike_summary", "background_correct", "zscore", "outliers_mad", "correction_quality", "spikes_suite2p", "spikes_conv", "prob_spikes", "isi_metrics", "corr_spearman", "mutual_info_bits",
    "threshold_density", "windowed_corr", "modularity_given", "batch_anova_f", "combat_meanonly", "anomaly_iqr", "opening", "loess_baseline", "model_compare", "stream_spike_counts", "p3_found", "p5_found",
]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in os.listdir(TABLES):
        db.execute(f"CREATE VIEW {table[:-8]} AS SELECT * FROM '{TABLES}/{table}'")
    got = __spark_entry__.queries()[name](spark, TABLES).toPandas()
    want = db.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(p):
        return sorted((tuple(None if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in p[sorted(p.columns)].astype(object).itertuples(index=False)), key=str)

    def close(a, b):
        return all(x == y or (x and y and "." in x and math.isclose(float(x), float(y), abs_tol=2e-5)) for x, y in zip(a, b))

    a, b = rows(got), rows(want)
    assert len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))


def frame(spark, **cells):
    rows = [(c, i + 1, None if v is None else float(v)) for c, values in cells.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cell string, t long, value double")


def values(df, cell="a", column="value"):
    return [r[column] for r in df.filter(F.col("cell") == cell).orderBy("t").collect()]


def test_blocks_of_frames_give_what_one_block_gives(spark):
    df = frame(spark, a=np.random.default_rng(0).normal(size=120).tolist(), b=[1.0, None, 3.0])
    whole = lambda over: {"m": F.avg("value").over(over(-3, 4)), "n": F.count("value").over(over(-3, 4))}
    one = sorted(map(tuple, traces.near(df, 3, 4, whole).select("cell", "t", "m", "n").collect()))
    for block in (1, 7, 50):
        many = sorted(map(tuple, traces.near(df, 3, 4, whole, block).select("cell", "t", "m", "n").collect()))
        assert [r[:2] + r[3:] for r in one] == [r[:2] + r[3:] for r in many]
        assert [r[2] for r in many] == pytest.approx([r[2] for r in one])


def test_missing_readings_and_constant_cells(spark):
    df = frame(spark, a=[1, None, 3, 4, 5, 6, 7], b=[2, 2, 2], c=[None, None])
    assert values(traces.smooth(df)) == [None, None, None, None, 5.0, None, None]
    assert values(traces.normalise(df, "zscore"), "b") == [None, None, None]
    assert {r.cell: r.longest for r in traces.missing_runs(df).collect()} == {"a": 1, "b": 0, "c": 2}
    assert values(traces.outliers(df), "c", "outlier") == [False, False]
    assert values(numeric.loess_baseline(df, 1.0), "c") == [None, None]
    assert traces.trace_stats(df.limit(0)).collect() == [] and spikes.oasis(df.limit(0)).collect() == []


def test_greedy_rules(spark):
    c = frame(spark, a=[0] * 20).filter("t in (1, 3, 4, 9, 10, 12, 13, 19)").withColumn("a", F.when(F.col("t") == 4, 9.0).when(F.col("t") == 12, 7.0).otherwise(1.0)).select("cell", "t", "a")
    assert [r.t for r in spikes.keep_first(c, 3).orderBy("t").collect()] == [1, 4, 9, 12, 19]
    assert [r.t for r in spikes.merge(c, 3).orderBy("t").collect()] == [4, 12, 19]


def test_decay_over_blocks(spark):
    df = frame(spark, a=np.linspace(1, 2, 5000).tolist())
    s = df.filter((F.col("t") % 97 == 0) | (F.col("t") == 1999)).select("cell", "t")
    got = spikes.ar1_fit(df, s).orderBy("t").collect()
    c = 1.0
    for i, r in enumerate(got):
        c = c * math.exp(-0.1) + got[i - 1].spike if i else 1.0
        assert r.fit == pytest.approx(c, abs=1e-9)


@pytest.mark.parametrize("method", sorted(spikes.DETECTORS))
def test_every_detector_keeps_frames_and_schema(spark, method):
    g = np.random.default_rng(3)
    y = g.normal(0, 0.1, 200)
    y[[50, 100, 150]] += 2
    out = spikes.infer_spikes(frame(spark, a=y.tolist(), b=[1.0] * 60, c=[1.0, 2.0]), method)
    assert out.columns == ["cell", "t", "fit", "spike"] and out.count() == 262
    assert {r.spike for r in out.select("spike").distinct().collect()} <= {0.0, 1.0}


def test_graph_figures(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 1.0)], "src long, dst long, w double")
    n = spark.createDataFrame([(i,) for i in range(1, 6)], "node long")
    g = network.graph_summary(e, n).first()
    assert (g.nodes, g.edges, g.density, g.clustering) == (5, 4, 0.4, pytest.approx(6 / 10))
    assert {r.node: r.closeness and round(r.closeness, 6) for r in network.closeness(e, n).collect()} == {1: 1.0, 2: 1.0, 3: round(4 / 3, 6), 4: 0.8, 5: None}
    assert network.graph_summary(e.limit(0), n.limit(0)).first().nodes == 0


def test_granger_against_plain_least_squares(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=120)
    y = np.r_[0, 0.8 * x[:-1]] + g.normal(0, 0.1, 120)
    f = {(r.src, r.dst): r.f for r in network.granger(frame(spark, x=x.tolist(), y=y.tolist()), 2).collect()}
    assert f["x", "y"] > 100 > 10 > f["y", "x"] >= 0


def test_kernels():
    g = np.random.default_rng(5)
    t = np.arange(1.0, 40)
    assert K.loess(t, 3 + 2 * t + t**2, 0.5) == pytest.approx(3 + 2 * t + t**2)
    y = g.normal(size=60)
    assert K.ssa(y)[1].sum(0) == pytest.approx(y) and K.emd(y).sum(0) == pytest.approx(y)
    m = np.outer(g.random(20), g.random(8))
    w, h = K.nmf(m, 1, 500)
    assert (w >= 0).all() and (h >= 0).all() and w @ h == pytest.approx(m, abs=1e-3)
    low, sparse = K.robust_pca(m + np.where(g.random(m.shape) < 0.05, 5.0, 0))
    assert np.abs(low - m).mean() < 0.05
    s = np.c_[np.sign(np.sin(np.arange(500) / 7)), g.random(500) - 0.5]
    found = K.ica(s @ np.array([[1, 0.5], [0.4, 1]]), 2)[0]
    assert np.abs(np.corrcoef(found.T, s.T)[:2, 2:]).max(1).min() > 0.95
    assert K.ward(np.abs(np.subtract.outer([0, 0.1, 5, 5.2, 9], [0, 0.1, 5, 5.2, 9])), 3).tolist() == [1, 1, 2, 2, 3]


def test_samplers_repeat_and_recover(spark):
    df = frame(spark, a=np.random.default_rng(6).normal(3, 0.5, 400).tolist())
    d = numeric.estimate_parameters(df, draws=300, burn=50)
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, numeric.estimate_parameters(df, draws=300, burn=50).collect()))
    s = {r.param: r for r in numeric.posterior_summary(d, ["param"]).collect()}
    assert s["mean"].lower < 3 < s["mean"].upper and s["variance"].median == pytest.approx(0.25, abs=0.06)


def test_combat_removes_batch_shift(spark):
    g = np.random.default_rng(7)
    rows = [(i, f, i % 3, float(g.normal(f + 2 * (i % 3), 1 + (i % 3)))) for i in range(90) for f in range(1, 21)]
    df = spark.createDataFrame(rows, "sample long, feature long, batch long, value double")
    r = samples.batch_report(df, samples.combat(df)).first()
    assert r.after < 0.1 * r.before and samples.combat(df).count() == len(rows)
    back = samples.pca_harmonise(df, 20, 20)
    assert back.count() == len(rows) and samples.batch_score(back).first().score < 1e-6


def test_regions(spark):
    picture = ["1100", "0101", "1101", "0001"]
    px = spark.createDataFrame([(1, r, c, float(v)) for r, row in enumerate(picture) for c, v in enumerate(row)], "frame long, r long, c long, value double")
    labels = images.components(px)
    assert sorted(r["count"] for r in labels.groupBy("label").count().collect()) == [3, 5] and images.remove_small(labels, 4).count() == 5
    once = images.opening(px)
    assert sorted(map(tuple, images.opening(once).select("r", "c", "value").collect())) == sorted(map(tuple, once.select("r", "c", "value").collect()))
    assert images.components(px.limit(0)).collect() == []


def test_wide_checks_and_round_trip(spark, tmp_path):
    for df, said in ((spark.range(1).select(F.lit(1).alias("x")), "cell columns"), (spark.range(1).select(F.lit(1).alias("Cell_1")), "background"), (spark.range(1).select(F.lit("a").alias("Cell_1"), F.lit(1).alias("BG_1")), "not numeric")):
        with pytest.raises(ValueError, match=said):
            files.check_wide(df)
    with pytest.raises(ValueError, match="span"):
        numeric.correct(frame(spark, a=[1, 2, 3]), span=2)
    wide = spark.createDataFrame([(1, 1.0, None, 0.5), (2, 2.0, 3.0, 0.5)], "t long, Cell_1 double, Cell_2 double, BG_1 double")
    path = files.export(wide, str(tmp_path), ("csv", "parquet", "json"))[0]
    back = files.read_csv(spark, path, 2, 1, "t")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))
    cells, background = files.long_parts(wide)
    assert sorted(r.value for r in traces.subtract_background(cells, background).filter("value is not null").collect()) == [0.5, 1.5, 2.5]


def test_stream_equals_batch(spark, tmp_path):
    from glimmerframe.streaming.spikes import process_stream, read_stream, running_spikes, window_counts

    rows = spark.range(0, 400, 1, 4).select((F.col("id") % 3).cast("string").alias("cell"), F.timestamp_seconds(F.col("id") * 3600).alias("at"), F.when(F.col("id") == 390, 50.0).otherwise((F.col("id") % 7).cast("double")).alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), rows.schema)
    process_stream(stream, lambda b: b.filter("value > 3"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.filter("value > 3").count()
    q = window_counts(stream, 3, at="at").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, window_counts(rows, 3, at="at").collect()))
    q = running_spikes(stream).writeStream.format("memory").queryName("spiked").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("spiked").count() == 400 and [r.value for r in spark.table("spiked").filter("spike").collect()] == [50.0]


def test_synthetic_is_the_same_for_a_seed(spark):
    a, b = (numeric.synthetic(spark, 2, 50, seed=9).orderBy("cell", "t").collect() for _ in range(2))
    assert a == b and len(a) == 250
    with pytest.raises(ValueError):
        numeric.synthetic(spark, 0)
