"""Tests of the findings in FINDINGS_r02.md."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmerframe.functions import kernels as K
from glimmerframe.operators import composed, numeric
from glimmerframe.operators import spikes as S
from glimmerframe.plans import load_all, registry

load_all()


def stages(spark):
    sc = spark.sparkContext
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {(s := found.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(found.size())}


def shuffled(df):
    """Records that df's run writes to shuffles."""
    before = stages(df.sparkSession)
    df.write.format("noop").mode("overwrite").save()
    df.sparkSession.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for stage, n in stages(df.sparkSession).items() if stage not in before)


def events(spark, folder, cells, frames):
    g = np.random.default_rng(3)
    rows = [(c * frames + t, c, t, float(x)) for c in range(cells) for t, x in enumerate(g.exponential(50, frames))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long, value double").selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts", "value")
    df.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_gibbs_gaussian_shuffles_no_draws(spark, tmp_path):
    """1000 draws of two parameters a cell were shuffled twice, fifty times the input."""
    cells, frames = 40, 30
    q = registry.QUERIES["gibbs_gaussian"](spark, events(spark, tmp_path, cells, frames))
    assert shuffled(q) < 3 * cells * frames
    assert sorted(map(tuple, q.collect())) == [(c, 1000, True, True) for c in range(cells)]


def test_draws_are_a_cells_own_whatever_it_is_drawn_with(spark):
    g = np.random.default_rng(4)
    rows = [(c, float(g.normal(1000 + (c or 0), 1 + (c or 0)))) for c in (1, 2, 3, None) for _ in range(200)] + [(1, None), (1, float("nan")), (8, None), (9, 5.0)]
    df = spark.createDataFrame(rows, "cell long, value double")
    of = lambda d: {(r.cell, r.draw, r.param): r.value for r in d.collect()}
    every, alone = of(numeric.estimate_parameters(df, draws=50, burn=20)), of(numeric.estimate_parameters(df.filter("cell = 2"), draws=50, burn=20))
    assert len(alone) == 100 and {k: v for k, v in every.items() if k[0] == 2} == pytest.approx(alone, rel=1e-9)
    assert {k[0] for k in every} == {1, 2, 3, 9, None} and np.isfinite(list(every.values())).all() and len(every) == 5 * 100
    rates = of(numeric.estimate_parameters(df, "poisson", draws=50))
    assert {k[0] for k in rates} == {1, 2, 3, 8, 9, None} and len(rates) == 6 * 50
    assert np.mean([v for k, v in rates.items() if k[0] == 8]) == pytest.approx(1, abs=0.6)  # no reading: Gamma(1, 1)


def test_normal_draws_are_the_gibbs_recursion():
    ys, m = [np.random.default_rng(i).normal(i, 1 + i, 30 + i) for i in range(3)], []
    n, centre, spread = (np.array([f(y) for y in ys], float) for f in (len, np.mean, np.var))
    means, variances = K.normal_draws(n, centre, spread, 40, 5, [np.random.default_rng(9 + i) for i in range(3)])
    for i, y in enumerate(ys):
        g = np.random.default_rng(9 + i)
        z, gamma, var, want = g.standard_normal(45), g.standard_gamma(1 + len(y) / 2, 45), y.var(), []
        for a, b in zip(z, gamma):
            precision = len(y) / var + 1 / 10
            m = y.sum() / var / precision + a * precision**-0.5
            var = (1 + ((y - m) ** 2).sum() / 2) / b
            want.append((m, var))
        assert np.c_[means[i], variances[i]] == pytest.approx(np.array(want[5:]))


def odd_traces(spark):
    """Long and short cells, missing readings, missing frames, a constant cell, rows of no cell or no frame."""
    g, rows = np.random.default_rng(5), [(None, 1, 2.0), (1, None, 3.0)]
    for cell, n in ((1, 400), (2, 333), (3, 40), (4, 14), (5, 2), (6, 300), (7, 21)):
        for t in range(1, n + 1):
            if cell != 6 or t not in (100, 101, 150):
                rows.append((cell, t, None if cell == 2 and t % 97 == 0 else 3.0 if cell == 7 else float(g.exponential(5) + np.sin(t / 20))))
    return spark.createDataFrame(rows, "cell long, t long, value double")


def test_auto_optimise_plan_is_small_and_reads_each_fold_once(spark):
    """The search for a threshold had hundreds of exchanges, whose plan alone took the driver's memory; the loess of every fold was done once a metric."""
    df = odd_traces(spark)
    plan = composed.optimise_threshold(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") + plan.count("Exchange(") < 10
    got = {r.what: r for r in composed.auto_optimise(df).collect()}
    assert set(got) == {"correction", "spikes"} and got["spikes"].name == "caiman" and got["spikes"].setting == 1.5
    assert got["correction"].name == "snr" and got["correction"].setting in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def test_span_scores_are_the_metrics_of_corrected_folds(spark):
    df = odd_traces(spark).filter("t IS NOT NULL AND cell IS NOT NULL")
    got = {(r.target, r.span): r.score for r in numeric.span_scores(df, numeric.METRICS, (0.3, 0.7)).collect()}
    rows = []
    for (cell, fold), p in numeric.folds(df).toPandas().sort_values("t").groupby(["cell", "fold"]):
        y = p["value"].to_numpy(float) / p["value"].mean()
        for span in (0.3, 0.7):
            rows += [(span, int(fold), int(cell), int(t), float(v) if np.isfinite(v) else None) for t, v in zip(p["t"], y - K.loess(p["t"].to_numpy(), y, span))]
    done = spark.createDataFrame(rows, "span double, fold int, cell long, t long, value double").cache()
    for target in numeric.METRICS:
        want = numeric.metric(done, target, ["span", "fold"]).groupBy("span").agg(F.avg("score").alias("s")).collect()
        assert {r.span: got[target, r.span] for r in want} == {r.span: pytest.approx(r.s, rel=1e-9) for r in want}


def test_oasis_counts_are_the_detectors_spikes(spark):
    df = odd_traces(spark).filter("t IS NOT NULL AND cell IS NOT NULL")
    want = {r.cell: r.n for r in S.oasis(df).groupBy("cell").agg(F.sum("spike").alias("n")).collect()}
    got = {c: K.oasis_counts(p["value"].to_numpy(float)[None], frames=p["t"].to_numpy())[0] for c, p in df.toPandas().sort_values("t").groupby("cell")}
    assert got == want and sum(want.values()) > 100


def test_many_traces_are_fitted_as_each_one_alone():
    g = np.random.default_rng(8)
    for n in (3, 13, 14, 21, 66):
        y, t, spans = g.exponential(5, (4, n)), np.arange(n) + 40, (0.1, 0.3, 0.45, 0.9)
        for span, fit in zip(spans, K.local_fits(t.astype(float), y, spans)):
            assert all(np.array_equal(f, K.loess(t, v, span)) for f, v in zip(fit, y))
