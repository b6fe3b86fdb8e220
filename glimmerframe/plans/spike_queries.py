"""Reference queries of the spike detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmerframe.operators import spikes as S
from glimmerframe.operators.traces import steps
from glimmerframe.plans.registry import register
from glimmerframe.plans.views import TRACES_SQL, r6, traces

W = f"WITH RECURSIVE {TRACES_SQL}"
MA21 = """m AS (SELECT cell, t, value, CASE WHEN count(value) OVER w = 21 THEN avg(value) OVER w END AS m FROM traces WINDOW w AS (PARTITION BY cell ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
d AS (SELECT cell, t, value - coalesce(m, (SELECT median(value) FROM traces x WHERE x.cell = m.cell)) AS a FROM m)"""
OASIS = f"""{MA21}, c AS (SELECT d.cell, t, a FROM d JOIN (SELECT cell, stddev_samp(a) AS s FROM d GROUP BY cell) USING (cell) WHERE a > 0.1::DOUBLE * s),
k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY t) AS rn FROM c),
f AS (SELECT cell, rn, t, a, 1 AS e FROM k WHERE rn = 1 UNION ALL
 SELECT k.cell, k.rn, CASE WHEN k.t - f.t > 3 OR k.a > f.a THEN k.t ELSE f.t END, CASE WHEN k.t - f.t > 3 OR k.a > f.a THEN k.a ELSE f.a END, CASE WHEN k.t - f.t > 3 THEN e + 1 ELSE e END FROM f JOIN k ON k.cell = f.cell AND k.rn = f.rn + 1),
kept AS (SELECT cell, max_by(t, rn) AS t FROM f GROUP BY cell, e)"""


def keep(least: int) -> str:
    return f"""k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY t) AS rn FROM c),
f AS (SELECT cell, rn, t, t AS last, true AS ok FROM k WHERE rn = 1 UNION ALL
 SELECT k.cell, k.rn, k.t, CASE WHEN k.t - f.last >= {least} THEN k.t ELSE f.last END, k.t - f.last >= {least} FROM f JOIN k ON k.cell = f.cell AND k.rn = f.rn + 1),
kept AS (SELECT cell, t FROM f WHERE ok)"""


MARKED = "s AS (SELECT t.cell, t.t, t.value, (kept.t IS NOT NULL)::INT::DOUBLE AS spike FROM traces t LEFT JOIN kept ON kept.cell = t.cell AND kept.t = t.t)"
PLAIN = "SELECT cell, t, NULL::DOUBLE AS fit, spike FROM s"


def fitted(after: str) -> str:
    """A recursive fit: after gives c[i] from the frame before (g.c, p.spike)."""
    return f"g AS (SELECT cell, t, value AS c, spike FROM s WHERE t = 1 UNION ALL SELECT s.cell, s.t, {after}, s.spike FROM g JOIN s ON s.cell = g.cell AND s.t = g.t + 1) SELECT cell, t, round(c, 6) + 0.0 AS fit, spike FROM g"


AR1 = fitted("g.c * exp(-0.1::DOUBLE) + g.spike")
STEP1 = fitted("CASE WHEN g.spike = 1 THEN g.c + 1 ELSE g.c * exp(-1::DOUBLE) END")
Z = "z AS (SELECT cell, t, (value - avg(value) OVER p) / nullif(stddev_samp(value) OVER p, 0) AS value FROM traces WINDOW p AS (PARTITION BY cell))"


def shown(df: DataFrame) -> DataFrame:
    return df.select("cell", "t", r6("fit").alias("fit"), "spike")


@register("oasis_spike_summary", f"{W}, {OASIS}, n AS (SELECT cell, count(*) AS frames FROM traces GROUP BY cell), e AS (SELECT cell, count(*) AS e FROM kept GROUP BY cell) SELECT cell, coalesce(e, 0) AS n_spikes, round(coalesce(e, 0) / frames, 6) AS rate FROM n LEFT JOIN e USING (cell)")
def oasis_spike_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = traces(spark, sf_dir)
    events = S.oasis_events(df).groupBy("cell").agg(F.count("*").alias("e"))
    return df.groupBy("cell").agg(F.count("*").alias("n")).join(events, "cell", "left").select("cell", F.coalesce("e", F.lit(0)).cast("long").alias("n_spikes"), r6(F.coalesce("e", F.lit(0)) / F.col("n")).alias("rate"))


@register("oasis_candidates", f"{W}, {MA21} SELECT cell, count(*) FILTER (a > 0.1::DOUBLE * s) AS candidates FROM d JOIN (SELECT cell, stddev_samp(a) AS s FROM d GROUP BY cell) USING (cell) GROUP BY cell")
def oasis_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.per_cell(S.detrended(traces(spark, sf_dir)), F.stddev_samp("a").alias("s"))
    return d.groupBy("cell").agg(F.sum((F.col("a") > 0.1 * F.col("s")).cast("long")).alias("candidates"))


@register("calcium_ar1_fit", f"{W}, {OASIS}, {MARKED}, {AR1}")
def calcium_ar1_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(S.oasis(traces(spark, sf_dir)))


@register("spikes_fallback", f"{W}, m AS (SELECT cell, t, value, CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END AS m, 2 * stddev_samp(value) OVER (PARTITION BY cell) AS s FROM traces WINDOW w AS (PARTITION BY cell ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT cell, t, round(coalesce(m, value), 6) AS fit, (value > s)::INT::DOUBLE AS spike FROM m")
def spikes_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(S.fallback(traces(spark, sf_dir)))


@register("spikes_suite2p", f"{W}, {Z}, c AS (SELECT * FROM (SELECT cell, t, value - lag(value) OVER (PARTITION BY cell ORDER BY t) AS a FROM z) WHERE a > 2.5), {keep(3)}, {MARKED} {PLAIN}")
def spikes_suite2p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.difference(traces(spark, sf_dir))


@register("spikes_local_threshold", f"""{W}, h AS (SELECT *, least(50, count(*) OVER (PARTITION BY cell) // 10) // 2 AS h FROM traces),
l AS (SELECT a.cell, a.t, a.value, avg(b.value) AS m, stddev_samp(b.value) AS d FROM h a JOIN h b ON a.cell = b.cell AND b.t BETWEEN a.t - a.h AND a.t + a.h GROUP BY ALL),
c AS (SELECT cell, t FROM l WHERE value > m + 2 * d), {keep(6)}, {MARKED} {PLAIN}""")
def spikes_local_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.local_threshold(traces(spark, sf_dir))


PEAKS = "p AS (SELECT cell, t, value AS a FROM (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS r FROM traces WINDOW w AS (PARTITION BY cell ORDER BY t)) WHERE value > l AND value > r)"


@register("local_peaks", f"{W}, {PEAKS} SELECT cell, t, a FROM p")
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.peaks(traces(spark, sf_dir))


@register("peaks_top20pct", f"{W}, {PEAKS}, kept AS (SELECT cell, t FROM p JOIN (SELECT cell, quantile_cont(a, 0.8) AS q FROM p GROUP BY cell) USING (cell) WHERE a > q), {MARKED} {PLAIN}")
def peaks_top20pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.high_peaks(traces(spark, sf_dir))


GATED = f"""{Z}, n AS (SELECT cell, count(*) AS n FROM z GROUP BY cell),
w AS (SELECT a.cell, a.t, any_value(a.value) AS x, regr_slope(b.value, b.t) AS slope, avg(b.value) AS m, sum(b.value * b.value) AS q, count(*) AS k FROM z a JOIN z b ON a.cell = b.cell AND b.t BETWEEN a.t AND a.t + 19 GROUP BY a.cell, a.t),
ac AS (SELECT w.cell, w.t, sum((b.value - m) * (c.value - m)) / nullif(any_value(q - 20 * m * m), 0) AS acf FROM w JOIN z b ON w.cell = b.cell AND b.t BETWEEN w.t AND w.t + 18 JOIN z c ON c.cell = b.cell AND c.t = b.t + 1 GROUP BY w.cell, w.t),
y AS (SELECT w.cell, w.t, CASE WHEN k = 20 THEN x * (1 + 0.1::DOUBLE * slope + 0.05::DOUBLE * acf) ELSE 0 END AS value FROM w LEFT JOIN ac USING (cell, t)),
kept AS (SELECT cell, t FROM (SELECT *, avg(value) OVER v + 2 * stddev_samp(value) OVER v AS lim FROM y WINDOW v AS (PARTITION BY cell ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) WHERE value > lim)"""


@register("spikes_adaptive", f"{W}, {GATED}, {MARKED}, {STEP1}")
def spikes_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(S.gated_threshold(traces(spark, sf_dir)))


CONV = f"""{Z}, e AS (SELECT a.cell, a.t, sum(b.value * list_extract([-0.64::DOUBLE, -0.49, 0.06, 0.61, 0.76], (b.t - greatest(1, a.t - 2) + 1)::INT)) AS y FROM z a JOIN z b ON a.cell = b.cell AND b.t BETWEEN a.t - 2 AND a.t + 2 GROUP BY ALL),
y AS (SELECT cell, t, greatest(y, 0) AS a FROM e), c AS (SELECT cell, t, a FROM y JOIN (SELECT cell, quantile_cont(a, 0.9) AS q FROM y GROUP BY cell) USING (cell) WHERE a > q), {keep(3)}"""


@register("spikes_conv", f"{W}, {CONV}, {MARKED}, {STEP1}")
def spikes_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(S.conv_threshold(traces(spark, sf_dir)))


ATT = f"""{Z}, b AS (SELECT a.cell, a.t, any_value(a.value) AS x, sum(b.value * w) / sum(w) AS both_, sum(b.value * l) / sum(l) AS loc, sum(b.value * r) / sum(r) AS rec FROM
 (SELECT a.cell, a.t, a.value, b.value AS bv, b.t AS bt, exp(-abs(a.t - b.t) / 30.0::DOUBLE) / (1 + abs(a.value - b.value)) AS w, CASE WHEN abs(a.t - b.t) <= 15 THEN exp(-abs(a.t - b.t) / 15.0::DOUBLE) ELSE 0 END AS l,
  CASE WHEN b.t <= a.t THEN b.t - greatest(1, a.t - 30) + 1 ELSE 0 END AS r FROM z a JOIN z b ON a.cell = b.cell AND b.t BETWEEN a.t - 30 AND a.t + 30) a, LATERAL (SELECT a.bv AS value) b GROUP BY a.cell, a.t),
y AS (SELECT cell, t, 0.6::DOUBLE * both_ + 0.4::DOUBLE * (loc + abs(x) / sum(abs(x)) OVER (PARTITION BY cell) * x + rec) / 3 AS value FROM b)"""


@register("banded_attention", f"{W}, {ATT} SELECT cell, t, round(value, 6) + 0.0 AS value FROM y")
def banded_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.attention(traces(spark, sf_dir)).select("cell", "t", r6("value").alias("value"))


@register("spikes_attention", f"{W}, {ATT}, kept AS (SELECT cell, t FROM y JOIN (SELECT cell, quantile_cont(value, 0.9) AS q FROM y GROUP BY cell) USING (cell) WHERE value > q), {MARKED}, {STEP1}")
def spikes_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(S.attention_threshold(traces(spark, sf_dir)))


MEAN2 = "c AS (SELECT cell, t, value FROM (SELECT *, avg(value) OVER p + 2 * stddev_samp(value) OVER p AS lim FROM traces WINDOW p AS (PARTITION BY cell)) WHERE value > lim)"


@register("spikes_mean_threshold", f"{W}, {MEAN2}, kept AS (SELECT cell, t FROM c), {MARKED} {PLAIN}")
def spikes_mean_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mean_threshold(traces(spark, sf_dir))


ROLLING = """n AS (SELECT cell, greatest(5, least(50, count(*) // 20)) AS w FROM traces GROUP BY cell),
a AS (SELECT x.cell, x.t, any_value(x.value) AS x, avg(y.value) AS m, any_value(w) AS w FROM traces x JOIN n ON n.cell = x.cell JOIN traces y ON y.cell = x.cell AND y.t BETWEEN x.t - (w - 1) // 2 AND x.t + w // 2 GROUP BY x.cell, x.t HAVING count(*) = any_value(w)),
r AS (SELECT x.cell, x.t FROM a x JOIN a y ON y.cell = x.cell AND y.t BETWEEN x.t - (x.w - 1) // 2 AND x.t + x.w // 2 GROUP BY x.cell, x.t HAVING count(*) = any_value(x.w) AND any_value(x.x) > any_value(x.m) + 2 * sqrt(avg((y.x - y.m) * (y.x - y.m))))"""


@register("spikes_rolling_threshold", f"{W}, {ROLLING}, kept AS (SELECT cell, t FROM r), {MARKED} {PLAIN}")
def spikes_rolling_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rolling_threshold(traces(spark, sf_dir))


@register("sliding_windows", f"{W}, w AS (SELECT cell, t, count(*) OVER p AS n, first(value) OVER p AS first, last(value) OVER p AS last FROM traces WINDOW p AS (PARTITION BY cell ORDER BY t ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) SELECT cell, t, first, last FROM w WHERE n = 20")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sliding_windows(traces(spark, sf_dir)).select("cell", "t", F.get("values", F.lit(0)).alias("first"), F.get("values", F.lit(19)).alias("last"))


FEATURES = """w AS (SELECT a.cell, a.t, avg(b.value) AS m, stddev_samp(b.value) AS sd, regr_slope(b.value, b.t) AS trend, sum(b.value * b.value) - 20 * avg(b.value) * avg(b.value) AS q FROM traces a JOIN traces b ON a.cell = b.cell AND b.t BETWEEN a.t AND a.t + 19 GROUP BY a.cell, a.t HAVING count(*) = 20),
ac AS (SELECT w.cell, w.t, sum((b.value - m) * (c.value - m)) / nullif(any_value(q), 0) AS acf FROM w JOIN traces b ON w.cell = b.cell AND b.t BETWEEN w.t AND w.t + 18 JOIN traces c ON c.cell = b.cell AND c.t = b.t + 1 GROUP BY w.cell, w.t)"""


@register("window_features", f"{W}, {FEATURES} SELECT cell, t, round(m, 5) AS mean, round(sd, 5) AS sd, round(trend, 5) + 0.0 AS trend, round(acf, 5) + 0.0 AS autocorr FROM w JOIN ac USING (cell, t)")
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.window_features(traces(spark, sf_dir))
    return f.select("cell", "t", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("mean", "sd", "trend", "autocorr")])


@register("lags", f"{W}, l AS (SELECT cell, t, {', '.join(f'lag(value, {i}) OVER p AS lag_{i}' for i in range(1, 6))} FROM traces WINDOW p AS (PARTITION BY cell ORDER BY t)) SELECT * FROM l WHERE lag_5 IS NOT NULL")
def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lags(traces(spark, sf_dir))


@register("prob_spikes", f"{W}, {MEAN2}, {keep(6)} SELECT t.cell, t.t, (CASE WHEN kept.t IS NOT NULL THEN 0.8 WHEN c.t IS NOT NULL THEN 0.3 ELSE 0.1 END)::DOUBLE AS probability FROM traces t LEFT JOIN c ON c.cell = t.cell AND c.t = t.t LEFT JOIN kept ON kept.cell = t.cell AND kept.t = t.t")
def prob_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spike_probability(traces(spark, sf_dir))


OASIS_MARKED = f"{OASIS}, {MARKED}"


@register("isi_metrics", f"{W}, {OASIS_MARKED}, i AS (SELECT cell, t - lag(t) OVER (PARTITION BY cell ORDER BY t) AS isi FROM s WHERE spike = 1), j AS (SELECT cell, avg(isi) AS m, stddev_samp(isi) / avg(isi) AS cv FROM i GROUP BY cell), b AS (SELECT cell, sum(spike)::BIGINT AS n_spikes, avg(spike) AS rate FROM s GROUP BY cell) SELECT cell, n_spikes, round(rate, 6) AS rate, round(m, 6) AS mean_isi, round(cv, 6) AS cv_isi FROM b LEFT JOIN j USING (cell)")
def isi_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = traces(spark, sf_dir)
    return S.spike_metrics(S.mark(df, S.oasis_events(df))).select("cell", "n_spikes", *[r6(c).alias(c) for c in ("rate", "mean_isi", "cv_isi")])


@register("validate_spikes", f"{W}, {OASIS_MARKED}, i AS (SELECT cell, value, t - lag(t) OVER (PARTITION BY cell ORDER BY t) AS g FROM s WHERE spike = 1), j AS (SELECT cell, min(g) AS mi, avg(value) AS ma FROM i GROUP BY cell), b AS (SELECT cell, sum(spike)::BIGINT AS n_spikes, avg(spike) AS rate FROM s GROUP BY cell) SELECT cell, n_spikes, round(rate, 6) AS rate, mi AS min_interval, round(ma, 6) AS mean_amplitude, rate > 0.5 AS too_many, coalesce(mi < 3, false) AS too_close FROM b LEFT JOIN j USING (cell)")
def validate_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = traces(spark, sf_dir)
    v = S.validate_spikes(df, S.mark(df, S.oasis_events(df)))
    return v.withColumns({c: r6(c) for c in ("rate", "mean_amplitude")})


@register("spike_report", f"{W}, {OASIS_MARKED}, i AS (SELECT cell, value, t - lag(t) OVER (PARTITION BY cell ORDER BY t) AS g FROM s WHERE spike = 1), j AS (SELECT cell, avg((g < 5)::INT) AS v, avg((value < 0.1)::INT) AS w FROM i GROUP BY cell), b AS (SELECT cell, sum(spike)::BIGINT AS n_spikes, avg(spike) AS rate FROM s GROUP BY cell), a AS (SELECT cell, n_spikes, rate, coalesce(v, 0) AS v, coalesce(w, 0) AS w FROM b LEFT JOIN j USING (cell)) SELECT cell, n_spikes, round(rate, 6) AS rate, round(v, 6) AS violation_rate, round(w, 6) AS weak_rate, round(0.4 * greatest(0, 1 - abs(rate - 0.02::DOUBLE) / 0.02::DOUBLE) + 0.3 * greatest(0, 1 - v) + 0.3 * greatest(0, 1 - w), 6) AS quality FROM a")
def spike_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = traces(spark, sf_dir)
    return S.spike_report(df, S.mark(df, S.oasis_events(df))).select("cell", "n_spikes", *[r6(c).alias(c) for c in ("rate", "violation_rate", "weak_rate", "quality")])


@register("step_sizes", f"{W}, d AS (SELECT cell, value - lag(value) OVER (PARTITION BY cell ORDER BY t) AS d FROM traces) SELECT cell, round(median(abs(d)), 6) AS usual FROM d GROUP BY cell")
def step_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glimmerframe.functions.quantiles import exact_quantile

    s = steps(traces(spark, sf_dir)).withColumn("d", F.abs("step"))
    return exact_quantile(s, ["cell"], "d", name="usual").select("cell", r6("usual").alias("usual"))
