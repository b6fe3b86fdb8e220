"""Reference queries of the grouped numeric operators, the inference operators and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmerframe.operators import numeric as N
from glimmerframe.operators import spikes as S
from glimmerframe.operators import traces as T
from glimmerframe.plans.registry import register
from glimmerframe.plans.spike_queries import OASIS, W
from glimmerframe.plans.views import BINS_SQL, DAILY_SQL, MONTHS_SQL, bins, daily, months, r6, traces

LOESS = """n AS (SELECT cell, count(*) AS n, least(count(*), greatest(3, floor(count(*) * 0.45::DOUBLE + 1e-5))) AS q FROM {0} GROUP BY cell),
d AS (SELECT a.cell, a.t, b.t - a.t AS d, b.value AS y, row_number() OVER (PARTITION BY a.cell, a.t ORDER BY abs(b.t - a.t), b.t) AS k, q FROM {0} a JOIN {0} b ON a.cell = b.cell JOIN n ON n.cell = a.cell),
h AS (SELECT cell, t, max(abs(d)) AS h FROM d WHERE k <= q GROUP BY ALL),
w AS (SELECT cell, t, d / h AS s, y, pow(1 - pow(abs(d) / h, 3), 3) AS w FROM d JOIN h USING (cell, t) WHERE k <= q),
p AS (SELECT cell, t, sum(w) AS p0, sum(w * s) AS p1, sum(w * s * s) AS p2, sum(w * pow(s, 3)) AS p3, sum(w * pow(s, 4)) AS p4, sum(w * y) AS b0, sum(w * s * y) AS b1, sum(w * s * s * y) AS b2 FROM w GROUP BY ALL),
l AS (SELECT cell, t, (b0 * (p2 * p4 - p3 * p3) - p1 * (b1 * p4 - p3 * b2) + p2 * (b1 * p3 - p2 * b2)) / (p0 * (p2 * p4 - p3 * p3) - p1 * (p1 * p4 - p3 * p2) + p2 * (p1 * p3 - p2 * p2)) AS value FROM p)"""


def valued(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("cell", "t", (F.round("value", digits) + F.lit(0.0)).alias("value"))


@register("loess_baseline", f"{W}, {LOESS.format('traces')} SELECT cell, t, round(value, 4) + 0.0 AS value FROM l")
def loess_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(N.loess_baseline(traces(spark, sf_dir)), 4)


@register("modern_correct", f"{W}, z AS (SELECT cell, t, value / avg(value) OVER (PARTITION BY cell) AS value FROM traces), {LOESS.format('z')} SELECT cell, t, round(z.value - l.value, 4) + 0.0 AS value FROM z JOIN l USING (cell, t)")
def modern_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(N.correct(traces(spark, sf_dir)), 4)


@register("legacy_correct", f"WITH {BINS_SQL}, bg AS (SELECT t, avg(value) AS bg FROM bins WHERE event_type IN ('error', 'view') GROUP BY t), c AS (SELECT event_type AS cell, t - min(t) OVER () + 1 AS t, value - coalesce(bg, 0) AS value FROM bins LEFT JOIN bg USING (t) WHERE event_type IN ('click', 'purchase', 'signup')), {LOESS.format('c')} SELECT cell, t, round(c.value - l.value + 2, 4) + 0.0 AS value FROM c JOIN l USING (cell, t)")
def legacy_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bins(spark, sf_dir)
    b = b.join(F.broadcast(b.filter(F.col("event_type").isin("click", "purchase", "signup")).agg(F.min("t").alias("a")))).select(F.col("event_type").alias("cell"), (F.col("t") - F.col("a") + 1).alias("t"), "value")
    back = b.filter(F.col("cell").isin("error", "view")).select("t", F.col("value").alias("bg"))
    return valued(N.correct(b.filter(F.col("cell").isin("click", "purchase", "signup")), back, "legacy"), 4)


@register("chunked_normalize", f"WITH {DAILY_SQL} SELECT cell, t, round(value / avg(value) OVER (PARTITION BY cell, (t - 1) // 1000), 6) AS value FROM daily")
def chunked_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(N.in_chunks(daily(spark, sf_dir), T.normalise))


@register("chunked_correct", f"WITH {DAILY_SQL}, x AS (SELECT cell || ':' || ((t - 1) // 1000) AS cell, cell AS c, t AS u, (t - 1) % 1000 + 1 AS t, value FROM daily), z AS (SELECT cell, c, u, t, value / avg(value) OVER (PARTITION BY cell) AS value FROM x), {LOESS.format('z')} SELECT z.c AS cell, z.u AS t, round(z.value - l.value, 4) + 0.0 AS value FROM z JOIN l ON z.cell = l.cell AND z.t = l.t")
def chunked_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(N.in_chunks(daily(spark, sf_dir), N.correct), 4)


CHUNKED = OASIS.replace("FROM traces", "FROM pieces")


@register("chunked_spikes", f"WITH RECURSIVE {DAILY_SQL}, pieces AS (SELECT cell || ':' || ((t - 1) // 1000) AS cell, cell AS c, t AS u, (t - 1) % 1000 + 1 AS t, value FROM daily), {CHUNKED}, x AS (SELECT pieces.*, kept.t IS NOT NULL AS spike FROM pieces LEFT JOIN kept ON kept.cell = pieces.cell AND kept.t = pieces.t) SELECT c AS cell, u AS t, spike::INT::DOUBLE AS spike FROM x")
def chunked_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.in_chunks(daily(spark, sf_dir), S.infer_spikes).select("cell", "t", "spike")


def parts_sum(parts: DataFrame) -> DataFrame:
    return parts.groupBy("cell", "t").agg(F.round(F.sum("value"), 2).alias("value"))


SUMMED = f"WITH {DAILY_SQL} SELECT cell, t, round(value, 2) AS value FROM daily"


@register("ssa", SUMMED)
def ssa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of each trace, put together again."""
    return parts_sum(N.ssa(daily(spark, sf_dir)))


@register("emd", SUMMED)
def emd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes and the rest of each trace, put together again."""
    return parts_sum(N.emd(daily(spark, sf_dir)))


@register("haar_denoise", f"""WITH {DAILY_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY cell) AS n, (t - 1) % 8 AS p, (t - 1) // 8 AS o FROM daily),
s AS (SELECT *, sum(value) OVER w8 AS s8, sum(CASE WHEN p >= 4 THEN value ELSE -value END) OVER w8 / sqrt(8) AS d3, sum(CASE WHEN p % 4 >= 2 THEN value ELSE -value END) OVER w4 / 2 AS d2, sum(CASE WHEN p % 2 = 1 THEN value ELSE -value END) OVER w2 / sqrt(2) AS d1, 0.1::DOUBLE * sqrt(2 * ln(n)) AS lim
 FROM n WINDOW w8 AS (PARTITION BY cell, o), w4 AS (PARTITION BY cell, o, p // 4), w2 AS (PARTITION BY cell, o, p // 2))
SELECT cell, t, round(CASE WHEN t > n // 8 * 8 THEN value ELSE s8 / 8 + CASE WHEN abs(d3) > lim THEN d3 ELSE 0 END / sqrt(8) * CASE WHEN p >= 4 THEN 1 ELSE -1 END + CASE WHEN abs(d2) > lim THEN d2 ELSE 0 END / 2 * CASE WHEN p % 4 >= 2 THEN 1 ELSE -1 END + CASE WHEN abs(d1) > lim THEN d1 ELSE 0 END / sqrt(2) * CASE WHEN p % 2 = 1 THEN 1 ELSE -1 END END, 4) AS value FROM s""")
def haar_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(N.haar_denoise(daily(spark, sf_dir)), 4)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return months(spark, sf_dir).withColumn("recording", F.lit("all"))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, value) of the matrix, missing entries 0, rows and columns numbered as the decompositions number them."""
    m = months(spark, sf_dir)
    rows, columns = (m.select(k).distinct().withColumn(n, F.row_number().over(Window.orderBy(k))) for k, n in (("t", "i"), ("cell", "j")))  # one matrix's sides
    held = m.join(F.broadcast(rows), "t").join(F.broadcast(columns), "cell").select("i", "j", "value")
    whole = rows.select("i", F.explode(F.sequence(F.lit(1), F.lit(columns.count()))).alias("j"))
    return whole.join(held, ["i", "j"], "left").select("i", "j", F.coalesce("value", F.lit(0.0)).alias("x"))


@register("rpca", f"WITH {MONTHS_SQL}, r AS (SELECT row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM months)), c AS (SELECT row_number() OVER (ORDER BY cell) AS j FROM (SELECT DISTINCT cell FROM months)) SELECT i, j, true AS holds FROM r, c")
def rpca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether low rank and sparse part add up to the matrix, to a millionth of its largest entry."""
    parts = N.robust_pca(matrix(spark, sf_dir), "recording").groupBy("i", "j").agg(F.sum("value").alias("y"))
    both = numbered(spark, sf_dir).join(parts, ["i", "j"])
    most = both.agg(F.max("x").alias("most"))
    return both.join(F.broadcast(most)).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.abs(F.col("x") - F.col("y")) <= 1e-6 * F.col("most")).alias("holds"))


for _method in ("multiplicative", "als"):

    @register("nmf" if _method == "multiplicative" else "nmf_als", f"WITH {MONTHS_SQL} SELECT count(DISTINCT t) * count(DISTINCT cell) AS entries, true AS not_negative, true AS close FROM months")
    def nmf(spark: SparkSession, sf_dir: str, method: str = _method) -> DataFrame:
        """Whether both factors are not negative and their product is closer to the matrix than its mean is."""
        parts = N.nmf(matrix(spark, sf_dir), "recording", method=method)
        w, h = (parts.filter(F.col("part") == p).select("i", "j", "value") for p in "wh")
        product = w.select("i", F.col("j").alias("k"), F.col("value").alias("a")).join(h.select(F.col("i").alias("k"), "j", F.col("value").alias("b")), "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("y"))
        off = numbered(spark, sf_dir).join(product, ["i", "j"]).agg(F.count("*").alias("entries"), (F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))) / F.count("*") / F.var_pop("x")).alias("off"))
        return off.join(F.broadcast(parts.agg(F.min("value").alias("least")))).select("entries", (F.col("least") >= 0).alias("not_negative"), (F.col("off") < 1).alias("close"))


for _method in ("fastica", "infomax", "pca"):

    @register("ica" if _method == "fastica" else f"ica_{_method}", f"WITH {MONTHS_SQL} SELECT 2::BIGINT AS sources, count(DISTINCT t) AS frames, true AS centred, true AS from_unmixing FROM months")
    def ica(spark: SparkSession, sf_dir: str, method: str = _method) -> DataFrame:
        """Whether the sources are centred and are what the unmixing makes of the centred matrix."""
        parts = N.ica(matrix(spark, sf_dir), "recording", method=method)
        s = parts.filter("part = 'sources'").select("i", F.col("j").alias("k"), "value")
        u = parts.filter("part = 'unmixing'").select(F.col("i").alias("k"), "j", F.col("value").alias("u"))
        x = numbered(spark, sf_dir)
        x = x.join(x.groupBy("j").agg(F.avg("x").alias("m")), "j").select("i", "j", (F.col("x") - F.col("m")).alias("d"))
        y = x.join(u, "j").groupBy("i", "k").agg(F.sum(F.col("d") * F.col("u")).alias("y"))
        both = s.join(y, ["i", "k"])
        size = F.max(F.abs("value"))
        return both.agg(F.countDistinct("k").alias("sources"), F.countDistinct("i").alias("frames"), (F.abs(F.avg("value")) <= 1e-6 * size).alias("centred"), (F.max(F.abs(F.col("value") - F.col("y"))) <= 1e-6 * size).alias("from_unmixing"))


@register("fold_sizes", f"{W}, n AS (SELECT cell, count(*) AS n FROM traces GROUP BY cell) SELECT cell, least((t - 1) // greatest(1, n // 5), 4)::BIGINT AS fold, count(*) AS frames FROM traces JOIN n USING (cell) GROUP BY ALL")
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.folds(traces(spark, sf_dir)).groupBy("cell", F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("frames"))


@register("optimize_span", "SELECT 9::BIGINT AS spans, 1::BIGINT AS best, true AS highest")
def optimize_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans have been tried, how many are marked, and whether the marked one has the highest score."""
    s = N.optimise_span(traces(spark, sf_dir))
    return s.agg(F.count("*").alias("spans"), F.count(F.when(F.col("best"), 1)).alias("best"), (F.max(F.when(F.col("best"), F.col("score"))) == F.max("score")).alias("highest"))


@register("metric_snr", f"{W} SELECT 1 AS k, round(avg(s), 6) AS score FROM (SELECT avg(value) / nullif(stddev_samp(value), 0) AS s FROM traces GROUP BY cell)")
def metric_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.metric(traces(spark, sf_dir).withColumn("k", F.lit(1)), "snr", ["k"]).withColumn("score", r6("score"))


@register("metric_spike_detection", f"{W}, s AS (SELECT cell, avg((value > s)::INT) AS r FROM (SELECT cell, value, 2 * stddev_samp(value) OVER (PARTITION BY cell) AS s FROM traces) GROUP BY cell) SELECT 1 AS k, round(avg(CASE WHEN r BETWEEN 0.001 AND 0.1 THEN 1 - abs(r - 0.02::DOUBLE) / 0.02::DOUBLE ELSE 0 END), 6) AS score FROM s")
def metric_spike_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.metric(traces(spark, sf_dir).withColumn("k", F.lit(1)), "spike_detection", ["k"]).withColumn("score", r6("score"))


@register("bootstrap_ci", f"{W} SELECT cell, count(*) AS frames, true AS holds FROM traces GROUP BY cell")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the interval of spike counts over 1000 resamples is one, within the frames, and has the rates that belong to it."""
    b = N.bootstrap_counts(traces(spark, sf_dir))
    ordered = (F.col("count_low") >= 0) & (F.col("count_low") < F.col("count_high")) & (F.col("count_high") <= F.col("frames"))
    return b.select("cell", "frames", (ordered & (F.abs(F.col("rate_low") * F.col("frames") - F.col("count_low")) < 1e-9) & (F.abs(F.col("rate_high") * F.col("frames") - F.col("count_high")) < 1e-9)).alias("holds"))


for _name in ("poisson", "gaussian", "hierarchical"):

    @register(f"spike_mcmc_{_name}", f"{W} SELECT cell, count(*) AS frames, 1000::BIGINT AS draws, true AS holds FROM traces GROUP BY cell")
    def spike_mcmc(spark: SparkSession, sf_dir: str, model: str = _name) -> DataFrame:
        """Whether 1000 draws of a cell came, probabilities lie between 0 and 1 and add up to the mean number of spikes."""
        d = N.sample_spikes(traces(spark, sf_dir), model)
        of = lambda c, v: F.when(c, v)
        frame, spikes = F.col("t").isNotNull(), F.col("param") == "spikes"
        s = d.groupBy("cell").agg(F.count(of(frame, F.lit(1))).alias("frames"), F.count(of(spikes, F.lit(1))).alias("draws"), F.min(of(frame, F.col("value"))).alias("a"), F.max(of(frame, F.col("value"))).alias("z"), F.sum(of(frame, F.col("value"))).alias("s"), F.avg(of(spikes, F.col("value"))).alias("m"))
        return s.select("cell", "frames", "draws", ((F.col("a") >= 0) & (F.col("z") <= 1) & (F.abs(F.col("s") - F.col("m")) < 1e-6)).alias("holds"))


@register("gibbs_gaussian", f"{W} SELECT cell, 1000::BIGINT AS draws, true AS mean_holds, true AS variance_holds FROM traces GROUP BY cell")
def gibbs_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mean of the draws of each parameter is near the mean of its conditional expectations given the other's draws."""
    d = N.normal_posterior(traces(spark, sf_dir))
    m, v, n, centre = F.col("mean"), F.col("variance"), F.col("n"), F.col("centre")
    given = d.select("cell", "mean", "variance", (n * centre / v / (n / v + 0.1)).alias("em"), ((1 + n * (F.col("spread") + (centre - m) * (centre - m)) / 2) / (n / 2)).alias("ev"))
    near = lambda a, e: F.abs(F.avg(a) - F.avg(e)) < 0.25 * F.stddev(a)
    return given.groupBy("cell").agg(F.count("*").alias("draws"), near("mean", "em").alias("mean_holds"), near("variance", "ev").alias("variance_holds"))


@register("gamma_poisson", f"{W} SELECT cell, 1000::BIGINT AS draws, round((1 + greatest(sum(value), 0)) / (1 + count(*)), 6) AS expected, true AS holds FROM traces GROUP BY cell")
def gamma_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expectation of the rate, and whether the mean of 1000 draws is within six of its standard errors."""
    df = traces(spark, sf_dir)
    obs = df.groupBy("cell").agg(((1 + F.greatest(F.sum("value"), F.lit(0.0))) / (1 + F.count("*"))).alias("expected"))
    d = N.posterior_summary(N.estimate_parameters(df, "poisson"), ["cell"]).join(obs, "cell")
    return d.select("cell", F.col("n").alias("draws"), r6("expected").alias("expected"), (F.abs(F.col("mean") - F.col("expected")) < 6 * F.col("sd") / F.sqrt("n")).alias("holds"))


@register("posterior_summary", f"{W} SELECT cell, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.025), 6) AS lower, round(median(value), 6) AS median, round(quantile_cont(value, 0.975), 6) AS upper FROM traces GROUP BY cell")
def posterior_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.posterior_summary(traces(spark, sf_dir), ["cell"]).select("cell", "n", *[r6(c).alias(c) for c in ("mean", "sd", "lower", "median", "upper")])


@register("model_compare", f"{W}, m AS (SELECT cell, avg(value) AS mean, var_pop(value) AS variance FROM traces GROUP BY cell), l AS (SELECT cell, sum(-0.5::DOUBLE * ln(2 * pi() * variance) - (value - mean) * (value - mean) / (2 * variance)) AS ll, count(*) AS n FROM traces JOIN m USING (cell) GROUP BY cell) SELECT cell, round(ll, 6) AS log_likelihood, round(2 * (n + 2) - 2 * ll, 6) AS aic, round((n + 2) * ln(n) - 2 * ll, 6) AS bic, round(-2 * ll, 6) AS dic FROM l")
def model_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = traces(spark, sf_dir)
    c = N.information_criteria(df, df.groupBy("cell").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance")))
    return c.select("cell", *[r6(x).alias(x) for x in ("log_likelihood", "aic", "bic", "dic")])


def tested(d: DataFrame) -> DataFrame:
    return d.select(((F.col("lower") <= F.col("mean")) & (F.col("mean") <= F.col("upper"))).alias("inside"), F.col("p_greater").between(0, 1).alias("is_probability"))


for _name in ("mean", "variance"):

    @register(f"bayes_{_name}_test", "SELECT true AS inside, true AS is_probability")
    def bayes_test(spark: SparkSession, sf_dir: str, param: str = _name) -> DataFrame:
        return tested(N.compare_groups(N.estimate_parameters(traces(spark, sf_dir)), 1, 2, param, ratio=param == "variance"))


@register("bayes_proportion_test", f"{W}, c AS (SELECT (1 + count(*) FILTER (value > 50 AND cell = 1)) / (2 + count(*) FILTER (cell = 1)) - (1 + count(*) FILTER (value > 50 AND cell = 2)) / (2 + count(*) FILTER (cell = 2)) AS d FROM traces) SELECT round(d, 6) AS expected, true AS near FROM c")
def bayes_proportion_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected difference of the shares above 50 in two cells, and whether that of 1000 draws is near."""
    df = traces(spark, sf_dir)
    share = lambda c: F.try_divide(1 + F.sum(((F.col("cell") == c) & (F.col("value") > 50)).cast("long")), 2 + F.sum((F.col("cell") == c).cast("long")))
    e = df.agg((share(1) - share(2)).alias("e"))
    return N.compare_groups(N.proportion_draws(df, 50.0), 1, 2, "proportion").join(F.broadcast(e)).select(r6("e").alias("expected"), (F.abs(F.col("mean") - F.col("e")) < 0.02).alias("near"))


@register("frame_uncertainty", f"{W} SELECT cell, t, true AS holds FROM traces")
def frame_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = N.frame_uncertainty(traces(spark, sf_dir))
    return u.select("cell", "t", ((F.col("lower") <= F.col("upper")) & F.col("probability").between(0, 1) & (F.abs(F.col("sd") * F.col("sd") - F.col("probability") * (1 - F.col("probability"))) < 1e-9)).alias("holds"))


@register("population_frames", f"{W} SELECT t, count(*) AS cells, round(avg(value), 6) AS mean, round(coalesce(var_samp(value), 0), 2) AS variance FROM traces GROUP BY t")
def population_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.population(traces(spark, sf_dir)).select("t", "cells", r6("mean").alias("mean"), F.round("variance", 2).alias("variance"))


@register("predictive_check", f"{W} SELECT cell, true AS holds FROM traces GROUP BY cell")
def predictive_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the shares of 100 replicates (from 1000 draws) that reach a cell's mean and variance are shares."""
    df = traces(spark, sf_dir)
    p = N.predictive_check(df, N.estimate_parameters(df))
    return p.select("cell", (F.col("p_mean").between(0, 1) & F.col("p_variance").between(0, 1)).alias("holds"))


@register("synthetic_traces", "SELECT cell, 1000::BIGINT AS frames, 1000::BIGINT AS finite, 1::BIGINT AS first, 1000::BIGINT AS last FROM (SELECT unnest(['Cell_1', 'Cell_2', 'Cell_3', 'Cell_4', 'Cell_5', 'BG_1', 'BG_2', 'BG_3']) AS cell)")
def synthetic_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.synthetic(spark).groupBy("cell").agg(F.count("*").alias("frames"), F.sum((F.abs("value") < float("inf")).cast("long")).alias("finite"), F.min("t").alias("first"), F.max("t").alias("last"))


@register("pipeline_summary", f"{W}, {OASIS}, n AS (SELECT cell, count(*) AS frames, avg(value) / nullif(stddev_samp(value), 0) AS snr FROM traces GROUP BY cell), e AS (SELECT cell, count(*) AS e FROM kept GROUP BY cell) SELECT cell, frames, round(snr, 6) AS snr, coalesce(e, 0) AS n_spikes FROM n LEFT JOIN e USING (cell)")
def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = traces(spark, sf_dir)
    q = T.quality_control(df).select("cell", F.col("n").alias("frames"), r6("snr").alias("snr"))
    e = S.oasis_events(df).groupBy("cell").agg(F.count("*").alias("e"))
    return q.join(e, "cell", "left").select("cell", "frames", "snr", F.coalesce("e", F.lit(0)).cast("long").alias("n_spikes"))


@register("raster", f"{W}, {OASIS} SELECT cell, t FROM kept")
def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.oasis_events(traces(spark, sf_dir)).select("cell", "t")


@register("activity_heatmap", f"{W}, n AS (SELECT max(t) AS n FROM traces) SELECT cell, ((t - 1) * 100 // n)::BIGINT AS bin, round(avg(value), 6) AS activity FROM traces, n GROUP BY ALL")
def activity_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = traces(spark, sf_dir)
    n = df.agg(F.max("t").alias("n"))
    return df.join(F.broadcast(n)).groupBy("cell", F.floor((F.col("t") - 1) * 100 / F.col("n")).alias("bin")).agg(r6(F.avg("value")).alias("activity"))
