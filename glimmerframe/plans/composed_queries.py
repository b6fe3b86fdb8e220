"""Queries of whole analyses. Their SQL is composed of that of the single operators, as the analyses are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmerframe.operators import composed as C
from glimmerframe.operators import images as I
from glimmerframe.operators import network as N
from glimmerframe.operators import numeric
from glimmerframe.operators import spikes as S
from glimmerframe.operators import traces as T
from glimmerframe.plans import network_queries as NQ
from glimmerframe.plans import sample_queries as SQ
from glimmerframe.plans import spike_queries, trace_queries  # noqa: F401  (their SQL is used below)
from glimmerframe.plans.registry import ORACLE, register
from glimmerframe.plans.spike_queries import OASIS
from glimmerframe.plans.views import BINS_SQL, TRACES_SQL, bins, months, pixels, r6, samples, traces

W = f"WITH {TRACES_SQL}"
PERCENTILE = "e2 AS (SELECT * FROM e WHERE abs(w) >= (SELECT quantile_cont(a, 0.9) FROM mm) AND w <> 0)"


@register("functional_connectivity", ORACLE["graph_summary"].replace(f"{NQ.THR_ABS}", f"m{NQ.ALL}, {PERCENTILE}"))
def functional_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.functional_connectivity(months(spark, sf_dir), value=0.9)["summary"]
    return s.withColumns({c: r6(c) for c in ("density", "mean_degree", "clustering")})


@register("graph_metrics", f"SELECT d.*, closeness FROM ({ORACLE['graph_degree']}) d JOIN ({ORACLE['graph_closeness']}) c USING (node)")
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.graph_metrics(*NQ.kept(spark, sf_dir)).withColumns({c: r6(c) for c in ("strength", "closeness")})


@register("causality_methods", f"WITH l AS ({ORACLE['lagged_corr']}), p AS ({ORACLE['lagged_links']}), c AS ({ORACLE['ccf_max']}) SELECT 'pcmci' AS method, src, dst, w FROM p UNION ALL SELECT 'ccm', src, dst, w FROM c UNION ALL SELECT 'granger', src, dst, max(abs(r)) FROM l GROUP BY ALL")
def causality_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.causality(months(spark, sf_dir), ("pcmci", "ccm", "granger"), alpha=0.6).withColumn("w", r6("w"))


@register("window_communities", f"{NQ.W}, {NQ.WINS} SELECT win, (SELECT count(DISTINCT cell) FROM months) AS cells, 2::BIGINT AS communities FROM wins")
def window_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, wins = NQ.windowed(spark, sf_dir)
    c = C.window_communities(e, wins, N.nodes_of(months(spark, sf_dir)), 25)
    return c.groupBy("win").agg(F.count("*").alias("cells"), F.countDistinct("community").alias("communities"))


@register("statistical_analysis", f"""WITH q AS (SELECT avg(score) AS c FROM ({ORACLE['correction_quality']})),
s AS (SELECT avg(quality) AS s, bool_or(violation_rate > 0.1::DOUBLE OR weak_rate > 0.3::DOUBLE OR rate < 0.001::DOUBLE OR rate > 0.1::DOUBLE) AS odd FROM ({ORACLE['spike_report']}))
SELECT round(c, 4) AS correction_quality, round(s, 4) AS spike_quality, round((c + s) / 2, 4) AS overall_quality, coalesce((c + s) / 2 >= 0.8::DOUBLE, false) AS passed, (c < 0.6::DOUBLE)::INT + odd::INT AS recommendations FROM q, s""")
def statistical_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = traces(spark, sf_dir)
    q = T.correction_quality(df, T.detrend(df).withColumn("value", F.col("value") + 100)).agg(F.avg(r6("score")).alias("c"))  # as in the query correction_quality
    a = C.statistical_analysis(df, df, S.mark(df, S.oasis_events(df)))
    both = a.join(F.broadcast(q)).withColumn("o", (F.col("c") + F.col("spike_quality")) / 2)
    told = F.when(F.col("c") < 0.6, 1).otherwise(0) + F.when(F.array_contains("recommendations", C.POOR_SPIKES), 1).otherwise(0)
    return both.select(F.round("c", 4).alias("correction_quality"), F.round("spike_quality", 4).alias("spike_quality"), F.round("o", 4).alias("overall_quality"), F.coalesce(F.col("o") >= 0.8, F.lit(False)).alias("passed"), told.alias("recommendations"))


@register("validation_report", f"{W}, q AS (SELECT cell, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM traces GROUP BY cell), o AS (SELECT count(DISTINCT cell) AS o FROM traces JOIN q USING (cell) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)), t AS (SELECT count(*) AS readings, count(DISTINCT cell) AS cells, count(*) - count(value) AS missing, min(value) AS lowest, max(value) AS highest FROM traces) SELECT readings, cells, missing, o AS outlier_cells, lowest, highest, missing = 0 AND lowest >= -10 AND highest <= 10 AS passed, CASE WHEN missing > 0 THEN 'missing,' ELSE '' END || CASE WHEN lowest < -10 OR highest > 10 THEN 'range,' ELSE '' END || CASE WHEN o > 0 THEN 'outliers' ELSE '' END AS issues FROM t, o")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.validation_report(traces(spark, sf_dir))
    return r.select("readings", "cells", "missing", "outlier_cells", "lowest", "highest", "passed", F.array_join("issues", ",").alias("issues"))


@register("missing_metadata", "SELECT recording_id, (experiment_id IS NULL)::INT + (date IS NULL)::INT + (animal_id IS NULL)::INT AS missing FROM recordings")
def missing_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.missing_fields(spark.read.parquet(f"{sf_dir}/recordings.parquet"))
    return m.select("recording_id", F.size("missing").alias("missing"))


@register("curate", f"WITH d AS ({ORACLE['preprocess_chain']}), q AS (SELECT cell, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM d GROUP BY cell) SELECT cell, count(*) AS frames, count(value) FILTER (value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS kept FROM d JOIN q USING (cell) GROUP BY cell")
def curate(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = C.curate(traces(spark, sf_dir), lowest=0.0, highest=1000.0)["data"]
    return data.groupBy("cell").agg(F.count("*").alias("frames"), F.count("value").alias("kept"))


@register("batch_quality_control", f"WITH {BINS_SQL}, s AS (SELECT event_type AS dataset, t // 7 AS cell, avg(value) / nullif(stddev_samp(value), 0) AS snr, count(value) AS n FROM bins GROUP BY ALL) SELECT dataset, sum(n) > 0 AS qc_pass, round(avg(snr), 6) AS mean_snr FROM s GROUP BY dataset")
def batch_quality_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bins(spark, sf_dir).select(F.col("event_type").alias("dataset"), F.floor(F.col("t") / 7).alias("cell"), "t", "value")
    return C.batch_quality_control(df).withColumn("mean_snr", r6("mean_snr"))


FOLDS = f"""n AS (SELECT cell, greatest(1, count(*) // 5) AS s FROM traces GROUP BY cell), folded AS (SELECT cell, t, value, least((t - 1) // s, 4) AS fold FROM traces JOIN n USING (cell)),
pieces AS (SELECT cell || ':' || fold AS cell, fold, t - min(t) OVER (PARTITION BY cell, fold) + 1 AS t, value, count(*) OVER (PARTITION BY cell, fold) AS n, value > 2 * stddev_samp(value) OVER (PARTITION BY cell, fold) AS high FROM folded)"""
FOUND = f"""{OASIS.replace('FROM traces', 'FROM pieces')}, x AS (SELECT p.cell, p.fold, CASE WHEN p.n >= 21 THEN kept.t IS NOT NULL ELSE coalesce(p.high, false) END AS spike FROM pieces p LEFT JOIN kept ON kept.cell = p.cell AND kept.t = p.t),
r AS (SELECT cell, fold, avg(spike::INT) AS r FROM x GROUP BY ALL), s AS (SELECT fold, avg(CASE WHEN r < 0.001::DOUBLE OR r > 0.1::DOUBLE THEN 0 ELSE 1 - abs(r - 0.02::DOUBLE) / 0.02::DOUBLE END) AS s FROM r GROUP BY fold)"""


@register("optimize_threshold", f"WITH RECURSIVE {TRACES_SQL}, {FOLDS}, {FOUND} SELECT threshold::DOUBLE AS threshold, round(avg(s), 6) + 0.0 AS mean_score, round(stddev_samp(s), 6) AS sd_score, threshold = 1.5 AS best FROM s, (SELECT unnest([1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0]) AS threshold) GROUP BY threshold")
def optimize_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.optimise_threshold(traces(spark, sf_dir)).withColumns({c: r6(c) for c in ("mean_score", "sd_score")})


@register("auto_optimize")
def auto_optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.auto_optimise(traces(spark, sf_dir))


@register("batch_correction", ORACLE["batch_center_scale"])
def batch_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SQ.valued(C.correct_batches(samples(spark, sf_dir), "mnn"))


AWARE = "fixed AS (SELECT sample, feature, batch, value - star * sqrt(pooled) AS value FROM {0} JOIN s USING (feature, batch))"


@register("batch_aware", f"{SQ.W}, {SQ.COMBAT_MEAN}, {AWARE.format('samples')}, a AS (SELECT avg(f) AS a FROM ({SQ.FSTAT.format('samples')})), b AS (SELECT avg(f) AS b FROM ({SQ.FSTAT.format('fixed')})) SELECT round(a, 5) AS before, round(b, 5) AS after, round(a - b, 5) AS improvement, round((a - b) / a * 100, 4) AS percent FROM a, b")
def batch_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.batch_aware(samples(spark, sf_dir), mean_only=True)["report"]
    return r.select(*[F.round(c, 5).alias(c) for c in ("before", "after", "improvement")], F.round("percent", 4).alias("percent"))


@register("held_out_batch", f"WITH {SQ.SAMPLES_SQL.replace('samples AS', 'everyone AS')}, samples AS (SELECT * FROM everyone WHERE batch <> 9), {SQ.COMBAT_MEAN}, {AWARE.format('samples')}, a AS (SELECT avg(f) AS a FROM ({SQ.FSTAT.format('samples')})), b AS (SELECT avg(f) AS b FROM ({SQ.FSTAT.format('fixed')})) SELECT 'combat' AS method, 9 AS test_batch, (SELECT count(DISTINCT sample) FROM samples) AS train_samples, (SELECT count(DISTINCT sample) FROM everyone WHERE batch = 9) AS test_samples, round((a - b) / a, 5) AS reduction FROM a, b")
def held_out_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.held_out_batch(samples(spark, sf_dir), 9, mean_only=True).withColumn("reduction", F.round("reduction", 5))


@register("analysis_summary", f"WITH RECURSIVE {TRACES_SQL}, {OASIS}, cells AS (SELECT cell, count(*) AS n, avg(value) / nullif(stddev_samp(value), 0) AS snr FROM traces GROUP BY cell), rates AS (SELECT cells.cell, count(kept.t) AS s, count(kept.t) / any_value(n) AS r FROM cells LEFT JOIN kept USING (cell) GROUP BY cells.cell) SELECT (SELECT count(*) FROM cells) AS cells, (SELECT max(n) FROM cells) AS frames, sum(s)::BIGINT AS spikes, round(avg(r), 6) AS mean_rate, (SELECT round(avg(snr), 6) FROM cells) AS mean_snr, (SELECT round(median(value), 6) FROM traces) AS median_value FROM rates")
def analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = traces(spark, sf_dir)
    return C.analysis_summary(df, S.mark(df, S.oasis_events(df))).withColumns({c: r6(c) for c in ("mean_rate", "mean_snr", "median_value")})


@register("roi_table", f"SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY label) AS roi_id, centroid_c AS x, centroid_r AS y, intensity FROM ({ORACLE['region_props']})")
def roi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.roi_table(I.components(SQ.mask(spark, sf_dir)), pixels(spark, sf_dir)).withColumns({c: r6(c) for c in ("x", "y", "intensity")})


@register("roi_quality", f"{SQ.P}, p AS ({ORACLE['region_props']}) SELECT frame, label, round(area / (area + 4), 6) AS size, round(1 - eccentricity, 6) + 0.0 AS shape FROM p")
def roi_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = I.roi_quality(I.components(SQ.mask(spark, sf_dir)), pixels(spark, sf_dir))
    # a region's own pixels tie with its mean, so the share that it exceeds, and with it the overall score, is left to the tests
    return q.select("frame", "label", r6("size").alias("size"), (1 - r6(1 - F.col("shape"))).alias("shape")).withColumn("shape", r6("shape"))


INVERSE = "back AS MATERIALIZED (SELECT frame, r, c, (value <= 0)::INT AS value FROM pixels)"


@register("fill_holes", f"{SQ.P}, {INVERSE}, {SQ.labelled_sql('back', 'b')}, open_ AS (SELECT DISTINCT frame, label FROM b WHERE r IN (0, 7) OR c IN (0, 7)), h AS (SELECT frame, r, c FROM b ANTI JOIN open_ USING (frame, label)) SELECT p.frame, p.r, p.c, CASE WHEN h.frame IS NOT NULL THEN 1.0::DOUBLE ELSE (p.value > 0)::INT::DOUBLE END AS value FROM pixels p LEFT JOIN h ON h.frame = p.frame AND h.r = p.r AND h.c = p.c")
def fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SQ.shown(I.fill_holes(SQ.mask(spark, sf_dir)))


@register("contours", f"{SQ.P}, {SQ.MASK}, {SQ.labelled_sql('mask', 'k')} SELECT frame, label, r, c FROM k WHERE (SELECT count(*) FROM k o WHERE o.frame = k.frame AND o.label = k.label AND abs(o.r - k.r) + abs(o.c - k.c) = 1) < 4")
def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.borders(I.components(SQ.mask(spark, sf_dir)))


@register("distance_transform", f"{SQ.P}, {SQ.MASK} SELECT a.frame, a.r, a.c, min(abs(a.r - b.r) + abs(a.c - b.c))::DOUBLE AS value FROM mask a JOIN mask b ON a.frame = b.frame AND b.value = 0 GROUP BY ALL")
def distance_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.distance_transform(SQ.mask(spark, sf_dir)).filter(F.col("value").isNotNull())


@register("local_maxima", f"{SQ.P} SELECT a.frame, a.r, a.c, round(a.value, 6) AS value FROM pixels a JOIN pixels b ON a.frame = b.frame AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 WHERE a.value > 0 GROUP BY a.frame, a.r, a.c, a.value HAVING max(b.value) <= a.value")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SQ.shown(I.local_maxima(pixels(spark, sf_dir)))


@register("kmeans_regions", f"{SQ.P} SELECT frame, count(*) AS pixels FROM pixels GROUP BY frame")
def kmeans_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.kmeans_regions(pixels(spark, sf_dir), 4.0).groupBy("frame").agg(F.count("*").alias("pixels"))


@register("synthetic_preset", "SELECT cell, 500::BIGINT AS frames FROM (SELECT unnest(['Cell_1', 'Cell_2', 'Cell_3', 'Cell_4', 'Cell_5', 'Cell_6', 'Cell_7', 'Cell_8', 'Cell_9', 'Cell_10', 'BG_1', 'BG_2', 'BG_3']) AS cell)")
def synthetic_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.synthetic_preset(spark).groupBy("cell").agg(F.count("*").alias("frames"))
