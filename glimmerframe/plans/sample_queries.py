"""Reference queries of the feature-table and image operators, over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmerframe.operators import images as I
from glimmerframe.operators import samples as S
from glimmerframe.operators.spikes import DETECTORS
from glimmerframe.plans.registry import register
from glimmerframe.plans.views import PIXELS_SQL, SAMPLES_SQL, TRACES_SQL, pixels, r6, samples, traces

W = f"WITH RECURSIVE {SAMPLES_SQL}"
FSTAT = """SELECT feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM
(SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS g FROM (SELECT feature, batch, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM {0} GROUP BY ALL)) GROUP BY feature"""
COSINE = "cosine AS (SELECT sample, feature, batch, value / sqrt(sum(value * value) OVER (PARTITION BY sample)) AS value FROM samples)"
SCALED = "scaled AS (SELECT sample, feature, batch, (value - avg(value) OVER p) / stddev_samp(value) OVER p AS value FROM {0} WINDOW p AS (PARTITION BY batch, feature))"
KEYED = ["sample", "feature", "batch"]


def valued(df: DataFrame) -> DataFrame:
    return df.select(*KEYED, r6("value").alias("value"))


@register("batch_anova_f", f"{W}, f AS ({FSTAT.format('samples')}) SELECT feature, round(f, 6) AS f FROM f")
def batch_anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.anova(samples(spark, sf_dir)).withColumn("f", r6("f"))


@register("cosine_normalize", f"{W}, {COSINE} SELECT sample, feature, batch, round(value, 6) + 0.0 AS value FROM cosine")
def cosine_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(S.cosine_normalise(samples(spark, sf_dir)))


@register("batch_center_scale", f"{W}, {COSINE}, {SCALED.format('cosine')} SELECT sample, feature, batch, round(value, 6) + 0.0 AS value FROM scaled")
def batch_center_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(S.mnn_like(samples(spark, sf_dir)))


@register("batch_report", f"{W}, centred AS (SELECT sample, feature, batch, value - 0.5 * avg(value) OVER (PARTITION BY batch, feature) AS value FROM samples), a AS (SELECT avg(f) AS a FROM ({FSTAT.format('samples')})), b AS (SELECT avg(f) AS b FROM ({FSTAT.format('centred')})) SELECT round(a, 6) AS before, round(b, 6) AS after, round(a - b, 6) AS improvement, round((a - b) / a * 100, 6) AS percent FROM a, b")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir)
    half = df.join(df.groupBy("batch", "feature").agg(F.avg("value").alias("m")), ["batch", "feature"]).withColumn("value", F.col("value") - 0.5 * F.col("m"))
    return S.batch_report(df, half).select(*[r6(c).alias(c) for c in ("before", "after", "improvement", "percent")])


COMBAT_MEAN = """g AS (SELECT feature, batch, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM samples GROUP BY ALL),
h AS (SELECT *, sum(n * m) OVER p / sum(n) OVER p AS grand, sum(n * v) OVER p / sum(n) OVER p AS pooled FROM g WINDOW p AS (PARTITION BY feature)),
k AS (SELECT *, (m - grand) / sqrt(pooled) AS gamma FROM h), s AS (SELECT *, (var_samp(gamma) OVER b * gamma + avg(gamma) OVER b) / (var_samp(gamma) OVER b + 1) AS star FROM k WINDOW b AS (PARTITION BY batch))"""


@register("combat_meanonly", f"{W}, {COMBAT_MEAN} SELECT sample, feature, batch, round(value - star * sqrt(pooled), 6) + 0.0 AS value FROM samples JOIN s USING (feature, batch)")
def combat_meanonly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(S.combat(samples(spark, sf_dir), mean_only=True))


COMBAT_FULL = """g AS (SELECT feature, batch, count(*) AS n, avg(value) AS m, var_pop(value) AS v, var_samp(value) AS vs FROM samples GROUP BY ALL),
h AS (SELECT *, sum(n * m) OVER p / sum(n) OVER p AS grand, sum(n * v) OVER p / sum(n) OVER p AS pooled FROM g WINDOW p AS (PARTITION BY feature)),
k AS (SELECT *, (m - grand) / sqrt(pooled) AS gamma, vs / pooled AS delta FROM h),
e AS (SELECT *, avg(gamma) OVER b AS mean, var_samp(gamma) OVER b AS t2, avg(delta) OVER b AS d, var_samp(delta) OVER b AS s2 FROM k WINDOW b AS (PARTITION BY batch)),
i AS (SELECT feature, batch, n, grand, pooled, gamma, delta, mean, t2, (2 * s2 + d * d) / s2 AS a, (d * s2 + pow(d, 3)) / s2 AS b, gamma AS star, delta AS scale, 0 AS i FROM e UNION ALL
 SELECT feature, batch, n, grand, pooled, gamma, delta, mean, t2, a, b, (n * t2 * gamma + scale * mean) / (n * t2 + scale),
  (b + ((n - 1) * delta + n * pow(gamma - (n * t2 * gamma + scale * mean) / (n * t2 + scale), 2)) / 2) / (n / 2 + a - 1), i + 1 FROM i WHERE i < 200),
s AS (SELECT * FROM i WHERE i = 200)"""


@register("combat_full", f"{W}, {COMBAT_FULL} SELECT sample, feature, batch, round(((value - grand) / sqrt(pooled) - star) / sqrt(scale) * sqrt(pooled) + grand, 5) + 0.0 AS value FROM samples JOIN s USING (feature, batch)")
def combat_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.combat(samples(spark, sf_dir)).select(*KEYED, (F.round("value", 5) + F.lit(0.0)).alias("value"))


@register("pca_harmonize", f"{W}, f AS ({FSTAT.format('samples')}) SELECT round(avg(f), 5) AS before, true AS reduced, (SELECT count(*) FROM samples) AS entries FROM f")
def pca_harmonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch effect before, and whether every entry is still there and the effect less than a tenth of it after."""
    df = samples(spark, sf_dir)
    done = S.pca_harmonise(df, 64)
    r = S.batch_report(df, done).join(F.broadcast(done.agg(F.count("value").alias("entries"))))
    return r.select(F.round("before", 5).alias("before"), (F.col("after") < 0.1 * F.col("before")).alias("reduced"), "entries")


@register("pca_scores", f"{W} SELECT component, (SELECT count(DISTINCT sample) FROM samples) AS samples, true AS centred, true AS in_order FROM (SELECT unnest([1, 2, 3, 4]) AS component)")
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the scores of each of four components are centred, and have no more variance than those of the one before."""
    s = S.pca_scores(samples(spark, sf_dir), 64, 4).groupBy("component").agg(F.count("*").alias("samples"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    before = F.lag("v").over(Window.orderBy("component"))  # four rows
    return s.select("component", "samples", (F.abs("m") < 1e-9 * F.sqrt("v")).alias("centred"), F.coalesce(F.col("v") <= before, F.lit(True)).alias("in_order"))


@register("kmeans_clusters", f"{W} SELECT count(DISTINCT sample) AS samples, 5::BIGINT AS clusters FROM samples")
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.kmeans(samples(spark, sf_dir), 64, 5).agg(F.count("*").alias("samples"), F.countDistinct("cluster").alias("clusters"))


@register("ward_clusters", f"{W} SELECT batch, count(DISTINCT sample) AS samples, 3::BIGINT AS clusters FROM samples GROUP BY batch")
def ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ward_clusters(samples(spark, sf_dir), 64, 3).groupBy("batch").agg(F.count("*").alias("samples"), F.countDistinct("cluster").alias("clusters"))


@register("contrastive_clusters", f"{W} SELECT count(DISTINCT sample) AS samples, 5::BIGINT AS clusters FROM samples")
def contrastive_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means on the leading 32 components of the standardised features."""
    return S.component_kmeans(samples(spark, sf_dir), 64, 5).agg(F.count("*").alias("samples"), F.countDistinct("cluster").alias("clusters"))


UNIT = "SELECT sample, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 6) AS score FROM r"


@register("anomaly_iqr", f"{W}, q AS (SELECT feature, quantile_cont(value, 0.25) AS a, median(value) AS m, quantile_cont(value, 0.75) AS b FROM samples GROUP BY feature), r AS (SELECT sample, avg(CASE WHEN b > a THEN abs(value - m) / (b - a) ELSE 0 END) AS raw FROM samples JOIN q USING (feature) GROUP BY sample) {UNIT}")
def anomaly_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.anomaly_scores(samples(spark, sf_dir)).withColumn("score", r6("score"))


@register("anomaly_zscore", f"{W}, q AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM samples GROUP BY feature), r AS (SELECT sample, avg(CASE WHEN s > 0 THEN abs(value - m) / s ELSE 0 END) AS raw FROM samples JOIN q USING (feature) GROUP BY sample) {UNIT}")
def anomaly_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.anomaly_scores(samples(spark, sf_dir), "zscore").withColumn("score", r6("score"))


@register("anomaly_mahalanobis")
def anomaly_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.anomaly_scores(samples(spark, sf_dir), "mahalanobis", 64)


MODELS = ("mean", "peaks", "suite2p")


@register("compare_models", f"""WITH {TRACES_SQL}, s AS (SELECT cell, t, value, avg(value) OVER p + 2 * stddev_samp(value) OVER p AS lim FROM traces WINDOW p AS (PARTITION BY cell)), n AS (SELECT count(*) AS truth FROM traces WHERE value > 150)
SELECT 'mean' AS model, count(*) FILTER (value > lim AND value > 150) AS true_positives, round(count(*) FILTER (value > lim AND value > 150) / count(*) FILTER (value > lim), 6) AS precision, round(count(*) FILTER (value > lim AND value > 150) / any_value(truth), 6) AS recall FROM s, n""")
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of detectors against readings above 150; the query shows one of them."""
    df = traces(spark, sf_dir)
    scores = S.compare_models(df.filter("value > 150").select("cell", "t"), {m: DETECTORS[m](df) for m in MODELS})
    return scores.filter("model = 'mean'").select("model", "true_positives", r6("precision").alias("precision"), r6("recall").alias("recall"))


@register("detection_scores", f"{W}, t AS (SELECT DISTINCT sample FROM samples WHERE batch = 3), f AS (SELECT DISTINCT sample FROM samples WHERE feature = 1 AND value > 0), n AS (SELECT (SELECT count(*) FROM t JOIN f USING (sample)) AS tp, (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM f) AS nf) SELECT tp AS true_positives, round(tp / nf, 6) AS precision, round(tp / nt, 6) AS recall, round(2 * tp / (nt + nf), 6) AS f1 FROM n")
def detection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir)
    d = S.detection_scores(df.filter("batch = 3"), df.filter("feature = 1 and value > 0"), ["sample"])
    return d.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@register("top_features", f"{W} SELECT sample, rank, feature, value FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value DESC, feature) AS rank FROM samples) WHERE rank <= 3")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ranked(samples(spark, sf_dir), 3)


P = f"{W}, {PIXELS_SQL}"
MASK = "mask AS (SELECT frame, r, c, (value > 0)::INT AS value FROM pixels)"


def near(source: str, h: int, expression: str) -> str:
    return f"SELECT a.frame, a.r, a.c, {expression} AS value FROM {source} a JOIN {source} b ON a.frame = b.frame AND b.r BETWEEN a.r - {h} AND a.r + {h} AND b.c BETWEEN a.c - {h} AND a.c + {h} GROUP BY a.frame, a.r, a.c"


ERODE, DILATE = "(sum(b.value) = 9)::INT", "max(b.value)"


def shown(df: DataFrame) -> DataFrame:
    return df.select("frame", "r", "c", r6("value").alias("value"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).withColumn("value", (F.col("value") > 0).cast("double"))


@register("contrast_stretch", f"{P} SELECT frame, r, c, round((value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p), 6) AS value FROM pixels WINDOW p AS (PARTITION BY frame)")
def contrast_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(I.contrast_stretch(pixels(spark, sf_dir)))


@register("mean_image", f"{P} SELECT 0::BIGINT AS frame, r, c, round(avg(value), 6) + 0.0 AS value FROM pixels GROUP BY r, c")
def mean_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(I.mean_image(pixels(spark, sf_dir)))


@register("gaussian3", f"""{P}, k AS (SELECT unnest(range(-3, 4)) AS d), g AS (SELECT d, exp(-d * d / 2.0::DOUBLE) / sum(exp(-d * d / 2.0::DOUBLE)) OVER () AS w FROM k),
x AS (SELECT a.frame, a.r, a.c, CASE WHEN count(*) = 7 THEN sum(b.value * w) ELSE 0 END AS value FROM pixels a JOIN pixels b ON a.frame = b.frame AND a.c = b.c JOIN g ON b.r - a.r = g.d GROUP BY ALL),
y AS (SELECT a.frame, a.r, a.c, CASE WHEN count(*) = 7 THEN sum(b.value * w) ELSE 0 END AS value FROM x a JOIN x b ON a.frame = b.frame AND a.r = b.r JOIN g ON b.c - a.c = g.d GROUP BY ALL) SELECT frame, r, c, round(value, 6) + 0.0 AS value FROM y""")
def gaussian3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(I.gaussian(pixels(spark, sf_dir)))


@register("median3", f"{P}, o AS (SELECT a.frame, a.r, a.c, coalesce(b.value, 0) AS v FROM (SELECT *, unnest([-1, 0, 1]) AS dr FROM pixels) a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dc) d LEFT JOIN pixels b ON b.frame = a.frame AND b.r = a.r + a.dr AND b.c = a.c + d.dc) SELECT frame, r, c, round(median(v), 6) + 0.0 AS value FROM o GROUP BY ALL")
def median3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(I.median_filter(pixels(spark, sf_dir)))


@register("local_threshold", f"{P} {near('pixels', 7, '(any_value(a.value) > sum(b.value) / 225 - 0.05)::INT::DOUBLE')}")
def local_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(I.local_threshold(pixels(spark, sf_dir)))


@register("adaptive_threshold", f"{P} {near('pixels', 7, '(any_value(a.value) > avg(b.value) - 0.1 * stddev_samp(b.value))::INT::DOUBLE')}")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(I.adaptive_threshold(pixels(spark, sf_dir)))


@register("quantile_threshold", f"{P} SELECT frame, r, c, (value > quantile_cont(value, 0.8) OVER (PARTITION BY frame))::INT::DOUBLE AS value FROM pixels")
def quantile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(I.quantile_threshold(pixels(spark, sf_dir)))


END = "SELECT frame, r, c, value::DOUBLE AS value FROM"
for _name, _sql, _run in (
    ("erode", f"{P}, {MASK}, e AS ({near('mask', 1, ERODE)}) {END} e", I.erode), ("dilate", f"{P}, {MASK}, d AS ({near('mask', 1, DILATE)}) {END} d", I.dilate),
    ("opening", f"{P}, {MASK}, e AS ({near('mask', 1, ERODE)}), d AS ({near('e', 1, DILATE)}) {END} d", I.opening), ("closing", f"{P}, {MASK}, d AS ({near('mask', 1, DILATE)}), e AS ({near('d', 1, ERODE)}) {END} e", I.closing),
):
    register(_name, _sql)(lambda spark, sf_dir, run=_run: shown(run(mask(spark, sf_dir))))


@register("sobel", f"{P}, g AS (SELECT a.frame, a.r, a.c, sum(b.value * (b.c - a.c) * (2 - abs(b.r - a.r))) AS x, sum(b.value * (b.r - a.r) * (2 - abs(b.c - a.c))) AS y FROM pixels a JOIN pixels b ON a.frame = b.frame AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY ALL) SELECT frame, r, c, round(sqrt(x * x + y * y), 6) AS value FROM g")
def sobel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(I.sobel(pixels(spark, sf_dir)))


LABELS = f"""on_ AS (SELECT frame, r, c FROM pixels WHERE value > 0), walk(frame, r, c, label) AS (SELECT frame, r, c, r * 1000000 + c FROM on_ UNION SELECT o.frame, o.r, o.c, w.label FROM walk w JOIN on_ o ON o.frame = w.frame AND abs(o.r - w.r) + abs(o.c - w.c) = 1),
labels AS (SELECT frame, r, c, min(label) AS label FROM walk GROUP BY ALL)"""


@register("components", f"{P}, {LABELS} SELECT frame, r, c, label FROM labels")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.components(mask(spark, sf_dir))


@register("region_props", f"{P}, {LABELS}, g AS (SELECT frame, label, count(*) AS area, avg(r) AS cr, avg(c) AS cc, avg(value) AS i, coalesce(var_samp(r), 0) AS a, coalesce(var_samp(c), 0) AS b, coalesce(covar_samp(r, c), 0) AS x FROM labels JOIN pixels USING (frame, r, c) GROUP BY ALL) SELECT frame, label, area, round(cr, 6) AS centroid_r, round(cc, 6) AS centroid_c, round(coalesce(sqrt(greatest(0, 1 - (a + b - sqrt((a - b) * (a - b) + 4 * x * x)) / nullif(a + b + sqrt((a - b) * (a - b) + 4 * x * x), 0))), 0), 6) AS eccentricity, round(i, 6) AS intensity FROM g")
def region_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.region_properties(I.components(mask(spark, sf_dir)), pixels(spark, sf_dir)).withColumns({c: r6(c) for c in ("centroid_r", "centroid_c", "eccentricity", "intensity")})


def labelled_sql(mask: str, name: str) -> str:
    """The regions of a mask (frame, r, c, value) as name."""
    return f"""{name}_on AS MATERIALIZED (SELECT frame, r, c FROM {mask} WHERE value > 0), {name}_w(frame, r, c, label) AS (SELECT frame, r, c, r * 1000000 + c FROM {name}_on UNION SELECT o.frame, o.r, o.c, w.label FROM {name}_w w JOIN {name}_on o ON o.frame = w.frame AND abs(o.r - w.r) + abs(o.c - w.c) = 1),
{name} AS MATERIALIZED (SELECT frame, r, c, min(label) AS label FROM {name}_w GROUP BY ALL)"""


SEVENTIETH = "top AS MATERIALIZED (SELECT frame, r, c, (value > quantile_cont(value, 0.7) OVER (PARTITION BY frame))::INT AS value FROM pixels)"


@register("jaccard_quality", f"{P}, {SEVENTIETH}, {MASK}, {labelled_sql('top', 'f')}, {labelled_sql('mask', 't')}, fn AS (SELECT frame, label, count(*) AS n FROM f GROUP BY ALL), tn AS (SELECT frame, label, count(*) AS n FROM t GROUP BY ALL), j AS (SELECT t.frame, t.label, f.label AS other, count(*) AS n FROM t JOIN f USING (frame, r, c) GROUP BY ALL), b AS (SELECT j.frame, j.label, max(j.n / (tn.n + fn.n - j.n)) AS j FROM j JOIN tn ON tn.frame = j.frame AND tn.label = j.label JOIN fn ON fn.frame = j.frame AND fn.label = j.other GROUP BY ALL) SELECT frame, label, round(coalesce(j, 0), 6) AS jaccard FROM tn LEFT JOIN b USING (frame, label)")
def jaccard_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return I.best_overlap(I.segment(px, "threshold"), I.components(mask(spark, sf_dir))).withColumn("jaccard", r6("jaccard"))


LOCAL = f"""st AS MATERIALIZED (SELECT frame, r, c, (value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p) AS value FROM pixels WINDOW p AS (PARTITION BY frame)),
k AS (SELECT unnest(range(-3, 4)) AS d), g AS (SELECT d, exp(-d * d / 2.0::DOUBLE) / sum(exp(-d * d / 2.0::DOUBLE)) OVER () AS w FROM k),
gx AS MATERIALIZED (SELECT a.frame, a.r, a.c, CASE WHEN count(*) = 7 THEN sum(b.value * w) ELSE 0 END AS value FROM st a JOIN st b ON a.frame = b.frame AND a.c = b.c JOIN g ON b.r - a.r = g.d GROUP BY ALL),
gy AS MATERIALIZED (SELECT a.frame, a.r, a.c, CASE WHEN count(*) = 7 THEN sum(b.value * w) ELSE 0 END AS value FROM gx a JOIN gx b ON a.frame = b.frame AND a.r = b.r JOIN g ON b.c - a.c = g.d GROUP BY ALL),
lt AS MATERIALIZED ({near('gy', 7, '(any_value(a.value) > sum(b.value) / 225 - 0.05)::INT')}),
o1 AS MATERIALIZED ({near('lt', 1, ERODE)}), o2 AS MATERIALIZED ({near('o1', 1, DILATE)}), c1 AS MATERIALIZED ({near('o2', 1, DILATE)}), c2 AS MATERIALIZED ({near('c1', 1, ERODE)})"""


@register("segment_local", f"{P}, {LOCAL}, {labelled_sql('c2', 's')} SELECT frame, r, c, label FROM s")
def segment_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.segment(pixels(spark, sf_dir), "local")
