"""Reference queries of the trace core: statistics, corrections, outliers, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmerframe.operators import traces as T
from glimmerframe.plans.registry import register
from glimmerframe.plans.views import BINS_SQL, DAILY_SQL, TRACES_SQL, bins, daily, r6, traces

W = f"WITH {TRACES_SQL}"
KEYS = "cell, t"


def valued(df: DataFrame) -> DataFrame:
    return df.select("cell", "t", r6("value").alias("value"))


@register("trace_stats", f"{W} SELECT cell, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS lowest, max(value) AS highest, round(median(value), 6) AS median, round(max(value) - min(value), 6) AS range FROM traces GROUP BY cell")
def trace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.trace_stats(traces(spark, sf_dir)).select("cell", "n", r6("mean").alias("mean"), r6("sd").alias("sd"), "lowest", "highest", r6("median").alias("median"), r6("range").alias("range"))


@register("background_correct", f"WITH {BINS_SQL}, bg AS (SELECT t, avg(value) AS bg FROM bins WHERE event_type IN ('error', 'view') GROUP BY t) SELECT event_type AS cell, t, round(value - coalesce(bg, 0), 6) + 0.0 AS value FROM bins LEFT JOIN bg USING (t) WHERE event_type IN ('click', 'purchase', 'signup')")
def background_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bins(spark, sf_dir)
    cells = b.filter(F.col("event_type").isin("click", "purchase", "signup")).select(F.col("event_type").alias("cell"), "t", "value")
    return valued(T.subtract_background(cells, b.filter(F.col("event_type").isin("error", "view")).select("t", F.col("value").alias("bg"))))


@register("normalize_mean", f"{W} SELECT cell, t, round(value / nullif(avg(value) OVER (PARTITION BY cell), 0), 6) AS value FROM traces")
def normalize_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(T.normalise(traces(spark, sf_dir)))


@register("zscore", f"{W} SELECT cell, t, round((value - avg(value) OVER p) / nullif(stddev_samp(value) OVER p, 0), 6) + 0.0 AS value FROM traces WINDOW p AS (PARTITION BY cell)")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(T.normalise(traces(spark, sf_dir), "zscore"))


@register("minmax", f"{W} SELECT cell, t, round((value - min(value) OVER p) / nullif(max(value) OVER p - min(value) OVER p, 0), 6) AS value FROM traces WINDOW p AS (PARTITION BY cell)")
def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(T.normalise(traces(spark, sf_dir), "minmax"))


DETREND = "detrended AS (SELECT cell, t, value - regr_intercept(value, t) OVER p - regr_slope(value, t) OVER p * t AS value FROM traces WINDOW p AS (PARTITION BY cell))"


@register("linear_detrend", f"{W}, {DETREND} SELECT cell, t, round(value, 4) + 0.0 AS value FROM detrended")
def linear_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.detrend(traces(spark, sf_dir)).withColumn("value", F.round("value", 4) + F.lit(0.0))


def ma(k: int, source: str = "traces") -> str:
    a, b = (k - 1) // 2, k // 2
    return f"SELECT cell, t, CASE WHEN count(value) OVER w = {k} THEN avg(value) OVER w END AS value FROM {source} WINDOW w AS (PARTITION BY cell ORDER BY t ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"


@register("smooth_ma5", f"{W}, m AS ({ma(5)}) SELECT cell, t, round(value, 6) AS value FROM m")
def smooth_ma5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(T.smooth(traces(spark, sf_dir)))


@register("moving_mean_21", f"{W}, m AS ({ma(21)}) SELECT cell, t, round(value, 6) AS value FROM m")
def moving_mean_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(T.smooth(traces(spark, sf_dir), 21))


@register("first_differences", f"{W} SELECT cell, t, round(value - lag(value) OVER (PARTITION BY cell ORDER BY t), 6) + 0.0 AS value FROM traces")
def first_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(T.steps(traces(spark, sf_dir)).withColumn("value", F.col("step")))


def outlier_sql(mark: str, source: str = "traces") -> str:
    return f"SELECT cell, t, coalesce({mark}, false) AS outlier, value FROM {source}"


IQR = "(SELECT cell, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {0} GROUP BY cell)"
OUT_IQR = f"SELECT cell, t, value, coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false) AS outlier FROM traces JOIN {IQR.format('traces')} USING (cell)"
OUT_Z = "SELECT cell, t, coalesce(abs(value - avg(value) OVER p) / nullif(stddev_samp(value) OVER p, 0) > 1.5, false) AS outlier FROM traces WINDOW p AS (PARTITION BY cell)"
OUT_MAD = "SELECT cell, t, coalesce(abs(value - m) / nullif(d, 0) > 1.5, false) AS outlier FROM traces JOIN (SELECT cell, m, median(abs(value - m)) AS d FROM traces JOIN (SELECT cell, median(value) AS m FROM traces GROUP BY cell) USING (cell) GROUP BY cell, m) USING (cell)"
for _name, _sql, _method in (("outliers_iqr", f"SELECT cell, t, outlier FROM ({OUT_IQR})", "iqr"), ("outliers_zscore", OUT_Z, "zscore"), ("outliers_mad", OUT_MAD, "mad")):
    register(_name, f"{W} {_sql}")(lambda spark, sf_dir, m=_method: T.outliers(traces(spark, sf_dir), m).select("cell", "t", "outlier"))


@register("flag_outlier_cells", f"{W} SELECT cell, count(*) FILTER (outlier) AS outliers, round(avg(outlier::INT), 6) AS share FROM ({OUT_IQR}) GROUP BY cell")
def flag_outlier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.outliers(traces(spark, sf_dir))
    return o.groupBy("cell").agg(F.sum(F.col("outlier").cast("long")).alias("outliers"), r6(F.avg(F.col("outlier").cast("int"))).alias("share"))


STEPS = "s AS (SELECT cell, t, value - lag(value) OVER (PARTITION BY cell ORDER BY t) AS step FROM traces)"


@register("temporal_outliers", f"{W}, {STEPS}, q AS (SELECT cell, quantile_cont(step, 0.25) AS a, quantile_cont(step, 0.75) AS b FROM s GROUP BY cell) SELECT cell, count(*) FILTER (abs(step) > b + 1.5 * (b - a)) AS warnings FROM s JOIN q USING (cell) WHERE step IS NOT NULL GROUP BY cell")
def temporal_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.temporal_outliers(traces(spark, sf_dir))


@register("temporal_outliers_zscore", f"{W}, {STEPS}, z AS (SELECT cell, abs(step - avg(step) OVER p) / nullif(stddev_samp(step) OVER p, 0) AS z FROM s WHERE step IS NOT NULL WINDOW p AS (PARTITION BY cell)) SELECT cell, count(*) FILTER (z > 1.5) AS warnings FROM z GROUP BY cell")
def temporal_outliers_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.temporal_outliers(traces(spark, sf_dir), "zscore")


RAW = "r AS (SELECT recording_id AS cell, t, max(x) AS value FROM (SELECT recording_id, Time AS t, CASE WHEN isfinite(Cell_1) THEN Cell_1 END AS x FROM raw_df WHERE Time BETWEEN 1 AND 1000000000) GROUP BY ALL)"
RUNS = """g AS (SELECT cell, t - row_number() OVER (PARTITION BY cell ORDER BY t) AS g FROM r WHERE value IS NULL), l AS (SELECT cell, max(n) AS longest FROM (SELECT cell, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY cell)"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/raw_df.parquet").filter(F.col("Time").between(1, 1_000_000_000))
    good = F.when(~F.isnan("Cell_1") & (F.abs("Cell_1") < float("inf")), F.col("Cell_1"))
    return x.groupBy(F.col("recording_id").alias("cell"), F.col("Time").alias("t")).agg(F.max(good).alias("value"))


@register("qc_missing_runs", f"WITH {RAW}, {RUNS} SELECT cell, coalesce(longest, 0) AS longest FROM (SELECT DISTINCT cell FROM r) LEFT JOIN l USING (cell)")
def qc_missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.missing_runs(recordings(spark, sf_dir))


@register("qc_snr", f"WITH {RAW}, {RUNS}, b AS (SELECT cell, count(*) AS n, avg((value IS NULL)::INT) AS missing, avg(value) / nullif(stddev_samp(value), 0) AS snr FROM r GROUP BY cell) SELECT cell, n, round(missing, 6) AS missing, coalesce(longest, 0) AS longest, round(snr, 6) AS snr, n < 100 AS short, missing > 0.1::DOUBLE AS too_many_missing, coalesce(longest, 0) > 20 AS long_gap, coalesce(snr < 2, false) AS low_snr FROM b LEFT JOIN l USING (cell)")
def qc_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.quality_control(recordings(spark, sf_dir))
    return q.withColumns({c: r6(c) for c in ("missing", "snr")})


PRE = f"""a AS (SELECT cell, t, CASE WHEN NOT outlier THEN value END AS value FROM ({OUT_IQR})),
b AS (SELECT cell, t, value - regr_intercept(value, CASE WHEN value IS NOT NULL THEN t END) OVER p - regr_slope(value, CASE WHEN value IS NOT NULL THEN t END) OVER p * t AS value FROM a WINDOW p AS (PARTITION BY cell)),
c AS (SELECT cell, t, (value - avg(value) OVER p) / nullif(stddev_samp(value) OVER p, 0) AS value FROM b WINDOW p AS (PARTITION BY cell)), d AS ({ma(5, "c")})"""


@register("preprocess_chain", f"{W}, {PRE} SELECT cell, t, round(value, 6) + 0.0 AS value FROM d")
def preprocess_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(T.preprocess(traces(spark, sf_dir)))


@register("preprocessing_quality", f"{W}, {PRE}, s AS (SELECT cell, avg(value) / nullif(stddev_samp(value), 0) AS o FROM traces GROUP BY cell), p AS (SELECT cell, avg(value) / nullif(stddev_samp(value), 0) AS p FROM d GROUP BY cell) SELECT round(least(1.0, avg(p / nullif(o, 0))), 6) + 0.0 AS quality FROM s JOIN p USING (cell)")
def preprocessing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = traces(spark, sf_dir)
    return T.preprocessing_quality(T.preprocess(df), df).select(r6("quality").alias("quality"))


@register("correction_quality", f"""{W}, {DETREND}, sr AS (SELECT cell, avg(value) / nullif(stddev_samp(value), 0) AS snr_raw FROM traces GROUP BY cell),
x AS (SELECT cell, t, value + 100 AS value FROM detrended), sc AS (SELECT cell, avg(value) / nullif(stddev_samp(value), 0) AS snr_corrected FROM x GROUP BY cell),
m AS ({ma(50, "x")}), st AS (SELECT cell, stddev_samp(value) AS stability FROM m GROUP BY cell),
o AS (SELECT cell, avg((value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::INT) AS f FROM x JOIN {IQR.format("x")} USING (cell) GROUP BY cell),
a AS (SELECT *, (snr_corrected - snr_raw) / nullif(snr_raw, 0) * 100 AS i FROM sr JOIN sc USING (cell) JOIN st USING (cell) JOIN o USING (cell)),
s AS (SELECT *, (least(i / 50, 1) + CASE WHEN stability IS NOT NULL THEN greatest(0, 1 - stability / 0.1) END + greatest(0, 1 - f / 0.05)) / 3 AS s FROM a)
SELECT cell, round(snr_raw, 6) AS snr_raw, round(snr_corrected, 6) AS snr_corrected, round(i, 6) + 0.0 AS improvement, round(stability, 6) AS stability, round(f, 6) AS outlier_fraction, round(s, 6) + 0.0 AS score, coalesce(s >= 0.8, false) AS passed FROM s""")
def correction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = traces(spark, sf_dir)
    q = T.correction_quality(df, T.detrend(df).withColumn("value", F.col("value") + 100))
    return q.select("cell", *[r6(c).alias(c) for c in ("snr_raw", "snr_corrected", "improvement", "stability", "outlier_fraction", "score")], "passed")


@register("soft_denoise", f"""WITH {DAILY_SQL}, m AS (SELECT cell, t, value, avg(value) OVER (PARTITION BY cell ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m, abs(value - lag(value) OVER (PARTITION BY cell ORDER BY t)) AS d FROM daily),
q AS (SELECT cell, sqrt(2 * ln(count(value))) * median(d) / 0.6745 AS tau FROM m GROUP BY cell)
SELECT cell, t, round(m + sign(value - m) * greatest(abs(value - m) - tau, 0), 4) AS value FROM m JOIN q USING (cell)""")
def soft_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.soft_denoise(daily(spark, sf_dir)).withColumn("value", F.round("value", 4))


@register("validate_traces", f"{W} SELECT count(*) AS rows, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (isinf(value)) AS infinite, count(*) FILTER (value < -1000) AS below, count(*) FILTER (value > 10000) AS above FROM traces")
def validate_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.validate(traces(spark, sf_dir))


LONG = "SELECT Time AS t, UNNEST(['Cell_1', 'Cell_2', 'Cell_3', 'Cell_4', 'Cell_5']) AS cell, UNNEST([Cell_1, Cell_2, Cell_3, Cell_4, Cell_5]) AS value FROM raw_df WHERE Time BETWEEN 1 AND 1000000000"


@register("wide_to_long", f"SELECT cell, t, count(*) AS n, round(sum(value), 6) AS total FROM ({LONG}) WHERE isfinite(value) GROUP BY ALL")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = spark.read.parquet(f"{sf_dir}/raw_df.parquet").filter(F.col("Time").between(1, 1_000_000_000))
    long = T.long_from_wide(wide, "Time").filter(F.abs("value") < float("inf"))
    return long.groupBy("cell", "t").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@register("qc_left_out", "SELECT recording_id AS cell, count(*) FILTER (Time IS NULL OR Time NOT BETWEEN 1 AND 1000000000) AS bad_frame_numbers, count(*) FILTER (NOT isfinite(Cell_1)) AS bad_readings FROM raw_df GROUP BY 1")
def qc_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the other queries of this module leave out: rows whose Time is no frame number, and readings that are no finite number."""
    x = spark.read.parquet(f"{sf_dir}/raw_df.parquet")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return x.groupBy(F.col("recording_id").alias("cell")).agg(count(~F.coalesce(F.col("Time").between(1, 1_000_000_000), F.lit(False))).alias("bad_frame_numbers"), count(F.isnan("Cell_1") | (F.abs("Cell_1") == float("inf"))).alias("bad_readings"))


TYPES = ("click", "error", "purchase", "signup", "view")


@register("long_to_wide", f"WITH {BINS_SQL} SELECT t, {', '.join(f"max(value) FILTER (event_type = '{k}') AS {k}" for k in TYPES)} FROM bins GROUP BY t")
def long_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.wide_from_long(bins(spark, sf_dir).withColumnRenamed("event_type", "cell"), list(TYPES))
