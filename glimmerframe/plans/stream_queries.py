"""Batch equivalents of the streaming operators, and round trips through files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmerframe.operators import traces as T
from glimmerframe.plans.registry import register
from glimmerframe.plans.views import TRACES_SQL, r6, traces
from glimmerframe.session import checkpoint_folder
from glimmerframe.sources import files
from glimmerframe.streaming.spikes import window_counts


@register("stream_spike_counts", "SELECT date_trunc('day', ts) AS window_start, user_id AS cell, count(*) AS readings, count(*) FILTER (value > 100) AS spikes FROM events GROUP BY ALL")
def stream_spike_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = window_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), 100.0, cell="user_id")
    return w.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("export_roundtrip", f"WITH {TRACES_SQL} SELECT cell, count(*) AS n, round(sum(value), 6) AS total FROM traces GROUP BY cell")
def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.export(traces(spark, sf_dir), f"{checkpoint_folder(spark)}/export-{uuid.uuid4().hex}", ("parquet",))[0]
    return files.load(spark, path).groupBy("cell").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@register("sparse_rows", "SELECT row_id FROM raw_df WHERE (Cell_1 IS NULL)::INT + (Cell_2 IS NULL)::INT + (Cell_3 IS NULL)::INT + (Cell_4 IS NULL)::INT + (Cell_5 IS NULL)::INT + (BG_1 IS NULL)::INT + (BG_2 IS NULL)::INT + (BG_3 IS NULL)::INT <= 0.8")
def sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.drop_sparse_rows(spark.read.parquet(f"{sf_dir}/raw_df.parquet")).select("row_id")


BACK = "WITH f AS (SELECT recording_id, captured_at, max(Cell_1) AS c, max(BG_1) AS a, max(BG_2) AS b, max(BG_3) AS d FROM raw_df WHERE isfinite(Cell_1) GROUP BY ALL)"


@register("recording_background", f"{BACK} SELECT recording_id, count(*) AS frames, round(avg(c - list_avg(list_filter([a, b, d], lambda x: x IS NOT NULL))), 6) AS corrected FROM f GROUP BY recording_id")
def recording_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/raw_df.parquet").filter(F.abs("Cell_1") < float("inf"))
    f = x.groupBy("recording_id", "captured_at").agg(*[F.max(c).alias(c) for c in ("Cell_1", "BG_1", "BG_2", "BG_3")])
    held = F.filter(F.array("BG_1", "BG_2", "BG_3"), lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(held, F.lit(0.0), lambda a, v: a + v), F.size(held))
    return f.groupBy("recording_id").agg(F.count("*").alias("frames"), r6(F.avg(F.col("Cell_1") - mean)).alias("corrected"))


@register("recording_stats", "SELECT recording_id AS cell, count(Cell_1) AS n, round(avg(Cell_1), 6) AS mean, round(median(Cell_1), 6) AS median FROM raw_df WHERE isfinite(Cell_1) GROUP BY recording_id")
def recording_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/raw_df.parquet").filter(F.abs("Cell_1") < float("inf"))
    s = T.trace_stats(x.select(F.col("recording_id").alias("cell"), F.col("Cell_1").alias("value")))
    return s.select("cell", "n", r6("mean").alias("mean"), r6("median").alias("median"))
