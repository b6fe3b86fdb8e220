"""Trace views of the tables that the reference queries run on, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACES_SQL = "traces AS (SELECT user_id AS cell, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value FROM events)"
BINS_SQL = """bins AS (SELECT event_type, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS t, avg(value) AS value FROM events GROUP BY ALL)"""
MONTHS_SQL = """months AS (SELECT c_nationkey::BIGINT AS cell, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS t, sum(o_totalprice) AS value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
DAILY_SQL = """daily AS (SELECT l_returnflag || l_linestatus AS cell, dense_rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_shipdate) AS t, value
FROM (SELECT l_returnflag, l_linestatus, l_shipdate, sum(l_extendedprice) AS value FROM lineitem GROUP BY ALL))"""
SAMPLES_SQL = "samples AS (SELECT vec_id AS sample, generate_subscripts(embedding, 1)::BIGINT AS feature, label::BIGINT AS batch, unnest(embedding)::DOUBLE AS value FROM embeddings)"
PIXELS_SQL = "pixels AS (SELECT sample AS frame, ((feature - 1) // 8)::BIGINT AS r, ((feature - 1) % 8)::BIGINT AS c, value FROM samples)"


def r6(column: Column | str) -> Column:
    """Rounded to six digits, without negative zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6) + F.lit(0.0)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("cell"), F.row_number().over(by).cast("long").alias("t"), "value")


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("t")).agg(F.avg("value").alias("value"))


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").cast("long").alias("cell"), month.alias("t")).agg(F.sum("o_totalprice").alias("value"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("cell"), "l_shipdate").agg(F.sum("l_extendedprice").alias("value"))
    return days.select("cell", F.row_number().over(Window.partitionBy("cell").orderBy("l_shipdate")).cast("long").alias("t"), "value")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("p", "x"), F.col("label").cast("long").alias("batch")).select("sample", (F.col("p") + 1).cast("long").alias("feature"), "batch", F.col("x").cast("double").alias("value"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("feature") - 1
    return samples(spark, sf_dir).select(F.col("sample").alias("frame"), F.floor(p / 8).alias("r"), (p % 8).alias("c"), "value")
