"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmerframe.llm import encode, leaks, neighbours, percentiles, residue, split

VOCABULARY = os.environ.get("GLIMMERFRAME_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.breaks(spark.read.parquet(f"{sf_dir}/raw_df.parquet"))


P1_SQL = """
WITH f AS (SELECT recording_id, captured_at, max(Time) AS t FROM raw_df WHERE recording_id IS NOT NULL AND captured_at IS NOT NULL GROUP BY ALL),
g AS (SELECT *, epoch_us(captured_at) - lag(epoch_us(captured_at)) OVER (PARTITION BY recording_id ORDER BY captured_at) AS gap FROM f),
m AS (SELECT *, median(gap) OVER (PARTITION BY recording_id) AS usual, count(*) OVER (PARTITION BY recording_id) AS n FROM g)
SELECT DISTINCT recording_id, t AS boundary_time FROM m WHERE n > 400 AND gap > 20 * usual AND t IS NOT NULL"""


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.pieces(spark.read.parquet(f"{sf_dir}/raw_df.parquet"))


def p1_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.piece_sizes(p1_pieces(spark, sf_dir))


P1_SIZES_SQL = """
SELECT recording_id, count(DISTINCT captured_at) AS frames, count(DISTINCT captured_at) AS own_frames, 0::BIGINT AS too_long, 0::BIGINT AS short_overlaps, 0::BIGINT AS fitting_neighbours
FROM raw_df WHERE recording_id IS NOT NULL AND captured_at IS NOT NULL GROUP BY 1"""


def _sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_load = percentiles.sketches(spark.read.parquet(f"{sf_dir}/raw_df.parquet"), ["recording_id", "load_id"], "Cell_1")
    by_method = percentiles.sketches(spark.read.parquet(f"{sf_dir}/spike_results.parquet"), ["recording_id", "method"], "spike")
    return by_load.withColumn("column_name", F.lit("Cell_1")).unionByName(by_method.withColumn("column_name", F.lit("spike")), allowMissingColumns=True)


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.percentiles(_sketched(spark, sf_dir), ["column_name", "recording_id", "load_id", "method"])


def p2_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["column_name", "recording_id"]
    return percentiles.percentiles(percentiles.combine(_sketched(spark, sf_dir), keys), keys)


FINITE = "count(*) AS n, true AS holds"
P2_HOLDS_SQL = f"""
SELECT 'Cell_1' AS column_name, recording_id, load_id, NULL::VARCHAR AS method, {FINITE} FROM raw_df WHERE isfinite(Cell_1) GROUP BY ALL
UNION ALL SELECT 'spike', recording_id, NULL::BIGINT, method, {FINITE} FROM spike_results WHERE isfinite(spike) GROUP BY ALL"""


def p2_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for table, keys, value in (("raw_df", ["recording_id", "load_id"], "Cell_1"), ("spike_results", ["recording_id", "method"], "spike")):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        made = percentiles.percentiles(percentiles.sketches(rows, keys, value), keys)
        parts.append(percentiles.hold(rows, made, keys, value).withColumn("column_name", F.lit(value)))
    return parts[0].unionByName(parts[1], allowMissingColumns=True).select("column_name", "recording_id", "load_id", "method", "n", "holds")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.mutual(spark.read.parquet(f"{sf_dir}/cell_windows.parquet"))


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.most_similar(spark.read.parquet(f"{sf_dir}/cell_windows.parquet"), fill=True)


P4_SQL = """
WITH e AS (SELECT window_id, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM cell_windows WHERE len(vec) = 64),
w AS (SELECT window_id FROM e GROUP BY 1 HAVING count(v) = 64 AND count(*) FILTER (NOT isfinite(v)) = 0 AND min(v) < max(v)),
c AS (SELECT e.window_id, i, v - avg(v) OVER (PARTITION BY e.window_id) AS d FROM e JOIN w USING (window_id)),
u AS (SELECT window_id, list(d / n ORDER BY i)::DOUBLE[64] AS x FROM (SELECT *, sqrt(sum(d * d) OVER (PARTITION BY window_id)) AS n FROM c) GROUP BY 1),
s AS (SELECT a.window_id AS a, b.window_id AS b, array_inner_product(a.x, b.x) AS r FROM u a JOIN u b ON a.window_id <> b.window_id),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY r DESC, b) AS k FROM s)
SELECT p.a AS window_a, p.b AS window_b FROM t p JOIN t q ON p.a = q.b AND p.b = q.a WHERE p.a < p.b AND p.k <= 5 AND q.k <= 5 AND p.r >= 0.97::DOUBLE"""


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), VOCABULARY)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_sizes": p1_sizes, "p2_percentiles": p2_percentiles, "p2_combined": p2_combined, "p2_holds": p2_holds, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p1_sizes": P1_SIZES_SQL, "p2_holds": P2_HOLDS_SQL, "p4_found": P4_SQL}
