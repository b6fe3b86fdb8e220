"""Queries of the general data-quality operators over the recording tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmerframe.operators import implausible, profile
from glimmerframe.plans.registry import register
from glimmerframe.plans.views import r6

P5_SQL = """
WITH f AS (SELECT recording_id, captured_at, max(Time) AS t, max(Cell_1) AS x, max(rig_id) AS rig_id FROM raw_df
           WHERE recording_id IS NOT NULL AND captured_at IS NOT NULL AND Cell_1 IS NOT NULL GROUP BY ALL),
j AS (SELECT f.*, isnan(x) OR isinf(x) OR x < coalesce(signal_floor, x) OR x > coalesce(signal_ceiling, x) AS bad FROM f LEFT JOIN rigs USING (rig_id)),
r AS (SELECT *, lag(x) OVER w AS b1, lag(x, 2) OVER w AS b2, lead(x) OVER w AS a1, lead(x, 2) OVER w AS a2,
             row_number() OVER w AS rn FROM j WHERE NOT bad WINDOW w AS (PARTITION BY recording_id ORDER BY captured_at)),
u AS (SELECT recording_id, median(abs(x - b1)) AS u FROM r GROUP BY 1),
s AS (SELECT r.*, u, sum(CASE WHEN abs(x - b1) < 0.01::DOUBLE * u THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY rn) AS island FROM r JOIN u USING (recording_id)),
k AS (SELECT *, count(*) OVER (PARTITION BY recording_id, island) AS held FROM s),
c AS (SELECT recording_id, t FROM j WHERE bad
      UNION ALL SELECT recording_id, t FROM k WHERE held >= 15
         OR x - b1 > 12 * u AND x - a1 > 12 * u OR b1 - x > 12 * u AND a1 - x > 12 * u
         OR least(x, a1) - greatest(b1, a2) > 12 * u AND a2 IS NOT NULL AND b1 IS NOT NULL OR least(b1, a2) - greatest(x, a1) > 12 * u AND a2 IS NOT NULL AND b1 IS NOT NULL
         OR least(x, b1) - greatest(b2, a1) > 12 * u AND b2 IS NOT NULL AND a1 IS NOT NULL OR least(b2, a1) - greatest(x, b1) > 12 * u AND b2 IS NOT NULL AND a1 IS NOT NULL)
SELECT DISTINCT recording_id, t AS frame_time FROM c WHERE t IS NOT NULL"""


@register("p5_found", P5_SQL)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible.find_implausible(spark.read.parquet(f"{sf_dir}/raw_df.parquet"), spark.read.parquet(f"{sf_dir}/rigs.parquet"))


P3_SQL = r"""
WITH a AS (SELECT load_id, avg((Time IS NULL)::INT) AS t, avg((Cell_1 IS NULL)::INT) AS c, avg(coalesce(Time < 1 OR Time > 1000000000, false)::INT) AS o,
                  median(Cell_1) FILTER (isfinite(Cell_1)) AS m FROM raw_df WHERE load_id IS NOT NULL GROUP BY 1),
u AS (SELECT median(m) AS u FROM a),
r AS (SELECT load_id, count(Time) AS nt, count(Cell_1) AS nc, count(DISTINCT Cell_1) AS d, count(*) FILTER (NOT regexp_full_match(Time, '[0-9]+')) AS bt,
             count(*) FILTER (NOT regexp_full_match(Cell_1, '[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?')) AS bc FROM raw_records WHERE load_id IS NOT NULL GROUP BY 1)
SELECT 'raw_df' AS table_name, 'Time' AS column_name, load_id, 'null_rate' AS finding FROM a WHERE t > 0.1::DOUBLE
UNION ALL SELECT 'raw_df', 'Cell_1', load_id, 'null_rate' FROM a WHERE c > 0.1::DOUBLE
UNION ALL SELECT 'raw_df', 'Time', load_id, 'range' FROM a WHERE o > 0.02::DOUBLE
UNION ALL SELECT 'raw_df', 'Cell_1', load_id, 'shift' FROM a, u WHERE m > 1.8::DOUBLE * u OR m < u / 1.8::DOUBLE
UNION ALL SELECT 'raw_records', 'Time', load_id, 'pattern' FROM r WHERE bt > 0.1::DOUBLE * nt
UNION ALL SELECT 'raw_records', 'Cell_1', load_id, 'pattern' FROM r WHERE bc > 0.1::DOUBLE * nc
UNION ALL SELECT 'raw_records', 'Cell_1', load_id, 'distinct' FROM r WHERE d < 0.4::DOUBLE * nc"""


@register("p3_found", P3_SQL)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.findings(spark.read.parquet(f"{sf_dir}/raw_df.parquet"), spark.read.parquet(f"{sf_dir}/raw_records.parquet"))


# The tables of problem 3: columns that are text with the pattern of their type, times, and numbers.
TABLES = {
    "raw_df": ({"recording_id": None, "rig_id": None}, ["captured_at", "loaded_at"], ["row_id", "load_id", "Time"], ["Cell_1", "Cell_2", "Cell_3", "Cell_4", "Cell_5", "BG_1", "BG_2", "BG_3"]),
    "raw_records": ({"recording_id": None, "Time": "digits", "Cell_1": "number"}, [], ["record_id", "load_id"], []),
}
FULL_MATCH = {None: "NULL", "digits": "regexp_full_match(value, '[0-9]+')", "number": r"regexp_full_match(value, '[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?')"}


def _profile_sql(table: str, texts: dict[str, str | None], times: list[str], whole: list[str], real: list[str]) -> tuple[str, str]:
    """The profile of one table: standard aggregates of every column, and the bits of every alternative of its text columns worked out anew."""
    number = {c: f"epoch_us({c}) / 1e6" for c in times} | {c: f"{c}::DOUBLE" for c in whole} | {c: f"CASE WHEN isfinite({c}) THEN {c} END" for c in real}
    typed = lambda c: f"CASE WHEN {c} > 0 THEN floor(ln({c}) * 3) + 10000 WHEN {c} < 0 THEN -(floor(ln(-{c}) * 3) + 10000) WHEN {c} = 0 THEN 0 END"
    base = [f"SELECT '{c}' AS column_name, load_id, count(*) AS rows, count({c}) AS filled, count({c}) - count({x}) AS bad_numbers, min({x}) AS lowest, max({x}) AS highest, {'avg' if c not in times else 'NULL + max'}({x})::DOUBLE AS mean, NULL::VARCHAR AS least_text, NULL::VARCHAR AS greatest_text, count(DISTINCT {c}) AS distinct_values FROM {table} GROUP BY load_id" for c, x in number.items()]
    base += [f"SELECT '{c}', load_id, count(*), count({c}), 0, NULL, NULL, NULL, min({c}), max({c}), count(DISTINCT {c}) FROM {table} GROUP BY load_id" for c in texts]
    parts = [f"SELECT '{c}' AS column_name, load_id, {f'floor(n / 60)' if c in times else typed('n')}::BIGINT::VARCHAR AS part, count(*) AS n FROM (SELECT load_id, {x} AS n FROM {table}) WHERE n IS NOT NULL GROUP BY ALL" for c, x in number.items()]
    values = " UNION ALL ".join(f"SELECT '{c}' AS column_name, load_id, {c} AS value, count(*) AS rows, {FULL_MATCH[kind]}::BOOLEAN AS well FROM {table} WHERE {c} IS NOT NULL GROUP BY ALL" for c, kind in texts.items())
    p = f"{table}_"
    return rf"""{p}v AS ({values}),
{p}m AS (SELECT column_name, load_id, value, rows, well, regexp_replace(translate(value, chr(1), chr(2)), '([0-9.])[eE]([+-]?[0-9])', '\1' || chr(1) || '\2', 'g') AS m FROM {p}v),
{p}s AS (SELECT *, translate(regexp_replace(regexp_replace(regexp_replace(m, '\p{{L}}+', 'A', 'g'), '[0-9]+', '9', 'g'), '[\t\n\f\r ]+', ' ', 'g'), chr(1), 'e') AS shape FROM {p}m),
{p}r AS (SELECT column_name, shape, generate_subscripts(runs, 1) AS place, unnest(runs) AS run FROM (SELECT DISTINCT column_name, value, shape, regexp_extract_all(m, '\p{{L}}+|[0-9]+|[\t\n\f\r ]+|[^\p{{L}}0-9\t\n\f\r ]') AS runs FROM {p}s)),
{p}g AS (SELECT column_name, shape, substr(shape, place::INT, 1) AS kind, count(*) AS n, sum(length(run)) AS chars, min(length(run)) AS lo, max(length(run)) AS hi, min(run) = max(run) AS same, sum(2 * log2(length(run)) + 1) AS anyb FROM {p}r GROUP BY column_name, shape, place),
{p}c AS (SELECT *, chars * CASE kind WHEN '9' THEN log2(10) WHEN 'A' THEN 6 ELSE 1 END AS w FROM {p}g),
{p}i AS (SELECT *, CASE WHEN kind = 'e' THEN 8 + n WHEN kind NOT IN ('9', 'A', ' ') THEN 8 ELSE least(CASE WHEN same THEN 8 * lo END, CASE WHEN lo = hi THEN 13 + w END, 18 + w + n * log2(hi - lo + 1), 9 + w + anyb) END AS bits FROM {p}c),
{p}a AS (SELECT column_name, shape, 16 + sum(bits) < 8 * (sum(chars) + max(n)) AS inside FROM {p}i GROUP BY column_name, shape),
{p}l AS (SELECT column_name, load_id, shape, coalesce(inside, false) AS inside, sum(rows) AS rows, sum(rows) FILTER (NOT well) AS misfit, bool_or(well) AS typed FROM {p}s LEFT JOIN {p}a USING (column_name, shape) GROUP BY ALL),
{p}b AS (SELECT column_name, load_id, sum(rows) FILTER (NOT inside) AS nonconforming, sum(CASE WHEN typed IS NULL AND inside OR inside AND typed THEN 0 WHEN typed IS NULL OR inside THEN rows ELSE coalesce(misfit, 0) END) AS malformed, sum(rows) AS filled FROM {p}l GROUP BY ALL),
{p}n AS ({' UNION ALL '.join(parts)} UNION ALL SELECT column_name, load_id, CASE WHEN inside THEN shape END, sum(rows) FROM {p}l GROUP BY ALL),
{p}q AS (SELECT *, n / sum(n) OVER (PARTITION BY column_name, load_id) AS mine, (sum(n) OVER (PARTITION BY column_name, part) - n) / nullif(sum(n) OVER (PARTITION BY column_name) - sum(n) OVER (PARTITION BY column_name, load_id), 0) AS theirs FROM {p}n),
{p}d AS (SELECT column_name, load_id, (sum(abs(mine - theirs)) + 1 - sum(theirs)) / 2 AS change FROM {p}q GROUP BY ALL),
{p}t AS ({' UNION ALL '.join(base)}),
{p}w AS (SELECT t.*, coalesce(nonconforming, 0) AS nonconforming, coalesce(malformed, 0) AS malformed, b.filled IS NOT NULL AS text, change, sum(t.rows - t.filled) OVER x - (t.rows - t.filled) AS on_, sum(t.rows) OVER x - t.rows AS orows,
 sum(t.filled - coalesce(nonconforming, 0)) OVER x - (t.filled - coalesce(nonconforming, 0)) AS oheld, sum(t.filled) OVER x - t.filled AS ofilled
 FROM {p}t t LEFT JOIN {p}b b ON t.column_name = b.column_name AND t.load_id IS NOT DISTINCT FROM b.load_id LEFT JOIN {p}d d ON t.column_name = d.column_name AND t.load_id IS NOT DISTINCT FROM d.load_id WINDOW x AS (PARTITION BY t.column_name))""", f"""
SELECT '{table}' AS table_name, column_name, load_id, rows, rows - filled AS nulls, round((rows - filled) / rows, 6) AS null_rate, bad_numbers::BIGINT AS bad_numbers, round(lowest, 6) AS lowest, round(highest, 6) AS highest, round(mean, 4) AS mean, least_text, greatest_text, distinct_values,
 CASE WHEN text THEN round(nonconforming / nullif(filled, 0), 6) END AS nonconforming_rate, round(CASE WHEN text THEN malformed ELSE bad_numbers END / nullif(filled, 0), 6) AS malformed_rate, round((rows - filled) / rows - on_ / nullif(orows, 0), 6) + 0.0 AS null_rate_change,
 CASE WHEN text THEN round((filled - nonconforming) / filled, 6) END AS coverage, CASE WHEN text THEN round((filled - nonconforming) / filled - oheld / nullif(ofilled, 0), 6) + 0.0 END AS coverage_change, round(greatest(0, least(1, change)), 6) + 0.0 AS change FROM {p}w"""


def _profiles_sql() -> str:
    ctes, selects = zip(*[_profile_sql(table, *columns) for table, columns in TABLES.items()])
    return "WITH " + ",\n".join(ctes) + " UNION ALL ".join(selects)


@register("p3_profile", _profiles_sql())
def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for table, (texts, *_) in TABLES.items():
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        parts.append(profile.load_profile(rows, "load_id", {c: profile.NUMBERS[kind] for c, kind in texts.items() if kind}).select(F.lit(table).alias("table_name"), "*"))
    rounded = ("null_rate", "lowest", "highest", "nonconforming_rate", "malformed_rate", "null_rate_change", "coverage", "coverage_change", "change")
    return parts[0].unionByName(parts[1]).withColumns({c: r6(c) for c in rounded} | {"mean": F.round("mean", 4)})


@register("p3_expressions")
def p3_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for table in TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        parts.append(profile.induced(rows, "load_id", [c for c, kind in rows.dtypes if kind == "string"]).select(F.lit(table).alias("table_name"), "*"))
    return parts[0].unionByName(parts[1])
