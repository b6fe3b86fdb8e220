"""Reading and writing recordings: wide CSV and Parquet in, CSV, JSON and Parquet out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmerframe.config import CONFIG
from glimmerframe.operators import traces

CELL, BACKGROUND = re.compile("^Cell_"), re.compile("^BG_")


def roles(df: DataFrame) -> tuple[list[str], list[str]]:
    """Cell and background columns by name."""
    return [c for c in df.columns if CELL.search(c)], [c for c in df.columns if BACKGROUND.search(c)]


def check_wide(df: DataFrame, require_background: bool = True) -> None:
    """Raises ValueError for a wide frame without columns, without cell or (if required) background columns, or with any of these not numeric. Reads no data."""
    cells, backgrounds = roles(df)
    if not df.columns:
        raise ValueError("Input data is empty")
    if not cells:
        raise ValueError("No cell columns found (must start with 'Cell_')")
    if require_background and not backgrounds:
        raise ValueError("No background columns found (must start with 'BG_')")
    for c in [*cells, *backgrounds]:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise ValueError(f"Column {c} is not numeric")


def read_csv(spark: SparkSession, path: str, cells: int, backgrounds: int = 0, key: str | None = None) -> DataFrame:
    """A wide CSV with a header, by a schema built from the numbers of columns, so that nothing is read twice."""
    names = [*([key] if key else []), *[f"Cell_{i + 1}" for i in range(cells)], *[f"BG_{i + 1}" for i in range(backgrounds)]]
    schema = T.StructType([T.StructField(n, T.LongType() if n == key else T.DoubleType()) for n in names])
    return spark.read.schema(schema).csv(path, header=True, nullValue="NA", nanValue="NaN")


def load(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    """Any built-in format by name."""
    return spark.read.format(form).options(**options).load(path)


def long_parts(df: DataFrame, key: str = "t") -> tuple[DataFrame, DataFrame]:
    """(cells, background) of a wide frame with a frame number: long traces and (t, bg)."""
    check_wide(df, require_background=False)
    cells = traces.long_from_wide(df, key)
    back = traces.long_from_wide(df, key, "^BG_").select("t", F.col("value").alias("bg")) if roles(df)[1] else df.select(F.col(key).cast("long").alias("t"), F.lit(None).cast("double").alias("bg")).limit(0)
    return cells, back


def export(df: DataFrame, folder: str, forms: tuple[str, ...] = ("csv", "parquet"), mode: str = "overwrite") -> list[str]:
    """df written below folder once for each form (csv, json, parquet, orc); the paths."""
    paths = []
    for form in forms:
        if form not in ("csv", "json", "parquet", "orc"):
            raise ValueError(f"cannot write {form}")
        path = f"{folder}/{form}"
        (df.write.mode(mode).option("header", "true") if form == "csv" else df.write.mode(mode)).format(form).save(path)
        paths.append(path)
    return paths


def drop_sparse_rows(df: DataFrame, most_missing: float = CONFIG.most_missing) -> DataFrame:
    """Wide rows of which at most that share of cell and background values is missing."""
    columns = [c for part in roles(df) for c in part]
    missing = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.filter(missing <= most_missing * max(len(columns), 1))


IMAGING = "struct<frame_rate:double,resolution:string,magnification:double,excitation_wavelength:double,emission_wavelength:double>"
PROCESSING = "struct<preprocessing_steps:array<string>,spike_detection_method:string,correction_method:string>"


def metadata(df: DataFrame, template: dict[str, object] | None = None) -> DataFrame:
    """df (experiment_id, date, ...) with the standard metadata fields added where missing: nulls, today's date, and the given template values; imaging_parameters and data_processing are structs."""
    fields = ("experiment_id", "date", "time", "animal_id", "session_id", "experimenter", "protocol", "notes")
    fill = {"date": F.date_format(F.current_date(), "yyyy-MM-dd"), "time": F.date_format(F.current_timestamp(), "HH:mm:ss")} | {k: F.lit(v) for k, v in (template or {}).items()}
    for f in fields:
        value = fill.get(f, F.lit(None).cast("string"))
        df = df.withColumn(f, F.coalesce(F.col(f), value) if f in df.columns else value)
    for f, kind in (("imaging_parameters", IMAGING), ("data_processing", PROCESSING)):
        df = df if f in df.columns else df.withColumn(f, F.lit(None).cast(kind))
    return df


def check_memory(df: DataFrame, rows: int, limit_mb: float = CONFIG.memory_mb) -> float:
    """estimated_mb, or ValueError beyond the limit: for operators that hold a whole trace or matrix."""
    needed = estimated_mb(df, rows)
    if needed > limit_mb:
        raise ValueError(f"about {needed:.0f} MB needed, more than {limit_mb:.0f}")
    return needed


def estimated_mb(df: DataFrame, rows: int) -> float:
    """Eight bytes per value; for planning only."""
    return rows * len(df.columns) * 8 / 2**20
