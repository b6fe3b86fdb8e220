"""Streams of readings: files in chunks, and event-time counts with late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema, form: str = "parquet", files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files_per_batch).load(path)


def process_stream(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """operator over every micro-batch, appended to out/batch=N; a batch that is run again after a failure replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").format(form).save(f"{out}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def window_counts(readings: DataFrame, limit: float, at: str = "ts", cell: str = "cell", value: str = "value", size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, cell, readings, spikes): readings above limit per tumbling window; a batch or a stream. On a stream, rows later than `late` are dropped by the watermark."""
    ts = F.col(at).cast("timestamp")
    rows = readings.select(ts.alias("__ts"), F.col(cell).alias("cell"), F.col(value).alias("value"))
    rows = rows.withWatermark("__ts", late) if readings.isStreaming else rows
    g = rows.groupBy(F.window("__ts", size).alias("w"), "cell").agg(F.count("*").alias("readings"), F.sum(F.when(F.col("value") > limit, 1).otherwise(0)).alias("spikes"))
    return g.select(F.col("w.start").alias("window_start"), "cell", "readings", "spikes")


STATE = "seen long, mean double, m2 double"
SPIKES = "cell string, at timestamp, value double, spike boolean"


def running(v: np.ndarray, seen: int, mean: float, m2: float, sds: float, warm_up: int) -> tuple[np.ndarray, int, float, float]:
    """(spike, seen, mean, m2): which values exceed the mean by sds sds of the values before them, and the moments after the last one; NaN is none and moves nothing."""
    good = np.isfinite(v)
    d = np.where(good, v - mean, 0.0)  # relative to the mean so far
    n = seen + np.cumsum(good)
    s, q = np.cumsum(d), m2 + np.cumsum(d * d)
    before = lambda x, start: np.concatenate([[start], x[:-1]])
    k, a, b = before(n, seen), before(s, 0.0), before(q, m2)
    with np.errstate(all="ignore"):
        centre = mean + np.where(k > 0, a / k, 0.0)
        sd = np.sqrt(np.maximum(0.0, np.where(k > 1, (b - np.where(k > 0, a * a / k, 0.0)) / (k - 1), 0.0)))
    spike = good & (k >= warm_up) & (v > centre + sds * sd)
    if not len(v) or n[-1] == 0:
        return spike, seen, mean, m2
    return spike, int(n[-1]), float(mean + s[-1] / n[-1]), float(max(0.0, q[-1] - s[-1] ** 2 / n[-1]))


def running_spikes(readings: DataFrame, sds: float = 3.0, warm_up: int = 20, late: str | None = None, idle_ms: int = 3_600_000) -> DataFrame:
    """(cell, at, value, spike) on a stream of (cell, at, value): a reading is a spike if it exceeds the running mean by sds running sds of the readings before it.

    State per cell is three numbers. Where `late` is given, readings later than that are dropped by the watermark, and the state of a cell that has had no reading for idle_ms of event
    time is dropped too; without it state is kept. Readings of one micro-batch are taken in order of time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if late is not None and state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else (0, 0.0, 0.0)
        p = pd.concat(list(batches)).sort_values("at", kind="stable")
        spike, *after = running(p["value"].to_numpy(float), *held, sds, warm_up)
        state.update(tuple(after))
        if late is not None:
            newest = int(p["at"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"cell": key[0], "at": p["at"], "value": p["value"], "spike": spike})

    rows = readings.select(F.col("cell").cast("string").alias("cell"), F.col("at").cast("timestamp").alias("at"), F.col("value").cast("double").alias("value"))
    rows = rows if late is None else rows.withWatermark("at", late)
    return rows.groupBy("cell").applyInPandasWithState(step, SPIKES, STATE, "append", "NoTimeout" if late is None else "EventTimeTimeout")
