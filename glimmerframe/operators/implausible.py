"""Readings that cannot be right: momentary spikes, stuck stretches, physically impossible values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmerframe.functions.quantiles import exact_quantile
from glimmerframe.operators import ordered

FORGET, CLIP, WIDEST, LIMIT = 0.1, 3.0, 2.0, 3.0


def chart(x: np.ndarray, usual: float, jump: float) -> np.ndarray:
    """Out-of-control readings of a robust exponentially weighted control chart.

    The mean and the scale (both exponentially weighted) take in a reading only after it has been clipped to CLIP scales around the mean, so a spike moves
    them little. The scale stays within half and twice the usual movement. The control limit is never so wide that both ends of
    a step of more than jump usual movements could lie inside: the mean moves at most FORGET * CLIP * WIDEST usual movements per reading.
    """
    widest = (jump - FORGET * CLIP * WIDEST) / 2 * usual
    lowest, highest = usual / 2, usual * WIDEST
    out = np.zeros(len(x), bool)
    if not len(x):
        return out
    mean, scale = float(x[0]), usual
    for i, v in enumerate(x.tolist()):
        off = v - mean
        size = off if off >= 0 else -off
        limit = LIMIT * scale
        if size > (limit if limit < widest else widest):
            out[i] = True
        most = CLIP * scale
        if size > most:
            off, size = (most if off > 0 else -most), most
        mean += FORGET * off
        scale += FORGET * (size - scale)
        if scale < lowest:
            scale = lowest
        elif scale > highest:
            scale = highest
    return out


def spikes(x: np.ndarray, usual: float, jump: float) -> np.ndarray:
    """Which readings are one or two in a row more than jump usual movements above, or below, both neighbours. Only places near a signal of the chart are compared."""
    signal = chart(x, usual, jump)
    near = np.flatnonzero(signal)
    near = np.unique(np.concatenate([near, near + 1]))
    most, found = jump * usual, np.zeros(len(x), bool)
    for width in (1, 2):
        at = near[(near >= 1) & (near + width < len(x))]
        first, last, before, after = x[at], x[at + width - 1], x[at - 1], x[at + width]
        above = np.minimum(first, last) - np.maximum(before, after) > most
        below = np.minimum(before, after) - np.maximum(first, last) > most
        hit = at[above | below]
        for k in range(width):
            found[hit + k] = True
    return found


def runs(still: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the stretches of readings joined by still steps; still[i] says so of the step from i to i + 1."""
    edge = np.diff(np.concatenate([[0], still.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def find_implausible(
    frames: DataFrame, limits: DataFrame, source: str = "recording_id", at: str = "captured_at", time: str = "Time", value: str = "Cell_1", rig: str = "rig_id",
    floor: str = "signal_floor", ceiling: str = "signal_ceiling", jump: float = 12.0, stuck: int = 15, still: float = 0.01, block_seconds: int = ordered.BLOCK_SECONDS,
) -> DataFrame:
    """(source, frame_time), without repeats: frames whose value is implausible for its source.

    Rows equal in source and moment are one frame (of differing ones the greatest value counts). Impossible: not-a-number, infinite, or outside the
    limits of its rig (a null or unknown limit limits nothing); such readings are left out of the rest, and so is null, which is never a case. The usual
    movement is the exact median of absolute steps between successive readings of the source. Spike: see spikes(). Stuck: at least `stuck` successive
    readings with every step below `still` usual movements. Frames of null time, source or moment give no row. Empty tables give an empty
    result; other columns are ignored. Each (source, time block) is one group of bounded size; stretches that cross blocks are stitched
    from their parts.
    """
    f = frames.select(F.col(source).alias("source"), ordered.micros(at).alias("at"), F.col(time).cast("long").alias("t"), F.col(value).cast("double").alias("x"), F.col(rig).alias("__rig"))
    f = f.filter(F.col("source").isNotNull() & F.col("at").isNotNull() & F.col("x").isNotNull())
    r = limits.groupBy(F.col(rig).alias("__rig")).agg(F.max(floor).alias("__lo"), F.min(ceiling).alias("__hi"))
    f = f.join(r, "__rig", "left")
    bad = F.isnan("x") | (F.abs("x") == float("inf")) | F.coalesce(F.col("x") < F.col("__lo"), F.lit(False)) | F.coalesce(F.col("x") > F.col("__hi"), F.lit(False))
    f = f.select("source", ordered.block_of(F.col("at"), block_seconds).alias("block"), "at", "x", "t", bad.alias("bad"))

    blocks = ordered.in_blocks(f)
    readings = ordered.one_per_moment(blocks, ["x", "t", "bad"]).filter(~F.col("bad"))
    context = ordered.edges(readings, ["x"], 3)
    step = F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("source", "block").orderBy("at")))
    across = readings.groupBy("source", "block").agg(F.min_by("x", "at").alias("x")).join(context, ["source", "block"]).select("source", F.abs(F.col("x") - F.get("before", F.lit(0))["x"]).alias("d"))
    usual = exact_quantile(readings.select("source", step.alias("d")).unionByName(across), ["source"], "d", name="usual")
    about = context.join(usual, "source").select(F.col("source").alias("about_source"), F.col("block").alias("about_block"), "usual", F.transform("before", lambda s: s["x"]).alias("before"), F.transform("after", lambda s: s["x"]).alias("after"))

    schema = "source string, block long, open_left boolean, open_right boolean, n long, times array<long>"

    def judge(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        source, block = key[0].as_py(), key[1].as_py()
        moment = left["at"].to_numpy()
        x = left["x"].to_numpy()
        order = np.lexsort((x, moment))  # not-a-number sorts last, as the greatest
        moment, x = moment[order], x[order]
        keep = np.append(moment[1:] != moment[:-1], True) if len(moment) else np.zeros(0, bool)
        t, bad = left["t"].take(pa.array(order)).filter(pa.array(keep)), left["bad"].to_numpy()[order][keep]
        x = x[keep]
        rows: list[tuple[bool, bool, int, list[int | None]]] = []
        times = t.to_pylist()
        cases = set(np.flatnonzero(bad).tolist())
        good = np.flatnonzero(~bad)
        if right.num_rows and len(good):
            usual = right["usual"][0].as_py()
            before, after = (right[c][0].as_py() or [] for c in ("before", "after"))
            whole = np.concatenate([before[::-1], x[good], after]).astype(float)
            own = slice(len(before), len(before) + len(good))
            cases.update(good[spikes(whole, usual, jump)[own]].tolist())
            steps = np.abs(np.diff(whole[max(0, own.start - 1) : own.stop + 1])) < still * usual
            lead = int(own.start > 0)
            for a, b in runs(steps):
                a, b = a - lead, b - lead
                open_left, open_right = a < 0, b >= len(good)
                held = good[max(a, 0) : min(b, len(good) - 1) + 1]
                if open_left or open_right:
                    rows.append((open_left, open_right, len(held), [times[i] for i in held]))
                elif len(held) >= stuck:
                    cases.update(held.tolist())
        if cases:
            rows.append((False, False, stuck, [times[i] for i in sorted(cases)]))
        part = list(zip(*rows)) if rows else [[], [], [], []]
        columns = [[source] * len(rows), [block] * len(rows), *map(list, part)]
        return pa.table(dict(zip(["source", "block", "open_left", "open_right", "n", "times"], columns)), pa.schema([("source", pa.string()), ("block", pa.int64()), ("open_left", pa.bool_()), ("open_right", pa.bool_()), ("n", pa.int64()), ("times", pa.list_(pa.int64()))]))

    judged = blocks.groupBy("source", "block").cogroup(about.groupBy("about_source", "about_block")).applyInArrow(judge, schema)
    # closed rows carry whole cases and stay apart by block; open ones are parts of stretches that go on in the next block that has readings
    closed = ~F.col("open_left") & ~F.col("open_right")
    parts = judged.withColumn("lane", F.when(closed, F.col("block")))
    along = Window.partitionBy("source", "lane").orderBy("block", F.col("open_left").desc())
    parts = parts.withColumn("stretch", F.sum(F.when(F.col("open_left"), 0).otherwise(1)).over(along))
    whole = F.sum("n").over(Window.partitionBy("source", "lane", "stretch"))
    kept = parts.withColumn("held", whole).filter(F.col("lane").isNotNull() | (F.col("held") >= stuck))
    found = kept.select(F.col("source").alias(source), F.explode("times").alias("frame_time"))
    return found.filter(F.col("frame_time").isNotNull()).distinct()
