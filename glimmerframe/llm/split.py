"""Splitting long recordings into pieces at natural boundaries.

Atomic segments are merged agglomeratively: adjacent pairs wait in a heap by the strength of the boundary between them, and the weakest boundary goes first
while the merged piece with its overlap stays within the limit. What remains are pieces that meet at the strongest breaks.

A source may hold a third of all frames, so the heap runs on bounded chunks of a source. A chunk decides only what cannot depend on its neighbours: a
boundary whose two pieces might still grow over a chunk's edge stays open, unless they are too large already. The few open pieces at the edges are merged
in a second pass by the same heap. The pieces are those of one heap over the whole source.
"""

from __future__ import annotations

from heapq import heapify, heappop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmerframe.functions.quantiles import exact_quantile
from glimmerframe.operators import ordered

# Strengths of boundaries: of intervals up to WEAK usual ones (PLAIN), of these where a full piece would end (FULL), else the interval itself.
PLAIN, FULL, WEAK = 1.0, 1.25, 1.5
CHUNK_CELLS, BUCKET = 1000, 20_000


def merged(sizes: list[int], strength: list[float], limit: int, overlap: int, opening: bool, open_left: bool = False, beyond: float | None = None) -> tuple[list[int], set[int]]:
    """(heads, undecided): numbers of the segments that begin a piece, and those of the boundaries that what lies outside may still remove.

    strength[i]: of the boundary before segment i; opening: the first piece repeats no frames. open_left: frames lie before the first segment; beyond: the least
    strength of the boundary after the last one, if frames may follow. Boundaries of equal strength go from left to right.
    """
    n = len(sizes)
    after, ahead, size, alive, grows, undecided, last = [*range(1, n), -1], [-1, *range(n - 1)], list(sizes), [True] * n, [False] * n, set(), n - 1
    heap = [(strength[i], i) for i in range(0 if open_left else 1, n)]
    if beyond is not None:
        heap.append((beyond, n))
    heapify(heap)
    while heap:
        _, right = heappop(heap)
        if right in (0, n):
            grows[0 if right == 0 else last] = True
            continue
        left = ahead[right]
        if size[left] + size[right] > (limit if opening and left == 0 else limit - overlap):
            continue  # pieces only grow, so this boundary stays
        if grows[left] or grows[right]:
            grows[left] = grows[right] = True
            undecided.add(right)
            continue
        size[left] += size[right]
        alive[right] = False
        last = left if right == last else last
        after[left] = after[right]
        if after[right] >= 0:
            ahead[after[right]] = left
    return [i for i in range(n) if alive[i]], undecided


def _frames(df: DataFrame, source: str, at: str, time: str, value: str, seconds: int) -> DataFrame:
    f = df.select(F.col(source).cast("string").alias("source"), ordered.micros(at).alias("at"), F.col(time).cast("long").alias("t"), F.col(value).cast("double").alias("x"))
    f = f.filter(F.col("source").isNotNull() & F.col("at").isNotNull())
    return ordered.one_per_moment(ordered.in_blocks(f.select("source", ordered.block_of(F.col("at"), seconds).alias("block"), "at", "t", "x")), ["t", "x"])


def _numbered(f: DataFrame, longer_than: int) -> DataFrame:
    """Frames with their number in the source, from 0 (place), the source's number of frames, and the interval before as a multiple of the source's median one (strength)."""
    inside, along = Window.partitionBy("source", "block").orderBy("at"), Window.partitionBy("source").orderBy("block")
    f = f.withColumn("gap", F.col("at") - F.lag("at").over(inside)).withColumn("__rn", F.row_number().over(inside))
    # one row a block: its edges, and the frames before it
    b = f.groupBy("source", "block").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("__n"))
    b = b.select("source", "block", (F.col("first_at") - F.lag("last_at").over(along)).alias("first_gap"), (F.sum("__n").over(along) - F.col("__n")).alias("before"), F.sum("__n").over(Window.partitionBy("source")).alias("frames"))
    b = b.filter(F.col("frames") > longer_than)
    intervals = f.select("source", F.col("gap").alias("d")).unionByName(b.select("source", F.col("first_gap").alias("d")))
    f = f.join(b.join(exact_quantile(intervals, ["source"], "d", name="usual"), "source", "left"), ["source", "block"])
    strength = F.coalesce("gap", "first_gap") / F.nullif("usual", F.lit(0.0))
    return f.select("source", "block", "at", "t", "x", (F.col("before") + F.col("__rn") - 1).alias("place"), "frames", strength.alias("strength"))


SEGMENT = "first long, n long, started_at long, ended_at long, first_time long, strength double, break_times array<long>, break_strengths array<double>"
NAMES = ["first", "n", "started_at", "ended_at", "first_time", "strength", "break_times", "break_strengths"]
FIELDS = [pa.int64()] * 5 + [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())]


def _merge(source, table: pa.Table, limit: int, overlap: int, chunk: bool) -> pa.Table:
    """The pieces of one run of segments in order; of a chunk, whose edges are not the source's, pieces may stay open there."""
    s = table.select([*NAMES, "frames"]).to_pydict()
    order = sorted(range(table.num_rows), key=s["first"].__getitem__)
    s = {k: [v[i] for i in order] for k, v in s.items()}
    full = limit - overlap
    whole = s["frames"][0] <= limit
    rank = [x if x is not None and x > WEAK else FULL if not whole and a % full == 0 else PLAIN for a, x in zip(s["first"], s["strength"])]
    starts = s["first"][0] == 0
    ends = s["first"][-1] + s["n"][-1] == s["frames"][0]
    open_left, open_right = chunk and not starts, chunk and not ends
    heads, undecided = merged(s["n"], rank, limit, 0 if whole else overlap, starts, open_left, FULL if open_right else None)
    rows = []
    for p, h in enumerate(heads):
        e = heads[p + 1] if p + 1 < len(heads) else len(order)
        times, strengths = list(s["break_times"][h] or []), list(s["break_strengths"][h] or [])
        for i in range(h + 1, e):  # boundaries that merging crossed
            x = s["strength"][i]
            if x is not None and x > WEAK:
                times.append(s["first_time"][i])
                strengths.append(x)
            times += s["break_times"][i] or []
            strengths += s["break_strengths"][i] or []
        left = h in undecided or (open_left and p == 0)
        right = (open_right and e == len(order)) or e in undecided
        rows.append((source, s["first"][h], sum(s["n"][h:e]), s["started_at"][h], s["ended_at"][e - 1], s["first_time"][h], s["strength"][h], times, strengths, s["frames"][0], left, right))
    columns = list(zip(*rows))
    kinds = [pa.string(), *FIELDS, pa.int64(), pa.bool_(), pa.bool_()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["source", *NAMES, "frames", "open_left", "open_right"])


def _merged_pieces(f: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(source, first, n, started_at, ended_at, first_time, strength, break_times, break_strengths): the pieces that merging leaves, with the breaks it crossed."""
    full = limit - overlap
    inside = Window.partitionBy("source", "block").orderBy("at")
    whole = F.col("frames") <= limit
    begins = (F.col("place") == 0) | F.coalesce(F.col("strength") > WEAK, F.lit(False)) | (~whole & (F.col("place") % full == 0))
    f = f.withColumn("__a", F.sum(begins.cast("int")).over(inside))
    # atomic segments: frames of one time block without a break and without the place where a full piece would end
    s = f.groupBy("source", "block", "__a").agg(
        F.min("place").alias("first"), F.count("*").alias("n"), F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.min_by("t", "at").alias("first_time"), F.min_by("strength", "at").alias("strength"), F.max("frames").alias("frames"))
    s = s.select("source", F.floor(F.col("first") / (full * CHUNK_CELLS)).alias("chunk"), *NAMES[:6], F.lit(None).cast("array<long>").alias("break_times"), F.lit(None).cast("array<double>").alias("break_strengths"), "frames")
    schema = f"source string, {SEGMENT}, frames long, open_left boolean, open_right boolean"
    made = s.groupBy("source", "chunk").applyInArrow(lambda key, table: _merge(key[0].as_py(), table, limit, overlap, True), schema)
    is_open = F.col("open_left") | F.col("open_right")
    run = F.sum(F.when(F.col("open_left"), 0).otherwise(1)).over(Window.partitionBy("source").orderBy("first"))  # the few open pieces of each chunk
    rest = made.filter(is_open).withColumn("run", run).groupBy("source", "run").applyInArrow(lambda key, table: _merge(key[0].as_py(), table, limit, overlap, False), schema)
    return made.filter(~is_open).unionByName(rest).drop("open_left", "open_right", "frames")


def _checked(limit: int, overlap: int) -> None:
    if overlap < 0 or limit <= overlap:
        raise ValueError("limit must be greater than overlap, overlap not below 0")


def pieces(
    df: DataFrame, source: str = "recording_id", at: str = "captured_at", time: str = "Time", value: str = "Cell_1", limit: int = 400, overlap: int = 20,
    block_seconds: int = ordered.BLOCK_SECONDS, with_frames: bool = True, longer_than: int = 0,
) -> DataFrame:
    """One row per piece of every source: (source, first, n, started_at, ended_at, first_time, strength, break_times, break_strengths[, repeated, times, cells]).

    Rows equal in source and moment are one frame; frames are ordered by moment. first is the number, from 0, of the piece's first own frame in the source;
    n, started_at and ended_at count own frames; strength is the interval before the piece as a multiple of the source's median one, break_times and break_strengths
    tell of the breaks (of more than WEAK) inside it. times and cells begin with the `repeated` frames before the piece, the last `overlap` ones (fewer only where the source
    has fewer), and hold at most `limit`. No two neighbouring pieces would fit into one. A source of at most `limit` frames is one piece; those of at most `longer_than`
    frames are left out. Null source or moment: left out; null time or value: kept. Empty tables give an empty result; other columns are ignored.

    Atomic segments begin after every break and at every multiple of limit - overlap frames of the source.
    """
    _checked(limit, overlap)
    f = _numbered(_frames(df, source, at, time, value, block_seconds), longer_than)
    made = _merged_pieces(f.drop("x"), limit, overlap)
    if not with_frames:
        return made.withColumnRenamed("source", source)
    # frames by bucket of places, with those that pieces beginning in it need from either side
    size = max(BUCKET, limit)
    own = F.floor(F.col("place") / size)
    reached = F.sequence(F.floor(F.greatest(F.lit(0), F.col("place") - limit) / size), F.floor((F.col("place") + overlap) / size))
    f = f.select("source", "place", "t", "x", F.explode(F.when(own > 0, reached).otherwise(F.sequence(own, F.floor((F.col("place") + overlap) / size)))).alias("bucket"))
    p = made.select(F.col("source").alias("of"), F.floor(F.col("first") / size).alias("ofbucket"), *NAMES)

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left["place"].to_numpy(), kind="stable")
        lowest = left["place"].to_numpy()[order[0]] if len(order) else 0
        first, n = right["first"].to_numpy(), right["n"].to_numpy()
        repeated = np.minimum(overlap, first)
        ends = np.cumsum(repeated + n)
        begins = ends - (repeated + n)
        taken = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - repeated - lowest - begins, repeated + n)
        rows, offsets = pa.array(order[taken]), pa.array(np.append(0, ends), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, left[c].take(rows).combine_chunks()) for c in ("t", "x")]
        return pa.table([right["of"], *[right[c] for c in NAMES], pa.array(repeated, pa.int64()), *lists], ["source", *NAMES, "repeated", "times", "cells"])

    whole = f.groupBy("source", "bucket").cogroup(p.groupBy("of", "ofbucket")).applyInArrow(fill, f"source string, {SEGMENT}, repeated long, times array<long>, cells array<double>")
    return whole.withColumnRenamed("source", source)


def breaks(df: DataFrame, source: str = "recording_id", more_than: float = 20.0, longer_than: int = 400, **columns) -> DataFrame:
    """(source, boundary_time), without repeats: the breaks stronger than more_than usual intervals in sources of more than longer_than frames.

    Read from the merged pieces: a break is where two of them meet, or one of those that merging crossed. Frames of null time give no row.
    """
    if more_than < WEAK:
        raise ValueError(f"more_than must be {WEAK} at least")
    made = pieces(df, source, with_frames=False, longer_than=longer_than, **columns)
    edge = F.array(F.struct(F.col("first_time").alias("t"), F.col("strength").alias("s")))
    crossed = F.zip_with("break_times", "break_strengths", lambda t, s: F.struct(t.alias("t"), s.alias("s")))
    found = made.select(source, F.explode(F.concat(edge, crossed)).alias("b")).filter((F.col("b.s") > more_than) & F.col("b.t").isNotNull())
    return found.select(source, F.col("b.t").alias("boundary_time")).distinct()


def piece_sizes(made: DataFrame, source: str = "recording_id", limit: int = 400, overlap: int = 20) -> DataFrame:
    """(source, frames, own_frames, too_long, short_overlaps, fitting_neighbours) of pieces(): the last three count pieces against the rules, 0 where all is well."""
    along = Window.partitionBy(source).orderBy("first")
    most = F.lit(limit) - F.when(F.col("first") == 0, 0).otherwise(overlap)
    fits = F.coalesce(F.col("n") + F.lead("n").over(along) <= most, F.lit(False))
    count = lambda c: F.sum(c.cast("long"))
    s = made.withColumn("__fits", fits)
    return s.groupBy(source).agg(F.max(F.col("first") + F.col("n")).alias("frames"), F.sum("n").alias("own_frames"), count(F.size("times") > limit).alias("too_long"), count((F.col("repeated") != F.least(F.lit(overlap), F.col("first"))) | (F.size("times") != F.col("n") + F.col("repeated"))).alias("short_overlaps"), count(F.col("__fits")).alias("fitting_neighbours"))
