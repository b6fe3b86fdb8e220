import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glimmerframe.llm import split

SCHEMA = "recording_id string, us long, Time long, Cell_1 double, source string"


def recording(name, n, seed, breaks=(), lost=0.05):
    r, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += r.randint(95_000, 105_000) * (1 if r.random() > lost else r.randint(2, 12)) + (10_000_000 if i in breaks else 0)
        rows.append((name, at, i + 1, float(i), "x"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("captured_at", F.timestamp_micros("us"))


def check(rows, made, limit=400, overlap=20):
    """Whole, in order, within the limit, each with the frames before it at its head, and no two neighbours that would fit into one."""
    made = sorted(made, key=lambda r: r.first)
    times = sorted({r[2] for r in rows})
    assert [t for r in made for t in r.times[r.repeated :]] == times
    for r, after in zip(made, [*made[1:], None]):
        assert len(r.times) == len(r.cells) == r.n + r.repeated <= limit
        assert r.times == times[max(0, r.first - overlap) : r.first + r.n] and r.cells == [float(t - 1) for t in r.times]
        assert after is None or r.n + after.n > (limit if r.first == 0 else limit - overlap)


def test_pieces_are_whole_and_cut_at_breaks(spark):
    a, b = recording("a", 2500, 1, {300, 301, 900, 905, 1600}), recording("b", 400, 2, {200})
    df = frame(spark, a + b + a[:50])
    for block in (7, 45, 600):
        made = split.pieces(df, block_seconds=block).collect()
        check(a, [r for r in made if r.recording_id == "a"])
        assert [r.n for r in made if r.recording_id == "b"] == [400]
        assert {901, 1601} <= {r.first_time for r in made if r.recording_id == "a"}
        assert {tuple(r) for r in split.breaks(df, block_seconds=block).collect()} == {("a", t) for t in (301, 302, 901, 906, 1601)}


def test_chunks_and_buckets_change_nothing(spark, monkeypatch):
    rows = recording("a", 6000, 3, {5, 2000, 2001, 4400}) + recording("b", 3000, 4, lost=0.4) + recording("c", 900, 5, {10})
    df = frame(spark, rows)
    whole = sorted((r.recording_id, r.first, r.n, sorted(r.break_times)) for r in split.pieces(df).collect())
    for cells, bucket, block in ((1, 400, 5), (2, 1000, 30), (3, 7000, 600)):
        monkeypatch.setattr(split, "CHUNK_CELLS", cells)
        monkeypatch.setattr(split, "BUCKET", bucket)
        made = split.pieces(df, block_seconds=block).collect()
        assert sorted((r.recording_id, r.first, r.n, sorted(r.break_times)) for r in made) == whole
        for name in "abc":
            check([r for r in rows if r[0] == name], [r for r in made if r.recording_id == name])
        sizes = split.piece_sizes(split.pieces(df, block_seconds=block)).collect()
        assert {tuple(r) for r in sizes} == {("a", 6000, 6000, 0, 0, 0), ("b", 3000, 3000, 0, 0, 0), ("c", 900, 900, 0, 0, 0)}


def test_breaks_come_from_the_merge(monkeypatch):
    segments = {"first": [0, 100, 150], "n": [100, 50, 300], "started_at": [0, 1, 2], "ended_at": [0, 1, 2], "first_time": [1, 101, 151], "strength": [None, 30.0, 40.0], "break_times": [None] * 3, "break_strengths": [None] * 3, "frames": [450] * 3}
    told = lambda: [(r["first_time"], r["break_times"]) for r in split._merge("a", pa.table(segments), 400, 20, False).to_pylist()]
    assert told() == [(1, [101]), (151, [])]
    monkeypatch.setattr(split, "merged", lambda *_: ([0], set()))
    assert told() == [(1, [101, 151])]


def test_unbroken_recording_and_equal_intervals(spark):
    rows = [("a", i * 100_000, i + 1, float(i), "x") for i in range(1500)]
    check(rows, split.pieces(frame(spark, rows)).collect())
    assert split.breaks(frame(spark, rows)).collect() == []


def test_slow_sources_are_not_cut_by_the_clock(spark):
    rows = [("a", i * 10_000_000, i + 1, float(i), "x") for i in range(1000)]
    assert sorted(r.n for r in split.pieces(frame(spark, rows)).collect()) == [240, 380, 380]


def test_merging_takes_the_weakest_boundary_first():
    assert split.merged([5, 5, 5, 5], [9, 3, 1, 2], 12, 1, True) == ([0, 1, 3], set())
    assert split.merged([5, 5, 5, 5], [9, 1, 1, 1], 100, 0, True)[0] == [0]
    assert split.merged([400], [0], 400, 20, True)[0] == [0]


def test_what_lies_outside_stays_undecided():
    heads, undecided = split.merged([5, 5, 5, 5], [2, 9, 1, 9], 100, 0, False, True, 3)
    assert heads == [0, 1, 3] and undecided == {1, 3}



def test_odd_input(spark):
    rows = [(None, 1, 1, 1.0, "x"), ("a", None, 1, 1.0, "x"), ("b", 5, None, None, "x"), ("b", 5, 3, None, "x"), ("b", 5, 3, 2.0, "x")]
    made = split.pieces(frame(spark, rows)).collect()
    assert [(r.recording_id, r.n, r.times, r.cells) for r in made] == [("b", 1, [3], [2.0])]
    assert split.pieces(frame(spark, rows).limit(0)).collect() == [] and split.breaks(frame(spark, rows)).collect() == []
    same = [("a", 1000, i, 0.0, "x") for i in range(500)]
    assert [r.n for r in split.pieces(frame(spark, same)).collect()] == [1]
    for limit, overlap in ((20, 20), (400, -1)):
        with pytest.raises(ValueError):
            split.pieces(frame(spark, rows), limit=limit, overlap=overlap)
