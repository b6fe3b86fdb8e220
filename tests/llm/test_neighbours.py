import numpy as np
import pytest

from glimmerframe.llm import neighbours as N


def frame(spark, rows, extra="x"):
    return spark.createDataFrame([(i, v, extra, 0) for i, v in rows], "window_id long, vec array<double>, id string, a int")


def brute(rows, k=5, fill=False, size=64):
    keep, x = N.shapes([v for _, v in rows], size, fill)
    ids = np.array([i for (i, _), ok in zip(rows, keep) if ok])
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {int(ids[i]): [(int(ids[j]), s[i, j]) for j in np.lexsort((ids, -s[i].round(9)))[:k] if s[i, j] > -2] for i in range(len(ids))}


def walks(n, seed=0):
    return np.random.default_rng(seed).normal(size=(n, 64)).cumsum(1)


def test_recall_against_brute_force(spark):
    rows = [(i + 1, (v * (i % 7 + 1) + i).tolist()) for i, v in enumerate(walks(1500))]
    got = {}
    for r in N.most_similar(frame(spark, rows), visited=400).collect():
        got.setdefault(r.window_id, set()).add(r.neighbour)
    want = brute(rows)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(got[i] & {j for j, _ in want[i]}) / 5 for i in want]) >= 0.9


def test_small_collections_are_exact_with_copies_and_gaps(spark):
    x = walks(40, 3)
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)]
    rows += [(100 + i, (x[0] * 3 + 7).tolist()) for i in range(30)]  # a class of copies: level and gain do not count
    rows += [(200, [None, *x[5].tolist()[1:]]), (201, [float("nan"), *x[6].tolist()[1:]]), (202, [1.0] * 64), (203, None), (204, []), (205, [float("inf"), *[0.0] * 63])]
    for fill in (False, True):
        got = {}
        for r in sorted(N.most_similar(frame(spark, rows), fill=fill, recall=1.0).collect(), key=lambda r: r.rank):
            got.setdefault(r.window_id, []).append((r.neighbour, r.similarity))
        want = brute(rows, fill=fill)
        assert set(got) == set(want) and (200 in got) == (201 in got) == fill
        for i in want:
            assert [j for j, _ in got[i]] == [j for j, _ in want[i]]
            assert [s for _, s in got[i]] == pytest.approx([s for _, s in want[i]], abs=1e-6)


def test_mutual_pairs(spark):
    x = walks(30, 5)
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)] + [(50, (x[3] * 2 + 1e-3).tolist()), (51, (x[7] + np.random.default_rng(1).normal(size=64) * 1e-3).tolist())]
    want = brute(rows)
    pairs = {(a, b) for a in want for b, s in want[a] if a < b and s >= 0.97 and a in [j for j, _ in want[b]]}
    assert {tuple(r) for r in N.mutual(frame(spark, rows)).collect()} == pairs >= {(4, 50), (8, 51)}


def test_odd_tables(spark):
    assert N.most_similar(frame(spark, []).limit(0)).collect() == []
    assert N.most_similar(frame(spark, [(1, [float(i) for i in range(64)])])).collect() == []
    two = N.most_similar(frame(spark, [(1, [float(i) for i in range(64)]), (1, [float(i) for i in range(64)]), (None, [float(i) for i in range(64)]), (2, [float(i % 3) for i in range(64)])])).collect()
    assert sorted((r.window_id, r.neighbour) for r in two) == [(1, 2), (2, 1)]


def test_grid_of_parts_changes_nothing(spark, monkeypatch):
    rows = [(i + 1, v.tolist()) for i, v in enumerate(walks(200, 9))]
    rows += [(1000 + i, (np.arange(64.0) ** 2 + 1e-3 * r).tolist()) for i, r in enumerate(np.random.default_rng(1).normal(size=(90, 64)))]  # one crowded cell
    whole = sorted(map(tuple, N.most_similar(frame(spark, rows)).select("window_id", "rank", "neighbour").collect()))
    monkeypatch.setattr(N, "INDEX_ROWS", 7)
    assert sorted(map(tuple, N.most_similar(frame(spark, rows)).select("window_id", "rank", "neighbour").collect())) == whole


def test_walk_visits_cells_by_distance():
    r = np.random.default_rng(2)
    f, s = r.random(6), r.random(6)
    counts = r.integers(0, 3, (6, 6))
    cells = N.walk(f, s, counts, 10**9)
    sums = [f[i] + s[j] for i, j in cells]
    assert sums == sorted(sums) and len(cells) == (counts > 0).sum()
