import numpy as np

from glimmerframe.llm import neighbours as N


def test_walk_is_widened_until_true_neighbours_are_found(spark):
    x = np.random.default_rng(4).normal(size=(3000, 64))  # noise: halves tell little, so the walk must be wide
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "window_id long, vec array<double>")
    _, u = N.shapes(x.tolist(), 64, False)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = [set(np.argsort(-row)[:5].tolist()) for row in s]
    got = {}
    for r in N.most_similar(df).collect():
        got.setdefault(r.window_id, set()).add(r.neighbour)
    assert len(got) == 3000 and np.mean([len(got[i] & want[i]) / 5 for i in range(3000)]) >= 0.9


def test_needed_is_what_the_walk_holds():
    r = np.random.default_rng(2)
    f, s, counts = r.random(6), r.random(6), r.integers(0, 3, (6, 6))
    for u, v in np.argwhere(counts > 0).tolist():
        n = N.needed(f, s, counts, u, v)
        assert (u, v) in N.walk(f, s, counts, n) and (u, v) not in N.walk(f, s, counts, n - counts[u, v])
