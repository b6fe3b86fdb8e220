import numpy as np
import pytest

from glimmerframe.operators import images


def spiral(n):
    """A one-pixel path of many turns that winds into an n x n frame."""
    m, r, c, dr, dc = np.zeros((n, n), int), 0, 0, 0, 1
    m[0, 0] = 1
    while True:
        ahead, two = (r + dr, c + dc), (r + 2 * dr, c + 2 * dc)
        free = 0 <= ahead[0] < n and 0 <= ahead[1] < n and not m[ahead]
        free = free and not (0 <= two[0] < n and 0 <= two[1] < n and m[two])
        if not free:
            dr, dc = dc, -dr
            ahead, two = (r + dr, c + dc), (r + 2 * dr, c + 2 * dc)
            if not (0 <= ahead[0] < n and 0 <= ahead[1] < n and not m[ahead]) or (0 <= two[0] < n and 0 <= two[1] < n and m[two]):
                return m
        r, c = ahead
        m[r, c] = 1


def test_a_winding_region_is_one(spark):
    m = spiral(41)
    px = spark.createDataFrame([(1, r, c, float(m[r, c])) for r in range(41) for c in range(41)], "frame long, r long, c long, value double")
    got = images.components(px).collect()
    assert len(got) == m.sum() and {r.label for r in got} == {0}


@pytest.mark.parametrize("window", [3, 5, 15])
def test_window_sums_against_numpy(spark, window):
    x = np.random.default_rng(3).normal(size=(9, 12)) + 100
    px = spark.createDataFrame([(1, r, c, float(x[r, c])) for r in range(9) for c in range(12)], "frame long, r long, c long, value double")
    h, local, adaptive = window // 2, np.zeros((9, 12)), np.zeros((9, 12))
    for r in range(9):
        for c in range(12):
            w = x[max(0, r - h) : r + h + 1, max(0, c - h) : c + h + 1]
            local[r, c] = x[r, c] > w.sum() / window**2 - 0.05
            adaptive[r, c] = x[r, c] > w.mean() - 0.1 * w.std(ddof=1)
    for run, want in ((images.local_threshold, local), (images.adaptive_threshold, adaptive)):
        assert {(r.r, r.c): r.value for r in run(px, window).collect()} == {(r, c): want[r, c] for r in range(9) for c in range(12)}
