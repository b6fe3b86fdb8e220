"""NumPy kernels for what column expressions cannot state: local regression, matrix decompositions, linkage, samplers."""

from __future__ import annotations

import numpy as np


def loess(t: np.ndarray, y: np.ndarray, span: float) -> np.ndarray:
    """Local quadratic fit with tricube weights over the floor(n * span) nearest readings, fitted directly at every t; NaN where y is missing.

    Fewer than three readings give 0; a singular local fit falls back to the line through all readings.
    """
    out, good = np.full(len(y), np.nan), np.isfinite(y)
    x, v = t[good].astype(float), y[good]
    n = len(x)
    if n < 3:
        out[good] = 0.0
        return out
    order = np.argsort(x, kind="stable")
    back = np.empty(n)
    back[order] = local_fits(x[order], v[order][None], (span,))[0][0]
    out[good] = back
    return out


def local_fits(x: np.ndarray, v: np.ndarray, spans: tuple[float, ...]) -> list[np.ndarray]:
    """loess at every x for each span, of many traces (rows of v) with readings at the same three or more ascending x; spans that come to as many readings share a fit."""
    n, found, lines = len(x), {}, []

    def line() -> np.ndarray:
        if not lines:
            lines.append(np.array([np.polyfit(x, y, 1) if x[0] != x[-1] else [0.0, y.mean()] for y in v]))
        return lines[0]

    def fits(q: int) -> np.ndarray:
        first, lo = np.empty(n, int), 0
        for i in range(n):
            while lo + q < n and x[lo + q] - x[i] < x[i] - x[lo]:
                lo += 1
            first[i] = lo
        fit = np.empty(v.shape)
        most = max(1, 2_000_000 // q)
        for a in range(0, n, most):
            rows = slice(a, min(n, a + most))
            at = first[rows, None] + np.arange(q)
            d = x[at] - x[rows, None]
            h = np.abs(d).max(1, keepdims=True)
            s = d / np.where(h > 0, h, 1.0)
            w = (1 - np.abs(s) ** 3) ** 3
            ws = [w * s**k for k in range(3)]
            p = [(w * s**k).sum(1) for k in range(5)]
            m = np.array([[p[i + j] for j in range(3)] for i in range(3)]).transpose(2, 0, 1)
            sound = np.abs(np.linalg.det(m)) > 1e-12 * np.maximum(p[0], 1e-300) ** 3
            some = max(1, most // len(at))
            for c in range(0, len(v), some):
                part = np.empty((len(v[c : c + some]), len(at)))
                if sound.any():
                    y = np.take(v[c : c + some], at[sound], axis=1)
                    b = np.stack([(ws[k][sound] * y).sum(-1) for k in range(3)], -1)
                    part[:, sound] = np.linalg.solve(m[sound], b[..., None])[..., 0, 0]
                if not sound.all():
                    slope, height = line()[c : c + some].T[:, :, None]
                    part[:, ~sound] = slope * x[rows][~sound] + height
                fit[c : c + some, rows] = part
        return fit

    for span in spans:
        q = min(n, max(3, int(n * span + 1e-5)))
        if q not in found:
            found[q] = fits(q)
    return [found[min(n, max(3, int(n * span + 1e-5)))] for span in spans]


def loess_interpolated(t: np.ndarray, y: np.ndarray, span: float, cell: float = 0.2) -> np.ndarray:
    """loess fitted at a few vertices only, with cubic interpolation by the fits' values and slopes between them; NaN where y is missing.

    Readings are halved at their median until a part holds at most n * span * cell of them; the ends of the parts are the vertices. Work grows with the
    number of vertices times n * span instead of n times n * span.
    """
    out, good = np.full(len(y), np.nan), np.isfinite(y)
    x, v = t[good].astype(float), y[good]
    n = len(x)
    q, most = min(n, max(3, int(n * span + 1e-5))), int(n * span * cell)
    if n < 8 or most < 1 or x.min() == x.max():
        return loess(t, y, span)
    order = np.argsort(x, kind="stable")
    x, v = x[order], v[order]
    margin = 0.005 * (x[-1] - x[0])
    vertices, parts = [x[0] - margin, x[-1] + margin], [(0, n - 1)]
    while parts:
        a, b = parts.pop()
        if b - a + 1 > most:
            m = (a + b) // 2
            if x[m] < x[m + 1]:
                vertices.append((x[m] + x[m + 1]) / 2)
                parts += [(a, m), (m + 1, b)]
    vertices = np.array(sorted(vertices))
    value, slope = np.empty(len(vertices)), np.empty(len(vertices))
    line = np.polyfit(x, v, 1)
    for i, at in enumerate(vertices):
        d = np.abs(x - at)
        near = np.argpartition(d, q - 1)[:q]
        h = d[near].max() * max(1.0, span)
        s = (x[near] - at) / h
        w = np.maximum(0.0, 1 - np.abs(s) ** 3) ** 3
        design = np.stack([np.ones(q), s, s * s], 1)
        m = (design * w[:, None]).T @ design
        if abs(np.linalg.det(m)) > 1e-12 * max(m[0, 0], 1e-300) ** 3:
            c = np.linalg.solve(m, (design * w[:, None]).T @ v[near])
            value[i], slope[i] = c[0], c[1] / h
        else:
            value[i], slope[i] = line[0] * at + line[1], line[0]
    k = np.clip(np.searchsorted(vertices, x, "right") - 1, 0, len(vertices) - 2)
    width = vertices[k + 1] - vertices[k]
    u = (x - vertices[k]) / width
    fit = (1 + 2 * u) * (1 - u) ** 2 * value[k] + u * (1 - u) ** 2 * width * slope[k] + u**2 * (3 - 2 * u) * value[k + 1] + u**2 * (u - 1) * width * slope[k + 1]
    back = np.empty(n)
    back[order] = fit
    out[good] = back
    return out


def robust_pca(m: np.ndarray, rounds: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank and sparse part by alternating shrinkage with multipliers; penalty 1 / sqrt(max side)."""
    penalty = 1 / np.sqrt(max(m.shape))
    mu = 10 * penalty
    low, sparse, dual = (np.zeros_like(m) for _ in range(3))
    shrink = lambda x, by: np.sign(x) * np.maximum(np.abs(x) - by, 0)
    for i in range(rounds):
        before = low, sparse
        u, s, vt = np.linalg.svd(m - sparse + dual / mu, full_matrices=False)
        low = (u * shrink(s, 1 / mu)) @ vt
        sparse = shrink(m - low + dual / mu, penalty / mu)
        dual = dual + mu * (m - low - sparse)
        if i and all(np.linalg.norm(a - b) <= tol * max(np.linalg.norm(b), 1e-300) for a, b in zip((low, sparse), before)):
            break
    return low, sparse


def nmf(m: np.ndarray, rank: int, rounds: int = 100, tol: float = 1e-6, method: str = "multiplicative", seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors of a matrix (negatives count as 0) by multiplicative updates or alternating least squares."""
    m = np.maximum(m, 0)
    g = np.random.default_rng(seed)
    w, h = np.maximum(g.random((m.shape[0], rank)), 1e-10), np.maximum(g.random((rank, m.shape[1])), 1e-10)
    ridge = 1e-8 * np.eye(rank)
    for i in range(rounds):
        before = w, h
        if method == "als":
            h = np.maximum(np.linalg.solve(w.T @ w + ridge, w.T @ m), 0)
            w = np.maximum(np.linalg.solve(h @ h.T + ridge, h @ m.T).T, 0)
        else:
            h = h * (w.T @ m) / (w.T @ w @ h + 1e-10)
            w = w * (m @ h.T) / (w @ h @ h.T + 1e-10)
        if i and all(np.linalg.norm(a - b) <= tol * max(np.linalg.norm(b), 1e-300) for a, b in zip((w, h), before)):
            break
    return w, h


def ica(m: np.ndarray, k: int, rounds: int = 200, tol: float = 1e-6, method: str = "fastica", seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(sources, unmixing) of a time x variables matrix: whitening by the k leading components, then fixed-point (tanh), infomax or plain PCA."""
    x = m - m.mean(0)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    k = min(k, int((s > 1e-12 * max(s[0], 1e-300)).sum()))
    if method == "pca" or k == 0:
        return u[:, :k] * s[:k], vt[:k]
    white = u[:, :k] * np.sqrt(len(x))
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):
        if method == "infomax":
            y = 1 / (1 + np.exp(-(white @ w.T)))
            new = w + 0.01 * (np.eye(k) + (1 - 2 * y).T @ (white @ w.T) / len(x)) @ w
        else:
            g = np.tanh(white @ w.T)
            a, _, b = np.linalg.svd(g.T @ white / len(x) - (1 - g**2).mean(0)[:, None] * w)
            new = a @ b
        change = np.abs(np.abs((new * w).sum(1)) / np.maximum(np.linalg.norm(new, axis=1) * np.linalg.norm(w, axis=1), 1e-300) - 1).max()
        w = new
        if change < tol:
            break
    return white @ w.T, w @ (vt[:k] / s[:k, None]) * np.sqrt(len(x))


def ssa(y: np.ndarray, window: int | None = None, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, components x time) of singular-spectrum analysis: lagged windows, SVD, means over anti-diagonals."""
    n = len(y)
    window = window or max(1, min(n // 3, 50))
    lagged = np.lib.stride_tricks.sliding_window_view(y, window).T
    u, s, vt = np.linalg.svd(lagged, full_matrices=False)
    k = min(k or window, len(s))
    place = np.add.outer(np.arange(window), np.arange(n - window + 1)).ravel()
    counts = np.bincount(place, minlength=n)
    return s, np.array([np.bincount(place, (s[i] * np.outer(u[:, i], vt[i])).ravel(), n) / counts for i in range(k)])


def emd(y: np.ndarray, most: int = 10) -> np.ndarray:
    """(modes + rest) x time: each mode is what remains after one subtraction of the mean of the linear envelopes; the rest comes last."""
    t, rest, modes = np.arange(len(y)), y.astype(float), []
    for _ in range(most):
        d = np.diff(rest)
        top, low = (np.flatnonzero((s * d[:-1] > 0) & (s * d[1:] < 0)) + 1 for s in (1, -1))
        if len(top) < 2 or len(low) < 2:
            break
        mean = (np.interp(t, top, rest[top]) + np.interp(t, low, rest[low])) / 2
        modes.append(rest - mean)
        rest = mean
    return np.array([*modes, rest])


def haar(y: np.ndarray, levels: int = 3, noise: float = 0.1) -> np.ndarray:
    """Hard-thresholded Haar wavelets (threshold noise * sqrt(2 ln n)), over the largest part whose length the levels divide; what is left stays."""
    n = len(y) >> levels << levels
    if n == 0:
        return y.copy()
    limit, a, details = noise * np.sqrt(2 * np.log(len(y))), y[:n].astype(float), []
    for _ in range(levels):
        d = (a[1::2] - a[0::2]) / np.sqrt(2)
        a = (a[1::2] + a[0::2]) / np.sqrt(2)
        details.append(np.where(np.abs(d) > limit, d, 0.0))
    for d in reversed(details):
        both = np.empty(2 * len(a))
        both[1::2], both[0::2] = (a + d) / np.sqrt(2), (a - d) / np.sqrt(2)
        a = both
    return np.concatenate([a, y[n:]])


def ward(distance: np.ndarray, k: int) -> np.ndarray:
    """Labels 1.. of k clusters by Ward's criterion on squared distances; clusters are numbered by their first member.

    Chains of nearest neighbours: two clusters that are each other's nearest are merged whenever a chain finds them, which gives the merges of the greedy order in quadratic time; the
    lowest n - k of them are kept.
    """
    n = len(distance)
    d = distance.astype(float) ** 2
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        a = chain[-1]
        b = int(np.argmin(d[a]))
        if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
            b = chain[-2]
            del chain[-2:]
            i, j = min(a, b), max(a, b)
            merges.append((d[i, j], i, j))
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
            new[~alive] = np.inf
            d[i], d[:, i] = new, new
            d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
            size[i] += size[j]
            alive[j] = False
        else:
            chain.append(b)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, i, j in sorted(merges, key=lambda m: m[0])[: n - max(1, min(k, n))]:
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    number: dict[int, int] = {}
    return np.array([number.setdefault(find(i), len(number) + 1) for i in range(n)], int)


def spike_sampler(y: np.ndarray, model: str, draws: int, burn: int, g: np.random.Generator) -> dict[str, np.ndarray]:
    """Posterior draws of a two-state spike model; all frames of one sweep are proposed together, as they are independent given the parameters.

    poisson: rate ~ Gamma(1 + spikes, 1 + n), kept below 1 where it is a probability; precision-like tau ~ Gamma(1 + n / 2, 1 + SS / 2). gaussian and
    hierarchical: mean, sd and amplitude by Gibbs steps, spikes with prior 0.1; hierarchical puts N(0, 10) and IG(1, 1) priors on them.
    """
    n, s = len(y), np.zeros(len(y))
    mean, var, amp, out = float(y.mean()), float(y.var()) or 1.0, 1.0, {k: [] for k in ("mean", "spread", "amplitude")}
    total, kept = np.zeros(n), []
    prior = 0.0 if model == "gaussian" else 1 / 100
    for i in range(burn + draws):
        if model == "poisson":
            mean = g.gamma(1 + s.sum(), 1 / (1 + n))
            var = g.gamma(1 + n / 2, 1 / (1 + ((y - mean) ** 2).sum() / 2))
            p = min(max(mean, 1e-6), 1 - 1e-6)
        else:
            rest = y - amp * s
            precision = n / var + prior
            mean = g.normal(rest.sum() / var / precision, precision**-0.5)
            var = 1 / g.gamma(1 + n / 2, 1 / (1 + ((rest - mean) ** 2).sum() / 2))
            precision = s.sum() / var + (prior or 1.0)
            amp = g.normal(((y - mean) * s).sum() / var / precision, precision**-0.5)
            p = 0.1
        odds = np.log(p / (1 - p)) + ((y - mean) ** 2 - (y - mean - amp) ** 2) / (2 * var)
        flip = np.log(g.random(n)) < np.where(s == 0, odds, -odds)
        s = np.where(flip, 1 - s, s)
        if i >= burn:
            for k, v in (("mean", mean), ("spread", var), ("amplitude", amp)):
                out[k].append(v)
            total += s
            kept.append(s.sum())
    return {k: np.array(v) for k, v in out.items()} | {"spike_probability": total / max(draws, 1), "spikes": np.array(kept)}


def normal_draws(n: np.ndarray, centre: np.ndarray, spread: np.ndarray, draws: int, burn: int, sources: list[np.random.Generator]) -> tuple[np.ndarray, np.ndarray]:
    """Gibbs draws of mean and variance with priors N(0, 10) and IG(1, 1), samples x draws, for many samples at once.

    A sample is its count, mean and population variance; its draws come from its own generator, so they don't depend on what it is drawn together with.
    """
    steps = burn + draws
    z, gamma = np.empty((steps, len(n))), np.empty((steps, len(n)))
    for i, g in enumerate(sources):
        z[:, i] = g.standard_normal(steps)
        gamma[:, i] = g.standard_gamma(1 + n[i] / 2, steps)
    mean, variance = np.empty((draws, len(n))), np.empty((draws, len(n)))
    var = np.where(spread == 0, 1.0, spread)
    with np.errstate(all="ignore"):
        for i in range(steps):
            precision = n / var + 1 / 10
            m = n * centre / var / precision + z[i] / np.sqrt(precision)
            var = (1 + n * (spread + (centre - m) ** 2) / 2) / gamma[i]
            if i >= burn:
                mean[i - burn], variance[i - burn] = m, var
    return mean.T, variance.T


def oasis_counts(y: np.ndarray, factor: float = 0.1, reach: int = 3, frames: np.ndarray | None = None) -> np.ndarray:
    """Events of each row of a draws x frames matrix: values above factor sds of the rest after the 21-frame mean (the row's median where that is missing), merged within reach; rows of under 21 frames: values above two sds.

    Missing readings are NaN; frames are the columns' ascending times, 0, 1, 2, ... if not given.
    """
    draws, n = y.shape
    missing = np.isnan(y).any()
    sd, median = (_nan_sd, _nan_median) if missing else (lambda x: x.std(1, ddof=1, keepdims=True), lambda x: np.median(x, 1, keepdims=True))
    if n < 21:
        return (y > 2 * sd(y)).sum(1) if n > 1 else np.zeros(draws, int)
    frames = np.arange(n) if frames is None else frames
    centre = np.repeat(median(y), n, 1)
    if missing or frames[-1] - frames[0] != n - 1:
        means = np.where(frames[20:] - frames[:-20] == 20, np.lib.stride_tricks.sliding_window_view(y, 21, 1).mean(2), np.nan)
        centre[:, 10 : n - 10] = np.where(np.isnan(means), centre[:, 10 : n - 10], means)
    else:
        sums = np.cumsum(np.concatenate([np.zeros((draws, 1)), y], 1), 1)
        centre[:, 10 : n - 10] = (sums[:, 21:] - sums[:, :-21]) / 21
    a = y - centre
    over = a > factor * sd(a)
    at, height, events = np.full(draws, frames[0] - reach - 1), np.full(draws, -np.inf), np.zeros(draws, int)
    for i, t in enumerate(frames):
        new = over[:, i] & (t - at > reach)
        better = over[:, i] & ~new & (a[:, i] > height)
        events += new
        at[new | better] = t
        height[new | better] = a[new | better, i]
    return events


def _nan_sd(x: np.ndarray) -> np.ndarray:
    n = (~np.isnan(x)).sum(1, keepdims=True)
    with np.errstate(all="ignore"):
        return np.where(n > 1, np.sqrt(np.nansum((x - np.nansum(x, 1, keepdims=True) / n) ** 2, 1, keepdims=True) / (n - 1)), np.nan)


def _nan_median(x: np.ndarray) -> np.ndarray:
    return np.array([[np.median(r[~np.isnan(r)]) if not np.isnan(r).all() else np.nan] for r in x])
