"""Functional networks of cells: pair measures, thresholds, graph figures, and their change over time.

Undirected edges are (src, dst, w) with src < dst, directed ones have src driving dst. A pair is measured on the frames that both cells have: by products of small matrices
for correlations, by an equi-join on the frame for the rest. A measure that is undefined (a constant cell) is null and never an edge.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmerframe.functions.quantiles import exact_quantile
from glimmerframe.session import cut, spread


def pairs(df: DataFrame, *columns: str, extra: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """(extra, src, dst, t, x_*, y_*): readings of two cells in one frame; both orders if ordered, else src < dst."""
    keys = [*extra, "t"]
    a = df.select(*keys, F.col("cell").alias("src"), *[F.col(c).alias(f"x_{c}") for c in columns])
    b = df.select(*keys, F.col("cell").alias("dst"), *[F.col(c).alias(f"y_{c}") for c in columns])
    return a.join(b, keys).filter(F.col("src") != F.col("dst") if ordered else F.col("src") < F.col("dst"))


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation, null where either side is constant or a pair is alone."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


FRAMES, CELLS = 1000, 1000
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def products(df: DataFrame, extra: tuple[str, ...] = (), lags: int = 0) -> DataFrame:
    """(extra, src, dst, lag, n, sx, sy, sxx, syy, sxy): sums over the frames t for which src has a reading at t and dst one at t + lag; values count from their cell's least one.

    lag 0: pairs src < dst only; lags 1 .. lags: pairs of different cells in both orders. Frames are cut into blocks and cells into groups; a block of frames of two groups is a pair of
    small matrices, whose products are the sums of all their pairs at once. What is shuffled is a row a reading (for each group of cells) and then a row a pair and block of frames,
    instead of a row a pair and frame.
    """
    kind = df.schema["cell"].dataType.simpleString()
    named = [(c, df.schema[c].dataType.simpleString()) for c in extra]
    df = df.filter(F.col("value").isNotNull() & F.col("cell").isNotNull() & F.col("t").isNotNull()).groupBy(*extra, "cell", "t").agg(F.max("value").alias("value"))
    df = df.join(df.groupBy(*extra, "cell").agg(F.min("value").alias("__low")), [*extra, "cell"]).select(*extra, "cell", "t", (F.col("value") - F.col("__low")).alias("x"))
    groups = max(1, -(-df.select("cell").distinct().count() // CELLS))
    own = F.pmod(F.xxhash64("cell"), F.lit(groups)).cast("int")
    df = df.withColumn("own", own).withColumn("block", F.explode(F.array_distinct(F.array(F.floor(F.col("t") / FRAMES), F.floor((F.col("t") - lags) / FRAMES)))))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # each pair of groups once, in both orders where lags tell them apart
    sides = F.array(F.struct(F.col("own").alias("i"), F.col("other").alias("j")), F.struct(F.col("other").alias("i"), F.col("own").alias("j")))
    df = df.withColumn("pair", F.explode(F.array_distinct(sides)))
    df = df.select(*extra, "block", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "own", "cell", "t", "x")
    df = df if lags else df.filter(F.col("i") <= F.col("j"))
    schema = ", ".join([f"`{c}` {k}" for c, k in named] + [f"src {kind}, dst {kind}, lag int", *[f"{c} double" for c in SUMS]])

    def multiply(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, i, j = (k.as_py() for k in key[len(extra) :])
        cells, code = np.unique(table["cell"].to_numpy(zero_copy_only=False), return_inverse=True)
        t, x, own = table["t"].to_numpy() - block * FRAMES, table["x"].to_numpy(), table["own"].to_numpy()
        group = np.zeros(len(cells), int)
        group[code] = own
        value, there = np.zeros((2, len(cells), FRAMES + lags))
        value[code, t], there[code, t] = x, 1.0
        first, second = np.flatnonzero(group == i), np.flatnonzero(group == j)
        out = []
        for lag in range(lags + 1):
            if lag == 0 and i > j:
                continue
            va, ha = value[first, :FRAMES], there[first, :FRAMES]
            vb, hb = value[second, lag : lag + FRAMES], there[second, lag : lag + FRAMES]
            sums = [ha @ hb.T, va @ hb.T, ha @ vb.T, (va * va) @ hb.T, ha @ (vb * vb).T, va @ vb.T]
            keep = sums[0] > 0
            if lag == 0 and i == j:
                keep &= first[:, None] < second[None, :]
            else:
                keep &= first[:, None] != second[None, :]
            p, q = np.nonzero(keep)
            a, b, parts = first[p], second[q], [m[p, q] for m in sums]
            if lag == 0:  # the lesser cell comes first
                swap = a > b
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                parts = [parts[0], *[np.where(swap, parts[y], parts[z]) for z, y in ((1, 2), (2, 1), (3, 4), (4, 3))], parts[5]]
            out.append((a, b, np.full(len(a), lag), *parts))
        a, b, lag, *parts = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, int) for k in range(3 + len(SUMS)))
        names = pa.array(cells, table.schema.field("cell").type)
        fixed = [pa.array([k.as_py()] * len(a), k.type) for k in key[: len(extra)]]
        return pa.table([*fixed, names.take(pa.array(a)), names.take(pa.array(b)), pa.array(lag, pa.int32()), *[pa.array(p, pa.float64()) for p in parts]], [*extra, "src", "dst", "lag", *SUMS])

    made = spread(df, *extra, "block", "i", "j").groupBy(*extra, "block", "i", "j").applyInArrow(multiply, schema)
    return made.groupBy(*extra, "src", "dst", "lag").agg(*[F.sum(c).alias(c) for c in SUMS])


def _pearson() -> Column:
    """Correlation from the sums of products(); null where a side is constant or a pair is alone."""
    n = F.col("n")
    spread_of = lambda s, q: F.when(F.col(q) - F.col(s) * F.col(s) / n > 1e-14 * F.col(q), F.col(q) - F.col(s) * F.col(s) / n)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(spread_of("sx", "sxx") * spread_of("sy", "syy")))) + F.when(spread_of("sx", "sxx").isNotNull() & spread_of("sy", "syy").isNotNull(), 0.0)


def correlation(df: DataFrame, method: str = "pearson", extra: tuple[str, ...] = ()) -> DataFrame:
    """(extra, src, dst, w) by pearson, spearman (average ranks within the cell) or kendall (tau-b)."""
    df = df.filter(F.col("value").isNotNull())
    by = [*extra, "src", "dst"]
    if method == "pearson":
        return products(df, extra).select(*by, _pearson().alias("w"))
    if method == "spearman":
        own = Window.partitionBy(*extra, "cell")
        ranked = df.withColumn("value", F.rank().over(own.orderBy("value")) + (F.count("*").over(Window.partitionBy(*extra, "cell", "value")) - 1) / 2)
        return products(ranked, extra).select(*by, _pearson().alias("w"))
    if method == "kendall":
        p = pairs(df, "value", extra=extra)
        q = p.select(*by, F.col("t").alias("u"), F.col("x_value").alias("x2"), F.col("y_value").alias("y2"))
        both = p.join(q, by).filter(F.col("t") < F.col("u"))
        sx, sy = F.signum(F.col("x_value") - F.col("x2")), F.signum(F.col("y_value") - F.col("y2"))
        return both.groupBy(*by).agg(F.try_divide(F.sum(sx * sy), F.nullif(F.sqrt(F.sum(F.abs(sx)) * F.sum(F.abs(sy))), F.lit(0.0))).alias("w"))
    raise ValueError("method must be pearson, spearman or kendall")


def binned(df: DataFrame, n: int) -> DataFrame:
    """df with b: equal-width bins 1..n of the cell's range, closed on the right; one bin for a constant cell."""
    s = df.filter(F.col("value").isNotNull())
    s = s.join(s.groupBy("cell").agg(F.min("value").alias("__a"), F.max("value").alias("__z")), "cell")
    bin_ = F.greatest(F.lit(1), F.ceil((F.col("value") - F.col("__a")) / F.nullif(F.col("__z") - F.col("__a"), F.lit(0.0)) * n))
    return s.withColumn("b", F.coalesce(bin_, F.lit(1)).cast("long")).drop("__a", "__z")


def mutual_information(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """(src, dst, w): mutual information in bits of binned readings."""
    joint = pairs(binned(df, n_bins), "b").groupBy("src", "dst", "x_b", "y_b").agg(F.count("*").alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy("src", "dst", *by))
    share = joint.withColumn("whole", total()).withColumn("nx", total("x_b")).withColumn("ny", total("y_b"))
    return share.groupBy("src", "dst").agg(F.sum(F.col("n") / F.col("whole") * F.log2(F.col("n") * F.col("whole") / (F.col("nx") * F.col("ny")))).alias("w"))


def gaussian_information(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, w): -ln(1 - r^2) / 2 of the Pearson correlation, in nats; null where |r| is 1."""
    r = correlation(df, extra=extra)
    return r.withColumn("w", -0.5 * F.ln(F.nullif(1 - F.col("w") * F.col("w"), F.lit(0.0))))


def lagged_correlation(df: DataFrame, max_lag: int = 5) -> DataFrame:
    """(src, dst, lag, r): correlation of src with dst lag frames later, lags 1 .. max_lag."""
    return products(df, lags=max_lag).filter(F.col("lag") > 0).select("src", "dst", "lag", _pearson().alias("r"))


def lagged_links(df: DataFrame, max_lag: int = 5, alpha: float = 0.05) -> DataFrame:
    """(src, dst, w, p): the largest absolute lagged correlation, p = 1 - w, w 0 where p is not below alpha. Cells of fewer than 4 max_lag frames use fewer lags."""
    n = df.agg(F.countDistinct("t").alias("__n"))
    r = lagged_correlation(df, max_lag).join(F.broadcast(n)).filter(F.col("lag") <= F.greatest(F.lit(1), F.floor(F.col("__n") / 4)))
    s = r.groupBy("src", "dst").agg(F.max(F.abs("r")).alias("s"))
    return s.select("src", "dst", F.when(1 - F.col("s") < alpha, F.col("s")).otherwise(F.lit(0.0)).alias("w"), (1 - F.col("s")).alias("p"))


def cross_correlation_peak(df: DataFrame, max_lag: int = 20) -> DataFrame:
    """(src, dst, w): the largest absolute cross-correlation over lags -max_lag .. max_lag, sums divided by src's whole length; null for a constant cell."""
    held = df.filter(F.col("value").isNotNull())
    cells = held.groupBy("cell").agg((F.avg("value") - F.min("value")).alias("m"), F.stddev_pop("value").alias("s"), F.count("value").alias("n"))
    p = products(held, lags=max_lag)
    for side in ("src", "dst"):
        p = p.join(cells.select(F.col("cell").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in "msn"]), side)
    total = F.col("sxy") - F.col("m_dst") * F.col("sx") - F.col("m_src") * F.col("sy") + F.col("n") * F.col("m_src") * F.col("m_dst")
    low = F.col("src") < F.col("dst")
    r = F.try_divide(total, F.nullif(F.col("s_src") * F.col("s_dst"), F.lit(0.0))) / F.when(low, F.col("n_src")).otherwise(F.col("n_dst"))
    return p.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.abs(r).alias("r")).groupBy("src", "dst").agg(F.max("r").alias("w"))


def transfer_entropy(df: DataFrame, n_bins: int = 5, max_lag: int = 3) -> DataFrame:
    """(src, dst, w): bits by which src's binned past narrows dst's next bin beyond dst's own past; 0 with fewer than 10 complete frames."""
    by = Window.partitionBy("cell").orderBy("t")
    lags = [F.lag("b", k).over(by) for k in range(max_lag, 0, -1)]
    past = reduce(lambda a, b: a * (n_bins + 1) + b, lags)
    s = binned(df, n_bins).withColumn("past", past)
    p = pairs(s, "b", "past", ordered=True).filter(F.col("x_past").isNotNull() & F.col("y_past").isNotNull())
    c = p.groupBy("src", "dst", "y_b", "y_past", "x_past").agg(F.count("*").alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy("src", "dst", *by))
    c = c.withColumn("whole", total()).withColumn("yp", total("y_past")).withColumn("yy", total("y_b", "y_past")).withColumn("xp", total("y_past", "x_past"))
    # H(future | own past) - H(future | both pasts)
    gain = F.col("n") / F.col("whole") * (F.log2(F.col("n") / F.col("xp")) - F.log2(F.col("yy") / F.col("yp")))
    return c.groupBy("src", "dst").agg(F.when(F.max("whole") < 10, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.sum(gain))).alias("w"))


def granger(df: DataFrame, max_lag: int = 5) -> DataFrame:
    """(src, dst, f): F statistic of dst on its own lags with and without src's lags; 0 where too short or fitted without rest."""

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("t")
        x, y = p["x_value"].to_numpy(float), p["y_value"].to_numpy(float)
        n = len(y)
        lag = min(max_lag, max(1, n - 1))
        f = 0.0
        if n - lag >= max(1, lag + 1):
            own, other = (np.column_stack([v[i : n - lag + i] for i in range(lag)]) for v in (y, x))
            target, one = y[lag:], np.ones((n - lag, 1))
            rest = []
            for design in (np.hstack([one, own]), np.hstack([one, own, other])):
                beta = np.linalg.lstsq(design, target, rcond=None)[0]
                rest.append(float(((target - design @ beta) ** 2).sum()))
            free = n - lag - 2 * lag - 1
            if rest[0] > 0 and free > 0 and rest[1] > 0:
                f = (rest[0] - rest[1]) / lag / (rest[1] / free)
        return pd.DataFrame({"src": p["src"].iloc[:1], "dst": p["dst"].iloc[:1], "f": [f]})

    kind = df.schema["cell"].dataType.simpleString()
    return spread(pairs(df.filter(F.col("value").isNotNull()), "value", ordered=True), "src", "dst").groupBy("src", "dst").applyInPandas(fit, f"src {kind}, dst {kind}, f double")


def nodes_of(df: DataFrame) -> DataFrame:
    return df.select(F.col("cell").alias("node")).distinct()


def entries(edges: DataFrame, nodes: DataFrame, directed: bool = False) -> DataFrame:
    """(a): absolute entries of the whole square matrix, both triangles (given both for directed edges) and the zero diagonal."""
    one = F.abs(F.coalesce("w", F.lit(0.0))).alias("a")
    twice = edges.select(one) if directed else edges.select(one, F.explode(F.array(F.lit(1), F.lit(2))).alias("__")).select("a")
    return twice.unionByName(nodes.select(F.lit(0.0).alias("a")))


def threshold(edges: DataFrame, nodes: DataFrame, method: str = "percentile", value: float = 0.95, directed: bool = False) -> DataFrame:
    """Edges whose |w| is not below a limit and not 0: the value itself (absolute), that quantile of all matrix entries (percentile), or the entry at rank round(value * n^2) (density)."""
    edges = edges.filter(F.col("w").isNotNull())
    if method == "absolute":
        return edges.filter((F.abs("w") >= value) & (F.col("w") != 0))
    if method == "percentile":
        limit = exact_quantile(entries(edges, nodes, directed).withColumn("k", F.lit(1)), ["k"], "a", value, "limit").select("limit")
    elif method == "density":
        e = entries(edges, nodes, directed).groupBy("a").agg(F.count("*").alias("n"))
        size = nodes.agg((F.count("*") * F.count("*")).alias("size"))
        run = e.join(F.broadcast(size)).withColumn("k", F.lit(1)).withColumn("upto", F.sum("n").over(Window.partitionBy("k").orderBy(F.desc("a"))))
        limit = run.filter(F.col("upto") >= F.round(F.col("size") * value)).agg(F.max("a").alias("limit"))
    else:
        raise ValueError("method must be absolute, percentile or density")
    return edges.join(F.broadcast(limit)).filter((F.abs("w") >= F.col("limit")) & (F.col("w") != 0)).drop("limit")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(*[F.col(c).alias({"src": "dst", "dst": "src"}.get(c, c)) for c in edges.columns]))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree, strength, two_step): edges, sum of |w|, and degree * (degree - 1), the ordered pairs of neighbours that meet in the node."""
    d = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum(F.abs("w")).alias("strength"))
    d = nodes.join(d, "node", "left").na.fill({"degree": 0, "strength": 0.0})
    return d.withColumn("two_step", F.col("degree") * (F.col("degree") - 1))


def graph_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(nodes, edges, density, mean_degree, clustering): clustering is closed ordered triplets by ordered triplets."""
    d = degrees(edges, nodes)
    base = d.agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.avg("degree").alias("mean_degree"), F.sum("two_step").alias("__t"))
    base = base.join(F.broadcast(_triangles(edges).agg(F.count("*").alias("__c"))))
    n = F.col("nodes")
    return base.select("nodes", "edges", F.try_divide(2 * F.col("edges"), n * (n - 1)).alias("density"), "mean_degree", F.coalesce(F.try_divide(6 * F.col("__c"), F.col("__t")), F.lit(0.0)).alias("clustering"))


def _triangles(edges: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each triangle once, as (extra, a, b, c) with a < b < c."""
    e = edges.select(*extra, "src", "dst")
    ab, bc, ac = e.toDF(*extra, "a", "b"), e.toDF(*extra, "b", "c"), e.toDF(*extra, "a", "c")
    return ab.join(bc, [*extra, "b"]).join(ac, [*extra, "a", "c"])


def closeness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, closeness): one by the mean hop distance to all nodes within reach, itself at distance 0 included; null for a node without edges.

    Breadth-first from all nodes at once, one join per hop, until nothing new is reached. The table of reached pairs is cut to the shared checkpoint folder.
    """
    steps = both_ways(edges).select("src", "dst").distinct()
    reached = cut(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("d")))
    hop = 0
    while True:
        hop += 1
        last = reached.filter(F.col("d") == hop - 1).select("src", F.col("dst").alias("via"))
        new = last.join(steps.withColumnRenamed("src", "via"), "via").select("src", "dst").distinct().join(reached.select("src", "dst"), ["src", "dst"], "left_anti")
        new = cut(new.withColumn("d", F.lit(hop)))
        if not new.head(1):
            break
        reached = reached.unionByName(new) if hop % 16 else cut(reached.unionByName(new))  # the plan stays bounded
    return reached.groupBy(F.col("src").alias("node")).agg(F.try_divide(F.lit(1.0), F.nullif(F.avg("d"), F.lit(0.0))).alias("closeness"))


def label_propagation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, community): synchronous label propagation by summed |w|, starts and ties by the least label, until nothing changes.

    Where labels swing between two states (two sides of a bipartite part), each node takes the lesser of its two and rounds go on; labels only fall then, so this ends.
    """
    both = both_ways(edges).select("src", "dst", F.abs("w").alias("w"))
    labels = cut(nodes.select("node", F.col("node").alias("community"), F.lit(None).cast(nodes.schema["node"].dataType).alias("before")))
    swung = False
    while True:
        votes = both.join(labels.select(F.col("node").alias("src"), "community"), "src").groupBy(F.col("dst").alias("node"), "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("node").agg(F.min_by("community", F.struct(-F.col("w"), F.col("community"))).alias("new"))
        new = F.coalesce("new", "community")
        new = F.least(new, "community") if swung else new
        labels = cut(labels.join(best, "node", "left").select("node", new.alias("community"), F.col("community").alias("before"), F.col("before").alias("earlier")))
        changed, since = labels.agg(F.sum((F.col("community") != F.col("before")).cast("int")), F.sum((~F.col("community").eqNullSafe(F.col("earlier"))).cast("int"))).first()
        if not changed:
            return labels.select("node", "community")
        swung = swung or not since


def windows(df: DataFrame, size: int = 50, step: int = 10) -> DataFrame:
    """df with win and win_center: every frame once for each window it lies in; only whole windows of frames 1 .. the last one."""
    last = df.agg(F.max("t").alias("__last"))
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - size) / step))
    final = F.least(F.floor((F.col("t") - 1) / step), F.floor((F.col("__last") - size) / step))
    w = df.join(F.broadcast(last)).filter(final >= first).withColumn("win", F.explode(F.sequence(first.cast("long"), final.cast("long"))))
    return w.withColumn("win_center", F.col("win") * step + (1 + size) / 2).withColumn("win", F.col("win") + 1).drop("__last")


def windowed_correlation(df: DataFrame, size: int = 50, step: int = 10, method: str = "pearson", least: float = 0.3) -> DataFrame:
    """(win, src, dst, w): edges with |w| >= least in each window. mutual_info takes the Gaussian formula. The diagonal is left out."""
    w = windows(df, size, step).select("win", "cell", "t", "value")
    e = gaussian_information(w, ("win",)) if method == "mutual_info" else correlation(w, method, ("win",))
    return e.filter(F.abs("w") >= least)


def window_metrics(edges: DataFrame, wins: DataFrame, n_cells: int, diagonal: bool = True) -> DataFrame:
    """(win, density, clustering, efficiency) of each window; density counts the diagonal of ones where it is part of the matrix.

    efficiency: mean of one by the shortest path over 1 / (|w| + 1e-10), missing edges at 1e10; one small matrix per window is worked on at a time.
    """
    n = n_cells
    m = wins.join(edges.groupBy("win").agg(F.count("*").alias("m")), "win", "left").na.fill({"m": 0})
    d = both_ways(edges).groupBy("win", "src").agg(F.count("*").alias("k")).groupBy("win").agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("t"))
    c = _triangles(edges, ("win",)).groupBy("win").agg(F.count("*").alias("c"))

    def efficiency(p: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(p["src"]) | set(p["dst"]))
        at = {v: i for i, v in enumerate(names)}
        # cells without an edge are all alike: one stands for them
        size = min(n, len(names) + 1)
        dist = np.full((size, size), 1e10)
        for a, b, w in zip(p["src"], p["dst"], p["w"]):
            dist[at[a], at[b]] = dist[at[b], at[a]] = 1 / (abs(w) + 1e-10)
        np.fill_diagonal(dist, 0)
        for k in range(size):
            dist = np.minimum(dist, dist[:, k : k + 1] + dist[k : k + 1])
        inner = dist[: len(names), : len(names)]
        total = (1 / inner[~np.eye(len(names), dtype=bool)]).sum() + (n * (n - 1) - len(names) * (len(names) - 1)) * 1e-10
        return pd.DataFrame({"win": p["win"].iloc[:1], "efficiency": [total / (n * (n - 1))]})

    e = edges.groupBy("win").applyInPandas(efficiency, "win long, efficiency double")
    out = m.join(d, "win", "left").join(c, "win", "left").join(e, "win", "left")
    return out.select("win", ((2 * F.col("m") + (n if diagonal else 0)) / (n * (n - 1))).alias("density"), F.coalesce(F.try_divide(6 * F.col("c"), F.col("t")), F.lit(0.0)).alias("clustering"), F.coalesce("efficiency", F.lit(1e-10)).alias("efficiency"))


def window_stability(edges: DataFrame, wins: DataFrame, n_cells: int, method: str = "jaccard") -> DataFrame:
    """(win, stability) of every window and the next, over whole matrices with a diagonal of ones: jaccard or cosine of the edge sets, or the correlation of entries."""
    n = n_cells
    a = edges.select("win", "src", "dst", F.col("w").alias("x"))
    b = edges.select((F.col("win") - 1).alias("win"), "src", "dst", F.col("w").alias("y"))
    both = a.join(b, ["win", "src", "dst"], "full").na.fill(0.0, ["x", "y"])
    one = lambda c: F.sum(F.when(c, 2).otherwise(0))
    x, y = F.col("x"), F.col("y")
    s = both.groupBy("win").agg(one((x != 0) & (y != 0)).alias("i"), one((x != 0) | (y != 0)).alias("u"), one(x != 0).alias("a"), one(y != 0).alias("b"), *[(2 * F.sum(c)).alias(k) for k, c in (("sx", x), ("sy", y), ("sxy", x * y), ("sxx", x * x), ("syy", y * y))])
    last = wins.agg(F.max("win").alias("__last"))
    s = wins.join(F.broadcast(last)).filter(F.col("win") < F.col("__last")).drop("__last").join(s, "win", "left").na.fill(0)
    if method == "jaccard":
        return s.select("win", ((F.col("i") + n) / (F.col("u") + n)).alias("stability"))
    if method == "cosine":
        return s.select("win", ((F.col("i") + n) / F.sqrt((F.col("a") + n) * (F.col("b") + n))).alias("stability"))
    size = float(n * n)
    sx, sy, sxy, sxx, syy = (F.col(c) + n for c in ("sx", "sy", "sxy", "sxx", "syy"))
    return s.select("win", F.try_divide(sxy - sx * sy / size, F.nullif(F.sqrt((sxx - sx * sx / size) * (syy - sy * sy / size)), F.lit(0.0))).alias("stability"))


def modularity(edges: DataFrame, communities: DataFrame, extra: tuple[str, ...] = (), diagonal: float = 0.0) -> DataFrame:
    """(extra, modularity): sum over ordered pairs of one community of |w| - s_i s_j / 2m, by 2m. diagonal: the matrix's diagonal entry, part of strengths and m but not of the sum."""
    both = both_ways(edges.select(*extra, "src", "dst", "w"))
    every = edges.select(*extra).distinct().crossJoin(communities) if extra else communities
    s = every.join(both.groupBy(*extra, F.col("src").alias("node")).agg(F.sum(F.abs("w")).alias("s")), [*extra, "node"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)) + diagonal)
    # within a community the sum of s_i s_j over i != j is the square of the sum less the sum of squares
    group = s.groupBy(*extra, "community").agg(F.sum("s").alias("a"), F.sum(F.col("s") * F.col("s")).alias("q"))
    sums = group.groupBy(*extra).agg(F.sum("a").alias("m2"), F.sum(F.col("a") * F.col("a") - F.col("q")).alias("e"))
    c1, c2 = (communities.select(F.col("node").alias(x), F.col("community").alias(f"c_{x}")) for x in ("src", "dst"))
    inside = both.join(c1, "src").join(c2, "dst").filter(F.col("c_src") == F.col("c_dst")).groupBy(*extra).agg(F.sum(F.abs("w")).alias("w"))
    joined = sums.join(inside, list(extra), "left") if extra else sums.join(F.broadcast(inside))
    m2 = F.col("m2")
    return joined.select(*extra, F.coalesce(F.try_divide(F.coalesce("w", F.lit(0.0)) - F.try_divide(F.col("e"), m2), m2), F.lit(0.0)).alias("modularity"))
