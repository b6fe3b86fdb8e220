"""Reference queries of the network operators, over monthly order sums per nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmerframe.operators import network as N
from glimmerframe.plans.registry import register
from glimmerframe.plans.views import MONTHS_SQL, months, r6

W = f"WITH RECURSIVE {MONTHS_SQL}"
PAIRS = "p AS (SELECT a.cell AS src, b.cell AS dst, a.t, a.value AS x, b.value AS y FROM months a JOIN months b ON a.t = b.t AND a.cell < b.cell)"
CORR = f"{PAIRS}, e AS (SELECT src, dst, corr(x, y) AS w FROM p GROUP BY ALL)"
EDGES = "SELECT src, dst, round(w, 6) + 0.0 AS w FROM e"
NODES = "nodes AS (SELECT DISTINCT cell AS node FROM months)"


def shown(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", r6("w").alias("w"))


@register("corr_pearson", f"{W}, {CORR} {EDGES}")
def corr_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.correlation(months(spark, sf_dir)))


@register("corr_spearman", f"{W}, r AS (SELECT cell, t, rank() OVER (PARTITION BY cell ORDER BY value) + (count(*) OVER (PARTITION BY cell, value) - 1) / 2 AS r FROM months), e AS (SELECT a.cell AS src, b.cell AS dst, corr(a.r, b.r) AS w FROM r a JOIN r b ON a.t = b.t AND a.cell < b.cell GROUP BY ALL) {EDGES}")
def corr_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.correlation(months(spark, sf_dir), "spearman"))


@register("corr_kendall", f"{W}, {PAIRS}, e AS (SELECT a.src, a.dst, sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))) AS w FROM p a JOIN p b ON a.src = b.src AND a.dst = b.dst AND a.t < b.t GROUP BY ALL) {EDGES}")
def corr_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.correlation(months(spark, sf_dir), "kendall"))


def bins(n: int) -> str:
    return f"b AS (SELECT cell, t, greatest(1, ceil((value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p) * {n}))::BIGINT AS b FROM months WINDOW p AS (PARTITION BY cell))"


@register("mutual_info_bits", f"{W}, {bins(10)}, j AS (SELECT a.cell AS src, c.cell AS dst, a.b AS x, c.b AS y, count(*) AS n FROM b a JOIN b c ON a.t = c.t AND a.cell < c.cell GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY src, dst) AS nn, sum(n) OVER (PARTITION BY src, dst, x) AS nx, sum(n) OVER (PARTITION BY src, dst, y) AS ny FROM j), e AS (SELECT src, dst, sum(n / nn * log2(n * nn / (nx * ny))) AS w FROM s GROUP BY ALL) {EDGES}")
def mutual_info_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.mutual_information(months(spark, sf_dir)))


@register("mutual_info_gauss", f"{W}, {CORR} SELECT src, dst, round(-0.5 * ln(1 - w * w), 6) + 0.0 AS w FROM e")
def mutual_info_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.gaussian_information(months(spark, sf_dir)))


LAGGED = "l AS (SELECT a.cell AS src, b.cell AS dst, k.k AS lag, corr(a.value, b.value) AS r FROM months a CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) k JOIN months b ON b.t = a.t + k.k AND a.cell <> b.cell GROUP BY ALL)"


@register("lagged_corr", f"{W}, {LAGGED} SELECT src, dst, lag::BIGINT AS lag, round(r, 6) + 0.0 AS r FROM l")
def lagged_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.lagged_correlation(months(spark, sf_dir)).select("src", "dst", F.col("lag").cast("long").alias("lag"), r6("r").alias("r"))


@register("lagged_links", f"{W}, {LAGGED}, s AS (SELECT src, dst, max(abs(r)) AS s FROM l GROUP BY ALL) SELECT src, dst, round(CASE WHEN 1 - s < 0.6 THEN s ELSE 0 END, 6) AS w, round(1 - s, 6) AS p FROM s")
def lagged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.lagged_links(months(spark, sf_dir), alpha=0.6).select("src", "dst", r6("w").alias("w"), r6("p").alias("p"))


@register("ccf_max", f"{W}, d AS (SELECT cell, t, (value - avg(value) OVER p) / stddev_pop(value) OVER p AS d, count(*) OVER p AS n FROM months WINDOW p AS (PARTITION BY cell)), c AS (SELECT a.cell AS src, b.cell AS dst, b.t - a.t AS lag, sum(a.d * b.d) / max(a.n) AS r FROM d a JOIN d b ON b.t - a.t BETWEEN -20 AND 20 AND a.cell < b.cell GROUP BY ALL), e AS (SELECT src, dst, max(abs(r)) AS w FROM c GROUP BY ALL) {EDGES}")
def ccf_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.cross_correlation_peak(months(spark, sf_dir)))


@register("transfer_entropy", f"{W}, {bins(5)}, l AS (SELECT cell, t, b, lag(b, 3) OVER p * 36 + lag(b, 2) OVER p * 6 + lag(b) OVER p AS past FROM b WINDOW p AS (PARTITION BY cell ORDER BY t)), c AS (SELECT x.cell AS src, y.cell AS dst, y.b AS f, y.past AS yp, x.past AS xp, count(*) AS n FROM l x JOIN l y ON x.t = y.t AND x.cell <> y.cell WHERE x.past IS NOT NULL AND y.past IS NOT NULL GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY src, dst) AS nn, sum(n) OVER (PARTITION BY src, dst, yp) AS a, sum(n) OVER (PARTITION BY src, dst, f, yp) AS b2, sum(n) OVER (PARTITION BY src, dst, yp, xp) AS c2 FROM c), e AS (SELECT src, dst, CASE WHEN max(nn) < 10 THEN 0 ELSE greatest(0, sum(n / nn * (log2(n / c2) - log2(b2 / a)))) END AS w FROM s GROUP BY ALL) {EDGES}")
def transfer_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.transfer_entropy(months(spark, sf_dir)))


def granger_sql(lags: int) -> str:
    """F of every ordered pair: regressors are made orthogonal to one another and to the target in turn, own lags first; what is left of the target are the rests."""
    names = [f"o{i}" for i in range(1, lags + 1)] + [f"x{i}" for i in range(1, lags + 1)]
    columns = ", ".join(f"lag(y, {i}) OVER p AS o{i}, lag(x, {i}) OVER p AS x{i}" for i in range(1, lags + 1))
    steps = [f"q AS (SELECT a.cell AS src, b.cell AS dst, a.t, a.value AS x, b.value AS y FROM months a JOIN months b ON a.t = b.t AND a.cell <> b.cell), l AS (SELECT src, dst, t, y, {columns} FROM q WINDOW p AS (PARTITION BY src, dst ORDER BY t))",
             f"s0 AS (SELECT src, dst, t, {', '.join(f'{c} - avg({c}) OVER p AS {c}' for c in [*names, 'y'])}, count(*) OVER p AS n FROM l WHERE o{lags} IS NOT NULL WINDOW p AS (PARTITION BY src, dst))"]
    for i, k in enumerate(names):
        rest = [*names[i + 1 :], "y"]
        kept = ", r0" if i >= lags else ""
        made = ", ".join(f"{c} - coalesce(sum({k} * {c}) OVER p / nullif(sum({k} * {k}) OVER p, 0), 0) * {k} AS {c}" for c in rest)
        mark = ", sum(y * y) OVER p AS r0" if i == lags else kept
        steps.append(f"s{i + 1} AS (SELECT src, dst, t, n, {made}{mark} FROM s{i} WINDOW p AS (PARTITION BY src, dst))")
    return f"{W}, {', '.join(steps)} SELECT src, dst, round((any_value(r0) - sum(y * y)) / {lags} / (sum(y * y) / (any_value(n) - {2 * lags + 1})), 4) + 0.0 AS f FROM s{2 * lags} GROUP BY src, dst"


@register("granger_f", granger_sql(5))
def granger_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.granger(months(spark, sf_dir)).withColumn("f", F.round("f", 4) + F.lit(0.0))


THR_ABS = "e2 AS (SELECT * FROM e WHERE abs(w) >= 0.2 AND w <> 0)"
ALL = "m AS (SELECT abs(w) AS a FROM e UNION ALL SELECT abs(w) FROM e UNION ALL SELECT 0 FROM nodes)"


def kept(spark: SparkSession, sf_dir: str, method: str = "absolute", value: float = 0.2) -> tuple[DataFrame, DataFrame]:
    m = months(spark, sf_dir)
    nodes = N.nodes_of(m)
    return N.threshold(N.correlation(m), nodes, method, value), nodes


@register("threshold_abs", f"{W}, {CORR}, {THR_ABS} SELECT src, dst, round(w, 6) AS w FROM e2")
def threshold_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(kept(spark, sf_dir)[0])


@register("threshold_percentile", f"{W}, {CORR}, {NODES}, {ALL} SELECT src, dst, round(w, 6) AS w FROM e WHERE abs(w) >= (SELECT quantile_cont(a, 0.9) FROM m) AND w <> 0")
def threshold_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(kept(spark, sf_dir, "percentile", 0.9)[0])


@register("threshold_density", f"{W}, {CORR}, {NODES}, {ALL}, k AS (SELECT a, row_number() OVER (ORDER BY a DESC) AS k, round(count(*) OVER () * 0.1) AS n FROM m) SELECT src, dst, round(w, 6) AS w FROM e WHERE abs(w) >= (SELECT a FROM k WHERE k = n) AND w <> 0")
def threshold_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(kept(spark, sf_dir, "density", 0.1)[0])


BOTH = "b AS (SELECT src, dst, abs(w) AS w FROM e2 UNION ALL SELECT dst, src, abs(w) FROM e2)"


@register("graph_degree", f"{W}, {CORR}, {NODES}, {THR_ABS}, {BOTH} SELECT node, count(src) AS degree, round(coalesce(sum(w), 0), 6) AS strength, count(src) * (count(src) - 1) AS two_step FROM nodes LEFT JOIN b ON src = node GROUP BY node")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.degrees(*kept(spark, sf_dir)).withColumn("strength", r6("strength"))


@register("graph_summary", f"{W}, {CORR}, {NODES}, {THR_ABS}, {BOTH}, t AS (SELECT count(*) AS t, count(c.src) AS c FROM b x JOIN b y ON x.dst = y.src AND x.src <> y.dst LEFT JOIN b c ON c.src = x.src AND c.dst = y.dst), n AS (SELECT count(*) AS n FROM nodes), m AS (SELECT count(*) AS m FROM e2) SELECT n AS nodes, m AS edges, round(2 * m / (n * (n - 1)), 6) AS density, round(2 * m / n, 6) AS mean_degree, round(c / nullif(t, 0), 6) AS clustering FROM t, n, m")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.graph_summary(*kept(spark, sf_dir)).withColumns({c: r6(c) for c in ("density", "mean_degree", "clustering")})


@register("graph_closeness", f"{W}, {CORR}, {NODES}, {THR_ABS}, {BOTH}, r(src, dst, d) AS (SELECT node, node, 0 FROM nodes UNION SELECT r.src, b.dst, d + 1 FROM r JOIN b ON b.src = r.dst WHERE d < 24), h AS (SELECT src, dst, min(d) AS d FROM r GROUP BY ALL) SELECT src AS node, round(1 / nullif(avg(d), 0), 6) AS closeness FROM h GROUP BY src")
def graph_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.closeness(*kept(spark, sf_dir)).withColumn("closeness", r6("closeness"))


def labels_sql(rounds: int) -> str:
    """That many rounds of label propagation, and as many in which labels only fall: more than the graph needs."""
    steps = ["l0 AS (SELECT node, node AS c FROM nodes)"]
    for i in range(2 * rounds):
        steps.append(f"l{i + 1} AS MATERIALIZED (SELECT node, {'coalesce(new, l.c)' if i < rounds else 'least(coalesce(new, l.c), l.c)'} AS c FROM l{i} l LEFT JOIN (SELECT dst AS node, arg_min(c, (-w, c)) AS new FROM (SELECT dst, c, sum(w) AS w FROM b JOIN l{i} ON src = node GROUP BY ALL) GROUP BY dst) USING (node))")
    return f"{W}, {CORR}, {NODES}, {THR_ABS}, {BOTH}, {', '.join(steps)} SELECT node, c AS community FROM l{2 * rounds}"


@register("label_communities", labels_sql(14))
def label_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.label_propagation(*kept(spark, sf_dir))


@register("modularity_given", f"{W}, {CORR}, {NODES}, {THR_ABS}, {BOTH}, s AS (SELECT node, coalesce(sum(w), 0) AS s FROM nodes LEFT JOIN b ON src = node GROUP BY node), m AS (SELECT sum(s) AS m2 FROM s) SELECT round(sum(coalesce(w, 0) - a.s * c.s / m2) / any_value(m2), 6) + 0.0 AS modularity FROM s a JOIN s c ON a.node <> c.node AND a.node % 5 = c.node % 5 LEFT JOIN b ON b.src = a.node AND b.dst = c.node, m")
def modularity_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, nodes = kept(spark, sf_dir)
    return N.modularity(e, nodes.withColumn("community", F.col("node") % 5)).select(r6("modularity").alias("modularity"))


WINS = f"""i AS (SELECT cell, t - min(t) OVER () + 1 AS t, value FROM months), g AS (SELECT unnest(generate_series(0, (max(t) - 30) // 10)) AS g FROM i),
w AS (SELECT g + 1 AS win, cell, t, value FROM i JOIN g ON t BETWEEN g * 10 + 1 AND g * 10 + 30), wins AS (SELECT DISTINCT win FROM w),
e AS (SELECT a.win, a.cell AS src, b.cell AS dst, corr(a.value, b.value) AS w FROM w a JOIN w b ON a.win = b.win AND a.t = b.t AND a.cell < b.cell GROUP BY ALL), e2 AS (SELECT * FROM e WHERE isfinite(w) AND abs(w) >= 0.3)"""
WBOTH = "b AS (SELECT win, src, dst, w FROM e2 UNION ALL SELECT win, dst, src, w FROM e2), n AS (SELECT count(DISTINCT cell) AS n FROM months)"


def windowed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = months(spark, sf_dir)
    m = m.join(F.broadcast(m.agg(F.min("t").alias("a")))).select("cell", (F.col("t") - F.col("a") + 1).alias("t"), "value")
    return N.windowed_correlation(m, 30, 10), N.windows(m, 30, 10).select("win").distinct()


@register("windowed_corr", f"{W}, {WINS} SELECT win, src, dst, round(w, 6) AS w FROM e2")
def windowed_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(spark, sf_dir)[0].withColumn("w", r6("w"))


@register("window_metrics", f"{W}, {WINS}, {WBOTH}, k AS (SELECT win, count(*) AS m FROM b GROUP BY win), t AS (SELECT x.win, count(c.src) / count(*) AS c FROM b x JOIN b y ON x.win = y.win AND x.dst = y.src AND x.src <> y.dst LEFT JOIN b c ON c.win = x.win AND c.src = x.src AND c.dst = y.dst GROUP BY x.win) SELECT win, round((coalesce(m, 0) + n) / (n * (n - 1)), 6) AS density, round(coalesce(c, 0), 6) AS clustering FROM wins LEFT JOIN k USING (win) LEFT JOIN t USING (win), n")
def window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, wins = windowed(spark, sf_dir)
    return N.window_metrics(e, wins, 25).select("win", r6("density").alias("density"), r6("clustering").alias("clustering"))


def efficiency_sql(doublings: int) -> str:
    """Shortest paths by repeated doubling of the number of hops; cells that no path reaches are 1e10 away."""
    steps = ["d0 AS (SELECT win, src, dst, 1 / (abs(w) + 1e-10) AS d FROM b UNION ALL SELECT DISTINCT win, src, src, 0 FROM b)"]
    for i in range(doublings):
        steps.append(f"d{i + 1} AS (SELECT x.win, x.src, y.dst, min(x.d + y.d) AS d FROM d{i} x JOIN d{i} y ON x.win = y.win AND x.dst = y.src GROUP BY ALL)")
    return f"{W}, {WINS}, {WBOTH}, {', '.join(steps)}, s AS (SELECT win, sum(1 / d) AS s, count(*) AS m FROM d{doublings} WHERE src <> dst GROUP BY win) SELECT win, round((coalesce(s, 0) + (n * (n - 1) - coalesce(m, 0)) * 1e-10) / (n * (n - 1)), 6) AS efficiency FROM wins LEFT JOIN s USING (win), n"


@register("window_efficiency", efficiency_sql(5))
def window_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, wins = windowed(spark, sf_dir)
    return N.window_metrics(e, wins, 25).select("win", r6("efficiency").alias("efficiency"))


STAB = f"{W}, {WINS}, {WBOTH}, full_ AS (SELECT win, a.node AS src, c.node AS dst, CASE WHEN a.node = c.node THEN 1 ELSE coalesce(b.w, 0) END AS x FROM wins CROSS JOIN (SELECT DISTINCT cell AS node FROM months) a CROSS JOIN (SELECT DISTINCT cell AS node FROM months) c LEFT JOIN b USING (win) WHERE b.src IS NULL OR (b.src = a.node AND b.dst = c.node))"
STAB = STAB.replace("LEFT JOIN b USING (win) WHERE b.src IS NULL OR (b.src = a.node AND b.dst = c.node)", "LEFT JOIN b ON b.win = wins.win AND b.src = a.node AND b.dst = c.node").replace("SELECT win, a.node", "SELECT wins.win, a.node")
NEXT = "FROM full_ a JOIN full_ c ON c.win = a.win + 1 AND c.src = a.src AND c.dst = a.dst GROUP BY a.win"
for _name, _sql in (("jaccard", "count(*) FILTER (a.x <> 0 AND c.x <> 0) / count(*) FILTER (a.x <> 0 OR c.x <> 0)"), ("cosine", "count(*) FILTER (a.x <> 0 AND c.x <> 0) / sqrt(count(*) FILTER (a.x <> 0) * count(*) FILTER (c.x <> 0))"), ("correlation", "corr(a.x, c.x)")):
    register(f"window_stability_{_name}", f"{STAB} SELECT a.win, round({_sql}, 6) AS stability {NEXT}")(lambda spark, sf_dir, m=_name: N.window_stability(*windowed(spark, sf_dir), 25, m).withColumn("stability", r6("stability")))
