"""Image operators on pixel tables (frame, r, c, value): one row per pixel, rows and columns from 0, every frame a full rectangle.

Neighbourhoods are offset joins without a theta condition: each pixel is sent to the pixels it lies near, and these aggregate what they get.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmerframe.functions.quantiles import exact_quantile
from glimmerframe.session import cut

KEYS = ["frame", "r", "c"]


def around(px: DataFrame, window: int, *aggregates: Column) -> DataFrame:
    """px with aggregates over the window x window neighbourhood; the aggregates see v, dr and dc (offsets of the neighbour). Pixels outside add nothing."""
    h = window // 2
    span = F.sequence(F.lit(-h), F.lit(h))
    sent = px.select("frame", "r", "c", F.col("value").cast("double").alias("v"), F.explode(span).alias("dr")).withColumn("dc", F.explode(span))
    sent = sent.select("frame", (F.col("r") - F.col("dr")).alias("r"), (F.col("c") - F.col("dc")).alias("c"), "v", "dr", "dc")
    return px.join(sent.groupBy(*KEYS).agg(*aggregates), KEYS)


def mean_image(px: DataFrame) -> DataFrame:
    """One frame (0): the mean over frames."""
    return px.groupBy("r", "c").agg(F.avg("value").alias("value")).select(F.lit(0).cast("long").alias("frame"), "r", "c", "value")


def contrast_stretch(px: DataFrame) -> DataFrame:
    """(x - min) / (max - min) of the frame; a constant frame stays."""
    s = px.groupBy("frame").agg(F.min("value").alias("__a"), F.max("value").alias("__z"))
    return px.join(s, "frame").withColumn("value", F.coalesce(F.try_divide(F.col("value") - F.col("__a"), F.nullif(F.col("__z") - F.col("__a"), F.lit(0.0))), "value")).drop("__a", "__z")


def convolve(px: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """Correlation with a square kernel of odd size, zero outside the frame."""
    k, h = len(kernel), len(kernel) // 2
    weights = F.array(*[F.lit(float(x)) for row in kernel for x in row])
    w = F.get(weights, ((F.col("dr") + h) * k + F.col("dc") + h).cast("int"))
    return around(px, k, F.sum(F.col("v") * w).alias("__s")).withColumn("value", F.col("__s")).drop("__s")


def gaussian(px: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Separable Gaussian of 2 ceil(3 sigma) + 1 taps, normalised; pixels whose window leaves the frame become 0 along that direction."""
    import math

    h = math.ceil(3 * sigma)
    taps = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-h, h + 1)]
    taps = [t / sum(taps) for t in taps]
    weights = F.array(*[F.lit(t) for t in taps])
    for along in ("r", "c"):
        other = "c" if along == "r" else "r"
        sent = px.select("frame", other, F.col("value").alias("v"), along, F.explode(F.sequence(F.lit(-h), F.lit(h))).alias("d"))
        sent = sent.select("frame", other, (F.col(along) - F.col("d")).alias(along), F.col("v"), F.get(weights, F.col("d") + h).alias("w"))
        s = sent.groupBy(*KEYS).agg(F.sum(F.col("v") * F.col("w")).alias("__s"), F.count("*").alias("__n"))
        px = px.join(s, KEYS).withColumn("value", F.when(F.col("__n") == 2 * h + 1, F.col("__s")).otherwise(F.lit(0.0))).drop("__s", "__n")
    return px


def median_filter(px: DataFrame, window: int = 3) -> DataFrame:
    """Median of the zero-padded window."""
    padded = F.concat(F.collect_list("v"), F.array_repeat(F.lit(0.0), F.lit(window * window) - F.count("v").cast("int")))
    return around(px, window, F.get(F.array_sort(padded), F.lit(window * window // 2)).alias("__m")).withColumn("value", F.col("__m")).drop("__m")


def window_sums(px: DataFrame, window: int, **values: Column) -> DataFrame:
    """px with sums of the named values over the window x window neighbourhood, and __n, the pixels in it: first along rows, then along columns, 2 * window rows a pixel instead of window ** 2."""
    h = window // 2
    sums = px.select(*KEYS, *[v.alias(n) for n, v in values.items()], F.lit(1).alias("__n"))
    for along, other in (("r", "c"), ("c", "r")):
        sent = sums.withColumn(along, F.explode(F.sequence(F.col(along) - h, F.col(along) + h)))
        sums = sent.groupBy("frame", other, along).agg(*[F.sum(n).alias(n) for n in (*values, "__n")])
    return px.join(sums, KEYS)


def local_threshold(px: DataFrame, window: int = 15, offset: float = 0.05) -> DataFrame:
    """1 where a pixel exceeds the zero-padded window's mean less offset, else 0."""
    a = window_sums(px, window, __s=F.col("value"))
    return a.withColumn("value", (F.col("value") > F.col("__s") / (window * window) - offset).cast("double")).drop("__s", "__n")


def adaptive_threshold(px: DataFrame, window: int = 15, factor: float = 0.1) -> DataFrame:
    """1 where a pixel exceeds the mean less factor sds of its window cut at the frame, else 0. Values are taken relative to the frame's mean, so that squares lose no digits."""
    x = px.join(px.groupBy("frame").agg(F.avg("value").alias("__m")), "frame").withColumn("__d", F.col("value") - F.col("__m"))
    a = window_sums(x, window, __s=F.col("__d"), __q=F.col("__d") * F.col("__d"))
    mean = F.col("__s") / F.col("__n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("__q") - mean * F.col("__s"), F.nullif(F.col("__n") - 1, F.lit(0)))))
    return a.withColumn("value", F.coalesce((F.col("__d") > mean - factor * sd).cast("double"), F.lit(0.0))).drop("__m", "__d", "__s", "__q", "__n")


def quantile_threshold(px: DataFrame, q: float = 0.8) -> DataFrame:
    """1 where a pixel exceeds the q-quantile of its frame, else 0."""
    return px.join(exact_quantile(px, ["frame"], "value", q, "__q"), "frame").withColumn("value", (F.col("value") > F.col("__q")).cast("double")).drop("__q")


def erode(px: DataFrame, window: int = 3) -> DataFrame:
    """1 where the whole zero-padded window is 1."""
    return window_sums(px, window, __s=F.col("value")).withColumn("value", (F.col("__s") == window * window).cast("double")).drop("__s", "__n")


def dilate(px: DataFrame, window: int = 3) -> DataFrame:
    """1 where any pixel of the window is above 0."""
    return window_sums(px, window, __s=(F.col("value") > 0).cast("int")).withColumn("value", (F.col("__s") > 0).cast("double")).drop("__s", "__n")


def opening(px: DataFrame, window: int = 3) -> DataFrame:
    return dilate(erode(px, window), window)


def closing(px: DataFrame, window: int = 3) -> DataFrame:
    return erode(dilate(px, window), window)


SOBEL = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]


def sobel(px: DataFrame) -> DataFrame:
    """Gradient magnitude by 3 x 3 Sobel kernels, zero outside the frame."""
    pick = lambda k: F.get(F.array(*[F.lit(float(x)) for row in k for x in row]), ((F.col("dr") + 1) * 3 + F.col("dc") + 1).cast("int"))
    across, down = pick(SOBEL), pick([list(x) for x in zip(*SOBEL)])
    a = around(px, 3, F.sum(F.col("v") * across).alias("__x"), F.sum(F.col("v") * down).alias("__y"))
    return a.withColumn("value", F.sqrt(F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y"))).drop("__x", "__y")


def components(px: DataFrame) -> DataFrame:
    """(frame, r, c, label): 4-connected regions of pixels above 0, labelled by their least r * 1000000 + c.

    Each round every region takes the least label that touches any of its pixels, as a whole, until nothing changes.
    """
    on = px.filter(F.col("value") > 0).select(*KEYS)
    code = F.col("r") * 1_000_000 + F.col("c")
    labels = cut(on.withColumn("label", code.cast("long")))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0), (0, 0))])
    while True:
        sent = labels.select("frame", "r", "c", "label", F.explode(steps).alias("s")).select("frame", (F.col("r") + F.col("s.a")).alias("r"), (F.col("c") + F.col("s.b")).alias("c"), "label")
        best = sent.groupBy(*KEYS).agg(F.min("label").alias("low"))
        near = labels.join(best, KEYS)
        lowest = near.groupBy("frame", "label").agg(F.min("low").alias("new"))
        for _ in range(2):  # labels that will change themselves are followed four steps
            onward = lowest.select("frame", F.col("label").alias("new"), F.col("new").alias("far"))
            lowest = lowest.join(onward, ["frame", "new"]).select("frame", "label", F.col("far").alias("new"))
        new = cut(labels.join(lowest, ["frame", "label"]))
        labels = new.select(*KEYS, F.col("new").alias("label"))
        if not new.filter(F.col("new") < F.col("label")).head(1):
            return labels


def remove_small(labels: DataFrame, least: int) -> DataFrame:
    """Regions of at least that many pixels."""
    return labels.join(labels.groupBy("frame", "label").count().filter(F.col("count") >= least).drop("count"), ["frame", "label"], "left_semi")


def region_properties(labels: DataFrame, px: DataFrame) -> DataFrame:
    """(frame, label, area, centroid_r, centroid_c, eccentricity, intensity): eccentricity sqrt(1 - l2 / l1) of the coordinates' covariance, 0 for less than two pixels or no spread."""
    g = labels.join(px, KEYS).groupBy("frame", "label").agg(F.count("*").alias("area"), F.avg("r").alias("centroid_r"), F.avg("c").alias("centroid_c"), F.avg("value").alias("intensity"), F.coalesce(F.var_samp("r"), F.lit(0.0)).alias("a"), F.coalesce(F.var_samp("c"), F.lit(0.0)).alias("b"), F.coalesce(F.covar_samp(F.col("r").cast("double"), F.col("c").cast("double")), F.lit(0.0)).alias("x"))
    root = F.sqrt((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) + 4 * F.col("x") * F.col("x"))
    ratio = F.try_divide(F.col("a") + F.col("b") - root, F.col("a") + F.col("b") + root)
    return g.select("frame", "label", "area", "centroid_r", "centroid_c", F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 1 - ratio)), F.lit(0.0)).alias("eccentricity"), "intensity")


def best_overlap(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """(frame, label, jaccard): of every true region the highest Jaccard overlap with a found one; 0 without any."""
    size = lambda d, n: d.groupBy("frame", F.col("label").alias(n)).agg(F.count("*").alias(f"n_{n}"))
    both = truth.withColumnRenamed("label", "t").join(labels.withColumnRenamed("label", "f"), KEYS).groupBy("frame", "t", "f").agg(F.count("*").alias("n"))
    j = both.join(size(truth, "t"), ["frame", "t"]).join(size(labels, "f"), ["frame", "f"]).withColumn("j", F.col("n") / (F.col("n_t") + F.col("n_f") - F.col("n")))
    best = j.groupBy("frame", "t").agg(F.max("j").alias("j"))
    return size(truth, "t").join(best, ["frame", "t"], "left").select("frame", F.col("t").alias("label"), F.coalesce("j", F.lit(0.0)).alias("jaccard"))


def segment(px: DataFrame, method: str = "threshold", least: int = 1) -> DataFrame:
    """(frame, r, c, label) of regions by threshold (70th percentile), local (stretch, smooth, local threshold, open, close) or edges (stretch, median, Sobel, 95th percentile, close)."""
    if method == "threshold":
        mask = quantile_threshold(px, 0.7)
    elif method == "local":
        mask = closing(opening(local_threshold(gaussian(contrast_stretch(px)))))
    elif method == "edges":
        mask = closing(quantile_threshold(sobel(median_filter(contrast_stretch(px), 5)), 0.95))
    else:
        raise ValueError("method must be threshold, local or edges")
    return remove_small(components(mask), least)


def kmeans_regions(px: DataFrame, diameter: float, seed: int = 1) -> DataFrame:
    """(frame, r, c, label): k-means over (value, r, c) of all pixels, max(2, round(pixels of a frame / (pi (diameter / 2)^2))) clusters."""
    from math import pi

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    size = px.groupBy("frame").count().agg(F.max("count")).first()[0] or 0
    v = px.select(*KEYS, array_to_vector(F.array("value", F.col("r").cast("double"), F.col("c").cast("double"))).alias("features"))
    if not size:
        return px.select(*KEYS, F.lit(0).alias("label")).limit(0)
    k = max(2, round(size / (pi * (diameter / 2) ** 2)))
    return KMeans(k=k, seed=seed).fit(v).transform(v).select(*KEYS, F.col("prediction").alias("label"))


def fill_holes(px: DataFrame) -> DataFrame:
    """A mask with every 4-connected hole filled: background that does not reach the frame's edge becomes 1."""
    ends = px.groupBy("frame").agg(F.min("r").alias("__a"), F.max("r").alias("__z"), F.min("c").alias("__l"), F.max("c").alias("__r"))
    back = components(px.withColumn("value", (F.col("value") <= 0).cast("double")))
    edge = (F.col("r") == F.col("__a")) | (F.col("r") == F.col("__z")) | (F.col("c") == F.col("__l")) | (F.col("c") == F.col("__r"))
    holes = back.join(back.join(ends, "frame").filter(edge).select("frame", "label").distinct(), ["frame", "label"], "left_anti").select(*KEYS, F.lit(1.0).alias("__h"))
    return px.join(holes, KEYS, "left").withColumn("value", F.coalesce("__h", (F.col("value") > 0).cast("double"))).drop("__h")


def borders(labels: DataFrame) -> DataFrame:
    """(frame, label, r, c): the pixels of a region with a side neighbour outside it: its contour."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    near = labels.select("frame", "label", "r", "c", F.explode(steps).alias("s")).select("frame", "label", (F.col("r") + F.col("s.a")).alias("r"), (F.col("c") + F.col("s.b")).alias("c"))
    inside = near.groupBy("frame", "label", "r", "c").count().filter(F.col("count") == 4).drop("count")
    return labels.select("frame", "label", "r", "c").join(inside, ["frame", "label", "r", "c"], "left_anti")


def distance_transform(px: DataFrame) -> DataFrame:
    """(frame, r, c, value): city-block distance to the nearest pixel that is not above 0, along rows and then along columns; null in a frame without one."""
    for along, other in (("c", "r"), ("r", "c")):
        start = F.when(F.col("value") <= 0, F.lit(0)) if along == "c" else F.col("__d")
        by = Window.partitionBy("frame", other)
        before = F.min(F.col("__s") - F.col(along)).over(by.orderBy(along)) + F.col(along)
        after = F.min(F.col("__s") + F.col(along)).over(by.orderBy(F.desc(along))) - F.col(along)
        px = px.withColumn("__s", start).withColumn("__d", F.least(before, after))
    return px.select(*KEYS, F.col("__d").cast("double").alias("value"))


def local_maxima(px: DataFrame, window: int = 3) -> DataFrame:
    """(frame, r, c, value): pixels above 0 that no pixel of their window exceeds."""
    return around(px, window, F.max("v").alias("__m")).filter((F.col("value") > 0) & (F.col("value") >= F.col("__m"))).select(*KEYS, "value")


def roi_quality(labels: DataFrame, px: DataFrame, least: int = 4) -> DataFrame:
    """(frame, label, size, shape, intensity, overall): size: area / (area + least); shape: 1 - eccentricity; intensity: the share of the frame's pixels that the region's mean exceeds; overall: their mean."""
    p = region_properties(labels, px)
    rank = px.select("frame", F.col("value").alias("v")).join(p.select("frame", "label", F.col("intensity").alias("m")), "frame").groupBy("frame", "label").agg(F.avg((F.col("v") < F.col("m")).cast("int")).alias("intensity"))
    s = p.select("frame", "label", (F.col("area") / (F.col("area") + least)).alias("size"), (1 - F.col("eccentricity")).alias("shape")).join(rank, ["frame", "label"])
    return s.withColumn("overall", (F.col("size") + F.col("shape") + F.col("intensity")) / 3)


def roi_table(labels: DataFrame, px: DataFrame) -> DataFrame:
    """(frame, roi_id, x, y, intensity): regions numbered in each frame by label, x across and y down, as editors of regions read them (write it with sources.files.export)."""
    number = F.row_number().over(Window.partitionBy("frame").orderBy("label"))
    return region_properties(labels, px).select("frame", number.cast("long").alias("roi_id"), F.col("centroid_c").alias("x"), F.col("centroid_r").alias("y"), "intensity")
