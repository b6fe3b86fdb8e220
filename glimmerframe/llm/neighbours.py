"""The most similar vectors of every vector, by an inverted multi-index.

Vectors are brought to one shape (mean taken off, length one), so that the inner product of two is their Pearson correlation. The two halves of a vector
are quantised separately; a cell is a pair of centroids. A query walks the pairs in order of summed distance, by a heap, until the cells it has passed
hold enough vectors; these are compared exactly. How many are enough is measured: a sample of the queries is compared with every vector, and the walk goes
on until it passes the wanted share of their true neighbours. Queries and vectors meet in parts of the index, which hold neighbouring cells and are cut to a bounded size on both
sides; there only vectors of passed cells are multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmerframe.session import cut

SAMPLE, MOST_CENTROIDS, INDEX_ROWS, LEAST_PARTS, TOGETHER = 20_000, 1024, 100_000, 2, 64
MEASURED, RECALL, MARGIN = 512, 0.95, 2
SCALE = float(1 << 30)


def shapes(values: list[list[float | None] | None], size: int, fill: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have a shape, and these as unit vectors without mean."""
    keep, out = np.zeros(len(values), bool), []
    for i, v in enumerate(values):
        if v is None or len(v) != size:
            continue
        x = np.array(v, float)
        good = np.isfinite(x)
        if not good.all():
            if not fill or good.sum() < 2 or np.isinf(x).any():
                continue
            x = np.interp(np.arange(size), np.flatnonzero(good), x[good])
        if x.min() == x.max():
            continue
        with np.errstate(all="ignore"):
            x = x / np.abs(x).max()
            x = x - x.mean()
            length = np.linalg.norm(x)
        if length > 0 and np.isfinite(length):
            keep[i] = True
            out.append(x / length)
    return keep, np.array(out).reshape(-1, size)


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spread rows of a sample ordered by hash."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmin((c**2).sum(1) - 2 * x @ c.T, 1)
        sums, counts = np.zeros_like(c), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, x)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    # in order along their widest direction, so that near ones have near numbers
    _, _, axes = np.linalg.svd(c - c.mean(0), full_matrices=False)
    return c[np.argsort(c @ axes[0], kind="stable")]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c**2).sum(1) - 2 * x @ c.T


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells by summed distance, nearest first, until they hold enough vectors."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    f, s = first.tolist(), second.tolist()
    heap, seen, out, held = [(f[a[0]] + s[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heappop(heap)
        n = counts[a[i], b[j]]
        if n:
            out.append((a[i], b[j]))
            held += n
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heappush(heap, (f[a[p]] + s[b[q]], p, q))
    return out


def needed(first: np.ndarray, second: np.ndarray, counts: np.ndarray, u: int, v: int) -> int:
    """Vectors that a walk must hold so that it passes the cell (u, v)."""
    nearer = first[:, None] + second[None, :] <= first[u] + second[v]
    return int(counts[nearer].sum())


def best(similar: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row, greatest first, ties by column."""
    k = min(k, similar.shape[1])
    if similar.shape[1] > 4 * k:
        least = -np.partition(-similar, k - 1, 1)[:, k - 1 : k]
        similar = np.where(similar >= least, similar, -np.inf)
    return np.argsort(-similar, 1, kind="stable")[:, :k]


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """Elements of unit vectors as 32-bit whole numbers (steps of 2^-30): half the bytes of a double, inner products right to about 1e-9."""
    return np.round(x * SCALE).astype(np.int32)


def most_similar(
    df: DataFrame, id_col: str = "window_id", vec_col: str = "vec", k: int = 5, size: int = 64, fill: bool = False, visited: int | None = None, sample: int = SAMPLE, recall: float = RECALL,
    least: float = -1.0, margin: float = 1.0,
) -> DataFrame:
    """(id_col, rank, neighbour, similarity): of every vector with a shape the k with the highest Pearson correlation; equal ones by id.

    Without fill only complete vectors of `size` finite, not all equal elements take part; with it gaps (null, not-a-number) are filled linearly from the
    readings around them. Codebooks are fitted on at most `sample` vectors (the first by hash of the id); every vector is indexed and every one is a
    query. visited: vectors in the cells that a query's walk passes; by default as many as a sample of MEASURED queries needs to pass the share `recall` of its true
    neighbours of at least the similarity `least`, at every size. Vectors of one shape (equal to six decimals) are searched once and
    share the result, so that any number of copies costs no pairs: a class of copies is represented by its k + 1 least ids, the
    only ones that can be among anyone's k. Rows of null id are left out; of rows with one id that of the least hash of its shape counts. An empty table gives an empty
    result; other columns are ignored.

    Each vector is shuffled once to meet its copies, then as a query once to every part of the index that holds a cell of its walk; a part of the index, of bounded size, once for
    every part whose queries come to it.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = shapes(batch.column(1).to_pylist(), size, fill)
            flat = pa.array(whole_numbers(x).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * size), flat)], ["id", "x"])

    given = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    units = given.mapInArrow(unit, f"id {kind}, x array<int>")
    rounded = F.transform("x", lambda v: F.round(v / SCALE, 6) + F.lit(0.0))
    units = units.select("id", "x", F.xxhash64(rounded).alias("a"), F.hash(rounded).alias("b"))
    units = cut(units.repartition("a", "b").sortWithinPartitions("a", "b", "id"))
    own = units.groupBy("id").agg(F.min(F.struct("a", "b")).alias("__c")).select("id", "__c.a", "__c.b")
    firsts = own.withColumn("place", F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))).filter(F.col("place") <= k + 1)
    members = firsts.groupBy("a", "b").agg(F.sort_array(F.collect_list("id")).alias("members"))
    vectors = units.groupBy("a", "b").agg(F.min_by("x", "id").alias("x"))
    classes = cut(vectors.join(members, ["a", "b"]).withColumn("id", F.get("members", F.lit(0))))

    total = classes.count()
    if total == 0:
        return units.select(F.col("id").alias(id_col), F.lit(1).alias("rank"), F.col("id").alias("neighbour"), F.lit(1.0).alias("similarity")).limit(0)
    width = min(MOST_CENTROIDS, 1 << max(0, round(math.log2(max(1, math.sqrt(total) / 4)))))
    half = size // 2
    fit = np.array([r.x for r in classes.select("x").orderBy(F.xxhash64("id"), "id").limit(max(width, sample)).collect()]) / SCALE
    books = spark.sparkContext.broadcast((centroids(fit[:, :half], min(width, len(fit))), centroids(fit[:, half:], min(width, len(fit)))))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(-1, size) / SCALE
            u, v = (np.argmin(distances(h, c), 1).astype(np.int32) for h, c in zip((x[:, :half], x[:, half:]), books.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(u), pa.array(v)], ["id", "x", "u", "v"])

    index = cut(classes.select("id", "x").mapInArrow(locate, f"id {kind}, x array<int>, u int, v int"))
    counts = np.zeros((width, width), np.int64)
    for r in index.groupBy("u", "v").agg(F.count("*").alias("n")).groupBy("u").agg(F.collect_list("v").alias("v"), F.collect_list("n").alias("n")).collect():  # a row a centroid
        counts[r.u, r.v] = r.n
    enough = visited if visited is not None else int(margin * _measured(index, books.value, counts, k, size, recall, least))
    parts = max(min(LEAST_PARTS, total), -(-total // INDEX_ROWS))
    begins = np.cumsum(counts).reshape(width, width) - counts
    held = spark.sparkContext.broadcast((counts, begins * parts // total, (begins + np.maximum(counts, 1) - 1) * parts // total))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, low, high = held.value
        for batch in batches:
            rows, reach, to = [], [], []
            for lo in range(0, batch.num_rows, 1000):
                x = np.array(batch.column(1).slice(lo, 1000).flatten()).reshape(-1, size) / SCALE
                first, second = (distances(h, c) for h, c in zip((x[:, :half], x[:, half:]), books.value))
                for i in range(len(x)):
                    cells = walk(first[i], second[i], counts, enough)
                    if cells:
                        u, v = np.array(cells).T
                        own = np.unique(np.concatenate([low[u, v], high[u, v], *[np.arange(p + 1, q) for p, q in zip(low[u, v], high[u, v]) if q > p + 1]]))
                        rows += [lo + i] * len(own)
                        reach += [first[i, u[-1]] + second[i, v[-1]]] * len(own)
                        to += own.tolist()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in range(3)], pa.array(reach, pa.float64()), pa.array(to, pa.int32())], ["q", "y", "home", "reach", "qpart"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, _, _ = held.value
        for batch in batches:
            u, v = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            inside = batch.column(4).to_numpy().astype(np.uint64) % counts[u, v].astype(np.uint64)  # a cell may be spread over parts
            part = (begins[u, v] + inside.astype(np.int64)) * parts // total
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(part.astype(np.int32))], ["id", "x", "u", "v", "part"])

    placed = index.withColumn("h", F.xxhash64("id")).mapInArrow(place, f"id {kind}, x array<int>, u int, v int, part int")
    # queries of one part of the index, at most as many as the part holds, meet each part that holds a cell of their walks
    probes = cut(placed.select("id", "x", "part").mapInArrow(probe, f"q {kind}, y array<int>, home int, reach double, qpart int"))
    homes = probes.select("qpart", "home").distinct().groupBy("qpart").agg(F.collect_list("home").alias("homes"))  # a number a pair of parts at most
    left = placed.join(F.broadcast(homes), F.col("part") == F.col("qpart")).select("id", "x", "u", "v", "part", F.explode("homes").alias("from"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        if left.num_rows and right.num_rows:
            order = pa.array(np.argsort(np.array(left["id"]), kind="stable"))  # of equal similarities the least id is first
            ids, x = left["id"].take(order), left["x"].combine_chunks().take(order)
            x = np.array(x.flatten()).reshape(-1, size) / SCALE
            cells, cell = np.unique(left["u"].to_numpy().astype(np.int64)[order] * width + left["v"].to_numpy()[order], return_inverse=True)
            number = {key: i for i, key in enumerate(ids.to_pylist())}
            y = np.array(right["y"].combine_chunks().flatten()).reshape(-1, size)
            near = [np.argmin(distances(h / SCALE, c), 1) for h, c in zip((y[:, :half], y[:, half:]), books.value)]
            reach, names = right["reach"].to_numpy(), right["q"].to_pylist()
            # queries of one cell walk much alike: they are compared together, with the cells that any of them passes
            walks = np.lexsort(near[::-1])
            for lo in range(0, len(walks), TOGETHER):
                some = walks[lo : lo + TOGETHER]
                z = y[some] / SCALE
                first, second = (distances(h, c) for h, c in zip((z[:, :half], z[:, half:]), books.value))
                passed = first[:, cells // width] + second[:, cells % width] <= reach[some, None] + 1e-9
                at = np.flatnonzero(passed.any(0)[cell])
                if not len(at):
                    continue
                similar = np.where(passed[:, cell[at]], z @ x[at].T, -np.inf)
                for i, q in enumerate(some.tolist()):
                    own = number.get(names[q], -1)
                    column = np.searchsorted(at, own)
                    if column < len(at) and at[column] == own:
                        similar[i, column] = -np.inf
                top = best(similar, k)
                value = np.take_along_axis(similar, top, 1)
                row, column = np.nonzero(value > -np.inf)
                found.append(pa.table({"q": right["q"].take(pa.array(some[row])), "n": ids.take(pa.array(at[top[row, column]])), "similarity": value[row, column]}))
        return pa.concat_tables(found) if found else pa.table({"q": left["id"].slice(0, 0), "n": left["id"].slice(0, 0), "similarity": pa.array([], pa.float64())})

    near = left.groupBy("part", "from").cogroup(probes.groupBy("qpart", "home")).applyInArrow(compare, f"q {kind}, n {kind}, similarity double")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "n"))).filter(F.col("rank") <= k).drop("rank")

    # from classes back to vectors
    others = near.join(classes.select(F.col("id").alias("n"), F.col("members").alias("own")), "n").groupBy("q").agg(F.collect_list(F.struct("similarity", "own")).alias("near"))
    lists = classes.select("a", "b", F.col("id").alias("q"), "members").join(others, "q", "left")
    full = own.join(lists, ["a", "b"])
    copies = F.transform("members", lambda m: F.struct(F.lit(-1.0).alias("s"), m.alias("n")))
    rest = F.flatten(F.transform(F.coalesce("near", F.array().cast("array<struct<similarity:double,own:array<" + kind + ">>>")), lambda c: F.transform(c["own"], lambda m: F.struct((-F.round(c["similarity"], 9)).alias("s"), m.alias("n")))))
    ranked = F.slice(F.array_sort(F.filter(F.concat(copies, rest), lambda e: e["n"] != F.col("id"))), 1, k)
    out = full.select(F.col("id").alias(id_col), F.posexplode(ranked).alias("at", "e"))
    return out.select(id_col, (F.col("at") + 1).alias("rank"), F.col("e.n").alias("neighbour"), F.least(F.lit(1.0), -F.col("e.s")).alias("similarity"))


def _measured(index: DataFrame, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, k: int, size: int, recall: float, least: float) -> int:
    """Vectors that the walks of a sample of queries must hold to pass the share recall of their true neighbours of at least that similarity, and `k` where there are none."""
    asked = index.select("id", "x").orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(MEASURED).collect()
    y = np.array([r.x for r in asked]) / SCALE
    sample = index.sparkSession.sparkContext.broadcast(([r.id for r in asked], y))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, y = sample.value
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(-1, size) / SCALE
            similar = y @ x.T
            place = {key: i for i, key in enumerate(batch.column(0).to_pylist())}
            for i, key in enumerate(own):
                if key in place:
                    similar[i, place[key]] = -np.inf
            top = best(similar, k)
            value = np.take_along_axis(similar, top, 1)
            at, rank = np.nonzero(value >= max(least, -2.0))
            hits = pa.array(top[at, rank])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(value[at, rank]), *[batch.column(c).take(hits) for c in (2, 3)]], ["q", "similarity", "u", "v"])

    true = index.select("id", "x", "u", "v").mapInArrow(compare, "q int, similarity double, u int, v int")
    true = true.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity")))).filter(F.col("rank") <= k)
    half, cells = size // 2, {}
    for r in true.select("q", "u", "v").collect():  # k rows a sampled query
        cells.setdefault(r.q, []).append((r.u, r.v))
    passed = []
    for q, own in cells.items():
        first, second = distances(y[q : q + 1, :half], books[0])[0], distances(y[q : q + 1, half:], books[1])[0]
        passed += [needed(first, second, counts, u, v) for u, v in own]
    return sorted(passed)[math.ceil(recall * len(passed)) - 1] if passed else k


def mutual(df: DataFrame, id_col: str = "window_id", least: float = 0.97, **how) -> DataFrame:
    """(window_a, window_b), window_a < window_b: pairs of at least this correlation, each among the other's k most similar.

    By default walks are MARGIN times as wide as any sampled query needs for its neighbours of this correlation.
    """
    near = most_similar(df, id_col, **({"recall": 1.0, "least": least, "margin": MARGIN} | how)).filter(F.col("similarity") >= least)
    pairs = near.select(F.least(id_col, "neighbour").alias("window_a"), F.greatest(id_col, "neighbour").alias("window_b"))
    return pairs.groupBy("window_a", "window_b").count().filter(F.col("count") == 2).drop("count")
