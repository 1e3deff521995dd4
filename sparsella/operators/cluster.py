"""k-means, nearest neighbours, and graph clustering: Louvain on a bounded sample, learned by a student that labels every cell.

Points are rows (cell, values): an id and an array of numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _stacked(column) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.empty((0, 0))


def checked(points: DataFrame) -> DataFrame:
    bad = points.where(F.exists("values", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v) == float("inf")))).limit(1).count()
    if bad:
        raise ValueError("points hold NaN or infinite values")
    return points


def assigned(points: DataFrame, centers) -> DataFrame:
    """cell and cluster_id, the nearest center; the first of equal ones."""
    c = np.asarray(centers, float)

    def run(batches):
        for batch in batches:
            x = _stacked(batch.column(1).to_pylist())
            best = np.empty(len(x), np.int32)
            for lo in range(0, len(x), 4096):
                best[lo : lo + 4096] = ((x[lo : lo + 4096, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best)], ["cell", "cluster_id"])

    return points.select(F.col("cell").cast("long").alias("cell"), F.col("values").cast("array<double>").alias("values")).mapInArrow(run, "cell long, cluster_id int")


def kmeans(points: DataFrame, n_clusters: int = 10, seed: int = 0, iterations: int = 50) -> tuple[DataFrame, DataFrame]:
    """Labels (cell, cluster_id), and centers in long form (cluster_id, pc_index, value). Clusters are numbered by their centers, so a run repeats."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    checked(points)
    ready = points.select("cell", array_to_vector(F.col("values").cast("array<double>")).alias("features"))
    model = KMeans(k=n_clusters, seed=seed, maxIter=iterations, initMode="k-means||").fit(ready)
    centers = np.array(sorted(model.clusterCenters(), key=lambda c: c.tolist()))
    long = [(i, j, float(v)) for i, c in enumerate(centers) for j, v in enumerate(c)]
    return assigned(points, centers), points.sparkSession.createDataFrame(long, "cluster_id int, pc_index int, value double")


def minibatch_kmeans(points: DataFrame, n_clusters: int = 10, seed: int = 0, batch_size: int = 2048, fit_batches: int = 1000) -> tuple[DataFrame, DataFrame]:
    """As kmeans, with centers fitted on at most fit_batches batches of batch_size points (Sculley, 2010): a hash orders the points, the first batch seeds the centers, each further one moves them. All points get labels.

    At most batch_size x fit_batches points pass the driver, partition by partition.
    """
    checked(points)
    rows = points.select(F.col("cell").cast("long").alias("cell"), F.col("values").cast("array<double>").alias("values"))
    order = F.xxhash64("cell", F.lit(seed))
    taken = rows.select("cell", "values").orderBy(order, "cell").limit(batch_size * fit_batches)
    rng, centers, weight, held = np.random.default_rng(seed), None, np.zeros(n_clusters), []

    def move(batch: np.ndarray) -> None:
        nonlocal centers
        if centers is None:
            centers = _spread(batch, n_clusters, rng)
        near = ((batch[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        n = np.bincount(near, minlength=n_clusters)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, batch)
        weight[:] += n
        seen = n > 0
        centers[seen] += (sums[seen] - n[seen, None] * centers[seen]) / weight[seen, None]

    for r in taken.select("values").toLocalIterator():
        held.append(r[0])
        if len(held) == batch_size:
            move(np.array(held))
            held = []
    if held and (centers is not None or len(held) >= n_clusters):
        move(np.array(held))
    if centers is None:
        raise ValueError("fewer points than clusters")
    centers = np.array(sorted(centers.tolist()))
    long = [(i, j, float(v)) for i, c in enumerate(centers) for j, v in enumerate(c)]
    return assigned(points, centers), points.sparkSession.createDataFrame(long, "cluster_id int, pc_index int, value double")


def _spread(x: np.ndarray, k: int, rng: np.random.Generator, tries: int = 8) -> np.ndarray:
    """k of the points, far from each other: each is drawn by its squared distance from those before, the best of some draws (k-means++)."""
    if len(x) < k:
        raise ValueError("fewer points in the first batch than clusters")
    out = [x[rng.integers(len(x))]]
    d = ((x - out[0]) ** 2).sum(axis=1)
    while len(out) < k:
        p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
        picked = rng.choice(len(x), tries, p=p)
        draws = [np.minimum(d, ((x - x[i]) ** 2).sum(axis=1)) for i in picked]
        best = int(np.argmin([v.sum() for v in draws]))
        out.append(x[picked[best]])
        d = draws[best]
    return np.array(out)


def nearest(points: DataFrame, k: int, metric_digits: int = 9, block: int = 4096) -> DataFrame:
    """cell, neighbor, rank (from 1) and distance of each point's k nearest others, exactly; equal distances by id.

    Points are packed in blocks; every block passes over all blocks, keeps its k best of each, and a
    last step merges them: an exact search is quadratic in work, but ships k rows a point and block.
    For large inputs give a bounded sample, as graph_clustering does.
    """
    rows = points.select(F.col("cell").cast("long").alias("cell"), F.col("values").cast("array<double>").alias("values"))
    packed = rows.groupBy(F.expr(f"cast(floor(cell / {block}) as bigint)").alias("block")).agg(F.collect_list("cell").alias("cells"), F.collect_list("values").alias("vectors"))
    pairs = packed.withColumnsRenamed({c: f"a_{c}" for c in packed.columns}).crossJoin(packed)

    def run(frames):
        for frame in frames:
            for _, r in frame.iterrows():
                a, b = _stacked(r["a_vectors"]), _stacked(r["vectors"])
                ids, others = np.asarray(r["a_cells"], np.int64), np.asarray(r["cells"], np.int64)
                d = np.stack([((b - v) ** 2).sum(axis=1) for v in a])
                d[ids[:, None] == others[None, :]] = np.inf
                d = np.round(d, metric_digits)
                order = np.stack([np.lexsort((others, row))[:k] for row in d])
                yield pd.DataFrame({"cell": np.repeat(ids, order.shape[1]), "neighbor": others[order].ravel(), "d": np.take_along_axis(d, order, 1).ravel()}).query("d < inf")

    from pyspark.sql.window import Window

    found = pairs.mapInPandas(run, "cell long, neighbor long, d double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("d", "neighbor"))).where(F.col("rank") <= k)
    return ranked.select("cell", "neighbor", "rank", F.sqrt("d").alias("distance"))


def sample_of(points: DataFrame, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """At most n points on the driver, the same at every run: those of least hash, in its order.

    Only points whose hash is below a bound that some more than n are expected to meet travel, packed by batch.
    """
    rows = points.select(F.col("cell").cast("long").alias("cell"), F.col("values").cast("array<double>").alias("values"))
    rows = rows.select("cell", "values", F.xxhash64(F.col("cell") + seed).alias("h"))
    total, wanted = rows.count(), n + 6 * int(n**0.5) + 100

    def pack(batches):
        for batch in batches:
            cell, values, h = (batch.column(i) for i in range(3))
            width = np.unique(np.diff(values.offsets.to_numpy()))
            if values.null_count or len(width) > 1:
                raise ValueError("points differ in length")
            if len(width):
                yield pa.RecordBatch.from_arrays([pa.array([int(width[0])]), *[pa.array([np.ascontiguousarray(c.to_numpy(zero_copy_only=False)).tobytes()]) for c in (h, cell, values.flatten())]], ["width", "h", "cells", "values"])

    while True:
        below = rows if wanted >= total else rows.where(F.col("h") < int(2**64 * wanted / total) - 2**63)
        found = below.mapInArrow(pack, "width long, h binary, cells binary, values binary").collect()
        h, cells = (np.concatenate([np.frombuffer(r[c], np.int64) for r in found] or [np.empty(0, np.int64)]) for c in ("h", "cells"))
        if len(h) >= n or wanted >= total:
            break
        wanted *= 2
    if len({r["width"] for r in found}) > 1:
        raise ValueError("points differ in length")
    order = np.lexsort((cells, h))[:n]
    x = np.concatenate([np.frombuffer(r["values"]).reshape(-1, r["width"]) for r in found]) if found else np.empty((0, 0))
    return cells[order], x[order]


#: Distances that an executor holds at once.
TILE = 1 << 20


def _least(d: np.ndarray, k: int, look: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the k least of each row, in order; the first of equal ones. The k-th least of some columns bounds that of all."""
    bound = np.partition(d[:, :look], k - 1, axis=1)[:, k - 1] if d.shape[1] > look else np.full(len(d), np.inf)
    near, far = np.empty((len(d), k), np.int32), np.empty((len(d), k))
    for i, row in enumerate(d):
        at = np.flatnonzero(row <= bound[i])
        at = at[np.argsort(row[at], kind="stable")[:k]]
        near[i], far[i] = at, row[at]
    return near, far


def neighbours_of(spark: SparkSession, x: np.ndarray, k: int, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Indices and distances of the k nearest others of a bounded sample: its rows are broadcast once, executors take `step` of them at a time and hold TILE distances."""
    k = min(k, len(x) - 1)
    held = spark.sparkContext.broadcast(x)

    def run(batches):
        x = held.value
        squares, rows = (x * x).sum(axis=1), max(1, TILE // len(x))
        for batch in batches:
            for lo in batch.column(0).to_pylist():
                found = []
                for at in range(lo, min(lo + step, len(x)), rows):
                    part = x[at : min(at + rows, lo + step)]
                    d = (-2 * part) @ x.T
                    d += squares
                    d += squares[at : at + len(part), None]
                    d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
                    found.append(_least(d, k))
                near, far = np.concatenate([f[0] for f in found]), np.sqrt(np.maximum(np.concatenate([f[1] for f in found]), 0))
                yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([near.tobytes()]), pa.array([far.tobytes()])], ["lo", "near", "far"])

    steps = -(-len(x) // step)
    found = spark.range(0, steps * step, step, min(steps, 4096)).mapInArrow(run, "lo long, near binary, far binary")
    index, distance = np.empty((len(x), k), np.int32), np.empty((len(x), k))
    for r in found.collect():  # 12 bytes a neighbour; an iterator would run its tasks one by one
        rows = slice(r["lo"], min(r["lo"] + step, len(x)))
        index[rows], distance[rows] = np.frombuffer(r["near"], np.int32).reshape(-1, k), np.frombuffer(r["far"]).reshape(-1, k)
    held.destroy()
    return index.astype(np.int64), distance


def _by_row(keys: np.ndarray, size: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds, columns and weights of the rows of a square matrix whose cells row * size + column are given, sorted here; without weights, each counts once and for one."""
    if weights is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    weights = np.ones(int(first.sum()), np.float32) if weights is None else np.add.reduceat(weights, np.flatnonzero(first)) if len(keys) else weights
    keys = keys[first]
    bounds = np.searchsorted(keys, np.arange(size + 1) * size)
    keys %= size
    return bounds, keys.astype(np.int32), weights


def louvain(index: np.ndarray, n: int, resolution: float = 1.0, seed: int = 0, rounds: int = 20) -> np.ndarray:
    """Communities of the graph that links each point with its neighbours (either way counts), by modularity with a resolution: local moves, then merging, until nothing changes.

    The graph is three arrays: a sample of 200,000 with 15 neighbours has up to six million links, for which dictionaries take more than the driver has.
    """
    rng = np.random.default_rng(seed)
    k = index.shape[1]
    keys = np.empty(2 * n * k, np.int64)
    for half, (a, b) in zip((keys[: n * k], keys[n * k :]), ((np.repeat(np.arange(n), k), index.ravel()), (index.ravel(), np.repeat(np.arange(n), k))), strict=True):
        half[:] = a
        half *= n
        half += b
    bounds, others, links_of = _by_row(keys, n)
    del keys, half, a, b
    member, own = np.arange(n), np.zeros(n)
    for _ in range(rounds):
        size = len(bounds) - 1
        row = np.repeat(np.arange(size, dtype=np.int32), np.diff(bounds))
        degree = np.bincount(row, links_of, size) + own
        total = float(degree.sum()) or 1.0
        ends, weight, degree = bounds.tolist(), degree.tolist(), degree.tolist()
        label = list(range(size))
        moved_any, moved = False, True
        while moved:
            moved = False
            for i in rng.permutation(size).tolist():
                links: dict[int, float] = {}
                lo, hi, mine = ends[i], ends[i + 1], label[i]
                for j, w in zip(others[lo:hi].tolist(), links_of[lo:hi].tolist(), strict=True):
                    c = label[j]
                    links[c] = links.get(c, 0.0) + w
                weight[mine] -= degree[i]
                best, gain = mine, links.get(mine, 0.0) - resolution * degree[i] * weight[mine] / total
                for c, w in sorted(links.items()):
                    if (g := w - resolution * degree[i] * weight[c] / total) > gain + 1e-12:
                        best, gain = c, g
                weight[best] += degree[i]
                if best != mine:
                    label[i], moved, moved_any = best, True, True
        if not moved_any:
            break
        _, merged = np.unique(label, return_inverse=True)
        member, merged = merged[member], merged.astype(np.int32)
        size = int(merged.max()) + 1
        a, b = merged[row], merged[others]
        inside = a == b
        own = np.bincount(merged, own, size) + np.bincount(a[inside], links_of[inside], size)
        bounds, others, links_of = _by_row(a[~inside].astype(np.int64) * size + b[~inside], size, links_of[~inside].astype(float))
    return _by_size(member)


def _by_size(labels: np.ndarray) -> np.ndarray:
    """Labels numbered anew: cluster 0 is the largest."""
    order = np.argsort(-np.bincount(labels), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[labels]


def distinct_points(x: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The row of each distinct point's first copy, in order, and for each row the number of its point. A hash groups the rows; all are compared with the first of their group, and a row that differs stays a point of its own."""
    spread = np.random.default_rng(0).integers(0, 1 << 63, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    parts = range(0, len(x), step)

    def hashed(part: np.ndarray) -> np.ndarray:
        bits = np.ascontiguousarray(part + 0.0).view(np.uint64)  # one zero
        return ((bits ^ (bits >> np.uint64(29))) * spread).sum(axis=1, dtype=np.uint64)

    _, first, number = np.unique(np.concatenate([hashed(x[lo : lo + step]) for lo in parts]), return_index=True, return_inverse=True)
    odd = np.flatnonzero(np.concatenate([(x[lo : lo + step] != x[first[number[lo : lo + step]]]).any(axis=1) for lo in parts]))
    number[odd] = len(first) + np.arange(len(odd))
    first = np.concatenate([first, odd])
    order = np.argsort(first)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return first[order], rank[number]


class Network:
    """A small network with one hidden layer, trained by Adam: softmax for classes, which are given as numbers, or linear outputs."""

    def __init__(self, width: int, outputs: int, hidden: int = 64, seed: int = 0, classes: bool = True):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.parts = [rng.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, outputs)), np.zeros(outputs)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.parts
        return np.maximum(x @ a + b, 0) @ c + d

    def classes_of(self, x: np.ndarray, step: int = 1024) -> np.ndarray:
        """The likeliest class of each row."""
        return np.concatenate([self(x[lo : lo + step]).argmax(axis=1) for lo in range(0, len(x), step)] or [np.empty(0, np.int64)])

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 50, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 0) -> Network:
        rng, first, second, step = np.random.default_rng(seed), [0.0] * 4, [0.0] * 4, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                rows, step = order[lo : lo + batch], step + 1
                a, b, c, d = self.parts
                h = np.maximum(x[rows] @ a + b, 0)
                out = h @ c + d
                if self.classes:
                    out = np.exp(out - out.max(axis=1, keepdims=True))
                    out /= out.sum(axis=1, keepdims=True)
                    out[np.arange(len(rows)), y[rows]] -= 1
                    error = out / len(rows)
                else:
                    error = (out - y[rows]) / len(rows)
                back = (error @ c.T) * (h > 0)
                for i, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ error, error.sum(axis=0))):
                    first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                    self.parts[i] = self.parts[i] * (1 - rate * decay) - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        return self


def graph_clustering(points: DataFrame, fit_sample_n: int = 200_000, n_neighbors: int = 15, resolution: float = 1.0, epochs: int = 50, random_state: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """Labels (cell, cluster_id) of all cells, parameters, evaluation, and the evaluation as a dict.

    The teacher's sample is bounded by fit_sample_n and lies on the driver; its exact neighbours are
    found on the executors, with quadratic work. Copies of a point get one label from the student, so
    they are one node of the teacher's graph: as each other's neighbours they would be a community for
    every point that has more than n_neighbors copies. The student learns from all of the sample.
    """
    checked(points)
    cells, x = sample_of(points, fit_sample_n, random_state)
    if len(cells) < 3:
        raise ValueError("too few cells to cluster")
    first, number = distinct_points(x)
    if len(first) > 1:
        labels = _by_size(louvain(neighbours_of(points.sparkSession, x[first], n_neighbors)[0], len(first), resolution, random_state)[number])
    else:
        labels = number
    mean, std = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = (x - mean) / std
    held = np.random.default_rng(random_state).permutation(len(x)) % 10 == 0
    student = Network(z.shape[1], int(labels.max()) + 1, seed=random_state).fit(z[~held], labels[~held], epochs, seed=random_state)
    guess, truth = student.classes_of(z[held]), labels[held]
    recall = [float((guess[truth == c] == c).mean()) for c in np.unique(truth)]
    f1 = [2 * ((guess == c) & (truth == c)).sum() / max(1, (guess == c).sum() + (truth == c).sum()) for c in np.unique(truth)]
    scores = {"accuracy": float((guess == truth).mean()), "balanced_accuracy": float(np.mean(recall)), "macro_f1": float(np.mean(f1)), "n_clusters": float(labels.max() + 1)}

    def run(batches):
        for batch in batches:
            v = _stacked(batch.column(1).to_pylist())
            out = student.classes_of((v - mean) / std) if len(v) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.astype(np.int32))], ["cell", "cluster_id"])

    spark = points.sparkSession
    rows = points.select(F.col("cell").cast("long").alias("cell"), F.col("values").cast("array<double>").alias("values")).mapInArrow(run, "cell long, cluster_id int")
    params = {"mode": "distilled_louvain", "fit_sample_n": fit_sample_n, "n_neighbors": n_neighbors, "resolution": resolution, "epochs": epochs, "random_state": random_state}
    return rows, spark.createDataFrame([(k, str(v)) for k, v in params.items()], "param_name string, param_value string"), spark.createDataFrame(list(scores.items()), "metric_name string, metric_value double"), scores
