"""A two-dimensional embedding: UMAP on a bounded sample (McInnes et al., 2018), learned by a student that places every cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import Network, _stacked, checked, neighbours_of, sample_of


def fuzzy_graph(index: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges and weights: each point's scale makes its memberships sum to log2 k; a + b - ab joins both directions."""
    n, k = index.shape
    rho, target = distance[:, 0], np.log2(k)
    low, high = np.zeros(n), np.full(n, np.inf)
    sigma = np.ones(n)
    for _ in range(64):
        total = np.exp(-np.maximum(distance - rho[:, None], 0) / sigma[:, None]).sum(axis=1)
        high = np.where(total > target, sigma, high)
        low = np.where(total > target, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    weight = np.exp(-np.maximum(distance - rho[:, None], 0) / np.maximum(sigma, 1e-9)[:, None])
    key = (np.repeat(np.arange(n), k) * n + index.ravel(), index.ravel() * n + np.repeat(np.arange(n), k))
    keys = np.unique(np.concatenate(key))
    one, other = np.zeros(len(keys)), np.zeros(len(keys))
    one[np.searchsorted(keys, key[0])] = weight.ravel()
    other[np.searchsorted(keys, key[1])] = weight.ravel()
    return keys // n, keys % n, one + other - one * other


def curve(spread: float, min_dist: float) -> tuple[float, float]:
    """a, b of 1 / (1 + a d^(2b)) nearest to the wished-for membership, by a grid that narrows."""
    d = np.linspace(0, 3 * spread, 300)
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a, b, span = 1.5, 0.9, 1.0
    for _ in range(12):
        grid = [(x, y) for x in a * np.exp(np.linspace(-span, span, 11)) for y in b * np.exp(np.linspace(-span, span, 11) / 2)]
        a, b = min(grid, key=lambda p: float(((1 / (1 + p[0] * d ** (2 * p[1])) - want) ** 2).sum()))
        span *= 0.6
    return float(a), float(b)


def layout(x: np.ndarray, index: np.ndarray, distance: np.ndarray, spread: float, min_dist: float, epochs: int, seed: int, negatives: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    head, tail, weight = fuzzy_graph(index, distance)
    a, b = curve(spread, min_dist)
    centered = x - x.mean(axis=0)
    _, _, v = np.linalg.svd(centered[: min(len(x), 5000)], full_matrices=False)
    y = centered @ v[:2].T if len(v) >= 2 else np.hstack([centered @ v[:1].T, rng.normal(0, 1e-2, (len(x), 1))])
    y = y / (np.abs(y).max() or 1.0) * 10 + rng.normal(0, 1e-4, y.shape)
    chance = weight / weight.max()
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        use = rng.random(len(head)) < chance
        i, j = head[use], tail[use]
        delta = y[i] - y[j]
        d2 = (delta**2).sum(axis=1)
        pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0)[:, None]
        step = np.clip(pull * delta, -4, 4) * rate
        np.add.at(y, i, step)
        np.add.at(y, j, -step)
        i = np.repeat(i, negatives)
        j = rng.integers(0, len(x), len(i))
        delta = y[i] - y[j]
        d2 = (delta**2).sum(axis=1)
        push = (2 * b / ((0.001 + d2) * (1 + a * d2**b)))[:, None]
        np.add.at(y, i, np.where((i != j)[:, None], np.clip(push * delta, -4, 4) * rate, 0))
    return y


def neighbour_overlap(spark: SparkSession, x: np.ndarray, y: np.ndarray, k: int) -> float:
    a, b = neighbours_of(spark, x, k)[0], neighbours_of(spark, y, k)[0]
    return float(np.mean([len(np.intersect1d(p, q)) / len(p) for p, q in zip(a, b, strict=True)]))


def trustworthiness(spark: SparkSession, x: np.ndarray, y: np.ndarray, k: int) -> float:
    n = len(x)
    k = min(k, (n - 1) // 2)
    rank = np.argsort(np.argsort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1), axis=1)
    near = neighbours_of(spark, y, k)[0]
    over = np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()
    return float(1 - 2 / (n * k * (2 * n - 3 * k - 1)) * over)


def umap(points: DataFrame, n_components: int = 2, n_neighbors: int = 15, min_dist: float = 0.5, spread: float = 1.0, fit_sample_n: int = 200_000, epochs: int = 200, student_epochs: int = 100, random_state: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cell, umap1, umap2 of all cells; parameters; evaluation. The sample is bounded by fit_sample_n and lies on the driver."""
    if n_components != 2:
        raise ValueError("n_components must be 2")
    if spread < min_dist:
        raise ValueError("spread must be at least min_dist")
    checked(points)
    _, x = sample_of(points, fit_sample_n, random_state)
    if len(x) < 4:
        raise ValueError("too few cells to embed")
    spark = points.sparkSession
    index, distance = neighbours_of(spark, x, n_neighbors)
    y = layout(x, index, distance, spread, min_dist, epochs, random_state)
    mean, std, at, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0), y.mean(axis=0), np.where(y.std(axis=0) > 0, y.std(axis=0), 1.0)
    z, t = (x - mean) / std, (y - at) / scale
    student = Network(z.shape[1], 2, seed=random_state, classes=False).fit(z, t, student_epochs, seed=random_state)
    part = slice(0, min(len(x), 1000))
    out = student(z[part]) * scale + at
    scores = {"trustworthiness": trustworthiness(spark, x[part], out, n_neighbors), "knn_overlap": neighbour_overlap(spark, x[part], out, n_neighbors), "teacher_mse": float(((student(z) - t) ** 2).mean())}

    def run(batches):
        for batch in batches:
            v = _stacked(batch.column(1).to_pylist())
            p = student((v - mean) / std) * scale + at if len(v) else np.empty((0, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p[:, 0].astype(np.float32)), pa.array(p[:, 1].astype(np.float32))], ["cell", "umap1", "umap2"])

    coords = points.select(F.col("cell").cast("long").alias("cell"), F.col("values").cast("array<double>").alias("values")).mapInArrow(run, "cell long, umap1 float, umap2 float")
    params = {"n_neighbors": n_neighbors, "min_dist": min_dist, "spread": spread, "fit_sample_n": fit_sample_n, "epochs": epochs, "student_epochs": student_epochs, "random_state": random_state}
    return coords, spark.createDataFrame([(k, str(v)) for k, v in params.items()], "param_name string, param_value string"), spark.createDataFrame(list(scores.items()), "metric_name string, metric_value double")
