"""Covariance, and principal components by a randomised range finder over distributed sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covariance(x: DataFrame, n_cells: int) -> DataFrame:
    """gene_a, gene_b, covariance (sample) of the genes in x, zeros included: products meet by cell."""
    a, b = (x.select("cell_id", F.col("gene_id").alias(f"gene_{k}"), F.col("v").alias(f"v_{k}")) for k in "ab")
    products = a.join(b, "cell_id").groupBy("gene_a", "gene_b").agg(F.sum(F.col("v_a") * F.col("v_b")).alias("p"))
    sums = x.groupBy("gene_id").agg(F.sum("v").alias("s"))
    grid = sums.withColumnsRenamed({"gene_id": "gene_a", "s": "sa"}).crossJoin(sums.withColumnsRenamed({"gene_id": "gene_b", "s": "sb"}))
    return grid.join(products, ["gene_a", "gene_b"], "left").select("gene_a", "gene_b", ((F.coalesce("p", F.lit(0.0)) - F.col("sa") * F.col("sb") / n_cells) / (n_cells - 1)).alias("covariance"))


def _sparse_rows(matrix: DataFrame, cells: DataFrame) -> DataFrame:
    rows = matrix.groupBy("filter_cell_id").agg(F.collect_list("filter_gene_id").alias("genes"), F.collect_list("data").alias("data"))
    return cells.select("filter_cell_id").join(rows, "filter_cell_id", "left")


def _blocks(frame: pd.DataFrame, zero: np.ndarray, size: int = 1024):
    for lo in range(0, len(frame), size):
        part = frame.iloc[lo : lo + size]
        out = np.tile(zero, (len(part), 1))
        for i, (genes, data) in enumerate(zip(part["genes"], part["data"], strict=True)):
            if genes is not None:
                out[i, np.asarray(genes, np.int64)] = data
        yield part["filter_cell_id"].to_numpy(), out


#: Rows of a summed matrix that travel together.
STRIPE = 256


def _summed(rows: DataFrame, make, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all blocks of make(block): each task sends its sum in stripes of rows, which are added on the executors."""

    def run(frames):
        total, zero = None, make.zero
        for frame in frames:
            for _, block in _blocks(frame, zero):
                part = make(block)
                total = part if total is None else total + part
        if total is not None:
            at = range(0, len(total), STRIPE)
            yield pd.DataFrame({"stripe": [i // STRIPE for i in at], "sums": [np.ascontiguousarray(total[i : i + STRIPE]).tobytes() for i in at]})

    def add(key, batches):
        total = None
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                part = np.frombuffer(blob)
                total = part.copy() if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], ["stripe", "sums"])

    schema = "stripe int, sums binary"
    added = rows.mapInPandas(run, schema).groupBy("stripe").applyInArrow(lambda key, table: pa.Table.from_batches(add(key, table.to_batches())), schema)
    out = np.zeros(shape)
    for r in added.toLocalIterator():
        part = np.frombuffer(bytes(r["sums"])).reshape(-1, shape[1])
        out[r["stripe"] * STRIPE : r["stripe"] * STRIPE + len(part)] = part
    return out


class _Range:
    """X'X omega of a block."""

    def __init__(self, zero, omega):
        self.zero, self.omega = zero, omega

    def __call__(self, block):
        return block.T @ (block @ self.omega)


class _Core:
    """(XQ)'(XQ) of a block, the squares of X in a last row."""

    def __init__(self, zero, q):
        self.zero, self.q = zero, q

    def __call__(self, block):
        y = block @ self.q
        tail = np.zeros((1, y.shape[1]))
        tail[0, 0] = (block * block).sum()
        return np.vstack([y.T @ y, tail])


def pca(matrix: DataFrame, cells: DataFrame, genes: DataFrame, n_components: int = 30, oversample: int = 200, n_iter: int = 2, random_state: int = 0, centered: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coordinates (filter_cell_id, pc0..), statistics (pc_index, variance, variance_ratio) and loadings (filter_gene_id, pc0..).

    matrix is a read index of a centered layer; genes carry zero_scale_transform, what an absent entry
    stands for. Signs are fixed so that each component's largest loading is positive.
    """
    if not centered:
        raise ValueError("the layer of the read index is not centered: run scale with a centering mode")
    found = genes.select("filter_gene_id", F.coalesce("zero_scale_transform", F.lit(0.0)).alias("z")).orderBy("filter_gene_id").collect()
    zero = np.array([r["z"] for r in found], float)
    n, width = cells.count(), len(zero)
    if not n or not width:
        raise ValueError("the read index is empty")
    if not np.isfinite(zero).all():
        raise ValueError("zero transforms are not finite")
    k = min(n_components + oversample, width)
    if n_components > width:
        raise RuntimeError(f"{width} genes have no {n_components} components")
    rows = _sparse_rows(matrix, cells).persist()
    basis = np.random.default_rng(random_state).standard_normal((width, k))
    for _ in range(n_iter + 1):
        basis, _ = np.linalg.qr(_summed(rows, _Range(zero, basis), (width, k)))
    core = _summed(rows, _Core(zero, basis), (k + 1, k))
    square = core[-1, 0]
    if not np.isfinite(core).all():
        raise ValueError("the matrix has values that are not finite")
    eig, vec = np.linalg.eigh((core[:-1] + core[:-1].T) / 2)
    order = np.argsort(-eig)
    eig, vec = eig[order], vec[:, order]
    if (eig > np.finfo(float).eps * max(eig.max(), 0)).sum() < n_components:
        raise RuntimeError(f"the matrix has a rank below {n_components}")
    parts = basis @ vec[:, :n_components]
    parts *= np.sign(parts[np.abs(parts).argmax(axis=0), np.arange(n_components)])
    names = [f"pc{i}" for i in range(n_components)]
    columns = ", ".join(f"{c} float" for c in names)

    def project(frames):
        for frame in frames:
            for ids, block in _blocks(frame, zero):
                yield pd.DataFrame(np.asarray(block @ parts, np.float32), columns=names).assign(filter_cell_id=ids)[["filter_cell_id", *names]]

    coords = rows.mapInPandas(project, f"filter_cell_id long, {columns}")
    spark = matrix.sparkSession
    variance = eig[:n_components] / max(n - 1, 1)
    stats = spark.createDataFrame([(i, float(v), float(e / square)) for i, (v, e) in enumerate(zip(variance, eig, strict=False))], "pc_index int, variance double, variance_ratio double")
    loadings = spark.createDataFrame(pd.DataFrame(parts.astype(np.float32), columns=names).assign(filter_gene_id=np.arange(width))[["filter_gene_id", *names]], f"filter_gene_id long, {columns}")
    return coords, stats, loadings

