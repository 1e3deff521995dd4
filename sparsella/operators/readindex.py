"""The read index: dense numbers for the chosen cells and genes, the filtered matrix in reading order, batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.prefix import dense_number
from .matrix import row_pointers, small


def chosen(meta: DataFrame, key: str, condition: str | None, out: str) -> DataFrame:
    """key and its dense number among the rows that meet a condition: a boolean column or a SQL expression; None takes all."""
    rows = meta if condition is None else meta.where(F.coalesce(F.expr(condition), F.lit(False)))
    return dense_number(rows.select(key), key, out)


def filtered_matrix(x: DataFrame, cells: DataFrame, genes: DataFrame, n_cells: int | None = None, n_genes: int | None = None) -> DataFrame:
    """filter_cell_id, filter_gene_id and data of the chosen cells and genes, range-partitioned and sorted by cell, then gene."""
    rows = x.where("v is not null").join(small(genes, n_genes), "gene_id").join(small(cells, n_cells), "cell_id")
    return rows.select("filter_cell_id", "filter_gene_id", F.col("v").alias("data")).repartitionByRange("filter_cell_id").sortWithinPartitions("filter_cell_id", "filter_gene_id")


def filtered_pointers(matrix: DataFrame, cells: DataFrame) -> DataFrame:
    named = matrix.select(F.col("filter_cell_id").alias("cell_id"))
    return row_pointers(named, cells, "filter_cell_id").withColumnRenamed("cell_id", "filter_cell_id")


def batch_plan(pointers: DataFrame, batch_size: int) -> DataFrame:
    """batch, its first and last cell, its cells and its entries."""
    batch = F.expr(f"cast(floor(filter_cell_id / {batch_size}) as bigint)")
    ends = pointers.groupBy(batch.alias("batch")).agg(F.min("filter_cell_id").alias("first_cell"), F.max("filter_cell_id").alias("last_cell"), F.count("*").alias("n_cells"), F.max("indptr").alias("end"))
    before = F.lag("end", 1, 0).over(Window.orderBy("batch"))  # one row a batch
    return ends.withColumn("nnz", F.col("end") - before).drop("end")


def shuffled_order(cells: DataFrame, batch_size: int, buffer_batches: int, seed: int, turn: int) -> DataFrame:
    """filter_cell_id and its place in a pass: shuffled within groups of buffer_batches batches, by a keyed hash."""
    group = F.expr(f"cast(floor(filter_cell_id / {batch_size * buffer_batches}) as bigint)")
    order = Window.partitionBy("g").orderBy(F.xxhash64("filter_cell_id", F.lit(seed), F.lit(turn)), "filter_cell_id")
    return cells.select("filter_cell_id", group.alias("g")).select("filter_cell_id", (F.col("g") * batch_size * buffer_batches + F.row_number().over(order) - 1).alias("place"))


#: Values in a dense block, at most, if a cell has not more.
BLOCK_VALUES = 1 << 23


def dense_block(genes, data, zero: np.ndarray) -> np.ndarray:
    """A dense matrix of rows given as Arrow lists of genes and data; absent entries are the zero vector's."""
    out = np.tile(zero, (len(genes), 1))
    row = np.repeat(np.arange(len(genes)), np.diff(genes.offsets.to_numpy())) if not genes.null_count else pc.list_parent_indices(genes).to_numpy()
    out[row, genes.flatten().to_numpy()] = data.flatten().to_numpy()
    return out


def sparse_rows(matrix: DataFrame, cells: DataFrame, batch_size: int = 2048, buffer_batches: int = 5, seed: int | None = None, turn: int = 0) -> DataFrame:
    """One row a cell: filter_cell_id, its place and batch in a pass, and its stored entries as arrays genes and data, null where it has none. seed None: in order. Nothing is as long as the number of genes."""
    places = cells.select("filter_cell_id", F.col("filter_cell_id").alias("place")) if seed is None else shuffled_order(cells, batch_size, buffer_batches, seed, turn)
    held = matrix.groupBy("filter_cell_id").agg(F.collect_list(F.col("filter_gene_id").cast("int")).alias("genes"), F.collect_list(F.col("data").cast("float")).alias("data"))
    return places.join(held, "filter_cell_id", "left").withColumn("batch", F.expr(f"cast(floor(place / {batch_size}) as bigint)"))


def row_sums(rows: DataFrame) -> DataFrame:
    """sparse_rows with the total and weighted (by gene number from 1) sums of each cell's values, where absent entries are zero."""
    pairs = F.zip_with("genes", "data", lambda g, v: v.cast("double") * (g + F.lit(1).cast("long")))
    plus = lambda a, v: a + v
    return rows.withColumns({"total": F.coalesce(F.aggregate("data", F.lit(0.0), plus), F.lit(0.0)), "weighted": F.coalesce(F.aggregate(pairs, F.lit(0.0), plus), F.lit(0.0))})


def map_dense(matrix: DataFrame, cells: DataFrame, zero: np.ndarray, make, schema: str, batch_size: int = 2048, buffer_batches: int = 5, seed: int | None = None, turn: int = 0, obs_col: DataFrame | None = None) -> DataFrame:
    """make(columns, block) of blocks of cells, on the executors: columns are filter_cell_id, place, batch and those of obs_col (by filter_cell_id), as Arrow; block is dense. It returns what schema says."""
    zero = np.asarray(zero, np.float32)
    rows = sparse_rows(matrix, cells, batch_size, buffer_batches, seed, turn)
    if obs_col is not None:
        rows = rows.join(obs_col, "filter_cell_id", "left")
    keep = [c for c in rows.columns if c not in ("genes", "data")]
    step = max(1, BLOCK_VALUES // max(1, len(zero)))

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                part = whole.slice(lo, step)
                yield make(part.select(keep), dense_block(part.column("genes"), part.column("data"), zero))

    return rows.mapInArrow(run, schema)


def dense_batches(matrix: DataFrame, cells: DataFrame, zero: np.ndarray, batch_size: int = 2048, buffer_batches: int = 5, seed: int | None = None, turn: int = 0, obs_col: DataFrame | None = None) -> DataFrame:
    """One row a cell: batch, place, filter_cell_id and values, a dense array that starts as the zero vector; obs_col adds a column by filter_cell_id. seed None: in order."""
    more = [] if obs_col is None else [f for f in obs_col.schema if f.name != "filter_cell_id"]
    schema = f"filter_cell_id {dict(cells.dtypes)['filter_cell_id']}, place long, batch long, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in more) + "values array<float>"

    def whole(columns, block):
        ends = pa.array(np.arange(len(block) + 1, dtype=np.int32) * block.shape[1])
        place = columns.column("place").cast(pa.int64())
        return pa.RecordBatch.from_arrays([columns.column("filter_cell_id"), place, columns.column("batch"), *[columns.column(f.name) for f in more], pa.ListArray.from_arrays(ends, pa.array(block.ravel()))], ["filter_cell_id", "place", "batch", *[f.name for f in more], "values"])

    return map_dense(matrix, cells, zero, whole, schema, batch_size, buffer_batches, seed, turn, obs_col)


def batch_sums(matrix: DataFrame, cells: DataFrame, zero: np.ndarray, batch_size: int = 2048) -> DataFrame:
    """batch, total and weighted (by gene number from 1) sums of all its dense values: what a reader of the batches must find."""

    def sums(columns, block):
        wide = block.astype(float)
        return pa.RecordBatch.from_arrays([columns.column("batch"), pa.array(wide.sum(axis=1)), pa.array(wide @ np.arange(1.0, wide.shape[1] + 1))], ["batch", "total", "weighted"])

    each = map_dense(matrix, cells, zero, sums, "batch long, total double, weighted double", batch_size)
    return each.groupBy("batch").agg(F.sum("total").alias("total"), F.sum("weighted").alias("weighted"))


def batches(dense: DataFrame):
    """Batches on the driver, one at a time and in order: (filter_cell_ids, float32 matrix, obs values or None)."""
    extra = [c for c in dense.columns if c not in ("batch", "place", "filter_cell_id", "values")]
    held: list = []
    for row in dense.repartitionByRange("batch", "place").sortWithinPartitions("batch", "place").toLocalIterator():
        if held and held[0]["batch"] != row["batch"]:
            yield _batch(held, extra)
            held = []
        held.append(row)
    if held:
        yield _batch(held, extra)


def _batch(rows: list, extra: list[str]):
    return np.array([r["filter_cell_id"] for r in rows]), np.array([r["values"] for r in rows], np.float32), pd.DataFrame({c: [r[c] for r in rows] for c in extra}) if extra else None


def csr_batches(matrix: DataFrame, cells: DataFrame, batch_size: int = 2048) -> DataFrame:
    """One row a batch: filter_cell_ids, indptr, indices and data of its rows, in order."""
    rows = cells.select("filter_cell_id").join(matrix, "filter_cell_id", "left").withColumn("batch", F.expr(f"cast(floor(filter_cell_id / {batch_size}) as bigint)"))

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["filter_cell_id", "filter_gene_id"])
        counts = frame.groupby("filter_cell_id")["filter_gene_id"].count()
        held = frame.dropna(subset=["filter_gene_id"])
        return pd.DataFrame({"batch": [int(frame["batch"].iloc[0])], "filter_cell_ids": [counts.index.to_numpy()], "indptr": [np.concatenate(([0], counts.cumsum().to_numpy()))], "indices": [held["filter_gene_id"].to_numpy(np.int64)], "data": [held["data"].to_numpy(np.float32)]})

    return rows.groupBy("batch").applyInPandas(make, "batch long, filter_cell_ids array<long>, indptr array<long>, indices array<long>, data array<float>")


def streamed_moments(dense: DataFrame) -> DataFrame:
    """gene, n, mean and m2 from batches: each task merges its batches' counts, means and squared deviations, and one sum merges the tasks (Chan et al.)."""

    def partial(frames):
        n, mean, m2 = 0, 0.0, 0.0
        for frame in frames:
            values = np.stack(frame["values"].to_numpy()).astype(float)
            k, mu = len(values), values.mean(axis=0)
            delta = mu - mean
            m2 = m2 + ((values - mu) ** 2).sum(axis=0) + delta**2 * n * k / (n + k)
            mean = mean + delta * k / (n + k)
            n += k
        if n:
            yield pd.DataFrame({"gene": np.arange(len(mean)), "n": n, "mean": mean, "m2": m2})

    parts = dense.mapInPandas(partial, "gene long, n long, mean double, m2 double")
    total = parts.groupBy("gene").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    between = parts.withColumnsRenamed({"n": "k", "mean": "mu"}).join(total, "gene")
    return between.groupBy("gene").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum(F.col("m2") + F.col("k") * (F.col("mu") - F.col("mean")) ** 2).alias("m2"))


#: Rows of moments that a task gathers before it merges them.
GATHERED = 1 << 20


def _merge(gene: np.ndarray, k: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts, means and squared deviations of equal genes, merged (Chan et al.)."""
    order = np.argsort(gene, kind="stable")
    gene, k, mean, m2 = gene[order], k[order], mean[order], m2[order]
    first = np.ones(len(gene), bool)
    first[1:] = gene[1:] != gene[:-1]
    at = np.flatnonzero(first)
    n = np.add.reduceat(k, at)
    center = np.add.reduceat(k * mean, at) / n
    return gene[at], n, center, np.add.reduceat(m2 + k * (mean - np.repeat(center, np.diff(np.append(at, len(gene))))) ** 2, at)


def _moments(parts):
    """Batches of merged moments of parts, which are merged whenever GATHERED of them are held."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > GATHERED:
            held = [_merge(*map(np.concatenate, zip(*held, strict=True)))]
            size = min(len(held[0][0]), GATHERED // 2)  # so that as many new ones come before the next merge
    if held and any(len(h[0]) for h in held):
        found = _merge(*map(np.concatenate, zip(*held, strict=True)))
        for lo in range(0, len(found[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)]) for c in found], ["gene", "k", "mean", "m2"])


def sparse_moments(rows: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """gene, n, mean and m2 of all genes as streamed_moments gives them, from batches of sparse_rows.

    Each task merges its batches' stored entries by gene, a shuffle brings the tasks' moments together, and the absent
    entries, which number cells less stored ones, are merged last: work and memory go with the stored entries, not
    with cells times genes. They are zero, or the gene's zero_scale_transform where genes has that column.
    """

    def stored(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                gene, v = part.column(0).flatten().to_numpy().astype(np.int64), part.column(1).flatten().to_numpy().astype(float)
                if len(gene):
                    yield _merge(gene, np.ones(len(gene), np.int64), v, np.zeros(len(gene)))

    read = lambda batches: (tuple(c.to_numpy() for c in b.columns) for b in batches if b.num_rows)
    schema = "gene long, k long, mean double, m2 double"
    parts = rows.select("genes", "data").where("genes is not null").mapInArrow(lambda batches: _moments(stored(batches)), schema)
    whole = parts.repartition("gene").mapInArrow(lambda batches: _moments(read(batches)), schema)
    zero = F.coalesce(F.col("zero_scale_transform"), F.lit(0.0)).cast("float").cast("double") if "zero_scale_transform" in genes.columns else F.lit(0.0)
    all_of_them = genes.select(F.col("filter_gene_id").cast("long").alias("gene"), zero.alias("zero")).join(whole, "gene", "left").fillna(0, ["k", "mean", "m2"])
    n, k = F.col("n"), F.col("k")
    counted = all_of_them.crossJoin(F.broadcast(cells.agg(F.count("*").alias("n"))))  # one row
    return counted.where("n > 0").select("gene", "n", ((k * F.col("mean") + (n - k) * F.col("zero")) / n).alias("mean"), (F.col("m2") + k * (n - k) / n * (F.col("mean") - F.col("zero")) ** 2).alias("m2"))
