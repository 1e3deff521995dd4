"""Quality metrics, filters and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import name_matches
from ..functions.stats import guarded
from .matrix import all_of


def cell_stats(x: DataFrame) -> DataFrame:
    return x.groupBy("cell_id").agg(F.sum("v").alias("total"), F.count("*").alias("nnz"))


def gene_stats(x: DataFrame) -> DataFrame:
    return x.groupBy("gene_id").agg(F.sum("v").alias("total"), F.count("*").alias("nnz"))


def _within(total: Column, nnz: Column, min_counts, max_counts, min_n, max_n) -> Column:
    bounds = [(total, min_counts, "ge"), (total, max_counts, "le"), (nnz, min_n, "ge"), (nnz, max_n, "le")]
    return all_of([c >= b if how == "ge" else c <= b for c, b, how in bounds if b is not None])


def filter_cells(x: DataFrame, obs: DataFrame, min_counts=None, max_counts=None, min_genes=None, max_genes=None, add_data: str = "filter_cells") -> DataFrame:
    """obs with a flag: the cell has entries (stored zeros count), and all given bounds hold."""
    flags = cell_stats(x).select("cell_id", _within(F.col("total"), F.col("nnz"), min_counts, max_counts, min_genes, max_genes).alias(add_data))
    return obs.drop(add_data).join(flags, "cell_id", "left").withColumn(add_data, F.coalesce(add_data, F.lit(False)))


def filter_genes(x: DataFrame, var: DataFrame, min_counts=None, max_counts=None, min_cells=None, max_cells=None, add_data: str = "filter_genes") -> DataFrame:
    """var with a flag, as filter_cells: a gene without entries never passes."""
    flags = gene_stats(x).select("gene_id", _within(F.col("total"), F.col("nnz"), min_counts, max_counts, min_cells, max_cells).alias(add_data))
    return var.drop(add_data).join(flags, "gene_id", "left").withColumn(add_data, F.coalesce(add_data, F.lit(False)))


def cell_total_counts(x: DataFrame, obs: DataFrame, add_data: str = "cell_total_counts") -> DataFrame:
    sums = x.groupBy("cell_id").agg(F.sum("v").alias(add_data))
    return obs.drop(add_data).join(sums, "cell_id", "left").withColumn(add_data, F.coalesce(add_data, F.lit(0.0)))


def gene_total_counts(x: DataFrame, var: DataFrame, n_cells: int, total: str = "gene_total_counts", mean: str = "gene_mean_counts") -> DataFrame:
    sums = x.groupBy("gene_id").agg(F.sum("v").alias(total))
    out = var.drop(total, mean).join(sums, "gene_id", "left").withColumn(total, F.coalesce(total, F.lit(0.0)))
    return out.withColumn(mean, F.col(total) / n_cells if n_cells else F.lit(0.0))


def pattern_flags(var: DataFrame, qc_vars: dict[str, str], name: str = "gene_name") -> DataFrame:
    return var.withColumns({k: F.coalesce(name_matches(F.col(name), p), F.lit(False)) for k, p in qc_vars.items()})


def qc_metrics(x: DataFrame, obs: DataFrame, var: DataFrame, qc_vars: dict[str, str], name: str = "gene_name") -> tuple[DataFrame, DataFrame]:
    """obs with totals, entry counts, and total and percent of each pattern's genes; var with flags, totals and entry counts. One scan for each side."""
    flagged = pattern_flags(var, qc_vars, name)
    marked = x.join(flagged.select("gene_id", *qc_vars), "gene_id")
    sums = marked.groupBy("cell_id").agg(
        F.sum("v").alias("cell_total_counts"),
        F.count("*").alias("n_genes_by_counts"),
        *[F.sum(F.when(F.col(k), F.col("v")).otherwise(0.0)).alias(f"total_counts_{k}") for k in qc_vars],
    )
    percent = {f"pct_counts_{k}": guarded(F.col(f"total_counts_{k}") * 100.0, F.col("cell_total_counts")) for k in qc_vars}
    new = [c for c in sums.columns if c != "cell_id"]
    cells = obs.drop(*new, *percent).join(sums, "cell_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in new}).withColumns(percent)
    by_gene = gene_stats(x).select("gene_id", F.col("total").alias("gene_total_counts"), F.col("nnz").alias("n_cells_by_counts"))
    genes = flagged.drop("gene_total_counts", "n_cells_by_counts").join(by_gene, "gene_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("gene_total_counts", "n_cells_by_counts")})
    return cells, genes
