"""Highly variable genes: by variance, by coefficient of variation, and by normalised dispersion in bins of means."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FLAVORS = ("var", "cv", "seurat")


def by_moments(x: DataFrame, var: DataFrame, n_cells: int, flavor: str = "var", n_top_genes: int | None = 2000) -> DataFrame:
    """gene_id, hvg_mean, hvg_var, hvg_std, hvg_nnz, hvg_score and highly_variable_genes, of all genes; equal scores by gene_id."""
    if flavor not in ("var", "cv"):
        raise ValueError("flavor must be var or cv")
    sums = x.where("v is not null").groupBy("gene_id").agg(F.count("*").alias("hvg_nnz"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    rows = var.select("gene_id").join(sums, "gene_id", "left").fillna(0)
    rows = rows.withColumn("hvg_mean", F.col("s") / n_cells).withColumn("hvg_var", F.greatest(F.col("q") / n_cells - F.col("hvg_mean") * F.col("hvg_mean"), F.lit(0.0)))
    rows = rows.withColumn("hvg_std", F.sqrt("hvg_var"))
    score = F.col("hvg_var") if flavor == "var" else F.when(F.col("hvg_mean") > 0, F.col("hvg_std") / F.col("hvg_mean")).otherwise(0.0)
    rows = rows.withColumn("hvg_score", score).drop("s", "q")
    if n_top_genes is None:
        return rows.withColumn("highly_variable_genes", F.lit(True))
    best = rows.orderBy(F.desc("hvg_score"), "gene_id").limit(n_top_genes).select("gene_id", F.lit(True).alias("highly_variable_genes"))
    return rows.join(best, "gene_id", "left").withColumn("highly_variable_genes", F.coalesce("highly_variable_genes", F.lit(False)))


def bin_number(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Which of equal-width bins over [low, high] a value is in, right-closed, by explicit edges; if low = high, the middle one of a widened range."""
    edges = [F.when(value > low + k * ((high - low) / bins), 1).otherwise(0) for k in range(1, bins)]
    return F.when(low == high, (bins - 1) // 2).otherwise(sum(edges[1:], edges[0]) if edges else F.lit(0))


def seurat(x: DataFrame, var: DataFrame, n_cells: int, n_bins: int = 20, n_top_genes: int | None = None, min_mean: float = 0.0125, max_mean: float = 3.0, min_disp: float = 0.5, max_disp: float = math.inf) -> DataFrame:
    """gene_id, means, dispersions, dispersions_norm, highly_variable_rank and highly_variable_genes from a log layer.

    x and var hold the cells and genes to use. The variance is the sample's; dispersions are logarithms
    of variance / mean, null where the variance is 0; a bin of one gene has its own dispersion as
    deviation and 0 as average; a bin without deviation gives null.
    """
    if n_cells < 1:
        raise ValueError("no cell to use")
    back = F.exp("v") - 1
    sums = x.where("v is not null").groupBy("gene_id").agg(F.sum(back).alias("s"), F.sum(back * back).alias("q"))
    rows = var.select("gene_id").join(sums, "gene_id", "left").fillna(0.0)
    mean = F.col("s") / n_cells
    variance = F.greatest((F.col("q") - F.col("s") * F.col("s") / n_cells) / (n_cells - 1), F.lit(0.0)) if n_cells > 1 else F.lit(0.0)
    rows = rows.select("gene_id", mean.alias("mean"), variance.alias("variance"))
    rows = rows.select("gene_id", F.log1p("mean").alias("means"), F.when(F.col("variance") > 0, F.log(F.col("variance") / F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean")))).alias("dispersions"))
    ends = rows.agg(F.min("means").alias("low"), F.max("means").alias("high"))
    rows = rows.crossJoin(F.broadcast(ends)).withColumn("bin", bin_number(F.col("means"), F.col("low"), F.col("high"), n_bins))
    by_bin = rows.groupBy("bin").agg(F.avg("dispersions").alias("avg"), F.stddev_samp("dispersions").alias("dev"))
    rows = rows.join(F.broadcast(by_bin), "bin")  # n_bins rows
    norm = F.when(F.col("dev").isNull(), F.when(F.col("avg") != 0, F.col("dispersions") / F.col("avg"))).when(F.col("dev") == 0, None).otherwise((F.col("dispersions") - F.col("avg")) / F.col("dev"))
    rows = rows.select("gene_id", "means", "dispersions", norm.alias("dispersions_norm"))
    if n_top_genes is None:
        value = F.coalesce("dispersions_norm", F.lit(0.0))
        within = (F.col("means") > min_mean) & (F.col("means") < max_mean) & (value > min_disp) & (value < F.lit(float(max_disp)))
        return rows.withColumn("highly_variable_rank", F.lit(None).cast("long")).withColumn("highly_variable_genes", within)
    rank = F.row_number().over(Window.orderBy(F.round("dispersions_norm", 9).desc_nulls_last(), "gene_id")) - 1  # one row a gene; rounded, so that equal ones tie
    rows = rows.withColumn("highly_variable_rank", F.when(F.col("dispersions_norm").isNotNull(), rank.cast("long")))
    return rows.withColumn("highly_variable_genes", F.coalesce(F.col("highly_variable_rank") < n_top_genes, F.lit(False)))
