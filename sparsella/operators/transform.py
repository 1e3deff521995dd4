"""Value layers: depth normalisation, logarithm, square root, and zero-aware scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import guarded

MODES = ("center_and_scale", "center_only", "scale_only")


def scale_factors(x: DataFrame, cells: DataFrame, target_sum: float = 1e4, add_data: str = "scale_factor") -> DataFrame:
    """cells with target / total; 0 for cells without a positive total."""
    sums = x.groupBy("cell_id").agg(F.sum("v").alias("_t"))
    return cells.drop(add_data).join(sums, "cell_id", "left").withColumn(add_data, guarded(F.lit(float(target_sum)), F.col("_t"))).drop("_t")


def normalize_total(x: DataFrame, target_sum: float = 1e4) -> DataFrame:
    """v * target / total; cells without a positive total have no entries in the layer."""
    sums = x.groupBy("cell_id").agg(F.sum("v").alias("_t")).where("_t > 0")
    return x.join(sums, "cell_id").select("cell_id", "gene_id", (F.col("v") * float(target_sum) / F.col("_t")).alias("v"))


def _log(value: Column, base: float | None) -> Column:
    if base is not None and (base <= 0 or base == 1):
        raise ValueError("base must be positive and not 1")
    return F.log1p(value) if base is None else F.log(float(base), value + 1.0)


def log1p(x: DataFrame, base: float | None = None) -> DataFrame:
    return x.where("v is not null").select("cell_id", "gene_id", _log(F.col("v"), base).alias("v"))


def normalize_and_log1p(x: DataFrame, target_sum: float = 1e4, base: float | None = None) -> DataFrame:
    """ln(1 + v * factor) in one projection; cells without a positive total keep their entries, as 0."""
    factors = scale_factors(x, x.select("cell_id").distinct(), target_sum)
    return x.where("v is not null").join(factors, "cell_id").select("cell_id", "gene_id", _log(F.col("v") * F.col("scale_factor"), base).alias("v"))


def square_root(x: DataFrame) -> DataFrame:
    return x.where("v is not null").select("cell_id", "gene_id", F.sqrt("v").alias("v"))


def gene_moments(x: DataFrame, n_cells: int) -> DataFrame:
    """gene_id, nnz, mean and population std over all cells, zeros included."""
    sums = x.where("v is not null").groupBy("gene_id").agg(F.count("*").alias("nnz"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    mean = F.col("s") / n_cells
    return sums.select("gene_id", "nnz", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / n_cells - mean * mean, F.lit(0.0))).alias("std"))


def _scaled(value: Column, mode: str, max_value: float | None) -> Column:
    mean, std = F.col("mean"), F.col("std")
    out = {"center_and_scale": guarded(value - mean, std), "center_only": value - mean, "scale_only": guarded(value, std)}[mode]
    return out if mode == "center_only" or max_value is None else F.greatest(F.lit(-float(max_value)), F.least(F.lit(float(max_value)), out))


def zero_transforms(moments: DataFrame, mode: str = "center_and_scale", max_value: float | None = 10.0) -> DataFrame:
    """gene_id and what the layer holds for a zero; a gene without entries has none (its zeros stay 0)."""
    return moments.select("gene_id", _scaled(F.lit(0.0), mode, max_value).alias("zero_scale_transform"))


def scale(x: DataFrame, n_cells: int, genes: DataFrame | None = None, mode: str = "center_and_scale", max_value: float | None = 10.0) -> tuple[DataFrame, DataFrame]:
    """The scaled layer of the stored entries and the genes' zero transforms. genes: gene_id of those to scale; all if None."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if genes is not None:
        if genes.isEmpty():
            raise ValueError("no gene to scale")
        x = x.join(genes.select("gene_id"), "gene_id", "left_semi")
    moments = gene_moments(x, n_cells)
    layer = x.where("v is not null").join(moments, "gene_id").select("cell_id", "gene_id", _scaled(F.col("v"), mode, max_value).alias("v"))
    return layer, zero_transforms(moments, mode, max_value)
