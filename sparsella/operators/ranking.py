"""Marker ranking by Welch's t test, over sums by group and gene; absent entries are zeros."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions.stats import benjamini_hochberg, bonferroni, t_two_sided


def group_sizes(obs: DataFrame, groupby: str) -> DataFrame:
    return obs.where(F.col(groupby).isNotNull()).groupBy(F.col(groupby).cast("string").alias("group")).agg(F.count("*").alias("n"))


def group_sums(x: DataFrame, obs: DataFrame, groupby: str) -> DataFrame:
    """group, gene_id, sum, sum of squares and entries; cells without a label are left out."""
    labels = obs.where(F.col(groupby).isNotNull()).select("cell_id", F.col(groupby).cast("string").alias("group"))
    rows = x.where("v is not null").join(labels, "cell_id")
    return rows.groupBy("group", "gene_id").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("nz"))


def welch(x: DataFrame, obs: DataFrame, genes: DataFrame, groupby: str, groups: list[str] | None = None, reference: str = "rest", input_is_log: bool = True, lfc_eps: float = 1e-9) -> DataFrame:
    """All genes for each group: scores, degrees of freedom, logfoldchanges, means, shares of non-zero cells and sizes.

    reference `rest` is all other labelled cells, also of groups that are not asked for.
    """
    sizes = group_sizes(obs, groupby)
    sums = group_sums(x, obs, groupby)
    wanted = sizes.where(F.col("group") != reference) if reference != "rest" else sizes
    if groups is not None:
        wanted = wanted.where(F.col("group").isin([str(g) for g in groups]))
    grid = genes.select("gene_id").crossJoin(F.broadcast(wanted.withColumnRenamed("n", "n_in")))  # one row a group
    rows = grid.join(sums, ["group", "gene_id"], "left").fillna(0)
    if reference == "rest":
        totals = sums.groupBy("gene_id").agg(F.sum("s").alias("ts"), F.sum("q").alias("tq"), F.sum("nz").alias("tz"))
        rows = rows.join(totals, "gene_id", "left").fillna(0).crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("tn"))))
        rows = rows.withColumns({"n_ref": F.col("tn") - F.col("n_in"), "rs": F.col("ts") - F.col("s"), "rq": F.col("tq") - F.col("q"), "rz": F.col("tz") - F.col("nz")})
    else:
        other = sums.where(F.col("group") == reference).select("gene_id", F.col("s").alias("rs"), F.col("q").alias("rq"), F.col("nz").alias("rz"))
        rows = rows.join(other, "gene_id", "left").fillna(0).crossJoin(F.broadcast(sizes.where(F.col("group") == reference).select(F.col("n").alias("n_ref"))))
    part = lambda s, q, n: F.when(F.col(n) > 1, F.greatest((F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1), F.lit(0.0)) / F.col(n)).otherwise(0.0)
    mean = lambda s, n: F.when(F.col(n) > 0, F.col(s) / F.col(n)).otherwise(0.0)
    rows = rows.withColumns({"a": part("s", "q", "n_in"), "b": part("rs", "rq", "n_ref"), "mean_in": mean("s", "n_in"), "mean_ref": mean("rs", "n_ref"), "pct_nz_in": mean("nz", "n_in"), "pct_nz_ref": mean("rz", "n_ref")})
    a, b = F.col("a"), F.col("b")
    below = F.when(F.col("n_in") > 1, a * a / (F.col("n_in") - 1)).otherwise(0.0) + F.when(F.col("n_ref") > 1, b * b / (F.col("n_ref") - 1)).otherwise(0.0)
    back = (lambda c: F.expm1(c)) if input_is_log else (lambda c: c)
    ratio = (back(F.col("mean_in")) + lfc_eps) / (back(F.col("mean_ref")) + lfc_eps)
    return rows.select("group", F.lit(reference).alias("reference"), "gene_id", F.when(a + b > 0, (F.col("mean_in") - F.col("mean_ref")) / F.sqrt(a + b)).otherwise(0.0).alias("scores"), F.when(below > 0, (a + b) * (a + b) / below).otherwise(1.0).alias("dof"), F.log2(ratio).alias("logfoldchanges"), "mean_in", "mean_ref", "pct_nz_in", "pct_nz_ref", "n_in", "n_ref")


@F.pandas_udf(DoubleType())
def welch_p(score: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(score.to_numpy(), dof.to_numpy()))


def up_and_down(scored: DataFrame, n_genes: int, rankby_abs: bool = False) -> DataFrame:
    """For each group the first n genes of positive fold change by falling score, then of negative by rising score; rank from 0 over both."""
    value = F.abs("scores") if rankby_abs else F.col("scores")
    side = F.when(F.col("logfoldchanges") > 0, 0).when(F.col("logfoldchanges") < 0, 1)
    rows = scored.withColumn("_side", side).where("_side is not null").withColumn("_by", value)
    key = F.col("_by") if rankby_abs else F.when(F.col("_side") == 0, F.col("_by")).otherwise(-F.col("_by"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("group", "_side").orderBy(key.desc(), "gene_id"))).where(F.col("_n") <= n_genes)
    return rows.withColumn("rank", (F.row_number().over(Window.partitionBy("group").orderBy("_side", "_n")) - 1).cast("long")).drop("_side", "_by", "_n")


def rank_genes_groups(x: DataFrame, obs: DataFrame, var: DataFrame, groupby: str, groups: list[str] | None = None, reference: str = "rest", n_genes: int | None = 100, mask_var: str | None = None, corr_method: str = "benjamini-hochberg", rankby_abs: bool = False, input_is_log: bool = True, lfc_eps: float = 1e-9, name: str = "gene_name") -> DataFrame:
    """The ranking with p-values, corrected over all candidate genes of a group before any is cut off."""
    if corr_method not in ("benjamini-hochberg", "bonferroni"):
        raise ValueError("corr_method must be benjamini-hochberg or bonferroni")
    genes = var if mask_var is None else var.where(F.coalesce(F.col(mask_var), F.lit(False)))
    if genes.isEmpty():
        raise ValueError("no candidate gene")
    scored = welch(x, obs, genes, groupby, groups, reference, input_is_log, lfc_eps).withColumn("pvals", welch_p("scores", "dof"))
    scored = benjamini_hochberg(scored, "pvals", "pvals_adj", ["group"], "gene_id") if corr_method == "benjamini-hochberg" else bonferroni(scored, "pvals", "pvals_adj", ["group"])
    if n_genes is None:
        order = Window.partitionBy("group").orderBy((F.abs("scores") if rankby_abs else F.col("scores")).desc(), "gene_id")
        ranked = scored.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    else:
        ranked = up_and_down(scored, n_genes, rankby_abs)
    return ranked.join(genes.select("gene_id", F.col(name).alias("names")), "gene_id").withColumn("method", F.lit("welch-t-test")).select("group", "reference", "rank", "gene_id", "names", "scores", "logfoldchanges", "pvals", "pvals_adj", "mean_in", "mean_ref", "pct_nz_in", "pct_nz_ref", "n_in", "n_ref", "method")
