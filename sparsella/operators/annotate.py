"""Cluster labels given by hand, and counts by label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import number_then_text


def cluster_list(obs: DataFrame, groupby: str) -> DataFrame:
    return obs.where(F.col(groupby).isNotNull()).select(F.col(groupby).cast("string").alias("cluster_id")).distinct().orderBy(*number_then_text(F.col("cluster_id")))


def annotate(obs: DataFrame, mapping, groupby: str, obs_col: str = "cell_type_manual", unknown_label: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """obs with obs_col; the annotation table; and cluster, type and cells. mapping: a dict by cluster id, or a list in the order of the clusters."""
    if isinstance(mapping, str):
        raise TypeError("mapping must be a dict or a list, not a string")
    known = [r[0] for r in cluster_list(obs, groupby).collect()]  # one row a cluster
    if isinstance(mapping, dict):
        given = [(str(k), v) for k, v in mapping.items()]
        if len({k for k, _ in given}) != len(given):
            raise ValueError("a cluster is named twice")
        if strange := sorted({k for k, _ in given} - set(known)):
            raise ValueError(f"unknown clusters: {strange}")
    else:
        mapping = list(mapping)
        if len(mapping) != len(known):
            raise ValueError(f"{len(mapping)} labels for {len(known)} clusters")
        given = list(zip(known, mapping, strict=True))
    table = obs.sparkSession.createDataFrame([(groupby, k, v, obs_col) for k, v in given], "groupby string, cluster_id string, cell_type string, obs_col string")
    names = table.select(F.col("cluster_id").alias("_c"), F.col("cell_type").alias(obs_col))
    out = obs.drop(obs_col).join(F.broadcast(names), F.col(groupby).cast("string") == F.col("_c"), "left").drop("_c")
    if unknown_label is not None:
        out = out.withColumn(obs_col, F.coalesce(obs_col, F.lit(unknown_label)))
    counts = out.groupBy(F.col(groupby).cast("string").alias("cluster_id"), obs_col).agg(F.count("*").alias("n")).where("cluster_id is not null").orderBy(*number_then_text(F.col("cluster_id")))
    return out, table, counts
