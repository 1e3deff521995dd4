"""The sparse matrix as a long table (cell_id, gene_id, v) of stored entries; what is not stored is zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running_total

#: Rows of a side that is broadcast; above it Spark chooses.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int | None) -> DataFrame:
    """df, to be broadcast if its known number of rows allows."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def summed(df: DataFrame, cell: str, gene: str, value: str) -> DataFrame:
    """Entries of a long table; equal coordinates are summed."""
    return df.groupBy(F.col(cell).alias("cell_id"), F.col(gene).alias("gene_id")).agg(F.sum(value).alias("v"))


def row_pointers(x: DataFrame, cells: DataFrame, cell: str = "cell_id") -> DataFrame:
    """cell_id and indptr, the inclusive running number of entries, for all cells, those without entries too."""
    counts = x.groupBy("cell_id").agg(F.count("*").alias("nnz"))
    rows = cells.select(F.col(cell).cast("long").alias("cell_id")).join(counts, "cell_id", "left").select("cell_id", F.coalesce("nnz", F.lit(0)).alias("nnz"))
    return running_total(rows, "cell_id", "nnz", "indptr").select("cell_id", F.col("indptr").cast("long").alias("indptr"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def with_columns_from(base: DataFrame, more: DataFrame, key: str, fill: dict | None = None) -> DataFrame:
    """base with the other columns of more, joined by key: columns of the same name are replaced; fill gives values for rows without a match."""
    new = [c for c in more.columns if c != key]
    out = base.drop(*new).join(more, key, "left")
    return out.fillna(fill) if fill else out


def by_ids(table: DataFrame, ids: list[int], key: str) -> DataFrame:
    """Rows of table for a list of ids, in the order of the list (column _order); empty and repeated ids are errors."""
    if not ids:
        raise ValueError("the list of ids is empty")
    if len(set(ids)) != len(ids):
        raise ValueError("the list of ids repeats some")
    wanted = table.sparkSession.createDataFrame(list(enumerate(ids)), f"_order long, {key} long")
    return wanted.join(table, key, "left").orderBy("_order")


def unknown_ids(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return wanted.join(table.select(key), key, "left_anti")
