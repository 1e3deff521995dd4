"""Incremental import of a stream of long entries, and running gene moments, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_entries(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends (cell_id, gene_id, v) rows of a stream to a Parquet matrix; with once, all that is there now."""
    writer = stream.select("cell_id", "gene_id", "v").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_sums(stream: DataFrame) -> DataFrame:
    """gene_id, entries, sum and sum of squares so far: what means and variances over all cells follow from."""
    return stream.groupBy("gene_id").agg(F.count("*").alias("nnz"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))


def windowed(stream: DataFrame, time: str, every: str, late: str, *by: str) -> DataFrame:
    """Counts and sums of value by event-time window and keys; rows later than `late` behind the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", *by, "n", "total")
