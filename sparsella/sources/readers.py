"""Sources: long tables, wide delimited text, Matrix Market, and frames or arrays in memory. Binary single-cell files have no reader without their libraries."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import dense_number

#: Values in the sample that decides the scale, and its limits.
SAMPLE_CELLS, MOST_LOG, MOST_LOG_P95 = 5000, 50.0, 10.0


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share; where it is unset, one of this machine if Spark runs on it alone, else an error."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


def is_count_scale(x: DataFrame, cells: int = SAMPLE_CELLS) -> bool:
    """Counts, rather than logarithms: among the non-zero values of the first cells, the greatest is above 50 or the 95th percentile above 10."""
    first = x.agg(F.min("cell_id")).first()[0] or 0
    found = x.where((F.col("cell_id") < first + cells) & (F.col("v") != 0)).agg(F.max("v").alias("m"), F.percentile("v", 0.95).alias("p")).first()
    if found["m"] is None:
        raise ValueError("no value other than zero: the scale cannot be told")
    return found["m"] > MOST_LOG or found["p"] > MOST_LOG_P95


def to_counts(x: DataFrame) -> DataFrame:
    """Undoes log(1 + v); what falls below zero is zero."""
    return x.withColumn("v", F.greatest(F.expm1("v"), F.lit(0.0)))


def counts_of(x: DataFrame) -> DataFrame:
    return x if is_count_scale(x) else to_counts(x)


def suffix_of(path: str) -> str:
    """The format's suffix, seen through .gz."""
    m = re.search(r"\.([A-Za-z0-9]+)(\.gz)?/*$", path)
    return m[1].lower() if m else ""


def read_wide(spark: SparkSession, path: str, separator: str = ",") -> tuple[DataFrame, DataFrame, DataFrame]:
    """obs, var and entries of a table whose first column names cells and whose other columns are genes."""
    raw = spark.read.option("header", True).option("sep", separator).csv(path)
    name, genes = raw.columns[0], raw.columns[1:]
    return from_wide(raw, name, genes)


def from_wide(raw: DataFrame, name: str, genes: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    numbered = dense_number(raw.withColumn("_row", F.monotonically_increasing_id()), "_row", "cell_id").drop("_row")
    obs = numbered.select("cell_id", F.col(f"`{name}`").alias("cell_name"))
    var = raw.sparkSession.createDataFrame(list(enumerate(genes)), "gene_id long, gene_name string")
    values = F.array(*[F.col(f"`{g}`") for g in genes])  # one array of columns, whatever their number
    x = numbered.select("cell_id", F.posexplode(values).alias("gene_id", "v")).select("cell_id", F.col("gene_id").cast("long").alias("gene_id"), F.col("v").cast("double").alias("v")).where("v <> 0")
    return obs, var, x


def dim_columns(df: DataFrame, array: str, width: int | None = None, name: str = "dim_") -> DataFrame:
    """An array column as numbered columns; width None: that of the longest array."""
    width = df.agg(F.max(F.size(array))).first()[0] or 0 if width is None else width
    return df.select(*[c for c in df.columns if c != array], *[F.get(array, F.lit(i)).cast("double").alias(f"{name}{i}") for i in range(width)])


def named(df: DataFrame, column: str | None, name: str) -> DataFrame:
    """df with its names in column `name`, taken from another column: it must be there, without nulls, each once."""
    if column is None:
        return df
    if column not in df.columns:
        raise ValueError(f"there is no column {column}")
    found = df.agg(F.count("*").alias("n"), F.count(column).alias("k"), F.countDistinct(column).alias("d")).first()
    if found["k"] < found["n"]:
        raise ValueError(f"{column} has nulls")
    if found["d"] < found["n"]:
        raise ValueError(f"{column} repeats names")
    return df.withColumn(name, F.col(column).cast("string"))


def read_layout(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, dict, dict]:
    """obs, var, X, and embeddings of cells and genes by name, of a folder of Parquet tables obs, var, X, obsm_* and varm_*, as Atlas.export writes it. Arrays become numbered columns."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = sorted(f.getPath().getName() for f in hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop))
    if missing := {"obs", "var", "X"} - set(names):
        raise ValueError(f"{path} has no {sorted(missing)}")
    read = lambda t: spark.read.parquet(f"{path}/{t}")

    def flat(df: DataFrame) -> DataFrame:
        for c, kind in df.dtypes:
            if kind.startswith("array"):
                df = dim_columns(df, c)
        return df

    return read("obs"), read("var"), read("X"), *({t[5:]: flat(read(t)) for t in names if t.startswith(k)} for k in ("obsm_", "varm_"))


def read_matrix_market(spark: SparkSession, path: str, genes_by_cells: bool = True) -> DataFrame:
    """Entries of a coordinate file; 1-based rows (genes, unless told otherwise) and columns; equal coordinates are summed. The size line is told by position, not by value."""
    lines = spark.read.text(path).where("value not like '\\%%' and trim(value) <> ''")
    first = spark.read.text(path).where("value not like '\\%%' and trim(value) <> ''").first()
    if first is None:
        raise ValueError(f"{path} has no size line")
    part = F.split(F.trim("value"), r"\s+")
    numbered = lines.withColumn("_i", F.monotonically_increasing_id())
    body = numbered.join(numbered.agg(F.min("_i").alias("_first")), F.col("_i") > F.col("_first"))
    a, b = (part[0].cast("long") - 1), (part[1].cast("long") - 1)
    value = F.when(F.size(part) > 2, F.get(part, F.lit(2)).cast("double")).otherwise(1.0)
    rows = body.select((b if genes_by_cells else a).alias("cell_id"), (a if genes_by_cells else b).alias("gene_id"), value.alias("v"))
    return rows.groupBy("cell_id", "gene_id").agg(F.sum("v").alias("v"))


def from_csr(spark: SparkSession, indptr, indices, data) -> DataFrame:
    """Entries of a compressed row matrix in memory."""
    import pandas as pd

    cells = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    return spark.createDataFrame(pd.DataFrame({"cell_id": cells.astype(np.int64), "gene_id": np.asarray(indices, np.int64), "v": np.asarray(data, float)}), "cell_id long, gene_id long, v double")


def from_arrays(arrays: DataFrame) -> DataFrame:
    """Entries of rows (cell_id, genes, data) that hold a cell's arrays."""
    return arrays.select("cell_id", F.posexplode("genes").alias("_p", "gene_id"), "data").select("cell_id", "gene_id", F.get("data", F.col("_p")).alias("v"))


def stacked(parts: list[tuple[DataFrame, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One matrix from several with the same genes in the same order: cell ids go on from part to part."""
    obs, var, x = parts[0]
    start, own = obs.count(), var.select("gene_id", "gene_name")
    for o, v, m in parts[1:]:
        if not own.exceptAll(v.select("gene_id", "gene_name")).isEmpty() or not v.select("gene_id", "gene_name").exceptAll(own).isEmpty():
            raise ValueError("the parts differ in their genes or the genes' order")
        obs = obs.unionByName(o.withColumn("cell_id", F.col("cell_id") + start), allowMissingColumns=True)
        x = x.unionByName(m.withColumn("cell_id", F.col("cell_id") + start))
        start += o.count()
    return obs, var, x


def shuffled(obs: DataFrame, x: DataFrame, seed: int = 0, *more: DataFrame) -> tuple[DataFrame, ...]:
    """The cells renumbered in a random order that a seed fixes; embeddings go along. Groups by the hash's high bits keep the numbering distributed."""
    order = obs.select("cell_id", F.xxhash64("cell_id", F.lit(seed)).alias("h")).select("cell_id", F.shiftrightunsigned("h", 44).alias("g"), "h")
    sizes = order.groupBy("g").agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window

    before = sizes.select("g", F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # 2**20 rows at most
    new = order.join(before, "g").select("cell_id", (F.col("b") + F.row_number().over(Window.partitionBy("g").orderBy("h", "cell_id")) - 1).alias("new_id"))
    return tuple(df.join(new, "cell_id").drop("cell_id").withColumnRenamed("new_id", "cell_id") for df in (obs, x, *more))


def load_any(spark: SparkSession, path: str):
    """(obs, var, x) by the path's suffix; obs and var are None where the format names neither."""
    kind = suffix_of(path)
    if kind == "parquet":
        return None, None, spark.read.parquet(path)
    if kind == "csv":
        return read_wide(spark, path)
    if kind in ("tsv", "txt", "tab"):
        return read_wide(spark, path, "\t")
    if kind == "mtx":
        return None, None, read_matrix_market(spark, path)
    raise ValueError(f"no reader for .{kind}: parquet, csv, tsv, txt, tab and mtx are read")
