"""A persistent atlas: Parquet datasets of versions under one folder, and a manifest that names each table's current one.

A verb writes a new version, then replaces the manifest; a failed verb leaves the old state. The
manifest is itself a small Parquet dataset of numbered versions, so any store that Spark writes works.
"""

from __future__ import annotations

import json
import os
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.naming import rename_duplicates
from .operators import annotate, cluster, embed, hvg, linalg, matrix, qc, ranking, readindex, transform
from .sources import readers

ARTIFACTS = {
    "cells": ("obs", None, "cell metadata"),
    "genes": ("var", None, "gene metadata"),
    "counts": ("X_data", None, "stored entries"),
    "cell filter": ("obs", "filter_cells", "cells that pass"),
    "gene filter": ("var", "filter_genes", "genes that pass"),
    "variable genes": ("var", "highly_variable_genes", "genes chosen by variability"),
    "scaled layer": ("X_data_scale", None, "scaled values"),
    "read index": ("X_data_filtered", None, "matrix in reading order"),
    "components": ("obsm_X_pca", None, "principal components"),
    "markers": ("rank_genes_groups", None, "marker ranking"),
    "layout": ("obsm_X_umap", None, "two-dimensional embedding"),
    "k-means clusters": ("obs", "kmeans", "cluster of each cell"),
    "graph clusters": ("obs", "graph_cluster", "cluster of each cell"),
    "annotation": ("manual_cluster_annotation", None, "labels given to clusters"),
}


def quoted(name: str) -> str:
    """A name as an identifier."""
    return "`" + name.replace("`", "``") + "`"


class Atlas:
    """Tables obs, var, X_data and layers, obsm_*, varm_*, uns_*, by name; queries over all of them; verbs that add to them."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        if not isinstance(path, str):
            raise TypeError("path must be a string")
        if not path:
            raise ValueError("path is empty")
        path = os.path.expanduser(path) if path.startswith("~") else path
        self.spark, self.path, self.read_only, self.tables, self.progress = spark, path.rstrip("/"), read_only, {}, False
        self.connect("r" if read_only else "r+")

    # Session and catalog.

    def connect(self, mode: str = "r+") -> Atlas:
        if mode not in ("r", "r+"):
            raise ValueError("mode must be r or r+")
        self.read_only = mode == "r"
        state = self._manifest()
        if state is None and self.read_only:
            raise FileNotFoundError(self.path)
        self.tables = state or {}
        return self

    def close(self) -> None:
        self.tables = {}

    def exists(self) -> bool:
        return self._manifest() is not None

    def __enter__(self) -> Atlas:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _files(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _manifest(self) -> dict | None:
        fs, at = self._files(f"{self.path}/manifest")
        if not fs.exists(at) or not fs.listStatus(at):
            return None
        row = self.spark.read.parquet(f"{self.path}/manifest").orderBy(F.desc("version")).first()
        return json.loads(row["state"]) if row else None

    def _commit(self, changed: dict) -> None:
        if self.read_only:
            raise PermissionError("the atlas is open for reading only")
        fs, at = self._files(f"{self.path}/manifest")
        last = self.spark.read.parquet(f"{self.path}/manifest").agg(F.max("version")).first()[0] if fs.exists(at) else 0
        self.tables = {k: v for k, v in (self.tables | changed).items() if v is not None}
        self.spark.createDataFrame([(last + 1, json.dumps(self.tables))], "version long, state string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def put(self, **frames: DataFrame) -> None:
        """Writes tables and makes them current together."""
        if self.read_only:
            raise PermissionError("the atlas is open for reading only")
        done = {}
        for name, df in frames.items():
            if self.progress:
                print(f"writing {name}", flush=True)
            done[name] = f"{self.path}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(done[name])
        self._commit(done)

    def drop(self, *names: str) -> None:
        self._commit(dict.fromkeys(names))

    def clone(self, path: str) -> Atlas:
        """A new atlas that begins with this one's tables. Versions are never rewritten, so both share their files."""
        other = Atlas(self.spark, path)
        if other.exists():
            raise FileExistsError(path)
        other._commit(dict(self.tables))
        return other

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"no table {name}; there are {self.table_names()}")
        return self.spark.read.parquet(self.tables[name])

    def table_names(self) -> list[str]:
        return sorted(self.tables)

    def has_table(self, name: str) -> bool:
        return name in self.tables

    def table_info(self, name: str) -> list[tuple[str, str]]:
        return self.table(name).dtypes

    def has_column(self, name: str, column: str) -> bool:
        return name in self.tables and column in self.table(name).columns

    def head(self, name: str, n: int = 5) -> DataFrame:
        return self.table(name).limit(n)

    def query(self, sql: str) -> DataFrame:
        """SQL over all tables by name, evaluated when the result is used. A name that is no identifier goes in backticks."""
        for name in self.tables:
            self.table(name).createOrReplaceTempView(quoted(name))
        return self.spark.sql(sql)

    def query_raw(self, sql: str):
        """An iterator over the rows of a query, which come to the driver partition by partition."""
        return self.query(sql).toLocalIterator()

    def execute_sql(self, sql: str) -> int:
        """Runs a statement to its end and gives the number of rows. `create table NAME as QUERY` adds a table, `drop table NAME` takes one away."""
        if made := re.fullmatch(r"\s*create\s+(?:or\s+replace\s+)?table\s+`?([^`\s]+)`?\s+as\s+(.+)", sql, re.I | re.S):
            self.put(**{made[1]: self.query(made[2].rstrip("; \n"))})
            return self.table(made[1]).count()
        if gone := re.fullmatch(r"\s*drop\s+table\s+(?:if\s+exists\s+)?`?([^`\s;]+)`?\s*;?\s*", sql, re.I):
            self.table(gone[1])
            self.drop(gone[1])
            return 0
        return self.query(sql).count()

    def set_verbosity(self, level: str) -> None:
        """What Spark logs from now on: ALL, DEBUG, INFO, WARN, ERROR or OFF."""
        if level.upper() not in ("ALL", "DEBUG", "INFO", "WARN", "ERROR", "OFF"):
            raise ValueError(f"no such level: {level}")
        self.spark.sparkContext.setLogLevel(level.upper())

    def set_progress(self, shown: bool) -> None:
        """Whether verbs name the tables that they write."""
        self.progress = bool(shown)

    def describe(self) -> dict:
        n = lambda t: self.table(t).count() if t in self.tables else 0
        return {"path": self.path, "tables": self.table_names(), "n_cells": n("obs"), "n_genes": n("var")}

    def __repr__(self) -> str:
        return f"Atlas({self.path!r}, {len(self.tables)} tables)"

    def workflow_state(self) -> DataFrame:
        rows = [(k, (t in self.tables) and (c is None or self.has_column(t, c)), t if c is None else f"{t}.{c}", what) for k, (t, c, what) in ARTIFACTS.items()]
        return self.spark.createDataFrame(rows, "artifact string, present boolean, evidence string, meaning string")

    def read_index_info(self) -> DataFrame:
        if "read_index_meta" not in self.tables:
            return self.spark.createDataFrame([], "key string, value string")
        return self.table("read_index_meta").orderBy("key")

    # Import, accessors and export.

    def load(self, obs: DataFrame, var: DataFrame, x: DataFrame, obsm: dict | None = None, varm: dict | None = None, detect_scale: bool = True) -> Atlas:
        """obs (cell_id, ...), var (gene_id, gene_name, ...) and entries (cell_id, gene_id, v): coordinates are summed, logarithms undone, unknown ids refused."""
        x = matrix.summed(x, "cell_id", "gene_id", "v")
        for side, meta in (("cell_id", obs), ("gene_id", var)):
            if not matrix.unknown_ids(x.select(side).distinct(), meta, side).isEmpty():
                raise ValueError(f"entries have a {side} that is not in the metadata")
        x = readers.counts_of(x) if detect_scale else x
        more = {f"obsm_{k}": v for k, v in (obsm or {}).items()} | {f"varm_{k}": v for k, v in (varm or {}).items()}
        self.put(obs=obs, var=var, X_data=x, X_indptr=matrix.row_pointers(x, obs), **more)
        return self

    def load_layout(self, paths: str | list[str], load_type: str = "order", seed: int = 0, cell_name_col: str | None = None, gene_name_col: str | None = None, detect_scale: bool = True) -> Atlas:
        """One or several folders of obs, var, X, obsm_* and varm_* (readers.read_layout), in order or in a random order of the cells that a seed fixes.

        Several must have the same genes; their cells and embeddings are put one after the other. cell_name_col
        and gene_name_col are columns whose values, distinct and without nulls, become the names.
        """
        if load_type not in ("order", "random"):
            raise ValueError("load_type must be order or random")
        parts = [readers.read_layout(self.spark, p) for p in ([paths] if isinstance(paths, str) else paths)]
        if not parts:
            raise ValueError("no path")
        obs, var, x = readers.stacked([p[:3] for p in parts]) if len(parts) > 1 else parts[0][:3]
        obsm, start = dict(parts[0][3]), parts[0][0].count()
        for o, _, _, more, _ in parts[1:]:
            if set(more) != set(obsm):
                raise ValueError("the parts differ in their embeddings")
            obsm = {k: v.unionByName(more[k].withColumn("cell_id", F.col("cell_id") + start)) for k, v in obsm.items()}
            start += o.count()
        obs, var = readers.named(obs, cell_name_col, "cell_name"), readers.named(var, gene_name_col, "gene_name")
        if load_type == "random":
            obs, x, *turned = readers.shuffled(obs, x, seed, *obsm.values())
            obsm = dict(zip(obsm, turned, strict=True))
        return self.load(obs, var, x, obsm, parts[0][4], detect_scale)

    def load_multi_format(self, path: str) -> Atlas:
        obs, var, x = readers.load_any(self.spark, path)
        obs = x.select("cell_id").distinct().withColumn("cell_name", F.col("cell_id").cast("string")) if obs is None else obs
        var = x.select("gene_id").distinct().withColumn("gene_name", F.col("gene_id").cast("string")) if var is None else var
        return self.load(obs, var, x)

    def rename_duplicated_genes(self, column: str = "gene_name") -> bool:
        if "var" not in self.tables:
            return False
        self.put(var=rename_duplicates(self.table("var"), column, "gene_id"))
        return True

    def _columns(self, name: str, key: str | None, columns) -> DataFrame:
        df = self.table(name)
        if columns is None:
            return df
        columns = [columns] if isinstance(columns, str) else list(columns)
        if strange := [c for c in columns if c not in df.columns]:
            raise ValueError(f"{name} has no columns {strange}")
        return df.select(*dict.fromkeys(([key] if key else []) + columns))

    def get_obs_df(self, columns=None) -> DataFrame:
        return self._columns("obs", "cell_id", columns).orderBy("cell_id")

    def get_var_df(self, columns=None) -> DataFrame:
        return self._columns("var", "gene_id", columns).orderBy("gene_id")

    def _prefixed(self, name: str, prefix: str, key: str | None, ids, columns) -> DataFrame:
        if not name.startswith(prefix):
            raise ValueError(f"the table's name must begin with {prefix}")
        df = self._columns(name, key, columns)
        return df.orderBy(key) if key and ids is None else df if ids is None else matrix.by_ids(df, list(ids), key).drop("_order")

    def get_obsm_df(self, name: str, ids=None, columns=None) -> DataFrame:
        return self._prefixed(name, "obsm_", "cell_id", ids, columns)

    def get_varm_df(self, name: str, ids=None, columns=None) -> DataFrame:
        return self._prefixed(name, "varm_", "gene_id", ids, columns)

    def get_uns_df(self, name: str, columns=None) -> DataFrame:
        return self._prefixed(name, "uns_", None, None, columns)

    def layer(self, data_name: str = "data_count") -> DataFrame:
        """cell_id, gene_id and v of a layer; null values are left out."""
        return self.table("X_data" if data_name == "data_count" else f"X_{data_name}").where("v is not null")

    def subset(self, ids: list[int], data_name: str = "data_count") -> dict[str, DataFrame]:
        """obs, var, X and embeddings of some cells, in the order asked for (_order)."""
        obs = matrix.by_ids(self.table("obs").withColumn("_known", F.lit(True)), ids, "cell_id")
        if strange := [r["cell_id"] for r in obs.where("_known is null").limit(5).collect()]:
            raise ValueError(f"unknown cells, such as {strange}")
        order = F.broadcast(obs.select("_order", "cell_id")) if len(ids) <= matrix.BROADCAST_ROWS else obs.select("_order", "cell_id")
        out = {"obs": obs.drop("_known"), "var": self.table("var"), "X": self.layer(data_name).join(order, "cell_id")}
        return out | {k: self.table(k).join(order, "cell_id") for k in self.tables if k.startswith("obsm_")}

    def export(self, path: str, data_name: str = "data_count") -> None:
        """All metadata, embeddings, one layer and its row pointers as Parquet, empty layers too."""
        x = self.layer(data_name)
        matrix.row_pointers(x, self.table("obs")).write.parquet(f"{path}/indptr")
        x.repartitionByRange("cell_id").sortWithinPartitions("cell_id", "gene_id").write.parquet(f"{path}/X")
        for name in self.tables:
            if name in ("obs", "var") or name.startswith(("obsm_", "varm_")):
                self.table(name).write.parquet(f"{path}/{name}")

    # Preprocessing.

    def _n_cells(self) -> int:
        return self.table("obs").count()

    def _lineage(self, name: str, source: str, how: str, centered: bool) -> DataFrame:
        old = self.table("expression_transform_meta").where(F.col("data_name") != name) if "expression_transform_meta" in self.tables else None
        new = self.spark.createDataFrame([(name, source, how, centered)], "data_name string, source_data string, transform string, centered boolean")
        return new if old is None else old.union(new)

    def _add_layer(self, name: str, x: DataFrame, source: str, how: str, centered: bool = False, **more: DataFrame) -> None:
        if not name:
            raise ValueError("the layer needs a name")
        self.put(**{f"X_{name}": x.withColumn("v", F.col("v").cast("float")), "expression_transform_meta": self._lineage(name, source, how, centered), **more})

    def filter_cells(self, **bounds) -> None:
        self.put(obs=qc.filter_cells(self.layer(), self.table("obs"), **bounds))

    def filter_genes(self, **bounds) -> None:
        self.put(var=qc.filter_genes(self.layer(), self.table("var"), **bounds))

    def calculate_cell_total_counts(self, **how) -> None:
        self.put(obs=qc.cell_total_counts(self.layer(), self.table("obs"), **how))

    def calculate_gene_total_counts(self, **how) -> None:
        self.put(var=qc.gene_total_counts(self.layer(), self.table("var"), self._n_cells(), **how))

    def calculate_qc_metrics(self, qc_vars: dict[str, str] | None = None) -> None:
        obs, var = qc.qc_metrics(self.layer(), self.table("obs"), self.table("var"), qc_vars or {"mt": "MT-", "ribo": "^(RPS|RPL)"})
        self.put(obs=obs, var=var)

    def normalize_total(self, target_sum: float = 1e4, add_data: str = "data_normalize") -> None:
        self._add_layer(add_data, transform.normalize_total(self.layer(), target_sum), "data_count", "normalize_total")

    def normalize_total_scale_factor(self, target_sum: float = 1e4) -> None:
        self.put(obs=transform.scale_factors(self.layer(), self.table("obs"), target_sum))

    def log1p(self, base: float | None = None, use_data: str = "data_normalize", add_data: str = "data_log1p") -> None:
        self._add_layer(add_data, transform.log1p(self.layer(use_data), base), use_data, "log1p")

    def normalize_and_log1p(self, target_sum: float = 1e4, base: float | None = None, add_data: str = "data_log1p") -> None:
        self._add_layer(add_data, transform.normalize_and_log1p(self.layer(), target_sum, base), "data_count", "normalize_and_log1p", obs=transform.scale_factors(self.layer(), self.table("obs"), target_sum))

    def sqrt(self, use_data: str = "data_count", add_data: str = "data_sqrt") -> None:
        self._add_layer(add_data, transform.square_root(self.layer(use_data)), use_data, "sqrt")

    def highly_variable_genes(self, flavor: str = "var", n_top_genes: int | None = 2000, use_data: str = "data_log1p", use_filtered: bool = True, inplace: bool = True, **how) -> DataFrame | None:
        x, obs, var = self.layer(use_data), self.table("obs"), self.table("var")
        if flavor == "seurat":
            if use_filtered and "filter_cells" in obs.columns:
                obs = obs.where("filter_cells")
                x = x.join(obs.select("cell_id"), "cell_id", "left_semi")
            genes = var.where("filter_genes") if use_filtered and "filter_genes" in var.columns else var
            if genes.isEmpty():
                raise ValueError("no gene to use")
            found = hvg.seurat(x.join(genes.select("gene_id"), "gene_id", "left_semi"), genes, obs.count(), n_top_genes=n_top_genes, **how)
        else:
            found = hvg.by_moments(x, var, obs.count(), flavor, n_top_genes)
        if not inplace:
            return found
        self.put(var=matrix.with_columns_from(var, found, "gene_id", {"highly_variable_genes": False}))
        return None

    def scale(self, use_data: str = "data_log1p", max_value: float | None = 10.0, use_hvg: bool = True, mode: str = "center_and_scale", add_data: str = "data_scale") -> None:
        var = self.table("var")
        if use_hvg and "highly_variable_genes" not in var.columns:
            raise ValueError("there are no variable genes: call highly_variable_genes, or pass use_hvg=False")
        genes = var.where("highly_variable_genes") if use_hvg else None
        layer, zero = transform.scale(self.layer(use_data), self._n_cells(), genes, mode, max_value)
        self._add_layer(add_data, layer, use_data, f"scale:{mode}", mode != "scale_only", var=matrix.with_columns_from(var, zero, "gene_id"))

    # Read index, batches and analysis.

    def build_read_index(self, cell_condition: str | None = "filter_cells", gene_condition: str | None = "filter_genes", use_hvg: bool = True, use_data: str = "data_log1p") -> None:
        obs, var = self.table("obs"), self.table("var")
        both = " and ".join(f"({c})" for c in ([gene_condition] if gene_condition else []) + (["highly_variable_genes"] if use_hvg else [])) or None
        cells, genes = readindex.chosen(obs, "cell_id", cell_condition, "filter_cell_id"), readindex.chosen(var, "gene_id", both, "filter_gene_id")
        x = readindex.filtered_matrix(self.layer(use_data), cells, genes)
        meta = {"cell_condition": str(cell_condition), "gene_condition": str(gene_condition), "use_hvg": str(use_hvg), "use_data": use_data}
        self.put(X_data_filtered=x, read_index_cells=cells, read_index_genes=genes, X_indptr_filtered=readindex.filtered_pointers(x, cells), read_index_meta=self.spark.createDataFrame(list(meta.items()), "key string, value string"))

    def _index(self) -> tuple[DataFrame, DataFrame, DataFrame, dict | None]:
        if "X_data_filtered" not in self.tables:
            raise ValueError("there is no read index: call build_read_index")
        use = self.table("read_index_meta").where("key = 'use_data'").first()["value"]
        meta = self.table("expression_transform_meta").where(F.col("data_name") == use).first() if "expression_transform_meta" in self.tables else None
        genes = self.table("read_index_genes")
        scaled = meta is not None and meta["transform"].startswith("scale:") and self.has_column("var", "zero_scale_transform")
        zero = self.table("var").select("gene_id", "zero_scale_transform") if scaled else self.table("var").select("gene_id", F.lit(0.0).alias("zero_scale_transform"))
        return self.table("X_data_filtered"), self.table("read_index_cells"), genes.join(zero, "gene_id", "left"), meta

    def dense_batches(self, pass_mode: str = "single", batch_size: int = 2048, max_batches: int | None = None, buffer_batch_num: int = 5, get_obs_col: str | None = None, seed: int = 0):
        """Batches in order (single), or shuffled within buffers and repeated until max_batches (multi)."""
        if get_obs_col in ("batch", "place", "filter_cell_id", "values"):
            raise ValueError(f"{get_obs_col} is a reserved name")
        if pass_mode == "multi" and max_batches is None:
            raise ValueError("a multi-pass stream needs max_batches")
        x, cells, genes, _ = self._index()
        zero = np.array([r[0] for r in genes.orderBy("filter_gene_id").select(F.coalesce("zero_scale_transform", F.lit(0.0))).collect()], np.float32)
        obs = cells.join(self.table("obs").select("cell_id", get_obs_col), "cell_id").select("filter_cell_id", get_obs_col) if get_obs_col else None
        turn = given = 0
        while True:
            for batch in readindex.batches(readindex.dense_batches(x, cells, zero, batch_size, buffer_batch_num, None if pass_mode == "single" else seed, turn, obs)):
                if max_batches is not None and given >= max_batches:
                    return
                given += 1
                yield batch
            turn += 1
            if pass_mode == "single" or not given:
                return

    def csr_batches(self, batch_size: int = 2048) -> DataFrame:
        x, cells, _, _ = self._index()
        return readindex.csr_batches(x, cells, batch_size)

    def pca(self, n_components: int = 30, oversample: int = 200, n_iter: int = 2, random_state: int = 0) -> None:
        x, cells, genes, meta = self._index()
        if meta is None:
            raise ValueError("the read index's layer has no recorded transform: run scale")
        coords, stats, loadings = linalg.pca(x, cells, genes, n_components, oversample, n_iter, random_state, meta["centered"])
        self.put(obsm_X_pca=coords.join(cells, "filter_cell_id").drop("filter_cell_id"), varm_PCs=loadings.join(genes.select("filter_gene_id", "gene_id"), "filter_gene_id").drop("filter_gene_id"), uns_pca_stats=stats)

    def points(self, use_rep: str = "X_pca", n_components: int | None = None) -> DataFrame:
        df = self.table(use_rep if use_rep.startswith("obsm_") else f"obsm_{use_rep}")
        columns = [c for c in df.columns if c != "cell_id"][:n_components]
        return df.select(F.col("cell_id").alias("cell"), F.array(*[F.col(c).cast("double") for c in columns]).alias("values"))

    def kmeans(self, use_rep: str = "X_umap", n_components: int = 30, n_clusters: int = 10, seed: int = 0, batch_size: int = 2048, fit_batches: int | None = 1000) -> None:
        """Mini-batch k-means on at most fit_batches batches; fit_batches None: Lloyd's on all points."""
        points = self.points(use_rep, n_components)
        labels, centers = cluster.kmeans(points, n_clusters, seed) if fit_batches is None else cluster.minibatch_kmeans(points, n_clusters, seed, batch_size, fit_batches)
        named = labels.select(F.col("cell").alias("cell_id"), F.col("cluster_id").alias("kmeans"))
        self.put(obs_cluster=labels.withColumnRenamed("cell", "cell_id"), kmeans_centers=centers, obs=matrix.with_columns_from(self.table("obs"), named, "cell_id"))

    def graph_clustering(self, use_rep: str = "X_pca", **how) -> dict:
        labels, params, scores, out = cluster.graph_clustering(self.points(use_rep), **how)
        named = labels.select(F.col("cell").alias("cell_id"), F.col("cluster_id").alias("graph_cluster"))
        self.put(obs_cluster_distilled_louvain=labels.withColumnRenamed("cell", "cell_id"), uns_graph_clustering_params=params, uns_graph_clustering_eval=scores, obs=matrix.with_columns_from(self.table("obs"), named, "cell_id"))
        return out

    def umap(self, use_rep: str = "X_pca", **how) -> None:
        coords, params, scores = embed.umap(self.points(use_rep), **how)
        self.put(obsm_X_umap=coords.withColumnRenamed("cell", "cell_id"), uns_umap_params=params, uns_umap_eval=scores)

    def rank_genes_groups(self, groupby: str, use_data: str = "data_log1p", **how) -> None:
        self.put(rank_genes_groups=ranking.rank_genes_groups(self.layer(use_data), self.table("obs"), self.table("var"), groupby, **how))

    def manual_annotate_clusters(self, mapping, groupby: str, obs_col: str = "cell_type_manual", unknown_label: str | None = None) -> DataFrame:
        obs, table, counts = annotate.annotate(self.table("obs"), mapping, groupby, obs_col, unknown_label)
        self.put(obs=obs, manual_cluster_annotation=table)
        return counts

    def with_cell_column(self, df: DataFrame) -> None:
        """Writes columns computed elsewhere back to obs by cell_id."""
        if not matrix.unknown_ids(df.select("cell_id"), self.table("obs"), "cell_id").isEmpty():
            raise ValueError("unknown cells")
        self.put(obs=matrix.with_columns_from(self.table("obs"), df, "cell_id"))
