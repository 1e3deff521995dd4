"""The persistent atlas: versions, verbs in order, accessors, errors; the stream import; the entry points."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparsella.catalog import Atlas
from sparsella.streaming import incremental


@pytest.fixture(scope="module")
def atlas(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    dense = rng.poisson(2.0, (30, 8)).astype(float)
    dense[:10, 0] += 60
    dense[0, 3], dense[:, 6] = 0, 0
    x = spark.createDataFrame(pd.DataFrame([(i, j, dense[i, j]) for i, j in zip(*np.nonzero(dense), strict=True)], columns=["cell_id", "gene_id", "v"]).astype({"cell_id": "int64", "gene_id": "int64"}))
    obs = spark.createDataFrame([(i, f"c{i}", "AB"[i % 2]) for i in range(30)], "cell_id long, cell_name string, label string")
    var = spark.createDataFrame([(j, f"g{j % 7}") for j in range(8)], "gene_id long, gene_name string")
    return Atlas(spark, str(tmp_path_factory.mktemp("atlas"))).load(obs, var, x)


def test_workflow(atlas, spark):
    assert atlas.rename_duplicated_genes()
    assert [r.gene_name for r in atlas.get_var_df().collect()][-1] == "g0_1"
    atlas.filter_cells(min_genes=1)
    atlas.filter_genes(min_cells=1)
    atlas.calculate_qc_metrics({"k": "g1"})
    atlas.normalize_and_log1p()
    atlas.highly_variable_genes(n_top_genes=6)
    atlas.scale()
    with pytest.raises(ValueError):
        atlas.pca(2)
    atlas.build_read_index(use_data="data_scale")
    atlas.pca(2)
    atlas.kmeans("X_pca", n_clusters=2)
    atlas.rank_genes_groups("label", n_genes=3)
    counts = atlas.manual_annotate_clusters({"0": "zero"}, "kmeans", unknown_label="rest")
    assert sum(r.n for r in counts.collect()) == 30
    state = {r.artifact: r.present for r in atlas.workflow_state().collect()}
    assert state["components"] and state["markers"]
    again = Atlas(spark, atlas.path, read_only=True)
    assert again.table_names() == atlas.table_names()
    with pytest.raises(PermissionError):
        again.sqrt()
    ids, values, _ = next(atlas.dense_batches(batch_size=7))
    assert values.shape[0] == 7 and abs(np.vstack([v for _, v, _ in atlas.dense_batches(batch_size=7)]).mean()) < 1e-4
    assert len(list(atlas.dense_batches("multi", 7, max_batches=9, get_obs_col="label"))) == 9
    assert atlas.query("select count(*) n from obs").first().n == 30


def test_accessors(atlas, tmp_path):
    assert [r.cell_id for r in atlas.subset([5, 2])["obs"].collect()] == [5, 2]
    for bad in ([], [1, 1], [1, 999]):
        with pytest.raises(ValueError):
            atlas.subset(bad)
    with pytest.raises(ValueError):
        atlas.get_obs_df("nothing")
    with pytest.raises(ValueError):
        atlas.table("nothing")
    atlas.export(str(tmp_path / "out"))
    assert atlas.spark.read.parquet(str(tmp_path / "out/indptr")).count() == 30


def test_stream_import(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(0, 1, 2.0), (1, 1, 3.0)], "cell_id long, gene_id long, v double").write.parquet(src)
    stream = spark.readStream.schema("cell_id long, gene_id long, v double").parquet(src)
    incremental.append_entries(stream, str(tmp_path / "m"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "m")).agg(F.sum("v")).first()[0] == 5.0
    assert incremental.running_sums(stream).isStreaming


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_layout_round_trip(spark, tmp_path):
    """A layout in and out: order, random order with a seed, several folders, names, arrays as columns; statements and names."""
    obs = spark.createDataFrame([(i, f"c{i}", i % 2) for i in range(8)], "cell_id long, tag string, batch long")
    var = spark.createDataFrame([(j, f"g{j}") for j in range(5)], "gene_id long, gene_name string")
    x = spark.createDataFrame([(i, j, float(60 + i * j)) for i in range(8) for j in range(5) if (i + j) % 3], "cell_id long, gene_id long, v double")
    e = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(8)], "cell_id long, xy array<double>")
    a = Atlas(spark, str(tmp_path / "a")).load(obs, var, x, {"X_test": e})
    a.export(str(tmp_path / "out"))
    one = Atlas(spark, str(tmp_path / "one")).load_layout(str(tmp_path / "out"), cell_name_col="tag")
    cells = lambda t: sorted((r.tag, r.gene_name, r.v) for r in t.query("select tag, gene_name, v from X_data join obs using (cell_id) join var using (gene_id)").collect())
    assert cells(one) == cells(a) and one.get_obs_df("cell_name").count() == 8
    assert [tuple(r) for r in one.get_obsm_df("obsm_X_test").collect()] == [(i, float(i), float(-i)) for i in range(8)]
    turned = [Atlas(spark, str(tmp_path / f"r{k}")).load_layout(str(tmp_path / "out"), "random", seed=s) for k, s in enumerate((3, 3, 4))]
    order = [[r.tag for r in t.get_obs_df().collect()] for t in turned]
    assert order[0] == order[1] != order[2] and all(cells(t) == cells(a) for t in turned)
    assert all(r.dim == int(r.tag[1:]) for r in turned[2].query("select tag, xy_dim_0 as dim from obsm_X_test join obs using (cell_id)".replace("xy_dim_0", "dim_0")).collect())
    two = Atlas(spark, str(tmp_path / "two")).load_layout([str(tmp_path / "out")] * 2)
    assert two.describe()["n_cells"] == 16 and two.table("obsm_X_test").count() == 16
    for wrong in ({"load_type": "other"}, {"cell_name_col": "none"}, {"cell_name_col": "batch"}):
        with pytest.raises(ValueError):
            Atlas(spark, str(tmp_path / "w")).load_layout(str(tmp_path / "out"), **wrong)
    assert a.execute_sql("create table `uns_a.b` as select batch, count(*) as n from obs group by batch") == 2 and a.has_table("uns_a.b")
    assert sorted(r.n for r in a.query_raw("select n from `uns_a.b`")) == [4, 4] and a.execute_sql("drop table `uns_a.b`") == 0 and not a.has_table("uns_a.b")
    a.set_verbosity("error")
    a.set_progress(False)
    with pytest.raises(ValueError):
        a.scale()
    with pytest.raises(ValueError):
        a.set_verbosity("loud")


def test_clone_shares_tables_and_changes_alone(spark, tmp_path):
    x = spark.createDataFrame([(0, 0, 60.0), (1, 1, 3.0), (1, 0, 7.0)], "cell_id long, gene_id long, v double")
    obs, var = spark.range(2).withColumnRenamed("id", "cell_id"), spark.range(2).withColumnRenamed("id", "gene_id").selectExpr("gene_id", "'g' as gene_name")
    a = Atlas(spark, str(tmp_path / "a")).load(obs, var, x)
    b = a.clone(str(tmp_path / "b"))
    b.filter_cells(min_counts=20)
    assert b.has_column("obs", "filter_cells") and not a.has_column("obs", "filter_cells") and b.tables["X_data"] == a.tables["X_data"]
    with pytest.raises(FileExistsError):
        a.clone(str(tmp_path / "b"))
