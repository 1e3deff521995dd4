"""Operators on a hand-checkable matrix with an empty cell, an empty gene and a stored zero, against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparsella.functions import naming, stats
from sparsella.operators import annotate, cluster, hvg, linalg, matrix, plotdata, qc, ranking, readindex, transform
from sparsella.sources import readers

CELLS, GENES = 24, 10


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    dense = rng.poisson(1.0, (CELLS, GENES)).astype(float)
    dense[:8, 1] += 4
    dense[8:16, 2] += 4
    dense[5], dense[:, 7] = 0, 0
    entries = [(i, j, dense[i, j]) for i, j in zip(*np.nonzero(dense), strict=True)] + [(6, 7, 0.0)]
    x = spark.createDataFrame(pd.DataFrame(entries, columns=["cell_id", "gene_id", "v"]).astype({"cell_id": "int64", "gene_id": "int64"})).cache()
    obs = spark.createDataFrame([(i, "ABC"[i // 8]) for i in range(CELLS)], "cell_id long, label string").cache()
    var = spark.createDataFrame([(j, ["MT-1", "RPS2", "x", "x", "x", "mt", "rpl3", "g7", "g8", "g9"][j]) for j in range(GENES)], "gene_id long, gene_name string").cache()
    return dense, x, obs, var


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_filters_count_stored_zeros_and_fail_what_has_no_entry(data):
    dense, x, obs, var = data
    found = by(qc.filter_cells(x, obs), "cell_id", "filter_cells")
    assert not found[5] and sum(found.values()) == CELLS - 1
    genes = by(qc.filter_genes(x, var, min_cells=1), "gene_id", "filter_genes")
    assert genes[7]  # a stored zero counts
    assert not by(qc.filter_genes(x, var, min_counts=1), "gene_id", "filter_genes")[7]


def test_metrics_and_patterns(data):
    dense, x, obs, var = data
    cells, genes = qc.qc_metrics(x, obs, var, {"mt": "MT-", "ribo": "^(RPS|RPL)"})
    assert by(genes, "gene_id", "ribo") == {j: j in (1, 6) for j in range(GENES)}
    assert by(cells, "cell_id", "cell_total_counts") == pytest.approx(dict(enumerate(dense.sum(1))))
    assert by(cells, "cell_id", "pct_counts_ribo")[5] == 0


def test_layers_and_scaling_keep_implicit_zeros(data):
    dense, x, obs, var = data
    log = transform.normalize_and_log1p(x, 100.0).cache()
    total = dense.sum(1, keepdims=True)
    want = np.log1p(np.divide(dense * 100, total, out=np.zeros_like(dense), where=total > 0))
    got = np.zeros_like(dense)
    for r in log.collect():
        got[r.cell_id, r.gene_id] = r.v
    assert np.allclose(got, want)
    layer, zero = transform.scale(log, CELLS)
    z = by(zero, "gene_id", "zero_scale_transform")
    full = np.tile([z.get(j) or 0.0 for j in range(GENES)], (CELLS, 1))
    for r in layer.collect():
        full[r.cell_id, r.gene_id] = r.v
    std = want.std(0)
    assert np.allclose(full, np.divide(want - want.mean(0), std, out=np.zeros_like(want), where=std > 1e-12), atol=1e-6)
    with pytest.raises(ValueError):
        transform.scale(log, CELLS, mode="other")


def test_pointers_and_batches_rebuild_the_matrix(data, spark):
    dense, x, obs, var = data
    p = by(matrix.row_pointers(x, obs), "cell_id", "indptr")
    nnz = (dense != 0).sum(1)
    nnz[6] += 1
    assert [p[i] for i in range(CELLS)] == np.cumsum(nnz).tolist()
    cells, genes = readindex.chosen(obs, "cell_id", "label <> 'B'", "filter_cell_id"), readindex.chosen(var, "gene_id", None, "filter_gene_id")
    m = readindex.filtered_matrix(x, cells, genes).cache()
    kept = np.delete(dense, range(8, 16), axis=0)
    got = list(readindex.batches(readindex.dense_batches(m, cells, np.zeros(GENES), 5)))
    assert [len(ids) for ids, _, _ in got] == [5, 5, 5, 1]
    assert np.allclose(np.vstack([v for _, v, _ in got]), kept)
    turns = [np.concatenate([ids for ids, _, _ in readindex.batches(readindex.dense_batches(m, cells, np.zeros(GENES), 5, 2, seed=1, turn=t))]) for t in (0, 1)]
    assert sorted(turns[0]) == list(range(16)) and sorted(turns[0][:10]) == list(range(10)) and list(turns[0]) != list(turns[1])
    plan = readindex.batch_plan(readindex.filtered_pointers(m, cells), 5).orderBy("batch").collect()
    assert sum(r.nnz for r in plan) == m.count()
    csr = readindex.csr_batches(m, cells, 5).orderBy("batch").collect()
    assert [len(r.indptr) - 1 for r in csr] == [5, 5, 5, 1]
    moments = by(readindex.streamed_moments(readindex.dense_batches(m, cells, np.zeros(GENES), 5)), "gene", "m2")
    assert np.allclose([moments[j] / 15 for j in range(GENES)], kept.var(0, ddof=1))


def test_seurat_bins_follow_pandas(data):
    dense, x, obs, var = data
    log = transform.normalize_and_log1p(x, 100.0)
    got = hvg.seurat(log, var, CELLS, n_bins=4, n_top_genes=3).toPandas().set_index("gene_id").sort_index()
    v = np.zeros_like(dense)
    for r in log.collect():
        v[r.cell_id, r.gene_id] = r.v
    back = np.expm1(v)
    mean, var_ = back.mean(0), back.var(0, ddof=1)
    with np.errstate(divide="ignore"):
        disp = np.log(np.where(var_ > 1e-12, var_ / np.where(mean == 0, 1e-12, mean), np.nan))
    frame = pd.DataFrame({"means": np.log1p(mean), "d": disp})
    groups = frame.groupby(pd.cut(frame["means"], 4), observed=True)["d"]
    avg, dev = groups.transform("mean"), groups.transform("std")
    avg, dev = avg.where(dev.notna(), 0), dev.where(dev.notna(), avg)
    norm = (frame["d"] - avg) / dev.replace(0, np.nan)
    assert np.allclose(got["dispersions_norm"].astype(float), norm, equal_nan=True, atol=1e-6)
    assert got["highly_variable_genes"].sum() == 3
    flat = hvg.seurat(log.where("v < 0"), var, CELLS)
    assert flat.where("dispersions is not null").count() == 0


def test_ranking_matches_a_plain_welch_test(data):
    dense, x, obs, var = data
    got = ranking.rank_genes_groups(x, obs, var, "label", n_genes=None, input_is_log=False).toPandas()
    a, b = dense[:8], dense[8:]
    row = got[(got.group == "A") & (got.gene_id == 1)].iloc[0]
    want = (a[:, 1].mean() - b[:, 1].mean()) / np.sqrt(a[:, 1].var(ddof=1) / 8 + b[:, 1].var(ddof=1) / 16)
    assert row.scores == pytest.approx(want) and 0 < row.pvals < 0.01 and row.pvals_adj >= row.pvals
    assert (got.pvals_adj <= 1).all()
    with pytest.raises(ValueError):
        ranking.rank_genes_groups(x, obs, var.withColumn("none", var.gene_id < 0), "label", mask_var="none")


def test_t_distribution():
    t = np.array([0.0, 1.0, 2.0, 5.0])
    assert np.allclose(stats.t_two_sided(t, np.full(4, 1.0)), 1 - 2 / np.pi * np.arctan(t))
    assert np.allclose(stats.t_two_sided(t, np.full(4, 2.0)), 1 - t / np.sqrt(2 + t * t))
    assert stats.t_two_sided(np.array([1.959964]), np.array([1e7]))[0] == pytest.approx(0.05, abs=1e-6)


def test_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "k int, name string")
    assert [r.name for r in naming.rename_duplicates(df, "name", "k").orderBy("k").collect()] == ["a", "a_1", "b", "a_2"]
    assert sorted(["c10", "c2", None, "c1"], key=naming.natural_key) == ["c1", "c2", "c10", None]


def test_annotation(data):
    _, _, obs, _ = data
    out, table, counts = annotate.annotate(obs, ["x", "y", "x"], "label")
    assert by(out, "cell_id", "cell_type_manual")[9] == "y" and table.count() == 3 and sum(r.n for r in counts.collect()) == CELLS
    for bad, error in (("xyz", TypeError), (["x"], ValueError), ({"Z": "x"}, ValueError), ({1: "x", "1": "y"}, ValueError)):
        with pytest.raises(error):
            annotate.annotate(obs, bad, "label")


def test_grid_counts_absent_entries(data):
    dense, x, obs, var = data
    got = {(r.label, r.gene_id): r for r in plotdata.dotplot(x, obs, var, "label").collect()}
    assert got["A", 1].mean == pytest.approx(dense[:8, 1].mean()) and got["B", 0].percent == pytest.approx((dense[8:16, 0] > 0).mean() * 100)
    assert got["C", 7].mean == 0


def test_principal_components(spark):
    rng = np.random.default_rng(0)
    full = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 12)) + 0.01 * rng.normal(size=(80, 12))
    full -= full.mean(0)
    m = spark.createDataFrame(pd.DataFrame([(i, j, full[i, j]) for i in range(80) for j in range(12)], columns=["filter_cell_id", "filter_gene_id", "data"]))
    cells = spark.createDataFrame([(i,) for i in range(80)], "filter_cell_id long")
    genes = spark.createDataFrame([(j, 0.0) for j in range(12)], "filter_gene_id long, zero_scale_transform double")
    coords, found, loadings = linalg.pca(m, cells, genes, 3)
    _, s, v = np.linalg.svd(full, full_matrices=False)
    assert np.allclose([r.variance for r in found.orderBy("pc_index").collect()], s[:3] ** 2 / 79, rtol=1e-6)
    got = loadings.orderBy("filter_gene_id").toPandas()[["pc0", "pc1", "pc2"]].to_numpy()
    assert np.allclose(np.abs((got * v[:3].T).sum(0)), 1, atol=1e-4) and coords.count() == 80
    with pytest.raises(ValueError):
        linalg.pca(m, cells, genes, 3, centered=False)


def test_clustering_finds_separate_groups(spark):
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(c, 0.3, (40, 5)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "cell long, values array<double>").cache()
    truth = np.repeat([0, 1, 2], 40)
    for labels in (cluster.kmeans(df, 3, seed=3)[0], cluster.graph_clustering(df, 120)[0]):
        got = labels.toPandas().sort_values("cell")["cluster_id"].to_numpy()
        assert sum(np.bincount(got[truth == c]).max() for c in range(3)) >= 0.95 * 120
    near = cluster.nearest(df, 3, block=32).toPandas()
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert set(near[near.cell == 17].neighbor) == set(np.argsort(d[17])[:3].tolist())


def test_readers(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% c\n3 2 4\n1 1 2\n3 1 1\n1 1 3\n2 2 4\n")
    got = sorted(map(tuple, readers.read_matrix_market(spark, str(tmp_path / "m.mtx")).collect()))
    assert got == [(0, 0, 5.0), (0, 2, 1.0), (1, 1, 4.0)]
    (tmp_path / "w.csv").write_text("cell,a,b\nc1,0,60\nc2,3,0\n")
    obs, var, x = readers.load_any(spark, str(tmp_path / "w.csv"))
    assert obs.count() == 2 and sorted(map(tuple, x.collect())) == [(0, 1, 60.0), (1, 0, 3.0)]
    assert readers.is_count_scale(x) and not readers.is_count_scale(x.withColumn("v", x.v / 20))
    obs2, _, x2 = readers.stacked([(obs, var, x), (obs, var, x)])
    assert obs2.count() == 4 and x2.where("cell_id >= 2").count() == 2
    o, m = readers.shuffled(obs2, x2, 5)
    assert sorted(r.cell_id for r in o.collect()) == [0, 1, 2, 3] and sorted(r.v for r in m.collect()) == [3.0, 3.0, 60.0, 60.0]
    with pytest.raises(ValueError):
        readers.load_any(spark, "x.h5ad")


def test_minibatch_kmeans_finds_clouds_and_labels_all(spark):
    rows = [(i, [float(i % 3) * 50 + (i % 7) / 10, float(i % 5)]) for i in range(900)]
    df = spark.createDataFrame(rows, "cell long, values array<double>")
    labels, centers = cluster.minibatch_kmeans(df, 3, seed=2, batch_size=64, fit_batches=6)
    assert {(r["cell"], r["cluster_id"]) for r in labels.collect()} == {(i, i % 3) for i in range(900)} and centers.count() == 6
    with pytest.raises(ValueError):
        cluster.minibatch_kmeans(df.limit(2), 3)


def test_neighbours_on_executors_equal_plain_ones(spark):
    x = np.random.default_rng(3).normal(size=(300, 4))
    index, distance = cluster.neighbours_of(spark, x, 5, step=64)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert (index == np.argsort(d, axis=1)[:, :5]).all() and np.allclose(distance, np.sort(d, axis=1)[:, :5])


def test_graph_clustering_joins_copies_of_points(spark):
    """Twenty copies of each of 60 points in three groups: neighbours among copies alone would make 60 communities."""
    df = spark.createDataFrame([(i, [float(i % 3) * 90, float(i % 60) / 20]) for i in range(1200)], "cell long, values array<double>")
    labels, _, _, scores = cluster.graph_clustering(df, n_neighbors=5, epochs=20)
    got = labels.toPandas()
    assert len(got) == 1200 and scores["n_clusters"] < 30
    assert (got.groupby(["cluster_id"])["cell"].agg(lambda c: (c % 3).value_counts(normalize=True).max()) > 0.95).all()
    sampled, x = cluster.sample_of(df, 100, 3)
    h = df.selectExpr("cell", "xxhash64(cell + 3L) as h").orderBy("h").limit(100)
    assert [r.cell for r in h.collect()] == sampled.tolist() and np.allclose(x[:, 0], sampled % 3 * 90)


def test_louvain_takes_little_of_the_driver():
    """Under 1,400 bytes a point of 15 neighbours; dictionaries took 1,800."""
    import tracemalloc

    index = (np.arange(4000)[:, None] + np.random.default_rng(0).integers(1, 60, (4000, 15))) % 4000
    tracemalloc.start()
    found = cluster.louvain(index, 4000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 4000 and peak < 1400 * 4000, peak


def test_moments_of_stored_entries_equal_those_of_dense_batches(data, spark):
    """Also with absent entries that are not zero; and with 3,000,000 genes, whose dense batches no task could hold."""
    dense, x, obs, var = data
    cells, genes = readindex.chosen(obs, "cell_id", None, "filter_cell_id"), readindex.chosen(var, "gene_id", None, "filter_gene_id")
    m = readindex.filtered_matrix(x, cells, genes).cache()
    rows = readindex.sparse_rows(m, cells, 5)
    zero = np.linspace(-1, 1, GENES).astype(np.float32)
    filled = genes.withColumn("zero_scale_transform", F.element_at(F.array(*[F.lit(float(z)) for z in zero]), F.col("filter_gene_id").cast("int") + 1))
    for g, z in ((genes, np.zeros(GENES)), (filled, zero)):
        want = {r.gene: (r.n, r["mean"], r.m2) for r in readindex.streamed_moments(readindex.dense_batches(m, cells, z, 5)).collect()}
        got = {r.gene: (r.n, r["mean"], r.m2) for r in readindex.sparse_moments(rows, cells, g).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    many = spark.range(3_000_000).withColumnRenamed("id", "filter_gene_id")
    wide = readindex.sparse_moments(readindex.sparse_rows(m.withColumn("filter_gene_id", F.col("filter_gene_id") * 299_999), cells), cells, many)
    assert tuple(wide.agg(F.count("*"), F.sum("n")).first()) == (3_000_000, 3_000_000 * CELLS)
    assert by(wide.where("gene % 299999 = 0 and gene < 2999990"), "gene", "mean") == pytest.approx({j * 299_999: dense[:, j].mean() for j in range(GENES)})


def test_a_shuffled_pass_of_stored_entries_is_that_of_dense_batches(data, spark):
    """Sums are doubles: gene numbers beyond a float's 24 bits are not rounded."""
    dense, x, obs, var = data
    cells, genes = readindex.chosen(obs, "cell_id", None, "filter_cell_id"), readindex.chosen(var, "gene_id", None, "filter_gene_id")
    m = readindex.filtered_matrix(x, cells, genes).cache()
    rows = readindex.row_sums(readindex.sparse_rows(m, cells, 5, 2, seed=1, turn=3)).collect()
    got = {r.filter_cell_id: (r.place, r.batch, r.total, r.weighted) for r in rows}
    full = readindex.dense_batches(m, cells, np.zeros(GENES), 5, 2, seed=1, turn=3).collect()
    assert got == {r.filter_cell_id: (r.place, r.batch, sum(r["values"]), sum((i + 1) * v for i, v in enumerate(r["values"]))) for r in full} and len(full) == CELLS
    far = readindex.row_sums(readindex.sparse_rows(m.withColumn("filter_gene_id", F.col("filter_gene_id") + (1 << 25)), cells, 5))
    weighted = by(far, "filter_cell_id", "weighted")
    assert weighted == {i: sum(v * (j + (1 << 25) + 1) for j, v in enumerate(dense[i])) for i in range(CELLS)}
