"""Queries against their SQL in DuckDB, on the smallest shared tables."""

import os

import duckdb
import pytest

from sparsella.plans import queries as plans
from sparsella.plans import sessions  # noqa: F401  (adds its queries to plans)

HERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(HERE), reason="the shared tables are not there")
SOME = ["matrix_indptr", "qc_cell_metrics", "filter_genes", "normalize_log1p", "hvg_seurat_topn", "scale_center_scale", "read_index_matrix", "covariance_matrix", "rank_scores_rest", "rank_topn_updown", "dotplot_scaled", "highest_expr_box", "rename_duplicated", "knn_graph", "rank_bh_bonferroni", "atlas_get_obsm", "atlas_execute_sql", "atlas_random_round_trip", "stream_appended", "shuffled_batches", "pca_covariance", "kmeans_minibatch_blobs", "t_pvalues", "highest_expr_sampled"]


@pytest.mark.parametrize("name", SOME)
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(HERE):
        con.execute(f"create view {t.split('.')[0]} as select * from '{HERE}/{t}'")
    got, want = plans.QUERIES[name](spark, HERE).toPandas(), con.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    columns = sorted(got.columns)
    rows = lambda f: sorted(str([None if v != v else round(float(v), 6) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind in "fiu" or isinstance(v, int) and not isinstance(v, bool) else v for v in r]) for r in f[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)
