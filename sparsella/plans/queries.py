"""Queries over the shared tables, each beside its equivalent SQL.

Cells are customers, genes are parts, the matrix is the quantity a customer ordered of a part; groups
are market segments; the embedding is the embeddings table. Floats are rounded where two engines'
sums may differ in the last bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.prefix import dense_number
from ..functions.stats import benjamini_hochberg
from ..operators import annotate, cluster, hvg, linalg, matrix, plotdata, qc, ranking, readindex, transform

QUERIES: dict = {}
ORACLE_SQL: dict = {}

# Texts that the SQL of several queries begins with.
X = "x AS (SELECT o_custkey AS cell_id, l_partkey AS gene_id, SUM(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey)"
T = X + ", tot AS (SELECT cell_id, SUM(v) AS t FROM x GROUP BY cell_id)"
L = T + ", l AS (SELECT x.cell_id, x.gene_id, ln(1 + x.v * CAST(10000.0 AS DOUBLE) / t) AS v FROM x JOIN tot ON x.cell_id = tot.cell_id WHERE t > 0)"
N = L + ", nc AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM customer)"
M = N + ", gm AS (SELECT gene_id, COUNT(*) AS nnz, SUM(v) / MAX(n) AS mean, sqrt(GREATEST(SUM(v * v) / MAX(n) - (SUM(v) / MAX(n)) * (SUM(v) / MAX(n)), 0)) AS std FROM l CROSS JOIN nc GROUP BY gene_id)"
FC = X + ", fc AS (SELECT c_custkey AS cell_id, ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS fcell FROM customer JOIN (SELECT cell_id FROM x GROUP BY cell_id HAVING SUM(v) >= 500) k ON cell_id = c_custkey), fg AS (SELECT p_partkey AS gene_id, ROW_NUMBER() OVER (ORDER BY p_partkey) - 1 AS fgene FROM part WHERE p_size <= 25)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def x_of(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return matrix.summed(lines.join(orders, lines.l_orderkey == orders.o_orderkey), "o_custkey", "l_partkey", "l_quantity")


def obs_of(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").withColumnRenamed("c_custkey", "cell_id")


def var_of(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").withColumnsRenamed({"p_partkey": "gene_id", "p_name": "gene_name"})


def log_of(s: SparkSession, d: str) -> DataFrame:
    return transform.log1p(transform.normalize_total(x_of(s, d)))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + 0.0 for c in columns})


def r6(x: str, digits: int = 6) -> str:
    return f"ROUND(CAST({x} AS DOUBLE), {digits}) + 0.0"


@query(f"WITH {X} SELECT * FROM x")
def matrix_build(s, d):
    return x_of(s, d)


@query(f"WITH {X} SELECT c_custkey AS cell_id, COUNT(gene_id) AS nnz FROM customer LEFT JOIN x ON cell_id = c_custkey GROUP BY c_custkey")
def matrix_nnz_by_cell(s, d):
    n = x_of(s, d).groupBy("cell_id").agg(F.count("*").alias("nnz"))
    return obs_of(s, d).select("cell_id").join(n, "cell_id", "left").fillna(0)


@query(f"WITH {X}, n AS (SELECT c_custkey AS cell_id, COUNT(gene_id) AS nnz FROM customer LEFT JOIN x ON cell_id = c_custkey GROUP BY c_custkey) SELECT cell_id, CAST(SUM(nnz) OVER (ORDER BY cell_id) AS BIGINT) AS indptr FROM n")
def matrix_indptr(s, d):
    return matrix.row_pointers(x_of(s, d), obs_of(s, d))


_PAT = {"mt": "^(red|blue)", "ribo": "small "}


@query(
    f"WITH {X}, f AS (SELECT p_partkey, regexp_matches(p_name, '^(red|blue)', 'i') AS mt, upper(p_name) LIKE 'SMALL %' AS ribo FROM part), q AS (SELECT cell_id, SUM(v) AS t, COUNT(*) AS k, SUM(CASE WHEN mt THEN v ELSE 0 END) AS m, SUM(CASE WHEN ribo THEN v ELSE 0 END) AS r FROM x JOIN f ON gene_id = p_partkey GROUP BY cell_id) "
    f"SELECT c_custkey AS cell_id, COALESCE(t, 0) AS cell_total_counts, COALESCE(k, 0) AS n_genes_by_counts, COALESCE(m, 0) AS total_counts_mt, COALESCE(r, 0) AS total_counts_ribo, {r6('CASE WHEN t > 0 THEN m * 100.0 / t ELSE 0 END')} AS pct_counts_mt, {r6('CASE WHEN t > 0 THEN r * 100.0 / t ELSE 0 END')} AS pct_counts_ribo FROM customer LEFT JOIN q ON cell_id = c_custkey"
)
def qc_cell_metrics(s, d):
    cells, _ = qc.qc_metrics(x_of(s, d), obs_of(s, d).select("cell_id"), var_of(s, d), _PAT)
    return rounded(cells, "pct_counts_mt", "pct_counts_ribo")


@query(f"WITH {X}, q AS (SELECT gene_id, SUM(v) AS t, COUNT(*) AS k FROM x GROUP BY gene_id) SELECT p_partkey AS gene_id, COALESCE(t, 0) AS gene_total_counts, COALESCE(k, 0) AS n_cells_by_counts FROM part LEFT JOIN q ON gene_id = p_partkey")
def qc_gene_metrics(s, d):
    _, genes = qc.qc_metrics(x_of(s, d), obs_of(s, d).select("cell_id"), var_of(s, d), _PAT)
    return genes.select("gene_id", "gene_total_counts", "n_cells_by_counts")


@query("SELECT p_partkey AS gene_id, regexp_matches(p_name, '^(red|blue)', 'i') AS mt, upper(p_name) LIKE 'SMALL %' AS ribo FROM part")
def qc_pattern_flags(s, d):
    return qc.pattern_flags(var_of(s, d), _PAT).select("gene_id", "mt", "ribo")


@query(f"WITH {X}, q AS (SELECT cell_id, SUM(v) AS t, COUNT(*) AS k FROM x GROUP BY cell_id) SELECT c_custkey AS cell_id, COALESCE(t >= 300 AND k >= 10 AND k <= 60, FALSE) AS filter_cells FROM customer LEFT JOIN q ON cell_id = c_custkey")
def filter_cells(s, d):
    return qc.filter_cells(x_of(s, d), obs_of(s, d), min_counts=300, min_genes=10, max_genes=60).select("cell_id", "filter_cells")


@query(f"WITH {X}, q AS (SELECT gene_id, SUM(v) AS t, COUNT(*) AS k FROM x GROUP BY gene_id) SELECT p_partkey AS gene_id, COALESCE(t <= 1000 AND k >= 20, FALSE) AS filter_genes FROM part LEFT JOIN q ON gene_id = p_partkey")
def filter_genes(s, d):
    return qc.filter_genes(x_of(s, d), var_of(s, d), max_counts=1000, min_cells=20).select("gene_id", "filter_genes")


@query(f"WITH {X} SELECT c_custkey AS cell_id, COALESCE(SUM(v), 0) AS cell_total_counts FROM customer LEFT JOIN x ON cell_id = c_custkey GROUP BY c_custkey")
def cell_total_counts(s, d):
    return qc.cell_total_counts(x_of(s, d), obs_of(s, d)).select("cell_id", "cell_total_counts")


@query(f"WITH {X} SELECT p_partkey AS gene_id, COALESCE(SUM(v), 0) AS gene_total_counts, {r6('COALESCE(SUM(v), 0) / (SELECT COUNT(*) FROM customer)')} AS gene_mean_counts FROM part LEFT JOIN x ON gene_id = p_partkey GROUP BY p_partkey")
def gene_mean_counts(s, d):
    out = qc.gene_total_counts(x_of(s, d), var_of(s, d), obs_of(s, d).count())
    return rounded(out.select("gene_id", "gene_total_counts", "gene_mean_counts"), "gene_mean_counts")


@query(f"WITH {T} SELECT c_custkey AS cell_id, {r6('CASE WHEN t > 0 THEN CAST(10000.0 AS DOUBLE) / t ELSE 0 END')} AS scale_factor FROM customer LEFT JOIN tot ON cell_id = c_custkey")
def scale_factor(s, d):
    return rounded(transform.scale_factors(x_of(s, d), obs_of(s, d).select("cell_id")), "scale_factor")


@query(f"WITH {T} SELECT x.cell_id, gene_id, {r6('v * CAST(10000.0 AS DOUBLE) / t')} AS v FROM x JOIN tot ON x.cell_id = tot.cell_id WHERE t > 0")
def normalize_total(s, d):
    return rounded(transform.normalize_total(x_of(s, d)), "v")


@query(f"WITH {L} SELECT cell_id, gene_id, {r6('v')} AS v FROM l")
def log1p_layer(s, d):
    return rounded(log_of(s, d), "v")


@query(f"WITH {X} SELECT cell_id, gene_id, {r6('log2(1 + v)')} AS v FROM x")
def log_base2_layer(s, d):
    return rounded(transform.log1p(x_of(s, d), base=2), "v")


@query(f"WITH {T} SELECT x.cell_id, gene_id, {r6('ln(1 + v * CASE WHEN t > 0 THEN CAST(5000.0 AS DOUBLE) / t ELSE 0 END)')} AS v FROM x JOIN tot ON x.cell_id = tot.cell_id")
def normalize_log1p(s, d):
    return rounded(transform.normalize_and_log1p(x_of(s, d), target_sum=5000), "v")


@query(f"WITH {X} SELECT cell_id, gene_id, {r6('sqrt(v)')} AS v FROM x")
def sqrt_layer(s, d):
    return rounded(transform.square_root(x_of(s, d)), "v")


def _hvg_sql(score: str) -> str:
    return (
        f"WITH {M}, g AS (SELECT p_partkey AS gene_id, COALESCE(mean, 0) AS m, COALESCE(std, 0) AS sd, COALESCE(nnz, 0) AS k FROM part LEFT JOIN gm ON gene_id = p_partkey), o AS (SELECT *, {score} AS sc FROM g), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ROUND(sc, 9) DESC, gene_id) AS rn FROM o) "
        f"SELECT gene_id, {r6('m')} AS hvg_mean, {r6('sd')} AS hvg_std, k AS hvg_nnz, {r6('sc')} AS hvg_score, rn <= 200 AS highly_variable_genes FROM r"
    )


def _hvg(s, d, flavor):
    out = hvg.by_moments(log_of(s, d), var_of(s, d), obs_of(s, d).count(), flavor, 200)
    return rounded(out.drop("hvg_var"), "hvg_mean", "hvg_std", "hvg_score")


@query(_hvg_sql("sd * sd"))
def hvg_var(s, d):
    return _hvg(s, d, "var")


@query(_hvg_sql("CASE WHEN m > 0 THEN sd / m ELSE 0 END"))
def hvg_cv(s, d):
    return _hvg(s, d, "cv")


_EDGES = " + ".join(f"CASE WHEN means > lo + {k} * ((hi - lo) / 20) THEN 1 ELSE 0 END" for k in range(1, 20))
_SEURAT = (
    f"WITH {N}, g AS (SELECT p_partkey AS gene_id, COALESCE(SUM(exp(v) - 1), 0) AS s1, COALESCE(SUM((exp(v) - 1) * (exp(v) - 1)), 0) AS s2 FROM part LEFT JOIN l ON gene_id = p_partkey GROUP BY p_partkey), "
    "h AS (SELECT gene_id, s1 / n AS mean, GREATEST((s2 - s1 * s1 / n) / (n - 1), 0) AS va FROM g CROSS JOIN nc), "
    "i AS (SELECT gene_id, ln(1 + mean) AS means, CASE WHEN va > 0 THEN ln(va / CASE WHEN mean = 0 THEN CAST(1e-12 AS DOUBLE) ELSE mean END) END AS dispersions FROM h), "
    "e AS (SELECT MIN(means) AS lo, MAX(means) AS hi FROM i), "
    f"b AS (SELECT gene_id, means, dispersions, {_EDGES} AS bin FROM i CROSS JOIN e), "
    "c AS (SELECT bin, AVG(dispersions) AS a, STDDEV_SAMP(dispersions) AS sd FROM b GROUP BY bin), "
    "dn AS (SELECT gene_id, means, dispersions, CASE WHEN sd IS NULL THEN CASE WHEN a <> 0 THEN dispersions / a END WHEN sd = 0 THEN NULL ELSE (dispersions - a) / sd END AS norm FROM b JOIN c ON b.bin = c.bin) "
)


@query(_SEURAT + f", r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ROUND(norm, 9) DESC NULLS LAST, gene_id) - 1 AS rk FROM dn) SELECT gene_id, {r6('means')} AS means, {r6('dispersions')} AS dispersions, {r6('norm')} AS dispersions_norm, CASE WHEN norm IS NOT NULL THEN rk END AS highly_variable_rank, norm IS NOT NULL AND rk < 200 AS highly_variable_genes FROM r")
def hvg_seurat_topn(s, d):
    out = hvg.seurat(log_of(s, d), var_of(s, d), obs_of(s, d).count(), n_top_genes=200)
    return rounded(out, "means", "dispersions", "dispersions_norm")


@query(_SEURAT + f"SELECT gene_id, {r6('means')} AS means, {r6('norm')} AS dispersions_norm, means > 0.0125 AND means < 3 AND COALESCE(norm, 0) > 0.5 AS highly_variable_genes FROM dn")
def hvg_seurat_cutoffs(s, d):
    out = hvg.seurat(log_of(s, d), var_of(s, d), obs_of(s, d).count())
    return rounded(out.select("gene_id", "means", "dispersions_norm", "highly_variable_genes"), "means", "dispersions_norm")


def _scale_sql(expr: str) -> str:
    return f"WITH {M} SELECT l.cell_id, l.gene_id, {r6(expr, 5)} AS v FROM l JOIN gm ON l.gene_id = gm.gene_id"


def _scale(s, d, mode, **how):
    layer, _ = transform.scale(log_of(s, d), obs_of(s, d).count(), mode=mode, **how)
    return rounded(layer, "v", digits=5)


@query(_scale_sql("CASE WHEN std > 0 THEN GREATEST(-10, LEAST(10, (v - mean) / std)) ELSE 0 END"))
def scale_center_scale(s, d):
    return _scale(s, d, "center_and_scale")


@query(_scale_sql("v - mean"))
def scale_center_only(s, d):
    return _scale(s, d, "center_only")


@query(_scale_sql("CASE WHEN std > 0 THEN GREATEST(-10, LEAST(10, v / std)) ELSE 0 END"))
def scale_only(s, d):
    return _scale(s, d, "scale_only")


@query(f"WITH {M} SELECT p_partkey AS gene_id, {r6('CASE WHEN std > 0 THEN GREATEST(-10, LEAST(10, -mean / std)) WHEN std IS NOT NULL THEN 0 END')} AS zero_scale_transform FROM part LEFT JOIN gm ON gene_id = p_partkey")
def zero_transform(s, d):
    zero = transform.zero_transforms(transform.gene_moments(log_of(s, d), obs_of(s, d).count()))
    return rounded(var_of(s, d).select("gene_id").join(zero, "gene_id", "left"), "zero_scale_transform")


def _index(s, d):
    x = x_of(s, d)
    obs = qc.filter_cells(x, obs_of(s, d), min_counts=500)
    cells = readindex.chosen(obs.select("cell_id", "filter_cells"), "cell_id", "filter_cells", "filter_cell_id")
    genes = readindex.chosen(var_of(s, d), "gene_id", "p_size <= 25", "filter_gene_id")
    return x, cells, genes


@query(f"WITH {FC} SELECT cell_id, CAST(fcell AS BIGINT) AS filter_cell_id FROM fc")
def read_index_cells(s, d):
    return _index(s, d)[1].select("cell_id", F.col("filter_cell_id").cast("long").alias("filter_cell_id"))


@query(f"WITH {FC} SELECT gene_id, CAST(fgene AS BIGINT) AS filter_gene_id FROM fg")
def read_index_genes(s, d):
    return _index(s, d)[2].select("gene_id", F.col("filter_gene_id").cast("long").alias("filter_gene_id"))


@query(f"WITH {FC} SELECT CAST(fcell AS BIGINT) AS filter_cell_id, CAST(fgene AS BIGINT) AS filter_gene_id, v AS data FROM x JOIN fc ON x.cell_id = fc.cell_id JOIN fg ON x.gene_id = fg.gene_id")
def read_index_matrix(s, d):
    x, cells, genes = _index(s, d)
    return readindex.filtered_matrix(x, cells, genes).withColumns({c: F.col(c).cast("long") for c in ("filter_cell_id", "filter_gene_id")})


@query(f"WITH {FC}, m AS (SELECT fcell, COUNT(fg.gene_id) AS k FROM fc LEFT JOIN x ON x.cell_id = fc.cell_id LEFT JOIN fg ON x.gene_id = fg.gene_id GROUP BY fcell) SELECT CAST(fcell // 128 AS BIGINT) AS batch, CAST(MIN(fcell) AS BIGINT) AS first_cell, CAST(MAX(fcell) AS BIGINT) AS last_cell, COUNT(*) AS n_cells, CAST(SUM(k) AS BIGINT) AS nnz FROM m GROUP BY fcell // 128")
def batch_plan(s, d):
    x, cells, genes = _index(s, d)
    plan = readindex.batch_plan(readindex.filtered_pointers(readindex.filtered_matrix(x, cells, genes), cells), 128)
    return plan.select(*[F.col(c).cast("long").alias(c) for c in ("batch", "first_cell", "last_cell", "n_cells", "nnz")])


@query(f"WITH {FC}, m AS (SELECT fcell, fgene, v FROM fc JOIN x ON x.cell_id = fc.cell_id JOIN fg ON x.gene_id = fg.gene_id) SELECT CAST(fcell // 256 AS BIGINT) AS batch, SUM(v) AS total, SUM(v * (fgene + 1)) AS weighted FROM m GROUP BY fcell // 256")
def dense_batch_checksum(s, d):
    import numpy as np

    x, cells, genes = _index(s, d)
    return readindex.batch_sums(readindex.filtered_matrix(x, cells, genes), cells, np.zeros(genes.count(), np.float32), 256)


@query(f"WITH {FC}, m AS (SELECT fgene, SUM(v) AS s1, SUM(v * v) AS s2 FROM fc JOIN x ON x.cell_id = fc.cell_id JOIN fg ON x.gene_id = fg.gene_id GROUP BY fgene), n AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM fc) SELECT CAST(fg.fgene AS BIGINT) AS gene, {r6('COALESCE(s1, 0) / n')} AS mean, {r6('COALESCE((s2 - s1 * s1 / n) / (n - 1), 0)', 4)} AS variance FROM fg CROSS JOIN n LEFT JOIN m ON m.fgene = fg.fgene")
def minibatch_streaming_moments(s, d):
    x, cells, genes = _index(s, d)
    out = readindex.sparse_moments(readindex.sparse_rows(readindex.filtered_matrix(x, cells, genes), cells, 256), cells, genes)
    return rounded(rounded(out.select("gene", "mean", (F.col("m2") / (F.col("n") - 1)).alias("variance")), "mean"), "variance", digits=4)


_TOP = "g30 AS (SELECT gene_id FROM x GROUP BY gene_id ORDER BY SUM(v) DESC, gene_id LIMIT 30)"


def _top_genes(x: DataFrame, n: int = 30) -> DataFrame:
    return x.groupBy("gene_id").agg(F.sum("v").alias("s")).orderBy(F.desc("s"), "gene_id").limit(n).select("gene_id")


_VARIABLE = "vg AS (SELECT p_partkey AS gene_id, COALESCE(std, 0) AS sd FROM part LEFT JOIN gm ON gene_id = p_partkey), g30 AS (SELECT gene_id FROM vg ORDER BY ROUND(sd * sd, 9) DESC, gene_id LIMIT 200)"


def _variable(s, d, n: int) -> DataFrame:
    """The genes that the variance flavor chooses."""
    return hvg.by_moments(log_of(s, d), var_of(s, d), obs_of(s, d).count(), "var", n).where("highly_variable_genes").select("gene_id")


@query(f"WITH {M}, {_VARIABLE}, k AS (SELECT l.* FROM l JOIN g30 ON l.gene_id = g30.gene_id), m AS (SELECT gene_id, SUM(v) AS s FROM k GROUP BY gene_id), c AS (SELECT a.gene_id AS a, b.gene_id AS b, SUM(a.v * b.v) AS p FROM k a JOIN k b ON a.cell_id = b.cell_id GROUP BY a.gene_id, b.gene_id) SELECT ma.gene_id AS gene_a, mb.gene_id AS gene_b, {r6('(COALESCE(p, 0) - ma.s * mb.s / n) / (n - 1)')} AS covariance FROM m ma CROSS JOIN m mb CROSS JOIN nc LEFT JOIN c ON c.a = ma.gene_id AND c.b = mb.gene_id")
def covariance_matrix(s, d):
    return rounded(linalg.covariance(log_of(s, d).join(_variable(s, d, 200), "gene_id", "left_semi"), obs_of(s, d).count()), "covariance")


_RANK = (
    f"WITH {L}, gn AS (SELECT c_mktsegment AS grp, CAST(COUNT(*) AS DOUBLE) AS n FROM customer GROUP BY c_mktsegment), nt AS (SELECT SUM(n) AS tn FROM gn), "
    "gg AS (SELECT c_mktsegment AS grp, gene_id, SUM(v) AS s, SUM(v * v) AS q, COUNT(*) AS nz FROM l JOIN customer ON cell_id = c_custkey GROUP BY c_mktsegment, gene_id), "
    "gt AS (SELECT gene_id, SUM(s) AS ts, SUM(q) AS tq, SUM(nz) AS tz FROM gg GROUP BY gene_id), "
)
_REST = "j AS (SELECT gn.grp, p_partkey AS gene_id, gn.n AS n1, tn - gn.n AS n2, COALESCE(s, 0) AS s1, COALESCE(q, 0) AS q1, COALESCE(nz, 0) AS z1, COALESCE(ts, 0) - COALESCE(s, 0) AS s2, COALESCE(tq, 0) - COALESCE(q, 0) AS q2, COALESCE(tz, 0) - COALESCE(nz, 0) AS z2, p_size FROM gn CROSS JOIN nt CROSS JOIN part LEFT JOIN gg ON gg.grp = gn.grp AND gg.gene_id = p_partkey LEFT JOIN gt ON gt.gene_id = p_partkey), "
_ONE = "j AS (SELECT gn.grp, p_partkey AS gene_id, gn.n AS n1, rn.n AS n2, COALESCE(gg.s, 0) AS s1, COALESCE(gg.q, 0) AS q1, COALESCE(gg.nz, 0) AS z1, COALESCE(rf.s, 0) AS s2, COALESCE(rf.q, 0) AS q2, COALESCE(rf.nz, 0) AS z2, p_size FROM gn JOIN gn rn ON rn.grp = 'BUILDING' AND gn.grp <> 'BUILDING' CROSS JOIN part LEFT JOIN gg ON gg.grp = gn.grp AND gg.gene_id = p_partkey LEFT JOIN gg rf ON rf.grp = 'BUILDING' AND rf.gene_id = p_partkey), "
_WELCH = (
    "w AS (SELECT grp, gene_id, p_size, n1, n2, z1 / n1 AS f1, z2 / n2 AS f2, s1 / n1 AS m1, s2 / n2 AS m2, GREATEST((q1 - s1 * s1 / n1) / (n1 - 1), 0) / n1 AS a, GREATEST((q2 - s2 * s2 / n2) / (n2 - 1), 0) / n2 AS b FROM j), "
    "k AS (SELECT *, CASE WHEN a + b > 0 THEN (m1 - m2) / sqrt(a + b) ELSE 0 END AS sc, log2((exp(m1) - 1 + 1e-9) / (exp(m2) - 1 + 1e-9)) AS lfc FROM w)"
)
_SCORES = f" SELECT grp, gene_id, {r6('sc', 5)} AS scores, {r6('m1')} AS mean_in, {r6('m2')} AS mean_ref, {r6('f1')} AS pct_nz_in, {r6('f2')} AS pct_nz_ref FROM k"


def _welch(s, d, **how):
    return ranking.welch(log_of(s, d), obs_of(s, d), how.pop("genes", var_of(s, d)), "c_mktsegment", **how)


def _scores(df):
    out = df.select(F.col("group").alias("grp"), "gene_id", "scores", "mean_in", "mean_ref", "pct_nz_in", "pct_nz_ref")
    return rounded(rounded(out, "scores", digits=5), "mean_in", "mean_ref", "pct_nz_in", "pct_nz_ref")


@query(_RANK + _REST + _WELCH + _SCORES)
def rank_scores_rest(s, d):
    return _scores(_welch(s, d))


@query(_RANK + _ONE + _WELCH + _SCORES)
def rank_scores_reference(s, d):
    return _scores(_welch(s, d, reference="BUILDING"))


@query(_RANK + _REST + _WELCH + _SCORES + " WHERE p_size <= 10")
def rank_masked(s, d):
    return _scores(_welch(s, d, genes=var_of(s, d).where("p_size <= 10")))


@query(
    _RANK + _REST + _WELCH + ", u AS (SELECT grp, gene_id, 0 AS side, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY ROUND(sc, 9) DESC, gene_id) AS n, sc FROM k WHERE lfc > 0 UNION ALL SELECT grp, gene_id, 1, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY ROUND(sc, 9), gene_id), sc FROM k WHERE lfc < 0) "
    f"SELECT grp, gene_id, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY side, n) - 1 AS rank, {r6('sc', 5)} AS scores FROM u WHERE n <= 15"
)
def rank_topn_updown(s, d):
    top = ranking.up_and_down(_welch(s, d).withColumn("scores", F.round("scores", 9)), 15)
    return rounded(top.select(F.col("group").alias("grp"), "gene_id", "rank", "scores"), "scores", digits=5)


@query(
    "WITH p AS (SELECT p_brand AS grp, p_partkey AS gene_id, CAST(p_partkey * 7919 % 1009 AS DOUBLE) / 1009 AS pval FROM part), r AS (SELECT *, COUNT(*) OVER (PARTITION BY grp) AS n, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY pval, gene_id) AS k FROM p) "
    f"SELECT grp, gene_id, {r6('LEAST(1, MIN(pval * n / k) OVER (PARTITION BY grp ORDER BY k DESC))')} AS bh, {r6('LEAST(1, pval * n)')} AS bonf FROM r"
)
def rank_bh_bonferroni(s, d):
    from ..functions.stats import bonferroni

    p = table(s, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("gene_id"), ((F.col("p_partkey") * 7919 % 1009).cast("double") / 1009).alias("pval"))
    out = bonferroni(benjamini_hochberg(p, "pval", "bh", ["grp"], "gene_id"), "pval", "bonf", ["grp"])
    return rounded(out.select("grp", "gene_id", "bh", "bonf"), "bh", "bonf")


@query()
def rank_pvalues_bh(s, d):
    return ranking.rank_genes_groups(log_of(s, d), obs_of(s, d), var_of(s, d), "c_mktsegment", n_genes=50)


_LABELS = {"AUTOMOBILE": "wheels", "BUILDING": "bricks", "FURNITURE": "bricks"}


@query("SELECT c_custkey AS cell_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'wheels' WHEN 'BUILDING' THEN 'bricks' WHEN 'FURNITURE' THEN 'bricks' ELSE 'other' END AS cell_type_manual FROM customer")
def annotate_clusters(s, d):
    obs = obs_of(s, d)
    known = {r[0] for r in annotate.cluster_list(obs, "c_mktsegment").collect()}
    return annotate.annotate(obs, {k: v for k, v in _LABELS.items() if k in known}, "c_mktsegment", unknown_label="other")[0].select("cell_id", "cell_type_manual")


@query(f"SELECT c_mktsegment AS label, COUNT(*) AS n, {r6('COUNT(*) * 100.0 / (SELECT COUNT(*) FROM customer)')} AS percent FROM customer GROUP BY c_mktsegment")
def cluster_sizes(s, d):
    return rounded(plotdata.cluster_size(obs_of(s, d), "c_mktsegment"), "percent")


@query("SELECT c_mktsegment AS first, c_nationkey AS second, COUNT(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey")
def annotation_contingency(s, d):
    return plotdata.contingency(obs_of(s, d), "c_mktsegment", "c_nationkey")


@query(f"WITH {X}, q AS (SELECT cell_id, SUM(v) AS t, COUNT(*) AS k FROM x GROUP BY cell_id) SELECT c_mktsegment AS label, median(COALESCE(t, 0)) AS median_total, median(CAST(COALESCE(k, 0) AS DOUBLE)) AS median_genes FROM customer LEFT JOIN q ON cell_id = c_custkey GROUP BY c_mktsegment")
def cluster_qc_medians(s, d):
    stats = obs_of(s, d).join(qc.cell_stats(x_of(s, d)), "cell_id", "left").fillna(0)
    return stats.groupBy(F.col("c_mktsegment").alias("label")).agg(F.median("total").alias("median_total"), F.median(F.col("nnz").cast("double")).alias("median_genes"))


@query("SELECT p_partkey AS gene_id, CASE WHEN ROW_NUMBER() OVER w > 1 THEN p_name || '_' || CAST(ROW_NUMBER() OVER w - 1 AS VARCHAR) ELSE p_name END AS gene_name FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)")
def rename_duplicated(s, d):
    return naming.rename_duplicates(var_of(s, d).select("gene_id", "gene_name"), "gene_name", "gene_id")


_GRID = f"WITH {L}, {_TOP}, gn AS (SELECT c_mktsegment AS label, CAST(COUNT(*) AS DOUBLE) AS n FROM customer GROUP BY c_mktsegment), sm AS (SELECT c_mktsegment AS label, l.gene_id, SUM(v) AS s, SUM(CASE WHEN v > 0.5 THEN 1 ELSE 0 END) AS k FROM l JOIN customer ON cell_id = c_custkey GROUP BY c_mktsegment, l.gene_id), gr AS (SELECT gn.label, g30.gene_id, COALESCE(s, 0) / n AS mean, COALESCE(k, 0) * 100.0 / n AS percent FROM gn CROSS JOIN g30 LEFT JOIN sm ON sm.label = gn.label AND sm.gene_id = g30.gene_id) "


@query(_GRID + f"SELECT label, gene_id, {r6('mean')} AS mean, {r6('percent')} AS percent FROM gr")
def dotplot_stats(s, d):
    return rounded(plotdata.dotplot(log_of(s, d), obs_of(s, d), _top_genes(x_of(s, d)), "c_mktsegment", 0.5), "mean", "percent")


@query(_GRID + f", sc AS (SELECT *, MIN(mean) OVER (PARTITION BY gene_id) AS lo, MAX(mean) OVER (PARTITION BY gene_id) AS hi FROM gr) SELECT label, gene_id, {r6('CASE WHEN hi > lo THEN (mean - lo) / (hi - lo) ELSE 0 END')} AS mean FROM sc")
def dotplot_scaled(s, d):
    return rounded(plotdata.dotplot(log_of(s, d), obs_of(s, d), _top_genes(x_of(s, d)), "c_mktsegment", 0.5, standard_scale=True).drop("percent"), "mean")


@query(f"WITH {L}, g5 AS (SELECT gene_id FROM x GROUP BY gene_id ORDER BY SUM(v) DESC, gene_id LIMIT 5), vv AS (SELECT c_mktsegment AS label, g5.gene_id, COALESCE(v, 0) AS value FROM customer CROSS JOIN g5 LEFT JOIN l ON l.cell_id = c_custkey AND l.gene_id = g5.gene_id) SELECT label, gene_id, {r6('quantile_cont(value, 0.25)')} AS q1, {r6('quantile_cont(value, 0.5)')} AS q2, {r6('quantile_cont(value, 0.75)')} AS q3, {r6('MAX(value)')} AS top FROM vv GROUP BY label, gene_id")
def violin_values_quantiles(s, d):
    values = plotdata.violin_values(log_of(s, d), obs_of(s, d), _top_genes(x_of(s, d), 5), "c_mktsegment")
    out = values.groupBy("label", "gene_id").agg(F.percentile("value", 0.25).alias("q1"), F.percentile("value", 0.5).alias("q2"), F.percentile("value", 0.75).alias("q3"), F.max("value").alias("top"))
    return rounded(out, "q1", "q2", "q3", "top")


_PCT = f"WITH {T}, pc AS (SELECT x.cell_id, gene_id, v * 100.0 / t AS value FROM x JOIN tot ON x.cell_id = tot.cell_id WHERE t > 0), tp AS (SELECT gene_id, mp FROM (SELECT gene_id, SUM(value) / (SELECT COUNT(*) FROM customer) AS mp FROM pc GROUP BY gene_id) ORDER BY ROUND(mp, 9) DESC, gene_id LIMIT 20) "


@query(_PCT + f"SELECT gene_id, {r6('mp')} AS mean_percent FROM tp")
def highest_expr_mean_pct(s, d):
    return rounded(plotdata.highest_expressed(x_of(s, d), obs_of(s, d).count()), "mean_percent")


@query(
    _PCT + ", vv AS (SELECT tp.gene_id, COALESCE(value, 0) AS value FROM customer CROSS JOIN tp LEFT JOIN pc ON pc.cell_id = c_custkey AND pc.gene_id = tp.gene_id), q AS (SELECT gene_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM vv GROUP BY gene_id) "
    f"SELECT q.gene_id, {r6('q1')} AS q1, {r6('q2')} AS q2, {r6('q3')} AS q3, {r6('MIN(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END)')} AS low, {r6('MAX(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END)')} AS high FROM vv JOIN q ON q.gene_id = vv.gene_id GROUP BY q.gene_id, q1, q2, q3"
)
def highest_expr_box(s, d):
    box = plotdata.highest_expressed_box(x_of(s, d), obs_of(s, d), obs_of(s, d).count())
    return rounded(box.drop("mean_percent"), "q1", "q2", "q3", "low", "high")


@query(f"WITH {X} SELECT cell_id, c_mktsegment, p_name AS gene_name, v FROM x JOIN customer ON cell_id = c_custkey JOIN part ON gene_id = p_partkey WHERE p_name LIKE 'red%'")
def marker_expression(s, d):
    genes = var_of(s, d).where("gene_name like 'red%'").select("gene_id", "gene_name")
    return x_of(s, d).join(genes, "gene_id").join(obs_of(s, d).select("cell_id", "c_mktsegment"), "cell_id").select("cell_id", "c_mktsegment", "gene_name", "v")


@query(f"WITH {X} SELECT c_mktsegment, gene_id, {r6('AVG(v)')} AS mean_nonzero, COUNT(*) AS n FROM x JOIN customer ON cell_id = c_custkey WHERE v > 0 GROUP BY c_mktsegment, gene_id")
def mean_nonzero(s, d):
    out = x_of(s, d).where("v > 0").join(obs_of(s, d).select("cell_id", "c_mktsegment"), "cell_id").groupBy("c_mktsegment", "gene_id").agg(F.avg("v").alias("mean_nonzero"), F.count("*").alias("n"))
    return rounded(out, "mean_nonzero")


@query(_GRID.replace(_TOP, "g30 AS (SELECT p_partkey AS gene_id FROM part)") + f"SELECT label AS c_mktsegment, gene_id, {r6('mean')} AS mean_all, {r6('percent')} AS percent_above FROM gr")
def mean_all_cells(s, d):
    out = plotdata.dotplot(log_of(s, d), obs_of(s, d), var_of(s, d), "c_mktsegment", 0.5)
    return rounded(out.withColumnsRenamed({"label": "c_mktsegment", "mean": "mean_all", "percent": "percent_above"}), "mean_all", "percent_above")


@query(f"WITH {X} SELECT (SELECT COUNT(*) FROM customer) AS n_cells, (SELECT COUNT(*) FROM part) AS n_genes, (SELECT COUNT(*) FROM x) AS nnz")
def atlas_size(s, d):
    return obs_of(s, d).agg(F.count("*").alias("n_cells")).crossJoin(var_of(s, d).agg(F.count("*").alias("n_genes"))).crossJoin(x_of(s, d).agg(F.count("*").alias("nnz")))


@query("SELECT vec_id AS cell_id, c_mktsegment, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS dim_{i}" for i in range(64)) + " FROM embeddings JOIN customer ON c_custkey = vec_id")
def embedding_join(s, d):
    from ..sources.readers import dim_columns

    e = dim_columns(table(s, d, "embeddings").select(F.col("vec_id").alias("cell_id"), "embedding"), "embedding")
    return e.join(obs_of(s, d).select("cell_id", "c_mktsegment"), "cell_id")


@query(f"SELECT CAST(label AS VARCHAR) AS label, {r6('median(CAST(embedding[1] AS DOUBLE))')} AS x, {r6('median(CAST(embedding[2] AS DOUBLE))')} AS y, COUNT(*) AS n FROM embeddings GROUP BY label")
def label_centers(s, d):
    points = table(s, d, "embeddings").select("label", *[F.get("embedding", i).cast("double").alias(f"dim_{i}") for i in (0, 1)])
    return rounded(plotdata.label_centers(points, "label", "dim_0", "dim_1"), "x", "y")


@query("SELECT k._order, k.cell_id, c_name FROM (VALUES (0, 42), (1, 7), (2, 99), (3, 3), (4, 100000000)) k(_order, cell_id) LEFT JOIN customer ON c_custkey = k.cell_id")
def obs_subset_ordered(s, d):
    out = matrix.by_ids(obs_of(s, d).select("cell_id", "c_name"), [42, 7, 99, 3, 100000000], "cell_id")
    return out.select(F.col("_order").cast("int").alias("_order"), F.col("cell_id").cast("int").alias("cell_id"), "c_name")


@query("SELECT c_custkey AS cell_id, c_mktsegment FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 1103515245 + 7) % 2147483648, c_custkey) AS n FROM customer) WHERE n <= 10")
def hash_sample(s, d):
    return plotdata.sampled(obs_of(s, d).select("cell_id", "c_mktsegment"), 10, "cell_id", 7, "c_mktsegment")


@query("SELECT o_custkey AS cell_id FROM (SELECT DISTINCT o_custkey FROM orders) o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) c ON c_custkey = o_custkey WHERE c_custkey IS NULL")
def unknown_ids(s, d):
    wanted = table(s, d, "orders").select(F.col("o_custkey").alias("cell_id")).distinct()
    return matrix.unknown_ids(wanted, obs_of(s, d).where("c_nationkey < 12"), "cell_id")


@query(f"WITH {X} SELECT p_partkey AS gene_id FROM part WHERE p_partkey NOT IN (SELECT gene_id FROM x WHERE v >= 45)")
def genes_without_rows(s, d):
    return matrix.unknown_ids(var_of(s, d).select("gene_id"), x_of(s, d).where("v >= 45"), "gene_id")


@query("WITH a AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS e FROM embeddings), p AS (SELECT a.vec_id AS cell, b.vec_id AS neighbor, SUM((CAST(a.e AS DOUBLE) - CAST(b.e AS DOUBLE)) * (CAST(a.e AS DOUBLE) - CAST(b.e AS DOUBLE))) AS d2 FROM a JOIN a b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell ORDER BY ROUND(d2, 9), neighbor) AS rank FROM p) SELECT cell, neighbor, rank FROM r WHERE rank <= 15")
def knn_graph(s, d):
    return cluster.nearest(table(s, d, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").alias("values")), 15).select("cell", "neighbor", F.col("rank").cast("long").alias("rank"))


@query("WITH c AS (SELECT vec_id AS k, embedding AS ce FROM embeddings WHERE vec_id < 5), a AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS e FROM embeddings), b AS (SELECT k, generate_subscripts(ce, 1) AS i, unnest(ce) AS f FROM c), p AS (SELECT vec_id, k, SUM((CAST(e AS DOUBLE) - CAST(f AS DOUBLE)) * (CAST(e AS DOUBLE) - CAST(f AS DOUBLE))) AS d2 FROM a JOIN b ON a.i = b.i GROUP BY vec_id, k) SELECT vec_id AS cell, CAST(k AS INTEGER) AS cluster_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY ROUND(d2, 9), k) AS n FROM p) WHERE n = 1")
def kmeans_assign_fixed(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").alias("values"))
    centers = [r["values"] for r in e.where("cell < 5").orderBy("cell").collect()]
    return cluster.assigned(e, centers).select("cell", "cluster_id")


@query()
def kmeans_lloyd(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").alias("values"))
    return cluster.kmeans(e, 8, seed=1)[0].select("cell", "cluster_id")


@query()
def pca_variance(s, d):
    _, stats, _ = _pca(s, d)
    return stats


@query()
def pca_coords(s, d):
    return _pca(s, d)[0]


def _pca(s, d):
    layer, zero = transform.scale(log_of(s, d), obs_of(s, d).count(), _variable(s, d, 2000))
    cells = dense_number(obs_of(s, d).select("cell_id"), "cell_id", "filter_cell_id")
    genes = dense_number(zero, "gene_id", "filter_gene_id")
    return linalg.pca(readindex.filtered_matrix(layer, cells, genes), cells, genes, 10)


@query()
def louvain_student(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").alias("values"))
    return cluster.graph_clustering(e)[0]


@query()
def umap_coords(s, d):
    from ..operators import embed

    e = table(s, d, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").alias("values"))
    return embed.umap(e)[0]


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def events_hourly(s, d):
    return table(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id AS cell_id, event_type AS gene, COUNT(*) AS n, ROUND(SUM(value), 4) AS v FROM events GROUP BY user_id, event_type")
def events_matrix(s, d):
    return table(s, d, "events").groupBy(F.col("user_id").alias("cell_id"), F.col("event_type").alias("gene")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))


@query(f"WITH {X}, q AS (SELECT cell_id, SUM(v) AS total, COUNT(*) AS nnz FROM x GROUP BY cell_id) SELECT c_custkey AS cell_id, total, nnz FROM customer JOIN q ON cell_id = c_custkey WHERE c_nationkey < 10 ORDER BY (c_custkey * 1103515245 + 3) % 2147483648, c_custkey LIMIT 200")
def qc_points(s, d):
    stats = obs_of(s, d).join(qc.cell_stats(x_of(s, d)), "cell_id")
    return plotdata.qc_points(stats, ["total", "nnz"], n=200, seed=3, where="c_nationkey < 10")


@query(_GRID.replace("LIMIT 30", "LIMIT 4") + f", vv AS (SELECT c_mktsegment AS label, g30.gene_id, COALESCE(v, 0) AS value FROM customer CROSS JOIN g30 LEFT JOIN l ON l.cell_id = c_custkey AND l.gene_id = g30.gene_id), md AS (SELECT label, gene_id, median(value) AS med, AVG(value) AS mn FROM vv GROUP BY label, gene_id) SELECT label, gene_id, {r6('med')} AS median, {r6('mn')} AS mean, {r6('CASE WHEN MAX(mn) OVER (PARTITION BY gene_id) > MIN(mn) OVER (PARTITION BY gene_id) THEN (mn - MIN(mn) OVER (PARTITION BY gene_id)) / (MAX(mn) OVER (PARTITION BY gene_id) - MIN(mn) OVER (PARTITION BY gene_id)) ELSE 0 END')} AS color FROM md")
def stacked_violin(s, d):
    return rounded(plotdata.stacked_violin(log_of(s, d), obs_of(s, d), _top_genes(x_of(s, d), 4), "c_mktsegment"), "median", "mean", "color")


@query(_GRID.replace("LIMIT 30", "LIMIT 3") + f"SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'in' ELSE 'ref' END AS side, c_custkey AS cell_id, g30.gene_id, {r6('COALESCE(v, 0)')} AS value FROM customer CROSS JOIN g30 LEFT JOIN l ON l.cell_id = c_custkey AND l.gene_id = g30.gene_id WHERE c_mktsegment IS NOT NULL")
def ranking_violin(s, d):
    return rounded(plotdata.ranking_violin(log_of(s, d), obs_of(s, d), _top_genes(x_of(s, d), 3), "c_mktsegment", "MACHINERY"), "value")


@query("SELECT vec_id AS cell_id, CAST(embedding[1] AS DOUBLE) AS dim_0, c_mktsegment, COALESCE(v, 0) AS gene_1 FROM embeddings JOIN customer ON c_custkey = vec_id LEFT JOIN (SELECT o_custkey, SUM(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = 1 GROUP BY o_custkey) ON o_custkey = vec_id")
def embedding_colors(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.get("embedding", F.lit(0)).cast("double").alias("dim_0"))
    obs = obs_of(s, d).select("cell_id", "c_mktsegment")
    return plotdata.embedding_points(e.join(obs.select("cell_id"), "cell_id"), obs, ["c_mktsegment", "gene_1"], x_of(s, d), {"gene_1": 1})


@query(f"WITH {X} SELECT {r6('quantile_cont(v, 0.01)')} AS low, {r6('quantile_cont(v, 0.99)')} AS high FROM x")
def robust_range(s, d):
    return rounded(plotdata.robust_range(x_of(s, d), "v"), "low", "high")


@query(f"WITH {X}, b AS (SELECT c_custkey AS cell_id, x.gene_id, x.v FROM customer JOIN x ON x.cell_id = c_custkey WHERE c_custkey IN (5, 17, 42)) SELECT cell_id, gene_id, v FROM b")
def subset_matrix(s, d):
    order = matrix.by_ids(obs_of(s, d).select("cell_id"), [42, 5, 17], "cell_id")
    return x_of(s, d).join(F.broadcast(order), "cell_id").select("cell_id", "gene_id", "v")


@query(f"WITH {X}, k AS (SELECT cell_id, gene_id, v FROM x WHERE cell_id < 5000) SELECT COALESCE(MAX(v) > 50 OR quantile_cont(v, 0.95) > 10, FALSE) AS is_count FROM k WHERE v <> 0")
def scale_detection(s, d):
    from ..sources.readers import is_count_scale

    return s.createDataFrame([(bool(is_count_scale(x_of(s, d))),)], "is_count boolean")


@query(f"WITH {L} SELECT cell_id, gene_id, {r6('GREATEST(exp(v) - 1, 0)')} AS v FROM l")
def log_to_counts(s, d):
    from ..sources.readers import to_counts

    return rounded(to_counts(log_of(s, d)), "v")


@query(f"WITH {L}, w AS (SELECT c_custkey, c_mktsegment FROM customer), k AS (SELECT c_mktsegment AS label, CAST(COUNT(*) AS DOUBLE) AS n FROM w GROUP BY c_mktsegment) SELECT label, COUNT(*) AS stored, {r6('SUM(v) / MAX(n)')} AS per_cell FROM l JOIN w ON cell_id = c_custkey JOIN k ON label = c_mktsegment GROUP BY label")
def group_totals(s, d):
    sizes = ranking.group_sizes(obs_of(s, d), "c_mktsegment")
    sums = ranking.group_sums(log_of(s, d), obs_of(s, d), "c_mktsegment").groupBy("group").agg(F.sum("nz").alias("stored"), F.sum("s").alias("s"))
    return rounded(sums.join(sizes, "group").select(F.col("group").alias("label"), "stored", (F.col("s") / F.col("n")).alias("per_cell")), "per_cell")


@query(f"WITH {FC}, m AS (SELECT fcell, fgene, v FROM fc JOIN x ON x.cell_id = fc.cell_id JOIN fg ON x.gene_id = fg.gene_id) SELECT CAST(f.fcell // 256 AS BIGINT) AS batch, COUNT(DISTINCT f.fcell) AS n_cells, COUNT(v) AS nnz, {r6('COALESCE(SUM(v * (fgene + 1)), 0)')} AS weighted FROM fc f LEFT JOIN m ON m.fcell = f.fcell GROUP BY f.fcell // 256")
def csr_batch_checksum(s, d):
    x, cells, genes = _index(s, d)
    made = readindex.csr_batches(readindex.filtered_matrix(x, cells, genes), cells, 256)
    weighted = F.aggregate(F.zip_with("data", "indices", lambda v, g: v.cast("double") * (g + 1)), F.lit(0.0), lambda a, v: a + v)
    return rounded(made.select("batch", F.size("filter_cell_ids").cast("long").alias("n_cells"), F.size("data").cast("long").alias("nnz"), weighted.alias("weighted")), "weighted")


@query(f"WITH {X}, w AS (SELECT c_mktsegment AS label, cell_id, gene_id, v FROM x JOIN customer ON cell_id = c_custkey), q AS (SELECT label, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM w GROUP BY label) SELECT w.label, COUNT(*) AS n, {r6('SUM(v)')} AS total FROM w JOIN q ON w.label = q.label WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a) GROUP BY w.label")
def box_outliers(s, d):
    values = x_of(s, d).join(obs_of(s, d).select("cell_id", F.col("c_mktsegment").alias("label")), "cell_id").withColumnRenamed("v", "value")
    found = plotdata.outliers(values, plotdata.quartiles(values, ["label"]), ["label"], 1 << 40)
    return rounded(found.groupBy("label").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


_P = "CASE WHEN p_partkey % 50 = 0 THEN 0.0 ELSE CAST(p_partkey * 7919 % 1009 AS DOUBLE) / 10090 END"


@query(f"WITH p AS (SELECT p_partkey AS gene_id, {_P} AS pv, CAST(p_size - 25 AS DOUBLE) / 10 AS lf FROM part) SELECT gene_id, {r6('LEAST(CASE WHEN pv > 0 THEN -log10(pv) ELSE 300 END, 300)')} AS neg_log10_p, CASE WHEN pv < 0.05 AND lf >= 1 THEN 'up' WHEN pv < 0.05 AND lf <= -1 THEN 'down' ELSE 'none' END AS significance FROM p")
def volcano_points(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").alias("gene_id"), F.expr(_P).cast("double").alias("pvals_adj"), ((F.col("p_size") - 25).cast("double") / 10).alias("logfoldchanges"))
    return rounded(plotdata.volcano(rows).select("gene_id", "neg_log10_p", "significance"), "neg_log10_p")


@query(_hvg_sql("sd * sd").replace("SELECT gene_id, ROUND(", "SELECT gene_id, highly_variable_genes FROM (SELECT gene_id, ROUND(", 1) + ") WHERE highly_variable_genes OR gene_id IN (SELECT p_partkey FROM part WHERE (p_partkey * 1103515245 + 5) % 2147483648 % 10 = 0)")
def variability_sample(s, d):
    found = hvg.by_moments(log_of(s, d), var_of(s, d), obs_of(s, d).count(), "var", 200)
    others = plotdata.modulo_sample(found.where("not highly_variable_genes"), "gene_id", 10, 5)
    return plotdata.variability_points(found, n_others=0).unionByName(others).select("gene_id", "highly_variable_genes")


@query("WITH l AS (SELECT vec_id AS gene_id, 1 AS component, CAST(embedding[1] AS DOUBLE) AS loading FROM embeddings UNION ALL SELECT vec_id, 2, CAST(embedding[2] AS DOUBLE) FROM embeddings), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY component ORDER BY loading DESC, gene_id) AS t, ROW_NUMBER() OVER (PARTITION BY component ORDER BY loading, gene_id) AS b FROM l) SELECT gene_id, component, loading, 'top' AS side, t AS n FROM r WHERE t <= 7 UNION ALL SELECT gene_id, component, loading, 'bottom', b FROM r WHERE b <= 7")
def loadings_top(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("gene_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"pc{i}") for i in (0, 1)])
    return plotdata.top_loadings(e, ["pc0", "pc1"], 7).withColumn("n", F.col("n").cast("long"))


@query(f"WITH t AS (SELECT n_nationkey AS pc_index, CAST(n_nationkey + 1 AS DOUBLE) / 325 AS variance_ratio FROM nation) SELECT pc_index, {r6('SUM(variance_ratio) OVER (ORDER BY pc_index)')} AS cumulative FROM t")
def variance_running(s, d):
    stats = table(s, d, "nation").select(F.col("n_nationkey").alias("pc_index"), ((F.col("n_nationkey") + 1).cast("double") / 325).alias("variance_ratio"))
    return rounded(plotdata.variance_cumsum(stats).select("pc_index", "cumulative"), "cumulative")


@query("SELECT 'c_mktsegment' AS name, TRUE AS categorical UNION ALL SELECT 'c_nationkey', COUNT(DISTINCT c_nationkey) <= 128 FROM customer UNION ALL SELECT 'cell_id', COUNT(DISTINCT c_custkey) <= 128 FROM customer UNION ALL SELECT 'c_acctbal', FALSE")
def categorical_columns(s, d):
    obs = obs_of(s, d)
    return s.createDataFrame([(c, bool(plotdata.is_categorical(obs, c))) for c in ("c_mktsegment", "c_nationkey", "cell_id", "c_acctbal")], "name string, categorical boolean")


@query("SELECT c_custkey AS cell_id, c_name FROM customer WHERE (c_custkey * 1103515245 + 11) % 2147483648 % 16 = 0")
def modulo_sample(s, d):
    return plotdata.modulo_sample(obs_of(s, d).select("cell_id", "c_name"), "cell_id", 16, 11)


@query(f"WITH {X}, b AS (SELECT COUNT(*) AS n FROM customer WHERE c_nationkey < 13), a AS (SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS r FROM customer WHERE c_nationkey < 13), e AS (SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 + (SELECT n FROM b) AS r FROM customer WHERE c_nationkey >= 13) SELECT CAST(r AS BIGINT) AS cell_id, gene_id, v FROM x JOIN (SELECT * FROM a UNION ALL SELECT * FROM e) u ON x.cell_id = c_custkey")
def stacked_parts(s, d):
    from ..sources.readers import stacked

    x, obs, var = x_of(s, d), obs_of(s, d), var_of(s, d).select("gene_id", "gene_name")
    parts = []
    for where in ("c_nationkey < 13", "c_nationkey >= 13"):
        own = dense_number(obs.where(where).select("cell_id"), "cell_id", "row")
        parts.append((own.select(F.col("row").alias("cell_id")), var, x.join(own, "cell_id").select(F.col("row").alias("cell_id"), "gene_id", "v")))
    return stacked(parts)[2].withColumn("cell_id", F.col("cell_id").cast("long"))


@query(f"WITH {X}, t AS (SELECT cell_id, SUM(v) AS c_acctbal FROM x GROUP BY cell_id) SELECT c_custkey AS cell_id, c_name, {r6('COALESCE(c_acctbal, -1)')} AS c_acctbal FROM (SELECT c_custkey, c_name FROM customer) LEFT JOIN t ON cell_id = c_custkey")
def updated_column(s, d):
    totals = x_of(s, d).groupBy("cell_id").agg(F.sum("v").alias("c_acctbal"))
    return rounded(matrix.with_columns_from(obs_of(s, d).select("cell_id", "c_name", "c_acctbal"), totals, "cell_id", {"c_acctbal": -1.0}), "c_acctbal")
