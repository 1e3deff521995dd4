"""The data behind plots: counts, grids with implicit zeros, quartiles, embeddings with colors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cluster_size(obs: DataFrame, groupby: str) -> DataFrame:
    counts = obs.where(F.col(groupby).isNotNull()).groupBy(F.col(groupby).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row a label


def contingency(obs: DataFrame, first: str, second: str) -> DataFrame:
    return obs.groupBy(F.col(first).alias("first"), F.col(second).alias("second")).agg(F.count("*").alias("n"))


def _labels(obs: DataFrame, groupby: str) -> DataFrame:
    return obs.where(F.col(groupby).isNotNull()).select("cell_id", F.col(groupby).cast("string").alias("label"))


def dotplot(x: DataFrame, obs: DataFrame, genes: DataFrame, groupby: str, cutoff: float = 0.0, standard_scale: bool = False, zero: DataFrame | None = None) -> DataFrame:
    """label, gene_id, mean over all the group's cells and percent of them above cutoff. zero: gene_id and zero_scale_transform, what an absent entry stands for."""
    labels = _labels(obs, groupby)
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    sums = x.join(genes.select("gene_id"), "gene_id", "left_semi").join(labels, "cell_id").groupBy("label", "gene_id").agg(F.sum("v").alias("s"), F.count("*").alias("stored"), F.sum(F.when(F.col("v") > cutoff, 1).otherwise(0)).alias("above"))
    rows = genes.select("gene_id").crossJoin(F.broadcast(sizes)).join(sums, ["label", "gene_id"], "left").fillna(0)
    z = F.lit(0.0)
    if zero is not None:
        rows, z = rows.join(zero, "gene_id", "left"), F.coalesce("zero_scale_transform", F.lit(0.0))
    rest = F.col("n") - F.col("stored")
    rows = rows.select("label", "gene_id", ((F.col("s") + rest * z) / F.col("n")).alias("mean"), ((F.col("above") + F.when(z > cutoff, rest).otherwise(0)) * 100.0 / F.col("n")).alias("percent"))
    if standard_scale:
        gene = Window.partitionBy("gene_id")
        low, high = F.min("mean").over(gene), F.max("mean").over(gene)
        rows = rows.withColumn("mean", F.when(high > low, (F.col("mean") - low) / (high - low)).otherwise(0.0))
    return rows


def violin_values(x: DataFrame, obs: DataFrame, genes: DataFrame, groupby: str, zero: DataFrame | None = None) -> DataFrame:
    """label, cell_id, gene_id and value of all cells with a label, absent entries filled."""
    grid = _labels(obs, groupby).crossJoin(F.broadcast(genes.select("gene_id")))  # few genes
    rows = grid.join(x, ["cell_id", "gene_id"], "left")
    fill = F.lit(0.0)
    if zero is not None:
        rows, fill = rows.join(zero, "gene_id", "left"), F.coalesce("zero_scale_transform", F.lit(0.0))
    return rows.select("label", "cell_id", "gene_id", F.coalesce("v", fill).alias("value"))


def quartiles(values: DataFrame, by: list[str], accuracy: int | None = None) -> DataFrame:
    """Quartiles and Tukey whiskers (the last value within 1.5 quartile ranges) of column value. accuracy: take approximate quartiles, off by 1/accuracy of the rows at most, from a sketch of bounded size instead of all values."""
    at = F.percentile if accuracy is None else lambda c, p: F.percentile_approx(c, p, accuracy)
    q = values.groupBy(*by).agg(*[at("value", p).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    joined = values.join(F.broadcast(q), by)
    return joined.groupBy(*by, "q1", "q2", "q3").agg(F.min(F.when(F.col("value") >= F.col("q1") - reach, F.col("value"))).alias("low"), F.max(F.when(F.col("value") <= F.col("q3") + reach, F.col("value"))).alias("high"))


def percent_of_total(x: DataFrame) -> DataFrame:
    totals = x.groupBy("cell_id").agg(F.sum("v").alias("t")).where("t > 0")
    return x.join(totals, "cell_id").select("cell_id", "gene_id", (F.col("v") * 100.0 / F.col("t")).alias("value"))


def highest_expressed(x: DataFrame, n_cells: int, n_top: int = 20, all_cells: bool = True) -> DataFrame:
    """gene_id and mean percent of its cells' totals; over all cells or over stored entries. Equal means by gene_id."""
    shares = percent_of_total(x).groupBy("gene_id").agg(F.sum("value").alias("s"), F.count("*").alias("k"))
    return shares.select("gene_id", (F.col("s") / (F.lit(n_cells) if all_cells else F.col("k"))).alias("mean_percent")).orderBy(F.desc("mean_percent"), "gene_id").limit(n_top)


def highest_expressed_values(x: DataFrame, obs: DataFrame, n_cells: int, n_top: int = 20, sample_cells: int | None = None, seed: int = 0) -> DataFrame:
    """gene_id and percent of its cell's total, absent entries filled, for the highest expressed genes and all cells or a sample of them."""
    top = highest_expressed(x, n_cells, n_top)
    cells = obs.select("cell_id") if sample_cells is None else sampled(obs.select("cell_id"), sample_cells, "cell_id", seed)
    shares = percent_of_total(x).join(F.broadcast(top), "gene_id", "left_semi")  # n_top rows
    return cells.crossJoin(F.broadcast(top.select("gene_id"))).join(shares, ["cell_id", "gene_id"], "left").select("gene_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def highest_expressed_box(x: DataFrame, obs: DataFrame, n_cells: int, n_top: int = 20, sample_cells: int | None = None, seed: int = 0, accuracy: int | None = None) -> DataFrame:
    """Quartiles and whiskers of highest_expressed_values, exact or approximate, with the mean percent over all cells."""
    values = highest_expressed_values(x, obs, n_cells, n_top, sample_cells, seed)
    return quartiles(values, ["gene_id"], accuracy).join(F.broadcast(highest_expressed(x, n_cells, n_top)), "gene_id")


def outliers(values: DataFrame, boxes: DataFrame, by: list[str], most: int, seed: int = 0) -> DataFrame:
    """Up to `most` values beyond the whiskers for each group, chosen by a keyed hash."""
    beyond = values.join(F.broadcast(boxes), by).where("value < low or value > high")
    return beyond.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id"))).where(F.col("n") <= most).drop("n", "q1", "q2", "q3", "low", "high")


def sampled(df: DataFrame, n: int, key: str, seed: int = 0, by: str | None = None) -> DataFrame:
    """n rows (of each group), the same at every run: an arithmetic hash of the id orders them."""
    h = F.pmod(F.col(key).cast("long") * F.lit(1103515245).cast("long") + seed, F.lit(2147483648))
    if by is None:
        return df.orderBy(h, key).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(h, key))).where(F.col("_n") <= n).drop("_n")


def modulo_sample(df: DataFrame, key: str, modulus: int, seed: int = 0) -> DataFrame:
    """About one row in `modulus`, by the same arithmetic hash of the id; no sort, and a row stays in or out whatever the others are."""
    return df.where(F.pmod(F.pmod(F.col(key).cast("long") * F.lit(1103515245).cast("long") + seed, F.lit(2147483648)), F.lit(modulus)) == 0)


def sample_size(groups: int, genes: int) -> int:
    """Cells to take of each group: five million values over the grid, between 2,000 and 50,000."""
    return min(max(5_000_000 // max(1, groups * genes), 2_000), 50_000)


def embedding_points(embedding: DataFrame, obs: DataFrame, colors: list[str], x: DataFrame | None = None, genes: dict[str, int] | None = None, zero: DataFrame | None = None) -> DataFrame:
    """The embedding's columns with obs columns, or genes' values (absent: 0 or the zero transform), as colors."""
    genes, out = genes or {}, embedding
    for color in colors:
        if color in obs.columns:
            out = out.join(obs.select("cell_id", color), "cell_id", "left")
        elif color in genes and x is not None:
            one = x.where(F.col("gene_id") == genes[color]).select("cell_id", F.col("v").alias(color))
            fill = 0.0
            if zero is not None:
                found = zero.where(F.col("gene_id") == genes[color]).select("zero_scale_transform").first()
                fill = float(found[0]) if found and found[0] is not None else 0.0
            out = out.join(one, "cell_id", "left").withColumn(color, F.coalesce(color, F.lit(fill)))
        else:
            raise ValueError(f"{color} is neither a column of obs nor a gene")
    return out


def label_centers(points: DataFrame, label: str, a: str, b: str) -> DataFrame:
    return points.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.median(a).alias("x"), F.median(b).alias("y"), F.count("*").alias("n"))


def is_categorical(obs: DataFrame, column: str, most: int = 128) -> bool:
    kind = dict(obs.dtypes)[column]
    if kind in ("string", "boolean") or any(w in column.lower() for w in ("kmeans", "leiden", "louvain", "cluster")):
        return True
    return kind in ("int", "bigint", "smallint", "tinyint") and obs.select(F.countDistinct(column)).first()[0] <= most


def robust_range(values: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    return values.select(F.percentile(column, low).alias("low"), F.percentile(column, high).alias("high"))


def variance_cumsum(stats: DataFrame) -> DataFrame:
    return stats.withColumn("cumulative", F.sum("variance_ratio").over(Window.orderBy("pc_index").rowsBetween(Window.unboundedPreceding, 0)))  # one row a component


def top_loadings(loadings: DataFrame, components: list[str], n: int, key: str = "gene_id") -> DataFrame:
    """component (from 1), side, gene and loading: the n highest and the n lowest of each."""
    long = loadings.select(key, F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col(c).alias("loading")) for i, c in enumerate(components)])).alias("x")).select(key, "x.*")
    ranked = [long.withColumn("side", F.lit(side)).withColumn("n", F.row_number().over(Window.partitionBy("component").orderBy(order, key))) for side, order in (("top", F.desc("loading")), ("bottom", F.asc("loading")))]
    return ranked[0].union(ranked[1]).where(F.col("n") <= n)


def volcano(ranking: DataFrame, p_cut: float = 0.05, lfc_cut: float = 1.0, cap: float = 300.0) -> DataFrame:
    p = F.least(F.when(F.col("pvals_adj") > 0, -F.log10("pvals_adj")).otherwise(F.lit(cap)), F.lit(cap))
    kind: Column = F.when((F.col("pvals_adj") < p_cut) & (F.col("logfoldchanges") >= lfc_cut), "up").when((F.col("pvals_adj") < p_cut) & (F.col("logfoldchanges") <= -lfc_cut), "down").otherwise("none")
    return ranking.withColumns({"neg_log10_p": p, "significance": kind})


def qc_points(obs: DataFrame, keys: str | list[str], key: str = "cell_id", n: int | None = None, seed: int = 0, where: str | None = None) -> DataFrame:
    """Columns of obs for violins or scatters, filtered by a SQL condition and sampled; a single name is one column."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if strange := [k for k in keys if k not in obs.columns]:
        raise ValueError(f"obs has no columns {strange}")
    rows = obs if where is None else obs.where(where)
    rows = rows.select(key, *dict.fromkeys(keys))
    return rows if n is None else sampled(rows, n, key, seed)


def variability_points(var: DataFrame, flag: str = "highly_variable_genes", n_others: int | None = None, seed: int = 0) -> DataFrame:
    """All genes that the flag chose, and the others or a sample of them."""
    if flag not in var.columns:
        raise ValueError(f"var has no column {flag}: run highly_variable_genes")
    others = var.where(~F.coalesce(F.col(flag), F.lit(False)))
    return var.where(F.col(flag)).unionByName(others if n_others is None else sampled(others, n_others, "gene_id", seed))


def ranking_top(ranking: DataFrame, n: int = 20) -> DataFrame:
    """The first n of each group's ranking."""
    return ranking.where(F.col("rank") < n)


def ranking_violin(x: DataFrame, obs: DataFrame, genes: DataFrame, groupby: str, group: str, reference: str = "rest", zero: DataFrame | None = None) -> DataFrame:
    """side (in or ref), gene_id and value of the cells of a group and of its reference, absent entries filled."""
    values = violin_values(x, obs, genes, groupby, zero)
    side = F.when(F.col("label") == group, "in").when(F.lit(reference == "rest") | (F.col("label") == reference), "ref")
    return values.withColumn("side", side).where("side is not null").select("side", "cell_id", "gene_id", "value")


def stacked_violin(x: DataFrame, obs: DataFrame, genes: DataFrame, groupby: str, zero: DataFrame | None = None, allow_full: bool = False, most: int = 50_000_000) -> DataFrame:
    """label, gene_id, median over the label's cells and the median's place in the gene's range, for color. Grids above `most` values need allow_full."""
    if not allow_full and obs.count() * genes.count() > most:
        raise ValueError("the grid is very large: pass allow_full=True or sample the cells")
    medians = violin_values(x, obs, genes, groupby, zero).groupBy("label", "gene_id").agg(F.median("value").alias("median"), F.avg("value").alias("mean"))
    gene = Window.partitionBy("gene_id")
    low, high = F.min("mean").over(gene), F.max("mean").over(gene)
    return medians.withColumn("color", F.when(high > low, (F.col("mean") - low) / (high - low)).otherwise(0.0))
