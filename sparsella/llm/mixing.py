"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens raised to an exponent, normalised. The exponent is bisected,
between 0 (uniform) and 1 (as found), to the largest flattening that meets a target: an entropy of the
weights, or a limit on how often the most repeated source is passed. The budget is the least that
passes every source at least once, so no document is lost, unless one is given. A source's documents
lie in blocks of about BLOCK_TOKENS (by a keyed hash of doc_id and text); each pass takes the blocks in a
keyed permutation of its own, and the last pass stops within the block where the source's budget ends,
document by document.

A row's position is the share of its source's budget that precedes it, so sorting by position
interleaves the sources in proportion.

Sources are a table of their own throughout: only sums over them reach the driver, so their number may
grow too (a host, an URL).

Defined results: a null source is a source of its own; null and empty texts count one token; ties are
broken by doc_id, then text; repeated rows are rows of their own; an empty table gives an empty one;
columns that clash with the result's own (pass, block, position) are kept as they are in mixed_rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import few, stored, whole_row

#: Tokens in a block of a source, on average, and passes of the most repeated source.
BLOCK_TOKENS, MOST_PASSES = 1 << 18, 1.5
#: Exponents that are tried at once when sources are too many for the driver to see.
GRID = 64


def tokens_of(text: str = "text") -> Column:
    """Words, as the measure of a document; at least 1."""
    return F.greatest(F.size(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"[ \t-\r]+")), F.lit(1)).cast("long")


def weights(shares: np.ndarray, exponent: float) -> np.ndarray:
    w = shares**exponent
    return w / w.sum()


def entropy(w: np.ndarray) -> float:
    return float(-(w[w > 0] * np.log(w[w > 0])).sum())


def passes(shares: np.ndarray, w: np.ndarray) -> np.ndarray:
    """How often each source is passed if the least repeated is passed once."""
    times = w / shares
    return times / times.min()


def bisected(holds, low: float = 0.0, high: float = 1.0, steps: int = 60) -> tuple[float, float]:
    """The last exponents for which holds is true and false, halving from low (true) and high (false)."""
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low, high


def exponent_of_passes(least: float, most: float, most_passes: float) -> float:
    """The exponent nearest to 0 that repeats no source more than most_passes times; the least and the most share settle it: passes are shares ** (exponent - 1)."""
    over = lambda t: (most / least) ** (1 - t) > most_passes
    return bisected(over)[1] if over(0.0) else 0.0


def exponent_of_entropy(entropies, target: float) -> float:
    """The exponent nearest to 1 whose weights have the target entropy (0 if none has). entropies: gives those of an array of exponents in one go; each go narrows the range to one GRIDth."""
    if entropies(np.array([1.0]))[0] >= target:
        return 1.0
    low, high = 0.0, 1.0
    while high - low > 1e-12:
        grid = np.linspace(low, high, GRID + 1)
        flat = np.flatnonzero(entropies(grid[:-1]) >= target)
        at = int(flat[-1]) if len(flat) else 0
        low, high = float(grid[at]), float(grid[at + 1])
        if not len(flat):
            break
    return low


def exponent_for(shares: np.ndarray, target_entropy: float | None = None, most_passes: float | None = None) -> float:
    """The exponent of given shares: see exponent_of_passes and exponent_of_entropy."""
    if (target_entropy is None) == (most_passes is None):
        raise ValueError("give a target entropy or a limit on passes")
    if target_entropy is None:
        return exponent_of_passes(float(shares.min()), float(shares.max()), most_passes)
    return exponent_of_entropy(lambda ts: np.array([entropy(weights(shares, t)) for t in ts]), target_entropy)


def plan(docs: DataFrame, target_entropy: float | None = None, most_passes: float | None = MOST_PASSES, budget: int | None = None) -> DataFrame:
    """source, tokens, share, weight, exponent and source_budget (tokens to take), one row a source."""
    found = stored(docs.groupBy("source").agg(F.sum(tokens_of()).alias("tokens")), "sources")
    n, least, most = found.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    share = F.col("tokens") / F.lit(float(n or 1))
    if not n:
        exponent = 1.0
    elif target_entropy is not None:

        def entropies(ts: np.ndarray) -> np.ndarray:
            """Of weights x = share ** t / z: log z - sum(share ** t * t * log share) / z."""
            powers = [F.pow(share, F.lit(float(t))) for t in ts]
            row = np.array(found.agg(*map(F.sum, powers), *[F.sum(x * F.log(share)) for x in powers]).first(), float)
            z, logs = row[: len(ts)], row[len(ts) :]
            return np.log(z) - ts * logs / z

        exponent = exponent_of_entropy(entropies, target_entropy)
    else:
        exponent = exponent_of_passes(least / n, most / n, most_passes)
    z = float(found.agg(F.sum(F.pow(share, F.lit(exponent)))).first()[0] or 1.0)
    weight = F.pow(share, F.lit(exponent)) / F.lit(z)
    if budget is not None:
        take = F.floor(F.lit(float(budget)) * F.col("weight") + 0.5)
    else:  # the largest source is the least repeated: it is passed once
        total = float(most or 0) * z / (most / n) ** exponent if n else 0.0
        take = F.floor(F.greatest(F.lit(total) * F.col("weight"), F.col("tokens").cast("double")) + 1e-6)
    return found.select("source", "tokens", share.alias("share"), weight.alias("weight"), F.lit(exponent).alias("exponent")).withColumn("source_budget", take.cast("long"))


def mixed_rows(docs: DataFrame, target_entropy: float | None = None, most_passes: float | None = MOST_PASSES, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """All columns of docs in a struct `doc`, its token count, source_budget, the pass, block and position of each row of the mixture."""
    sources = few(plan(docs, target_entropy, most_passes, budget).withColumn("blocks", F.ceil(F.col("tokens") / F.lit(block_tokens))))
    mark = F.xxhash64(F.col("doc.doc_id"), F.col("doc.text"), F.lit(seed))
    rows = docs.select(whole_row(docs)).withColumns({"mix_source": F.col("doc.source"), "mix_n": tokens_of("doc.text"), "mix_mark": mark})
    rows = rows.join(sources.select(F.col("source").alias("of"), "blocks"), F.col("mix_source").eqNullSafe(F.col("of"))).withColumn("mix_block", F.expr("pmod(mix_mark, blocks)")).drop("of", "blocks")
    sums = rows.groupBy(F.col("mix_source").alias("s"), F.col("mix_block").alias("b")).agg(F.sum("mix_n").alias("n"))
    # One row a block and pass: where each pass takes each block, and the tokens that its source has before it.
    times = F.ceil(F.col("source_budget") / F.col("tokens")).cast("int")
    passed = sums.join(sources, F.col("s").eqNullSafe(F.col("source"))).where(times > 0).select("s", "b", "n", "source_budget", F.explode(F.sequence(F.lit(0), times - 1)).alias("p"))
    order = Window.partitionBy("s").orderBy("p", F.xxhash64("s", "p", "b", F.lit(seed)), "b").rowsBetween(Window.unboundedPreceding, -1)
    placed = few(passed.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where("before < source_budget"))
    taken = rows.join(placed, F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("mix_block") == F.col("b")))
    # Only the block in which the budget ends is ordered document by document; a whole block's rows need no order.
    whole = taken.where("before + n <= source_budget").withColumn("at", F.col("before") + F.col("n") * (F.xxhash64("mix_mark", "p", F.lit(seed)) / F.lit(2.0**64) + 0.5))
    inside = Window.partitionBy("s", "p", "b").orderBy(F.xxhash64("mix_mark", "p", F.lit(seed)), "doc.doc_id", "doc.text").rowsBetween(Window.unboundedPreceding, -1)
    part = taken.where("before + n > source_budget").withColumn("at", F.col("before") + F.coalesce(F.sum("mix_n").over(inside), F.lit(0))).where("at < source_budget")
    both = whole.withColumn("at", F.col("at").cast("double")).unionByName(part.withColumn("at", F.col("at").cast("double")))
    return both.select("doc", F.col("mix_n").alias("tokens"), "source_budget", F.col("p").alias("pass"), F.col("b").alias("block"), (F.col("at") / F.col("source_budget")).alias("position"))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mixture, with the columns of docs: a document taken in several passes is repeated."""
    return mixed_rows(docs, **how).select("doc.*")
