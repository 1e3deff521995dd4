"""Benchmark decontamination: DataFrame functions only.

Words are lower-cased runs of letters and digits; shingles are five of them (an item of fewer is one
shingle). A document and an item that share most of the item's shingles give item-sized windows, at
every start whose window holds enough of the item's shingles, in any order. Each distinct window gets a 64-bit
SimHash of its words; RADIUS + 1 blocks of it are matched with the items' blocks, which finds every
item of that size within RADIUS bits; survivors are verified by the exact weighted (multiset)
similarity of their shingles.

Losslessness of the first step: a window whose similarity to an item of m shingles is at least s
holds at least s * m of them, so a document in which fewer places of the item are hit has none; a
window that has m shingles itself holds at least 2 * s / (1 + s) * m.

Defined results: null and empty texts and items have no windows; a text shorter than an item is one
window; rows with equal doc_id and text give the same rows once; a null doc_id is a row of its own by
its text; ties take the first window; extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, row_key, stored, whole_row

#: Words in a shingle, similarity of a leak, bits of SimHash radius, and most rows of item shingles that are broadcast.
SHINGLE, SIMILARITY, RADIUS, BROADCAST_ROWS = 5, 0.8, 16, 500_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashed_shingles(hashes: Column, size: int) -> Column:
    """Hashes of all runs of `size` word hashes, in order."""
    last = F.size(hashes) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def plain_shingles(words: Column, size: Column) -> Column:
    """All runs of `size` words as text."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def simhash(words: Column) -> Column:
    """A bit is 1 if it is set in more than half of the words' hashes."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    ones = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)).cast("int")))
    return F.aggregate(F.transform(ones, lambda n, b: F.when(n * 2 > F.size(words), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def blocks_of(fp: Column, radius: int = RADIUS) -> Column:
    """radius + 1 numbered blocks of a fingerprint; two within radius agree in one at least."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")).alias("value")) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))])


def similarity(a: Column, b: Column) -> Column:
    """Multiset Jaccard similarity of two arrays."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return shared / (F.size(a) + F.size(b) - shared)


def leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """key (of the row), doc_id, item_id, similarity, start_word and n_words of the best window of each leaked item."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("item_words")).where("size(item_words) > 0").distinct()
    items = items.withColumn("n", F.size("item_words")).withColumn("size", F.least("n", F.lit(SHINGLE)))
    hashes = items.select("item_id", "n", "size", F.transform("item_words", lambda w: F.xxhash64(w)).alias("h"))
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # five at most
    rows = docs.select(row_key().alias("key"), F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).withColumn("doc_words", F.size("h"))
    hits = None
    for size in sizes:
        own = hashes.where(F.col("size") == size).select("item_id", "n", F.posexplode(hashed_shingles(F.col("h"), size)).alias("item_at", "shingle"))
        if own.count() <= BROADCAST_ROWS:
            own = F.broadcast(own)
        # The outer form: an inner one makes the optimizer filter by the array's size below the projections, which computes the word hashes anew for each shingle.
        found = rows.select("key", "doc_words", F.posexplode_outer(hashed_shingles(F.col("h"), size)).alias("at", "shingle")).join(own, "shingle")
        found = found.select("key", "doc_words", "item_id", "n", "item_at", "at", F.lit(size).alias("size"))
        hits = found if hits is None else hits.union(found)
    if hits is None:
        return docs.select(row_key().alias("key"), F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words")).limit(0)
    # A window of as many shingles as the item has needs 2s / (1 + s) of them at the similarity s. It holds that many hit places if, from its first on, the last of them is in it too: the starts between are those of one stretch of hits.
    places = hits.groupBy("key", "doc_words", "item_id", "n", "size").agg(F.collect_set("item_at").alias("items_at"), F.collect_set("at").alias("at"))
    enough = places.withColumn("m", F.col("n") - F.col("size") + 1).where(F.size("items_at") >= F.lit(similar) * F.col("m"))
    stretches = enough.withColumn("need", F.ceil(F.lit(2 * similar / (1 + similar)) * F.col("m") - 1e-9).cast("int")).select("key", "n", "doc_words", "m", "need", F.array_sort("at").alias("at"))
    # Made below the explode, so that no lambda sorts the places again. A text shorter than the item is one window.
    first = stretches.select("key", "n", "doc_words", "m", F.explode_outer(F.arrays_zip(F.col("at").alias("lo"), F.expr("slice(at, need, greatest(size(at) - need + 1, 0))").alias("hi"))).alias("x")).select("key", "n", "doc_words", "m", "x.*")
    short = F.col("doc_words") < F.col("n")
    spans = first.where(short | F.col("hi").isNotNull()).select("key", "n", F.when(short, 0).otherwise(F.greatest(F.col("hi") - F.col("m") + 1, F.lit(0))).alias("from"), F.when(short, 0).otherwise(F.least("lo", F.col("doc_words") - F.col("n"))).alias("to")).where("from <= to")
    windows = spans.select("key", "n", F.explode(F.sequence("from", "to")).alias("start")).distinct()
    per_row = windows.groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("windows"))
    texts = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text").join(per_row, "key")
    cut = texts.select("key", "doc_id", words_of(F.col("text")).alias("w"), "windows").select("key", "doc_id", F.explode_outer(F.transform("windows", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), F.slice("w", x["start"] + 1, x["n"]).alias("words")))).alias("x")).select("key", "doc_id", "x.*")
    cut = stored(cut, "windows")
    # Costly arrays are made below a join, so that no filter or lambda above it computes them again.
    distinct = cut.select("n", "words").distinct().select("n", "words", simhash(F.col("words")).alias("fp"), plain_shingles(F.col("words"), F.least("n", F.lit(SHINGLE), F.size("words"))).alias("a"))
    targets = items.select("item_id", "n", simhash(F.col("item_words")).alias("item_fp"), plain_shingles(F.col("item_words"), F.least("n", F.lit(SHINGLE))).alias("b"))
    targets = targets.select("item_id", "n", "item_fp", "b", F.explode_outer(blocks_of(F.col("item_fp"), radius)).alias("k")).select("item_id", "n", "item_fp", "b", "k.*")
    if items.count() * (radius + 1) <= BROADCAST_ROWS:
        targets = F.broadcast(targets)
    met = distinct.select("n", "words", "fp", "a", F.explode_outer(blocks_of(F.col("fp"), radius)).alias("k")).select("n", "words", "fp", "a", "k.*").join(targets, ["n", "block", "value"])
    close = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).dropDuplicates(["n", "words", "item_id"])
    judged = close.select("n", "words", "item_id", similarity(F.col("a"), F.col("b")).alias("similarity"))
    best = cut.join(judged, ["n", "words"]).groupBy("key", "doc_id", "item_id").agg(F.max_by(F.struct("similarity", "start", "n"), F.struct("similarity", -F.col("start"))).alias("x"))
    return best.where(F.col("x.similarity") >= similar).select("key", "doc_id", F.col("item_id").cast("long").alias("item_id"), "x.similarity", F.col("x.start").alias("start_word"), F.col("x.n").alias("n_words"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that hold no item, with their columns, whatever their names."""
    found = few(leaks(docs, benchmark, **how).select(F.col("key").alias("leaked_key")).distinct())
    return docs.select(whole_row(docs)).join(found, row_key("doc.") == F.col("leaked_key"), "left_anti").select("doc.*")
