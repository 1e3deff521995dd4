"""SimHash near-dedup at a shingle similarity: five words, 0.8 or more.

At 0.8, 64-bit SimHashes differ in some ten bits, too many for blocks of equal bits. So documents meet
in the buckets of min-hashed shingle bands (a pair at 0.8 misses all of them with a chance below
3e-5); the pivot distance tables of the SimHashes (of distinct shingles, as the similarity is) choose
the pairs there that are verified first by the exact similarity of their shingle sets. Texts with
equal sets are one class from the start.

A bucket first gives the pairs of a least spanning forest of its SimHashes. A bucket whose classes
these do not join into one component is then compared exactly across its components, so no pair that
meets in a band is lost to a failed edge; a large bucket is compared in tiles, by the same rule.

Defined results: null and empty texts have no shingles and are one class; fewer than five words are
one shingle; rows with equal doc_id and text are copies; of a group stays the row of the least doc_id
(nulls last; then the least text hash); all columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, bounded_batches, components, few, group_starts, mixed, row_key, settled, stored, text_column, whole_groups, whole_row
from .simhash import PIVOTS, distances, fingerprint, shingle_hashes

#: Words in a shingle, similarity of a link, bands and hashes in each, most bits in which the SimHashes of a pair differ that is verified first (at 0.8 they differ in 10, give or take 3; it orders the work and parts no pair), and most classes of a bucket that are put in one forest.
SHINGLE, SIMILARITY, BANDS, ROWS, RADIUS, BUCKET = 5, 0.8, 15, 3, 21, 4096
#: Bytes of shingles and rows on each side of a tile of a bucket that is compared exactly.
TILE_BYTES, TILE_ROWS = 4 << 20, 4096
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def bands_of(distinct: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band, of distinct shingle hashes."""
    if not len(distinct):
        return np.zeros(BANDS, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(distinct), 4096):
        h = distinct[lo : lo + 4096, None] * _FACTORS[None, :]
        np.minimum(least, (h ^ h >> np.uint64(32)).min(axis=0), out=least)
    out = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        out = mixed(out * np.uint64(3) + least[r::ROWS])
    return out.view(np.int64)


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """key, doc_id, set_id (a digest of the shingle set), fp (the SimHash of the set) and bands."""

    def run(batches):
        for batch in batches:
            ids, fps, bands = [], [], []
            for text in text_column(batch).to_pylist():
                distinct = np.unique(shingle_hashes(text, size))
                ids.append(xxhash.xxh3_64_intdigest(distinct.tobytes(), 1) - (1 << 63))
                fps.append(fingerprint(distinct))
                bands.append(bands_of(distinct))
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * BANDS, pa.int32()), pa.array(flat))], ["key", "doc_id", "set_id", "fp", "bands"])

    return docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"key {KEY}, doc_id long, set_id long, fp long, bands array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similar * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.withColumnsRenamed({"set_id": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"set_id": "b", "shingles": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """set_id and shingles (distinct hashes in order, binary) of the rows with the wanted keys, each set once."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, size)).tobytes() for t in text_column(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["set_id", "shingles"])

    texts = docs.select(row_key().alias("key"), "text").join(few(wanted), "key").select("set_id", "text")
    return texts.mapInArrow(run, "set_id long, shingles binary").groupBy("set_id").agg(F.first("shingles").alias("shingles"))


def spanning_pairs(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Of one bucket: the pairs of a least spanning forest of the fingerprints' distances up to radius. Near copies are nearest, so they are linked before anything less alike can stand between them."""
    n, table = len(fps), distances(fps[:, None], PIVOTS[None, :]).astype(np.int16)
    i, j, d = [], [], []
    for lo in range(0, n, 256):
        rows = slice(lo, min(lo + 256, n))
        near = np.ones((rows.stop - lo, n), bool)
        for c in range(table.shape[1]):  # the pivots' coordinates discard most pairs of unlike texts
            near &= np.abs(table[rows, c, None] - table[None, :, c]) <= radius
        x, y = np.nonzero(near)
        x, y = x[x + lo < y] + lo, y[x + lo < y]
        far = distances(fps[x], fps[y])
        keep = far <= radius
        for column, found in ((i, x), (j, y), (d, far)):
            column.append(found[keep].astype(np.uint16))
    i, j, d = np.concatenate(i), np.concatenate(j), np.concatenate(d)
    label, out = np.arange(n), []
    for level in range(radius + 1):
        x, y = i[d == level], j[d == level]
        while len(x):
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            _, first = np.unique(label[x], return_index=True)  # one pair for each tree, then what is joined is left out
            for k in first.tolist():
                p, q = int(label[x[k]]), int(label[y[k]])
                if p != q:
                    label[label == max(p, q)] = min(p, q)
                    out.append((int(x[k]), int(y[k])))
        if len(out) == n - 1:
            break
    return out


def _bucket_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (bucket, set_id, fp), buckets being of at most BUCKET rows."""

    def run(batches):
        for table in whole_groups(batches, ["bucket"]):
            ids, fps = table.column("set_id").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            begin = group_starts(table, ["bucket"])
            sizes = np.diff(np.append(begin, len(ids)))
            two = begin[sizes == 2]  # verified without a look at the SimHashes
            links = [np.stack([ids[two], ids[two + 1]])]
            for lo, n in zip(begin[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                found = np.array(spanning_pairs(fps[lo : lo + n]), np.int64).reshape(-1, 2)
                links.append(ids[lo + found.T])
            out = np.concatenate(links, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(out.max(axis=0)), pa.array(out.min(axis=0))], ["a", "b"])

    return buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def _sized(rows: DataFrame) -> DataFrame:
    """rows (bucket, set_id, fp, ...) with the number n of rows in each bucket and its least set_id, of buckets of more than one row."""
    return rows.join(stored(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("set_id").alias("head")).where("n > 1"), "sizes"), "bucket")  # stored: a hot bucket is split


def met_classes(classes: DataFrame) -> DataFrame:
    """bucket, set_id, fp, n and head of the classes (set_id, fp, bands) that share a band with another."""
    return stored(_sized(classes.select("set_id", "fp", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "set_id", "fp")), "met")


def candidate_pairs(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that meet in a band and are worth verifying first.

    A bucket of more than BUCKET classes is taken in pieces here, and each class is linked to its least one;
    what that leaves apart is compared by parted_links, like the parts of smaller buckets.
    """
    big = F.col("n") > BUCKET
    piece = F.expr(f"pmod(xxhash64(set_id, 3), ceil(2 * n / {BUCKET}))")
    pieces = met.select(F.when(big, F.xxhash64("bucket", piece)).otherwise(F.col("bucket")).alias("bucket"), "set_id", "fp")
    star = met.where(big & (F.col("set_id") != F.col("head"))).select(F.col("set_id").alias("a"), F.col("head").alias("b"))
    return _bucket_pairs(pieces).union(star).distinct()


def links_between(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, group: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """Pairs (i of left, j of right) of similar sets (sorted, distinct) that connect all the groups that any similar pair connects: every left set is compared with every right one, exactly."""
    sizes, label, out = np.array([len(x) for x in sets]), np.unique(group, return_inverse=True)[1], []
    tokens, codes = np.unique(np.concatenate([sets[j] for j in right]), return_inverse=True)
    if not len(tokens):
        return out
    row, held = np.repeat(np.arange(len(right)), sizes[right]), np.bincount(codes, minlength=len(tokens))
    common = held * 8 > max(len(right), 64)  # shingles of a template are counted by a matrix product, the others by their lists of rows
    place, often = np.cumsum(common) - 1, common[codes]
    dense = np.zeros((len(right), int(common.sum())), np.float32)
    dense[row[often], place[codes[often]]] = 1
    held = np.where(common, 0, held)
    first, posted = np.cumsum(held) - held, row[~often][np.argsort(codes[~often], kind="stable")]
    for i in left.tolist():
        if (label[right] == label[i]).all():
            continue
        at = np.minimum(np.searchsorted(tokens, sets[i]), len(tokens) - 1)
        at = at[tokens[at] == sets[i]]
        n = held[at]
        shared = np.bincount(posted[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(right))
        if dense.shape[1]:
            own = np.zeros(dense.shape[1], np.float32)
            own[place[at[common[at]]]] = 1
            shared = shared + np.rint(dense @ own).astype(np.int64)
        near = right[shared >= similar * (sizes[i] + sizes[right] - shared) - 1e-9]
        near = near[label[near] != label[i]]
        if len(near):
            others, where = np.unique(label[near], return_index=True)
            out += [(i, int(j)) for j in near[where]]
            label[np.isin(label, others)] = label[i]
    return out


def parted_links(met: DataFrame, named: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) of components that meet in a bucket of met (bucket, set_id, n), by the exact similarity.

    A bucket whose classes are all of one component needs nothing, and of buckets of the same classes one is
    taken. In the others, all classes outside the largest component are compared with all classes, in tiles of
    about TILE_BYTES of shingles and TILE_ROWS rows a side, however large the bucket is.
    """
    known = sets.select("set_id", F.length("shingles").cast("long").alias("bytes")).join(named.select(F.col("node").alias("set_id"), "component"), "set_id", "left").select("set_id", "bytes", F.coalesce("component", "set_id").alias("component"))
    members = stored(met.where("n > 2").select("bucket", "set_id").join(known, "set_id"), "members")
    parts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.expr("bit_xor(xxhash64(set_id))").alias("mark"))
    whole = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.expr("bit_xor(mark)").alias("mark")).where("parts > 1")
    whole = whole.groupBy("n", "bytes", "mark").agg(F.min(F.struct("bucket", "main")).alias("x")).select("x.bucket", "x.main", "n", "bytes")
    blocks = lambda n, size: F.greatest(F.ceil(n / F.lit(TILE_ROWS)), F.ceil(size / F.lit(TILE_BYTES)), F.lit(1).cast("long"))
    whole = whole.select("bucket", F.col("main.component").alias("main"), blocks(F.col("n"), F.col("bytes")).alias("across"), blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("down"))
    rows = stored(members.select("bucket", "set_id", "component").join(stored(whole, "whole"), "bucket"), "parted")
    if rows.isEmpty():
        return rows.select(F.col("component").alias("a"), F.col("main").alias("b"))
    single = F.expr("across = 1 and down = 1")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    one = rows.where(single).select(F.col("bucket").alias("tile"), F.when(F.col("component") == F.col("main"), 1).otherwise(2).alias("side"), "set_id", "component")
    left = rows.where(~single & F.expr("component <> main")).select("*", F.expr("pmod(xxhash64(set_id, 1), down)").alias("i"), spread(F.col("across")).alias("j")).withColumn("side", F.lit(0))
    right = rows.where(~single).select("*", spread(F.col("down")).alias("i"), F.expr("pmod(xxhash64(set_id, 2), across)").alias("j")).withColumn("side", F.lit(1))
    tiles = one.union(left.unionByName(right).select(F.xxhash64("bucket", "i", "j").alias("tile"), "side", "set_id", "component"))

    def run(batches):
        for table in whole_groups(batches, ["tile"]):
            begin = group_starts(table, ["tile"])
            side, group = table.column("side").to_numpy(), table.column("component").to_numpy()
            a, b = [], []
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), table.num_rows], strict=True):
                left, right = np.flatnonzero(side[lo:hi] != 1), np.flatnonzero(side[lo:hi] != 0)
                if len(left) and len(right):
                    own = [np.frombuffer(x, np.uint64) for x in table.column("shingles").slice(lo, hi - lo).to_pylist()]
                    found = links_between(own, left, right, group[lo:hi], similar)
                    a += [group[lo + i] for i, _ in found]
                    b += [group[lo + j] for _, j in found]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held = tiles.join(sets, "set_id").select("tile", "side", "set_id", "component", "shingles")
    return held.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similar: float = SIMILARITY) -> DataFrame:
    """key, doc_id, set_id and group (the least set_id that links reach) of each row of docs."""
    bounded_batches(docs.sparkSession)
    rows = stored(sketches(docs, size), "sketches")
    classes = rows.groupBy("set_id").agg(F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    met = met_classes(classes)
    pairs = stored(candidate_pairs(met), "pairs")
    wanted = met.select("set_id").distinct().join(classes.select("set_id", "key"), "set_id")
    sets = stored(_shingle_sets(docs, wanted.select("set_id", "key"), size), "sets")
    named = components(_verified(pairs, sets, similar))
    links = stored(parted_links(met, named, sets, similar), "links")
    found = rows.select("key", "doc_id", "set_id").join(named.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    if not links.isEmpty():
        again = components(links).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        found = found.join(again, "component", "left").withColumn("component", F.coalesce("whole", "component"))
    return found.select("key", "doc_id", "set_id", F.col("component").alias("group"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, similar: float = SIMILARITY) -> DataFrame:
    """The rows of docs, one of each group of near duplicates, with their columns."""
    found = settled(lambda: near_duplicates(docs, size, similar), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")
    stays = stored(found.groupBy("group").agg(F.min(order).alias("first")).select("group", F.col("first.key").alias("stay")), "stays")  # stored: a hot group is split
    judged = found.groupBy("group", "key").agg(F.count("*").alias("copies")).join(stays, "group")
    goes = few(judged.where("key <> stay").select(F.col("key").alias("row")))
    twice = few(judged.where("key = stay and copies > 1").select(F.col("key").alias("row")))
    rows = docs.select(whole_row(docs), row_key().alias("of"))
    kept = rows.join(goes, F.col("of") == F.col("row"), "left_anti")
    if twice.isEmpty():
        return kept.select("doc.*")
    single = kept.join(twice, F.col("of") == F.col("row"), "left_anti")
    again = kept.join(twice, F.col("of") == F.col("row"), "left_semi").dropDuplicates(["of"])
    return single.union(again).select("doc.*")
