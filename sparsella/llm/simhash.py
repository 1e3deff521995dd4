"""SimHash near-dedup with pivot distance tables.

Fingerprints: of the shingles of a text's lower-cased words, a bit is 1 if it is set in more than
half of the shingles' hashes. Pairs within a small radius: a fingerprint is cut into blocks, and two
that differ in at most `radius` bits agree in all but `radius` of them, so every such pair meets in a
bucket of one choice of blocks. In a bucket, a table of Hamming distances to many pivots discards
pairs (a coordinate difference is at most the distance, by the triangle inequality); survivors are
verified. Equal fingerprints are one node, and a bucket gives its spanning links, never all pairs.

Defined results: null and empty texts have the fingerprint zero and are linked like others; repeated
rows are repeated in the result; rows with a null doc_id are linked, between others too, and are no
component's name unless alone with other nulls (then null); doc_ids are below NAMELESS; extra columns
are left alone.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, components, group_starts, mixed, stored, text_column, whole_groups

#: Reference fingerprints: the more, the fewer pairs reach the verification.
PIVOTS = mixed(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: A bucket above this size is searched by enumeration of masks, which is exact too and linear in its size.
WIDE = 2048
#: From here on, numbers stand for fingerprints that only rows without a doc_id have: greater than any doc_id, they name no component that holds one.
NAMELESS = 1 << 62


def lowered_words(text: bytes) -> list[bytes]:
    return text.lower().split()  # on bytes: A-Z only, and blanks are 9 to 13 and 32


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; fewer words than size: of the whole sequence; none: empty."""
    parts = lowered_words(text)
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= size:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], 42) for s, e in zip(starts[: len(parts) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[lo : lo + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t, size)) for t in text_column(batch).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def near_in_bucket(fps: np.ndarray, radius: int, free: int = (1 << 64) - 1) -> list[tuple[int, int]]:
    """Links (indices) that connect all of a bucket's distinct fingerprints whose distances are at most radius.
    free: the bits in which fingerprints of this bucket may differ."""
    n, parent, out = len(fps), list(range(len(fps))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(a: int, b: int) -> None:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((a, b))

    if n > WIDE:
        places = [i for i in range(64) if free >> i & 1]
        order = np.argsort(fps)
        ranked = fps[order]
        for k in range(1, radius + 1):
            for bits in combinations(places, k):
                other = fps ^ np.uint64(sum(1 << i for i in bits))
                at = np.minimum(np.searchsorted(ranked, other), n - 1)
                for i in np.flatnonzero(ranked[at] == other).tolist():
                    if i < (j := int(order[at[i]])):
                        link(i, j)
        return out
    table = distances(fps[:, None], PIVOTS[None, :]).astype(np.int16)
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        for c in range(table.shape[1]):  # each coordinate discards some
            rest = rest[np.abs(table[rest, c] - table[i, c]) <= radius]
            if not len(rest):
                break
        for j in rest[distances(fps[rest], fps[i]) <= radius].tolist() if len(rest) else []:
            link(i, j)
    return out


def near_links(nodes: DataFrame, radius: int = 2, blocks: int = 5) -> DataFrame:
    """Links (a, b) of nodes (fp, node), with distinct fp, that connect all those whose fingerprints differ in at most radius bits."""
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    masks = [((1 << int(hi - lo)) - 1) << int(lo) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    tables = [sum(masks[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(tables)])
    keyed = nodes.select("fp", "node", F.explode(keys).alias("k")).select("k.t", "k.key", "fp", "node")
    busy = F.count("*").over(Window.partitionBy("t", "key"))
    free = [(1 << 64) - 1 ^ m for m in tables]

    def run(batches):
        for table in whole_groups(batches, ["t", "key"]):
            t, fps, node = (table.column(c).to_numpy() for c in ("t", "fp", "node"))
            fps, begin = fps.view(np.uint64), group_starts(table, ["t", "key"])
            sizes = np.diff(np.append(begin, len(t)))
            two = begin[sizes == 2]
            a, b = fps[two], fps[two + 1]
            keep = np.ones(len(two), bool)
            for pivot in PIVOTS:
                keep &= np.abs(distances(a, pivot).astype(np.int16) - distances(b, pivot)) <= radius
            two = two[keep & (distances(a, b) <= radius)]
            links = [np.stack([node[two], node[two + 1]])]
            for lo, n in zip(begin[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                found = np.array(near_in_bucket(fps[lo : lo + n], radius, free[int(t[lo])]), np.int64).reshape(-1, 2)
                links.append(node[lo + found.T])
            out = np.concatenate(links, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], ["a", "b"])

    full = keyed.withColumn("n", busy).where("n > 1").drop("n").sortWithinPartitions("t", "key")
    return full.mapInArrow(run, "a long, b long").distinct()


def near_components(docs: DataFrame, size: int = 3, radius: int = 2, blocks: int = 5) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id that links of at most radius bits reach."""
    bounded_batches(docs.sparkSession)
    fps = stored(fingerprints(docs, size), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("fp"), 2)).alias("node"))
    found = components(near_links(nodes, radius, blocks))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    named = stored(named.withColumn("component_id", F.when(F.col("component_id") < NAMELESS, F.col("component_id"))), "named")  # stored: the rows of a hot fingerprint are split
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")
