"""Substring dedup on the token De Bruijn graph.

Edges are windows of k consecutive words; edges that start in two or more documents are repeated.
A bucketed exchange gives each occurrence of a repeated edge its source, the least doc_id that holds
it. Consecutive repeated edges of a document that share a source are one nonbranching path: paths are
compacted to one row each (document, first edge, edges, source), and joined with the source's text,
where every edge of the path is compared word by word. Edges that this does not confirm are dropped.
Words covered by a confirmed edge whose source precedes the document go.

Defined results: null texts have no words; documents of fewer than k words keep all; equal doc_ids
never remove each other's words; rows with a null doc_id keep all; repeated rows are repeated in the
result; extra columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import bucket_runs, chunk_of, first_seen, pack_docs, packed, planes, sizes, unpack_docs, unplaned
from .common import Rolling, slices, text_column, trim, words

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
NOTE = "chunk int, kind int, bucket int, bits binary, source binary"


class Edges:
    """The k-word windows of a chunk's documents: hashes, and for each document its words and first window."""

    def __init__(self, blobs: list[bytes], k: int):
        self.ids, self.texts = unpack_docs(blobs)
        by_byte, by_word = Rolling(11), Rolling(13)
        column = pa.array(self.texts, pa.large_binary())
        hashes, counts = [], []
        for _, _, data, offsets in slices(column):
            starts, ends, first = words(data, offsets)
            token = by_byte.ranges(by_byte.sums(data), starts, ends)
            sums = by_word.sums(token)
            n = np.diff(first)
            windows = np.maximum(n - k + 1, 0)
            at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(windows.sum())
            hashes.append(by_word.ranges(sums, at, at + k))
            counts.append(n)
        self.n_words = np.concatenate(counts) if counts else np.empty(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.windows = np.maximum(self.n_words - k + 1, 0)
        self.first = np.concatenate(([0], np.cumsum(self.windows)))
        self.doc = np.repeat(np.arange(len(self.ids)), self.windows)
        self.distinct, seen, self.number = first_seen(self.hashes)
        self.least = self.ids[self.doc[seen]]  # documents are in order of doc_id


def _column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def edge_blobs(base: DataFrame, k: int, buckets: int) -> DataFrame:
    """bucket, chunk and a chunk's distinct edges of that bucket, each with the least doc_id of the chunk that holds it."""

    def run(key, table):
        e = Edges(_column(table, "docs"), k)
        rows = []
        for b, lo, hi in bucket_runs(e.distinct, buckets):
            held, number = np.unique(e.least[lo:hi], return_inverse=True)
            short = np.uint16 if len(held) < 1 << 16 else np.uint32
            rows.append((b, key[0].as_py(), planes(e.distinct[lo:hi]), number.astype(short).tobytes(), planes(np.diff(held, prepend=0)), short().itemsize))
        return pa.table(dict(zip(("bucket", "chunk", "edges", "number", "ids", "wide"), map(list, zip(*rows, strict=True)) if rows else [[]] * 6, strict=True)), schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("edges", pa.binary()), ("number", pa.binary()), ("ids", pa.binary()), ("wide", pa.int32())]))

    return base.groupBy("chunk").applyInArrow(run, "bucket int, chunk int, edges binary, number binary, ids binary, wide int")


def edge_sources(blobs: DataFrame, buckets: int) -> DataFrame:
    """For each chunk and bucket: bits of the edges, in order, that start in a document before the chunk's least, and their sources."""

    def run(key, table):
        trim()
        edges, ids, sizes_ = [], [], []
        for x, number, held, wide in zip(*(_column(table, c) for c in ("edges", "number", "ids", "wide")), strict=True):
            edges.append(unplaned(x, np.uint64))
            ids.append(np.cumsum(unplaned(held, np.int64))[np.frombuffer(number, np.uint16 if wide == 2 else np.uint32)])
            sizes_.append(len(edges[-1]))
        edges, ids = np.concatenate(edges), np.concatenate(ids)
        order = np.argsort(edges, kind="stable")
        ranked = edges[order]
        new = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        least = np.empty(len(ids), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ids[order], new), np.diff(np.append(new, len(ids))))
        earlier, cuts = least < ids, np.cumsum(sizes_)[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(earlier, cuts)]
        source = [planes(x[y]) for x, y in zip(np.split(least, cuts), np.split(earlier, cuts), strict=True)]
        n = len(bits)
        return pa.table({"chunk": table.column("chunk"), "kind": pa.array([0] * n, pa.int32()), "bucket": pa.array([key[0].as_py()] * n, pa.int32()), "bits": pa.array(bits, pa.binary()), "source": pa.array(source, pa.binary())})

    return blobs.repartition(max(1, buckets), "bucket").groupBy("bucket").applyInArrow(run, NOTE)


def _marked(e: Edges, notes: pa.Table, buckets: int) -> np.ndarray:
    """For each window of a chunk the least doc_id that holds its edge."""
    runs, least = {b: (lo, hi) for b, lo, hi in bucket_runs(e.distinct, buckets)}, e.least.copy()
    for kind, b, bits, source in zip(*(_column(notes, c) for c in ("kind", "bucket", "bits", "source")), strict=True):
        if kind == 0:
            lo, hi = runs[b]
            least[lo + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo))] = unplaned(source, np.int64)
    return least[e.number]


def paths(base: DataFrame, notes: DataFrame, k: int, buckets: int, chunks: int) -> DataFrame:
    """Compacted paths, packed by document: chunk (of the source) and the words of each path, to compare with the source."""

    def run(left, right):
        at, blobs, owner = [], [], []
        if left.num_rows:
            e = Edges(_column(left, "docs"), k)
            least = _marked(e, right, buckets)
            hit = np.flatnonzero(least < e.ids[e.doc])
            if len(hit):
                begins = np.flatnonzero(np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(e.doc[hit]) != 0) | (np.diff(least[hit]) != 0))))
                ends = np.append(begins[1:], len(hit)) - 1
                d, source = e.doc[hit[begins]], least[hit[begins]]
                lo, hi = hit[begins] - e.first[d], hit[ends] - e.first[d] + k
                text, of, split = [], -1, []
                for i, a, b in zip(d.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    if i != of:
                        of, split = i, e.texts[i].split()
                    text.append(b"%d %d %d " % (e.ids[i], a, b - a) + b" ".join(split[a:b]))
                chunk = chunk_of(source, chunks)
                order = np.argsort(chunk, kind="stable")
                cut = np.flatnonzero(np.diff(chunk[order], prepend=-1))
                for p, q in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
                    rows = order[p:q]
                    at.append(int(chunk[rows[0]]))
                    blobs.append(pack_docs(source[rows], [text[i] for i in rows.tolist()]))
        return pa.table({"chunk": pa.array(at, pa.int32()), "paths": pa.array(blobs, pa.binary())})

    return base.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(run, "chunk int, paths binary")


def unconfirmed(base: DataFrame, found: DataFrame, k: int, chunks: int) -> DataFrame:
    """Edges of paths that their source does not hold word by word: those whose hashes collide. Notes of kind 1."""

    def run(left, right):
        out = []
        if left.num_rows and right.num_rows:
            ids, texts = unpack_docs(_column(left, "docs"))
            sources, claims = unpack_docs(_column(right, "paths"))
            of, held = None, []
            for source, claim in zip(sources.tolist(), claims, strict=True):
                doc, begin, n, line = claim.split(b" ", 3)
                if source != of:
                    lo, hi = np.searchsorted(ids, [source, source + 1]).tolist()
                    of, held = source, [b" " + b" ".join(t.split()) + b" " for t in texts[lo:hi]]
                if any(b" " + line + b" " in t for t in held):
                    continue
                parts = line.split()
                out += [(int(doc), int(begin) + i) for i in range(int(n) - k + 1) if not any(b" " + b" ".join(parts[i : i + k]) + b" " in t for t in held)]
        ids = np.array([d for d, _ in out], np.int64)
        return pa.table({"chunk": pa.array(chunk_of(ids, chunks), pa.int32()), "kind": pa.array([1] * len(out), pa.int32()), "bucket": pa.array([0] * len(out), pa.int32()), "bits": pa.array([np.int64(w).tobytes() for _, w in out], pa.binary()), "source": pa.array([np.int64(d).tobytes() for d, _ in out], pa.binary())})

    return base.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, NOTE)


def kept(base: DataFrame, notes: DataFrame, k: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text."""

    def run(left, right):
        removed, digests, texts = [], [], []
        e = Edges(_column(left, "docs") if left.num_rows else [], k)
        if left.num_rows:
            gone = _marked(e, right, buckets) < e.ids[e.doc]
            for kind, w, d in zip(*(_column(right, c) for c in ("kind", "bits", "source")), strict=True):
                if kind == 1:
                    lo, hi = np.searchsorted(e.ids, [int(np.frombuffer(d, np.int64)[0])] * 2, "left")[0], np.searchsorted(e.ids, int(np.frombuffer(d, np.int64)[0]), "right")
                    for i in range(lo, hi):
                        gone[e.first[i] + int(np.frombuffer(w, np.int64)[0])] = False
            for i, text in enumerate(e.texts):
                mine = gone[e.first[i] : e.first[i + 1]]
                split = text.split()
                if mine.any():
                    steps = np.zeros(len(split) + 1, np.int32)
                    at = np.flatnonzero(mine)
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + k, -1)
                    stays = np.cumsum(steps[:-1]) == 0
                    split = [w for w, keep in zip(split, stays.tolist(), strict=True) if keep]
                line = b" ".join(split)
                removed.append(int(e.n_words[i]) - len(split))
                digests.append(hashlib.sha256(line).hexdigest())
                texts.append(line)
        return pa.table({"doc_id": pa.array(e.ids, pa.int64()), "n_words": pa.array(e.n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(texts, pa.binary()).cast(pa.string())})

    return base.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(run, RESULT + ", kept string")


def _without_id(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            lines = [t.split() for t in text_column(batch).to_pylist()]
            joined = [b" ".join(x) for x in lines]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, lines)), pa.int64()), pa.array([0] * len(lines), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in joined], pa.string()), pa.array(joined, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT + ", kept string")


def drop_repeated_words(docs: DataFrame, k: int = 13, chunk_bytes: int | None = None) -> DataFrame:
    """Documents without the words of repeated k-word windows that start in an earlier document too."""
    chunks, parts, buckets = sizes(docs, 0.16, *([chunk_bytes] if chunk_bytes else []))
    base = packed(docs, chunks, parts)
    notes = edge_sources(edge_blobs(base, k, buckets), buckets)
    wrong = unconfirmed(base, paths(base, notes, k, buckets, chunks), k, chunks)
    return kept(base, notes.union(wrong), k, buckets).union(_without_id(docs))
