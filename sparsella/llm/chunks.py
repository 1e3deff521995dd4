"""Texts dealt out in chunks of bounded size, and the exchange by which chunks learn which of
their hashed windows occur elsewhere.

A chunk is a set of whole documents, chosen by a hash of doc_id. It sends each distinct 64-bit
window once, in blobs by range of the hash, so a window that a third of all documents hold costs one
entry a chunk, not one an occurrence. The packed texts are shuffled once; the branches of a plan
that need them reuse that exchange.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, gathered, mixed, text_column, trim

#: Bytes of text in a chunk, and entries in a bucket of hashes, on average.
CHUNK_BYTES, BUCKET_ENTRIES = 4 << 20, 1 << 20


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array by significance: sorted numbers have long runs in their high bytes, which shuffle compression takes away."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplaned(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.frombuffer(data, np.uint8).reshape(dtype.itemsize, -1).T.copy().view(dtype).ravel()


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def chunk_of(ids: np.ndarray, chunks: int) -> np.ndarray:
    return (mixed(ids.view(np.uint64)) % np.uint64(chunks)).astype(np.int32)


def pack_docs(ids: np.ndarray, texts: list[bytes], level: int = 3) -> bytes:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return zstandard.ZstdCompressor(level=level).compress(struct.pack("<q", len(ids)) + ids.tobytes() + lengths.tobytes() + b"".join(texts))


def unpack_docs(blobs: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """doc_ids and texts, in order of doc_id, then text: the same however the rows arrive."""
    trim()
    ids, texts = [], []
    for blob in blobs:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n = struct.unpack_from("<q", data)[0]
        ids.append(np.frombuffer(data, np.int64, n, 8))
        ends = (8 + 16 * n + np.cumsum(np.frombuffer(data, np.int64, n, 8 + 8 * n))).tolist()
        texts += [data[s:e] for s, e in zip([8 + 16 * n, *ends[:-1]], ends, strict=True)] if n else []
    all_ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
    order = sorted(range(len(texts)), key=lambda i: (all_ids[i], texts[i]))
    return all_ids[order], [texts[i] for i in order]


#: Stands for a null doc_id where rows without one are packed too.
NO_ID = np.iinfo(np.int64).min


def packed(docs: DataFrame, chunks: int, parts: int, by_id: bool = True) -> DataFrame:
    """chunk, docs (binary): by_id, the rows that have a doc_id, in the chunk of their doc_id; else all rows (NO_ID for a null doc_id), by doc_id and text, so that one doc_id on many rows fills no chunk."""

    def run(batches):
        for batch in gathered(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts, chunk = text_column(batch).to_pylist(), batch.column(2).to_numpy() if batch.num_columns > 2 else chunk_of(ids, chunks)
            order = np.argsort(chunk, kind="stable")
            cuts = np.flatnonzero(np.diff(chunk[order], prepend=-1))
            at, blobs = [], []
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                rows = order[lo:hi]
                at.append(int(chunk[rows[0]]))
                blobs.append(pack_docs(ids[rows], [texts[i] for i in rows.tolist()]))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "docs"])

    bounded_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.where("doc_id is not null").select(doc_id.alias("doc_id"), "text") if by_id else docs.select(F.coalesce(doc_id, F.lit(int(NO_ID))).alias("doc_id"), "text", F.pmod(F.xxhash64(doc_id, "text"), F.lit(chunks)).cast("int").alias("chunk"))
    return rows.mapInArrow(run, "chunk int, docs binary").repartition(parts, "chunk")


def sizes(docs: DataFrame, entries_per_byte: float, chunk_bytes: int = CHUNK_BYTES) -> tuple[int, int, int]:
    """Chunks, partitions and buckets (a power of two) for these texts."""
    n = text_bytes(docs)
    chunks = max(1, math.ceil(n / chunk_bytes))
    return chunks, max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(chunks / 2)), 1 << max(0, round(math.log2(max(1, n * entries_per_byte / BUCKET_ENTRIES))))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The top bits of hashes; buckets is a power of two."""
    bits = buckets.bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def bucket_runs(sorted_hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the buckets that hold any of the sorted hashes: as many steps as hashes, however many buckets there are."""
    mine = bucket_of(sorted_hashes, buckets)
    begin = np.flatnonzero(np.diff(mine, prepend=-1))
    return list(zip(mine[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(mine)][: len(begin)], strict=True))


def first_seen(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, the first place of each, and for each place the number of its hash."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(ranked), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[new], order[new], number
