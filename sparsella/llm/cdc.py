"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes sets chunk boundaries, with normalised chunking: a strict mask
before the normal size, a loose one after it, and a least and a greatest size (FastCDC, Xia et al.,
2016). A text's fingerprint is the set of its chunks, each 48 bits of digest and 16 of length, in
order, as hexadecimal digits; near(a, b) is the share of a's distinct chunk bytes that b holds too.
A change moves only the boundaries near it, so the rest of the chunks stay.

The document that follows another is the next in descending doc_id (then text); the last is followed
by the first. Documents are dealt out by ranges of doc_id; each range also gets the head of the range
below.

Defined results: null texts are empty; an empty text has an empty fingerprint, which is near (1) to
another empty one only; null doc_ids come last; repeated rows follow each other; a table of one row
follows itself; extra columns are left alone.
"""

from __future__ import annotations

import bisect
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import pack_docs, text_bytes, unpack_docs
from .common import Rolling, bounded_batches, gathered, mixed, slices, text_column

#: Least, normal and greatest bytes of a chunk, and bits that must be zero before and after the normal size.
LEAST, NORMAL, MOST, STRICT, LOOSE = 32, 64, 256, 7, 5
#: Bytes of text in a range of documents, on average, as long as there are not too many ranges: their bounds and heads (two numbers each) pass through the driver. Beyond, ranges grow (190 MB at 100 TB).
RANGE_BYTES, MOST_RANGES = 4 << 20, 1 << 19
NONE = np.iinfo(np.int64).min  # stands for a null doc_id: it comes last

_GEAR = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).astype(np.uint32)
_BYTES = Rolling(307)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i - k]] << k, 0 <= k < 32, modulo 2**32, by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def _cuts(strict: list[int], loose: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of a text, from the places after which a boundary may stand."""
    out, find = [], bisect.bisect_left
    while start < end:
        if end - start <= LEAST:
            cut = end
        else:
            at = find(strict, start + LEAST)
            cut = strict[at] if at < len(strict) else end
            if cut >= start + NORMAL:
                at = find(loose, start + NORMAL)
                cut = min(loose[at] if at < len(loose) else end, start + MOST)
            cut = min(cut, end)
        out.append(cut)
        start = cut
    return out


def chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its distinct chunks in order: digest << 16 | length."""
    out: list[np.ndarray] = []
    for _, _, data, offsets in slices(pa.array(texts, pa.large_binary())):
        h = gear_hashes(data)
        loose = np.flatnonzero((h & np.uint32(((1 << LOOSE) - 1) << 16)) == 0)
        strict = loose[(h[loose] & np.uint32(((1 << STRICT) - 1) << 16)) == 0] + 1
        loose = loose + 1
        begin = [np.searchsorted(x, offsets).tolist() for x in (strict, loose)]
        strict, loose, ends = strict.tolist(), loose.tolist(), []
        bounds = offsets.tolist()
        counts = []
        for i in range(len(bounds) - 1):
            found = _cuts(strict[begin[0][i] : begin[0][i + 1] + 1], loose[begin[1][i] : begin[1][i + 1] + 1], bounds[i], bounds[i + 1])
            ends += found
            counts.append(len(found))
        ends = np.array(ends, np.int64)
        starts = np.concatenate((offsets[:1], ends[:-1])) if len(ends) else ends
        chunk = _BYTES.ranges(_BYTES.sums(data), starts, ends) & ~np.uint64(0xFFFF) | (ends - starts).astype(np.uint64)
        out += [np.unique(x) for x in np.split(chunk, np.cumsum(counts)[:-1])]
    return out


def _length(chunks: np.ndarray) -> int:
    return int((chunks & np.uint64(0xFFFF)).sum())


def near(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a):
        return float(not len(b))
    return _length(np.intersect1d(a, b, assume_unique=True)) / _length(a)


def written(chunks: np.ndarray) -> str:
    return chunks.astype(">u8").tobytes().hex()


def read_back(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """Code points of the text, and the text with its last half replaced by the head of the following one."""
    own = text.decode()
    half = len(own) // 2
    return len(own), (own[: len(own) - half] + following.decode()[:half]).encode()


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _bounds(docs: DataFrame, ranges: int) -> list[int]:
    ranges = min(ranges, MOST_RANGES)
    if ranges < 2:
        return []
    found = docs.select(F.percentile_approx(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)), [i / ranges for i in range(1, ranges)], min(100 * ranges, 1 << 20))).first()[0]
    return sorted(set(found or []))


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how near a document is to its edited text and to the one that follows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), "text")
    bounds = np.array(_bounds(docs, math.ceil(text_bytes(docs) / range_bytes) or 1), np.int64)

    def heads(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = np.searchsorted(bounds, ids, "right")
            for r in np.unique(at).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([int(ids[at == r].max())], pa.int64())], ["range", "head"])

    first = dict(rows.select("doc_id").mapInArrow(heads, "range int, head long").groupBy("range").agg(F.max("head")).collect())  # one row a range
    held = sorted(first)
    goes_to = {first[r]: held[(i + 1) % len(held)] for i, r in enumerate(held)}  # a range's head follows the last of the range above; the last of all is followed by the first

    def pack(batches):
        for batch in gathered(batches):
            ids, texts = batch.column(0).to_numpy(), text_column(batch).to_pylist()
            at = np.searchsorted(bounds, ids, "right")
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
            out = []
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                mine = order[lo:hi]
                out.append((int(at[mine[0]]), 0, pack_docs(ids[mine], [texts[i] for i in mine.tolist()])))
            for i in np.flatnonzero(np.isin(ids, list(goes_to))).tolist():
                out.append((goes_to[int(ids[i])], 1, pack_docs(ids[i : i + 1], [texts[i]])))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["range", "kind", "docs"])

    def run(key, table):
        kind = np.array(table.column("kind").to_pylist())
        blobs = table.column("docs").to_pylist()
        ids, texts = unpack_docs([b for b, k in zip(blobs, kind, strict=True) if k == 0])
        _, after = unpack_docs([b for b, k in zip(blobs, kind, strict=True) if k == 1])
        order = np.argsort(~ids, kind="stable")  # descending; texts of equal doc_ids are in order already
        ids, texts = ids[order], [texts[i] for i in order.tolist()]
        chars, changed, out = [], [], [[] for _ in range(5)]
        following = [*texts[1:], after[0]]
        for text, other in zip(texts, following, strict=True):
            n, new = edited(text, other)
            chars.append(n)
            changed.append(new)
        sets, new_sets = chunk_sets([*texts, after[0]]), chunk_sets(changed)
        for i, new in enumerate(new_sets):
            for column, x in zip(out, (hashlib.sha256(changed[i]).hexdigest(), written(sets[i]), written(new), near(sets[i], new), near(sets[i], sets[i + 1])), strict=True):
                column.append(x)
        return pa.table({"doc_id": pa.array(ids, mask=ids == NONE), "n_chars": pa.array(chars, pa.int64()), "edited_sha256": pa.array(out[0], pa.string()), "fingerprint": pa.array(out[1], pa.large_string()).cast(pa.string()), "edited_fingerprint": pa.array(out[2], pa.large_string()).cast(pa.string()), "near_edited": pa.array(out[3], pa.float64()), "near_next": pa.array(out[4], pa.float64())})

    parts = max(spark.sparkContext.defaultParallelism, math.ceil(len(held) / 2))
    return rows.mapInArrow(pack, "range int, kind int, docs binary").repartition(parts, "range").groupBy("range").applyInArrow(run, RESULT)
