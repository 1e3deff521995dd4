"""Hashed indicator features of texts, made for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, Rolling, bounded_batches, mixed, slices, text_column, words

#: Byte classes of word shapes: capital, letter, digit; every other byte is its own class.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[48:58] = 65, 48
SHAPE[97:123] = SHAPE[128:] = 97
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that no term holds: all but letters, digits and bytes of other scripts.
NO_TERM = np.ones(256, bool)
NO_TERM[48:58] = NO_TERM[65:91] = NO_TERM[97:123] = NO_TERM[128:] = False

_BYTES, _SHAPES, _NGRAMS = Rolling(101), Rolling(103), Rolling(107)


def _ngrams(token: np.ndarray, doc: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and texts of the n-grams of tokens that stay within a text."""
    at = np.arange(max(0, len(token) - n + 1))
    at = at[doc[at] == doc[at + n - 1]] if len(at) else at
    sums = _NGRAMS.sums(token)
    return mixed(_NGRAMS.ranges(sums, at, at + n) + np.uint64(salt)), doc[at]


def _distinct(hashes: list[np.ndarray], docs: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.concatenate([d.astype(np.uint64) << np.uint64(bits) | h >> np.uint64(64 - bits) for h, d in zip(hashes, docs, strict=True)])
    pairs.sort()
    if len(pairs):
        pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
    return (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64((1 << bits) - 1)).astype(np.int64)


def style_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs: word uni- and bigrams, word-shape uni-, bi- and trigrams, and bigrams of a word with itself by text share."""
    starts, ends, first = words(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    low = LOWER[data]
    token = _BYTES.ranges(_BYTES.sums(low), starts, ends)
    kind = SHAPE[data]
    stays = np.ones(len(data), bool)
    stays[1:] = kind[1:] != kind[:-1]
    stays[starts] = True
    place = np.concatenate(([0], np.cumsum(stays)))
    shape = _SHAPES.ranges(_SHAPES.sums(kind[stays]), place[starts], place[ends])
    hashes, docs = [], []
    for what, n, salt in ((token, 1, 1), (token, 2, 2), (shape, 1, 3), (shape, 2, 4), (shape, 3, 5)):
        h, d = _ngrams(what, doc, n, salt)
        hashes.append(h)
        docs.append(d)
    total = np.maximum(np.diff(first), 1)
    again = np.flatnonzero((token[1:] == token[:-1]) & (doc[1:] == doc[:-1])) if len(token) else np.empty(0, int)
    share = np.bincount(doc[again], minlength=len(total)) / total
    ranked = np.sort(doc.astype(np.uint64) << np.uint64(44) | token >> np.uint64(20))
    distinct = np.bincount((ranked[np.concatenate(([True], ranked[1:] != ranked[:-1]))] >> np.uint64(44)).astype(np.int64), minlength=len(total)) / total if len(ranked) else np.zeros(len(total))
    for salt, value in ((6, share), (7, distinct)):
        hashes.append(mixed(np.floor(value * 8).astype(np.uint64) + np.uint64(salt << 32)))
        docs.append(np.arange(len(total)))
    return _distinct(hashes, docs, bits)


def term_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs: lower-cased terms."""
    starts, ends, first = words(data, offsets, NO_TERM)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return _distinct([_BYTES.ranges(_BYTES.sums(LOWER[data]), starts, ends)], [doc], bits)


def feature_rows(docs: DataFrame, make, bits: int, keep: list[str]) -> DataFrame:
    """The columns in keep, and the text's features as int32 in a binary column."""
    kinds = dict(docs.dtypes)
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for lo, hi, data, offsets in slices(text_column(batch)):
                doc, feature = make(data, offsets, bits)
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
                feature = feature.astype(np.int32)
                out += [feature[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.binary())], [*keep, "features"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", features binary")


def labelled(docs: DataFrame, labels: DataFrame, label: str, make, bits: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, row ends and features of at most `most` labelled rows outside the held-out fold, the same rows at every run: those whose ids hash lowest."""
    mine = labels.where(f"doc_id is not null and {label} is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0")
    mine = mine.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(mine), "doc_id")  # at most `most` ids
    made = feature_rows(rows, make, bits, ["doc_id", "y"]).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("features")).limit(most)  # a doc_id may stand on many rows
    found = made.toArrow().sort_by([("doc_id", "ascending")])
    parts = [np.frombuffer(x, np.int32) for x in found.column("features").to_pylist()]
    y = found.column("y").to_numpy().astype(np.int64)
    return y, np.cumsum([0, *map(len, parts)]), np.concatenate(parts) if parts else np.empty(0, np.int32)


def scored(docs: DataFrame, make, bits: int, score, cut: float) -> DataFrame:
    """doc_id, held_out, score and predicted; score takes (text numbers, features, texts) and gives a score for each text."""

    def run(batches):
        for batch in batches:
            out = []
            for lo, hi, data, offsets in slices(text_column(batch)):
                doc, feature = make(data, offsets, bits)
                out.append(score(doc, feature, hi - lo))
            total = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.float64()), pa.array((total >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    bounded_batches(docs.sparkSession)
    held = F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
