"""Removal of long byte strings that start anywhere else, same document included: run-length indexes of
the passages that may repeat.

The corpus is cut by content into blocks that can be indexed alone. Every L-byte string has an anchor:
the least hash among its A-byte substrings, the leftmost of equal ones. Equal strings have equal anchors
at equal places, so only strings whose anchors repeat can repeat. A run of strings with one anchor is its
context. Equal contexts are counted and held once, like a run of the transform; one that stands in two
places repeats as a whole. Where an anchor has several contexts, each goes once to the block of the
anchor, where a run-length Burrows-Wheeler index of the block's contexts is built (rindex.RunIndex) and
its matching statistics say which strings of a context also start in another one.

An anchor with more than HOT contexts (a passage shorter than L in very many texts) would make a block
without bound. Its strings are spread by two 64-bit hashes of each string and counted instead.

Contexts count as equal if two 64-bit hashes from different bases agree, of the anchor and of the whole
context; strings in an index are compared byte by byte.

Defined results: null texts are empty; texts shorter than L bytes keep all; repeated rows count as
occurrences of each other; so do rows with a null doc_id; extra columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import NO_ID, bucket_of, bucket_runs, packed, planes, sizes, unpack_docs, unplaned
from .common import Rolling, mixed, slices, trim
from .rindex import RunIndex

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
NOTE = "chunk int, kind int, bucket int, bits binary"
SENT = "kind int, bucket int, chunk int, hashes binary, more binary, flags binary, texts binary"
#: Most contexts of an anchor that are indexed together, and bytes of contexts in an index, about.
HOT, INDEX_BYTES = 2048, 1 << 21
#: What a chunk learns of a context: it is alone; it stands elsewhere too; it is to be indexed, and is asked for or only held against others; or its strings are to be counted one by one.
ALONE, REPEATS, ASKED, HELD, ASKED_HOT, HELD_HOT = range(6)
_PLACE = np.uint64((1 << 28) - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BYTES, _MORE = Rolling(211), Rolling(223)


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    span, now = 1, values
    while 2 * span <= width:
        now = np.minimum(now[:-span], now[span:])
        span *= 2
    rest = width - span
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


class Anchors:
    """The anchors of some texts' L-byte strings, one row for each run of strings that share one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
        self.data, self.offsets, self.length = data, offsets, length
        self.low = self.high = self.at = np.empty(0, np.int64)
        sums = _BYTES.sums(data)
        if len(data) >= length:
            places = np.arange(len(data) - anchor + 1)
            grams = _BYTES.ranges(sums, places, places + anchor)
            least = least_in(grams & ~_PLACE | places.astype(np.uint64) & _PLACE, length - anchor + 1)
            starts = np.arange(len(data) - length + 1)
            at = starts + ((least & _PLACE).astype(np.int64) - starts & int(_PLACE))
            ends = np.searchsorted(offsets, starts, "right")  # the text of each string, and whether the string ends in it
            inside = starts + length <= offsets[ends]
            new = inside.copy()
            new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1] | (ends[1:] != ends[:-1])
            self.low = np.flatnonzero(new)
            stops = inside.copy()
            stops[:-1] &= new[1:] | ~inside[1:]
            self.high, self.at = np.flatnonzero(stops), at[self.low]
        self.gram = mixed(_BYTES.ranges(sums, self.at, self.at + anchor) ^ _SPREAD)  # a least hash is small: mixed again, so that buckets are even
        self.context = _MORE.ranges(_MORE.sums(data), self.low, self.high + length)

    def strings(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes and the starts of the strings of these rows."""
        n = self.high[rows] - self.low[rows] + 1
        at = np.repeat(self.low[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return (*(h.ranges(h.sums(self.data), at, at + self.length) for h in (_BYTES, _MORE)), at)


def distinct_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct pair stands first, in order of the pairs, and for each place the number of its pair."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, bool)
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number  # lexsort is stable


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


class Chunk:
    """The anchors of a chunk's documents, and its distinct contexts in order of anchor and context."""

    def __init__(self, table: pa.Table, length: int, anchor: int):
        self.ids, self.texts = unpack_docs(table.column("docs").to_pylist() if table.num_rows else [])
        self.parts = [Anchors(data, offsets, length, anchor) for *_, data, offsets in slices(pa.array(self.texts, pa.large_binary()))]
        join = lambda xs, t=np.uint64: np.concatenate(xs) if xs else np.empty(0, t)
        gram, context = join([a.gram for a in self.parts]), join([a.context for a in self.parts])
        self.part = join([np.full(len(a.low), i) for i, a in enumerate(self.parts)], np.int64)
        self.within = join([np.arange(len(a.low)) for a in self.parts], np.int64)
        self.first, self.number = distinct_pairs(gram, context)
        self.gram, self.context = gram[self.first], context[self.first]
        self.often = np.bincount(self.number, minlength=len(self.first)) > 1

    def codes(self, notes: pa.Table, buckets: int) -> np.ndarray:
        out, runs = np.zeros(len(self.gram), np.uint8), {b: (lo, hi) for b, lo, hi in bucket_runs(self.gram, buckets)}
        for b, bits in _notes(notes, 0):
            lo, hi = runs[b]
            out[lo:hi] = np.frombuffer(bits, np.uint8)
        return out

    def size(self, pairs: np.ndarray) -> np.ndarray:
        """Strings in contexts."""
        n = np.concatenate([a.high - a.low + 1 for a in self.parts]) if self.parts else np.empty(0, np.int64)
        return n[self.first[pairs]]

    def text(self, pair: int) -> bytes:
        row = self.first[pair]
        a, i = self.parts[self.part[row]], self.within[row]
        return a.data[a.low[i] : a.high[i] + a.length].tobytes()

    def hot_strings(self, code: np.ndarray):
        """Of the contexts whose strings are counted one by one: both hashes, part and start of each string; the place of each distinct string's first, and its number for each string."""
        rows, out = np.isin(code, (ASKED_HOT, HELD_HOT))[self.number], []
        for i, a in enumerate(self.parts):
            mine = self.within[rows & (self.part == i)]
            if len(mine):
                h, g, at = a.strings(mine)
                out.append((h, g, np.full(len(at), i), at))
        h, g, part, at = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        return h, g, part, at, *distinct_pairs(h, g)


def _notes(notes: pa.Table, kind: int):
    for of, b, bits in zip(*(notes.column(c).to_pylist() for c in ("kind", "bucket", "bits")), strict=True):
        if of == kind:
            yield b, bits


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    """Rows of a schema of ints and binaries."""
    fields = [x.strip().split(" ") for x in schema.split(",")]
    return pa.table({name: pa.array([r[i] for r in rows], {"int": pa.int32(), "binary": pa.binary()}[kind]) for i, (name, kind) in enumerate(fields)})


def _entries(table: pa.Table) -> tuple[list[int], list[np.ndarray], list[np.ndarray], list[np.ndarray], list[bytes]]:
    """Of the rows of a bucket, in order of chunk: chunk, hashes, more, flags (two for each, in rows) and texts."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "hashes", "more", "flags", "texts")), strict=True), key=lambda r: r[0])
    hashes = [unplaned(r[1], np.uint64) for r in rows]
    return [r[0] for r in rows], hashes, [unplaned(r[2], np.uint64) for r in rows], [_unbits(r[3], len(h)) for r, h in zip(rows, hashes, strict=True)], [r[4] for r in rows]


def judged_contexts(hot: int):
    """For each chunk's contexts of a bucket of anchors: what becomes of them."""

    def run(key, table):
        trim()
        chunks, grams, contexts, often, _ = _entries(table)
        lengths = list(map(len, grams))
        gram, often = np.concatenate(grams), np.concatenate(often)
        first, number = distinct_pairs(gram, np.concatenate(contexts))
        held = np.bincount(number, minlength=len(first))
        held[number[often]] += 1
        anchor = np.cumsum(np.concatenate(([0], gram[first][1:] != gram[first][:-1])))  # of each distinct context
        several = np.bincount(anchor)[anchor]
        repeats, shared, large = held[number] > 1, several[number] > 1, several[number] > hot
        leads = np.zeros(len(gram), bool)
        leads[first] = True
        code = np.where(repeats, REPEATS, ALONE)
        code[shared & leads] = np.where(repeats, HELD, ASKED)[shared & leads] + 2 * large[shared & leads]
        out = np.split(code.astype(np.uint8), np.cumsum(lengths)[:-1])
        return _table(NOTE, [(c, 0, key[0].as_py(), x.tobytes()) for c, x in zip(chunks, out, strict=True)])

    return run


def indexed_contexts(length: int, index_bytes: int):
    """kind 1: for the contexts asked for, in order, a bit for each string: it matches elsewhere. kind 2: for each distinct hot string."""

    def counted(chunks, hashes, more, often):
        first, number = distinct_pairs(np.concatenate(hashes), np.concatenate(more))
        held = np.bincount(number, minlength=len(first))
        held[number[np.concatenate(often)]] += 1
        return np.split(held[number] > 1, np.cumsum(list(map(len, hashes)))[:-1])

    def matched(hashes, asked, texts):
        own = [_texts(x) for x in texts]
        gram, flag, chunk = np.concatenate(hashes), np.concatenate(asked), np.repeat(np.arange(len(own)), list(map(len, own)))
        flat = [t for x in own for t in x]
        sizes_, order = np.fromiter(map(len, flat), np.int64, len(flat)), np.argsort(gram, kind="stable")
        begin = np.flatnonzero(np.append(True, gram[order][1:] != gram[order][:-1]))
        order = order[np.repeat(np.logical_or.reduceat(flag[order], begin), np.diff(np.append(begin, len(order))))]  # anchors of which a context is asked for
        out: list[list[np.ndarray]] = [[] for _ in own]
        found: dict[int, np.ndarray] = {}
        ends = np.flatnonzero(np.append(gram[order][1:] != gram[order][:-1], True)[: len(order)]) + 1  # of the contexts of each anchor
        total, lo = np.concatenate(([0], np.cumsum(sizes_[order]))), 0
        while lo < len(order):
            hi = int(ends[max(np.searchsorted(total[ends], total[lo] + index_bytes, "right") - 1, np.searchsorted(ends, lo, "right"))])
            mine = order[lo:hi]
            index = RunIndex([flat[i] for i in mine.tolist()])
            far = index.matching_statistics(length) >= length
            for i, s in zip(mine.tolist(), index.starts.tolist(), strict=False):
                if flag[i]:
                    found[i] = far[s : s + len(flat[i]) - length + 1]
            lo = hi
        for i in np.flatnonzero(flag).tolist():
            out[chunk[i]].append(found[i])
        return [np.concatenate(x) if x else np.empty(0, bool) for x in out]

    def run(key, table):
        trim()
        kind, bucket = key[0].as_py(), key[1].as_py()
        chunks, hashes, more, flags, texts = _entries(table)
        out = matched(hashes, flags, texts) if kind == 1 else counted(chunks, hashes, more, flags)
        return _table(NOTE, [(c, kind, bucket, _bits(x)) for c, x in zip(chunks, out, strict=True)])

    return run


def _texts(blob: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[:4], "little")
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(data, np.uint32, n, 4))).tolist()
    return [data[s:e] for s, e in zip([4 + 4 * n, *ends[:-1]], ends, strict=True)]


def _blob(texts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(len(texts).to_bytes(4, "little") + np.array(list(map(len, texts)), np.uint32).tobytes() + b"".join(texts))


def marked_bytes(base: DataFrame, notes: DataFrame, length: int, anchor: int, buckets: int, more: int) -> DataFrame:
    def run(left, right):
        c = Chunk(left, length, anchor)
        code = c.codes(right, buckets)
        steps = [np.zeros(int(a.offsets[-1]) + 1, np.int32) for a in c.parts]
        whole = np.isin(code, (REPEATS, HELD, HELD_HOT))[c.number]
        asked = np.flatnonzero(np.isin(code, (ASKED, HELD)))
        bits, runs = dict(_notes(right, 1)), bucket_runs(c.gram[asked], more)
        singles = []  # part and start of strings that match elsewhere
        for b, lo, hi in runs:
            mine = asked[lo:hi]
            mine = mine[code[mine] == ASKED]
            sizes_ = c.size(mine)
            flags = _unbits(bits[b], int(sizes_.sum()))
            row = np.repeat(c.first[mine], sizes_)
            step = np.arange(len(row)) - np.repeat(np.cumsum(sizes_) - sizes_, sizes_)
            lows = np.concatenate([a.low for a in c.parts])
            singles.append((c.part[row][flags], (lows[row] + step)[flags]))
        h, _, part, at, first, number = c.hot_strings(code)
        if len(first):
            gone, bits = np.zeros(len(first), bool), dict(_notes(right, 2))
            for b, lo, hi in bucket_runs(h[first], more):
                gone[lo:hi] = _unbits(bits[b], hi - lo)
            singles.append((part[gone[number]], at[gone[number]]))
        for i, a in enumerate(c.parts):
            mine = c.within[whole & (c.part == i)]
            np.add.at(steps[i], a.low[mine], 1)
            np.add.at(steps[i], a.high[mine] + length, -1)
            for p, s in singles:
                np.add.at(steps[i], s[p == i], 1)
                np.add.at(steps[i], s[p == i] + length, -1)
        removed, spans, digests, texts = [], [], [], []
        for a, step in zip(c.parts, steps, strict=True):
            offsets, out = a.offsets, np.cumsum(step[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(out)))
            begins = out.copy()
            begins[1:] &= ~out[:-1]
            first = offsets[:-1][offsets[:-1] < len(out)]
            begins[first] = out[first]
            starts = np.concatenate(([0], np.cumsum(begins)))
            removed.append(total[offsets[1:]] - total[offsets[:-1]])
            spans.append(starts[offsets[1:]] - starts[offsets[:-1]])
            for i in range(len(offsets) - 1):
                text = c.texts[len(texts)]
                if removed[-1][i]:
                    text = np.frombuffer(text, np.uint8)[~out[offsets[i] : offsets[i + 1]]].tobytes()
                digests.append(hashlib.sha256(text).hexdigest())
                texts.append(text)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pa.table({"doc_id": pa.array(c.ids, pa.int64(), mask=c.ids == NO_ID), "n_bytes": pa.array(list(map(len, c.texts)), pa.int64()), "n_removed": pa.array(join(removed), pa.int64()), "n_spans": pa.array(join(spans), pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(texts, pa.binary())})

    return base.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(run, RESULT + ", kept binary")


def drop_long_matches(docs: DataFrame, length: int = 400, anchor: int = 128, chunk_bytes: int = 2 << 20, hot: int = HOT, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Documents without the bytes of strings of the given length that start anywhere else."""
    chunks, parts, buckets = sizes(docs, 4.4 / (length - anchor), chunk_bytes)  # an entry has two hashes
    more = max(buckets, 1 << (chunks // 2).bit_length())
    base = packed(docs, chunks, parts, by_id=False)

    def anchors(key, table):
        c, chunk = Chunk(table, length, anchor), key[0].as_py()
        return _table(SENT, [(0, b, chunk, planes(c.gram[lo:hi]), planes(c.context[lo:hi]), _bits(c.often[lo:hi]), b"") for b, lo, hi in bucket_runs(c.gram, buckets)])

    notes = base.groupBy("chunk").applyInArrow(anchors, SENT).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(judged_contexts(hot), NOTE)

    def contexts(left, right):
        c, rows = Chunk(left, length, anchor), []
        chunk, code = left.column("chunk")[0].as_py() if left.num_rows else -1, c.codes(right, buckets)
        sent = np.flatnonzero(np.isin(code, (ASKED, HELD)))
        for b, lo, hi in bucket_runs(c.gram[sent], more):
            mine = sent[lo:hi]
            rows.append((1, b, chunk, planes(c.gram[mine]), planes(c.context[mine]), _bits(code[mine] == ASKED), _blob([c.text(i) for i in mine.tolist()])))
        h, g, _, _, first, number = c.hot_strings(code)
        h, g, often = h[first], g[first], np.bincount(number, minlength=len(first)) > 1
        rows += [(2, b, chunk, planes(h[lo:hi]), planes(g[lo:hi]), _bits(often[lo:hi]), b"") for b, lo, hi in bucket_runs(h, more)]
        return _table(SENT, rows)

    found = base.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(contexts, SENT).repartition(more, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(indexed_contexts(length, index_bytes), NOTE)
    return marked_bytes(base, notes.union(found), length, anchor, buckets, more)
