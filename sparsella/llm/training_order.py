"""Training-order materialisation of token ids.

Documents, in a fixed order, form one stream of token ids, each document followed by an end mark; the
stream is cut into sequences of equal length. A keyed Feistel permutation with cycle-walking gives
every sequence a global slot: a bijection of 0..n-1, so no shuffle list is kept and a reader can
resume at any slot. Slots are range-partitioned into shards of fixed-stride rows.

Defined results: null and empty texts are an end mark alone; the order is by a hash group of doc_id,
then doc_id, then text (null doc_ids last); repeated rows are repeated in the stream; an empty table
gives no sequence; the last sequence is padded with end marks; extra columns are left alone.
"""

from __future__ import annotations

import base64
import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import chunk_of, text_bytes
from .common import bounded_batches, gathered, group_starts, mixed, text_column, trim, whole_groups

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed values of the public byte-level vocabulary: its end mark, and the pattern that splits text before merges.
END = 50256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens in a sequence, rows in a shard, bytes of text in a group of documents, words that a worker remembers.
LENGTH, SHARD_ROWS, GROUP_BYTES, REMEMBERED = 1024, 4096, 8 << 20, 400_000
NONE = np.iinfo(np.int64).max


class Tokenizer:
    """Token ids of whole texts. A merge never crosses a space that stands alone, so words are looked up one by one; a text with two spaces in a row is encoded as a whole."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.coding.encode_ordinary(text), np.uint16).tobytes()

    def __call__(self, text: str) -> bytes:
        if "  " in text or text[:1] == " ":
            return self.whole(text)
        head, *rest = text.split(" ")
        known, out = self.known, [self.whole(head)]
        for word in rest:
            ids = known.get(word)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[word] = self.whole(" " + word)
            out.append(ids)
        return b"".join(out)


class Feistel:
    """A keyed bijection of 0..n-1: four rounds over the least even number of bits that holds n, walked until it is below n."""

    def __init__(self, n: int, key: int, rounds: int = 4):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))
        self.mask = np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (mixed(left ^ k) & self.mask), left
            else:
                left, right = right, left ^ (mixed(right ^ k) & self.mask)
        return left << np.uint64(self.half) | right

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while len(far := np.flatnonzero(out >= np.uint64(self.n))):
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)


def _pack(ids: np.ndarray, parts: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(ids)) + ids.tobytes() + lengths.tobytes() + b"".join(parts))


def _tokenised(docs: DataFrame, groups: int, parts: int, vocabulary: str) -> DataFrame:
    """grp, tokens: packed documents by group."""

    def run(batches):
        tokenizer = Tokenizer(vocabulary)
        end = np.array([END], np.uint16).tobytes()
        for batch in gathered(batches):
            ids = batch.column(0).to_numpy()
            at = chunk_of(ids, groups)
            tokens = [tokenizer(t.decode()) + end for t in text_column(batch).to_pylist()]
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
            rows = [order[a:b] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(at[r[0]]) for r in rows], pa.int32()), pa.array([_pack(ids[r], [tokens[i] for i in r.tolist()]) for r in rows], pa.binary())], ["grp", "tokens"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NONE))).alias("doc_id"), "text")
    return rows.mapInArrow(run, "grp int, tokens binary").repartition(parts, "grp")


def _unpacked(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    trim()
    ids, tokens = [], []
    for blob in table.column("tokens").to_pylist():
        data = zstandard.ZstdDecompressor().decompress(blob)
        n = struct.unpack_from("<q", data)[0]
        mine = np.frombuffer(data, np.int64, n, 8)
        ends = (8 + 16 * n + np.cumsum(np.frombuffer(data, np.int64, n, 8 + 8 * n))).tolist()
        ids.append(mine)
        tokens += [data[s:e] for s, e in zip([8 + 16 * n, *ends[:-1]], ends, strict=True)]
    all_ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
    order = sorted(range(len(tokens)), key=lambda i: (all_ids[i], tokens[i]))
    return all_ids[order], [tokens[i] for i in order]


RESULT = "slot long, shard long, shard_row int, byte_offset long, sequence long, n_tokens int, doc_ids array<long>, tokens binary"


def materialised(docs: DataFrame, key: int = 20240229, length: int = LENGTH, shard_rows: int = SHARD_ROWS, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a sequence, ordered by slot within its shard: the shard, row and byte offset to write it at, the documents that it
    holds (as doc_ids, in order) and its token ids as 16-bit little-endian numbers. n_tokens leaves out padding."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = text_bytes(docs)
    groups = max(1, math.ceil(size / GROUP_BYTES))
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(groups / 2))
    base = _tokenised(docs, groups, parts, vocabulary)
    ranges = max(parts, math.ceil(size / 3 / length / shard_rows))

    def count(key, table):
        return pa.table({"grp": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([sum(map(len, _unpacked(table)[1])) // 2], pa.int64())})

    counts = base.groupBy("grp").applyInArrow(count, "grp int, n long")
    whole = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    starts = counts.select("grp", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))

    def cut(left, right):
        out = [[] for _ in range(7)]
        if left.num_rows:
            ids, tokens = _unpacked(left)
            start, total = right.column("start")[0].as_py(), right.column("total")[0].as_py()
            slot_of = Feistel(-(-total // length), key)
            shards = -(-slot_of.n // shard_rows)
            stream = np.frombuffer(b"".join(tokens), np.uint16)
            begins = start + np.concatenate(([0], np.cumsum([len(t) // 2 for t in tokens])))
            sequences = np.arange(start // length, (begins[-1] - 1) // length + 1)
            for sequence, slot in zip(sequences.tolist(), slot_of(sequences).tolist(), strict=True):
                lo, hi = max(sequence * length, start), min((sequence + 1) * length, int(begins[-1]))
                held = ids[np.searchsorted(begins, lo, "right") - 1 : np.searchsorted(begins, hi, "left")]
                for column, x in zip(out, (slot // shard_rows * ranges // shards, slot // shard_rows, slot, sequence, lo - sequence * length, held.astype(np.int64).tobytes(), stream[lo - start : hi - start].tobytes()), strict=True):
                    column.append(x)
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["range", "shard", "slot", "sequence", "place", "ids", "part"])

    pieces = base.groupBy("grp").cogroup(starts.groupBy("grp")).applyInArrow(cut, "range int, shard long, slot long, sequence long, place int, ids binary, part binary")

    def assemble(batches):
        for table in whole_groups(batches, ["slot"]):
            begin = group_starts(table, ["slot"])
            slot, sequence = table.column("slot").to_numpy(), table.column("sequence").to_numpy()
            ids, part = table.column("ids").to_pylist(), table.column("part").to_pylist()
            out = [[] for _ in range(3)]
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(slot)], strict=True):
                row = b"".join(part[lo:hi])
                held = np.frombuffer(b"".join(ids[lo:hi]), np.int64).tolist()
                out[0].append(len(row) // 2)
                out[1].append([None if x == NONE else x for x in held])
                out[2].append(row + np.full(length - len(row) // 2, END, np.uint16).tobytes())
            mine = slot[begin]
            yield pa.RecordBatch.from_arrays(
                [pa.array(mine), pa.array(mine // shard_rows), pa.array((mine % shard_rows).astype(np.int32)), pa.array(mine % shard_rows * 2 * length), pa.array(sequence[begin]), pa.array(out[0], pa.int32()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.binary())],
                ["slot", "shard", "shard_row", "byte_offset", "sequence", "n_tokens", "doc_ids", "tokens"],
            )

    # Ranges of slots, of whole shards: the number of sequences is known, so the ranges are exact and nothing is sampled.
    return pieces.repartitionById(ranges, F.col("range")).drop("range").sortWithinPartitions("slot", "place").mapInArrow(assemble, RESULT)


def write_shards(sequences: DataFrame, path: str) -> DataFrame:
    """Writes shard-<number>.bin under a path that pyarrow can open, each by one task, under a name of its own until it is whole: shard, rows, bytes. sequences: as materialised returns them, or read again in any order."""

    def run(batches):
        import uuid

        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root)
        for table in whole_groups(batches, ["shard"]):
            begin = group_starts(table, ["shard"])
            shard, tokens = table.column("shard").to_pylist(), table.column("tokens").to_pylist()
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(shard)], strict=True):
                name = f"{root}/shard-{shard[lo]:08d}.bin"
                part = f"{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    for row in tokens[lo:hi]:
                        out.write(row)
                files.move(part, name)
                yield pa.RecordBatch.from_arrays([pa.array([shard[lo]], pa.int64()), pa.array([hi - lo], pa.int64()), pa.array([sum(map(len, tokens[lo:hi]))], pa.int64())], ["shard", "rows", "bytes"])

    ordered = sequences.select("shard", "slot", "tokens").repartition("shard").sortWithinPartitions("shard", "slot").select("shard", "tokens")
    return ordered.mapInArrow(run, "shard long, rows long, bytes long")


def read_slots(path: str, first: int, count: int, length: int = LENGTH, shard_rows: int = SHARD_ROWS):
    """The sequences of consecutive slots, read in order from any slot on."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(path)
    while count > 0:
        shard, row = divmod(first, shard_rows)
        n = min(count, shard_rows - row)
        with files.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(row * 2 * length)
            data = np.frombuffer(f.read(n * 2 * length), "<u2").reshape(-1, length)
        if not len(data):
            return
        yield from data
        first, count = first + len(data), count - len(data)
