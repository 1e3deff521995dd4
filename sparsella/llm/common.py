"""Helpers shared by the training-data operators: byte-level numpy kernels on Arrow
text columns, storage that every executor shares, and connected components."""

from __future__ import annotations

import contextvars
import ctypes
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel takes at once; a longer text is one slice of its own.
SLICE = 1 << 18


def row_key(of: str = "") -> Column:
    """128 bits of a row's doc_id and text, as two hashes; of: prefix of the columns' names."""
    return F.struct(F.xxhash64(f"{of}doc_id", f"{of}text").alias("a"), F.xxhash64(F.lit(7), f"{of}doc_id", f"{of}text").alias("b"))


def whole_row(df: DataFrame) -> Column:
    """All columns in a struct `doc`, so that none clashes with a column of an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")


#: Type of row_key.
KEY = "struct<a:bigint,b:bigint>"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; where it is unset, a folder of this machine if Spark runs on it alone, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "/tmp/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Paths of what the operator that runs in this thread has stored, where they are to be deleted after it.
_PASSING: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("passing", default=None)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that no plan needs any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _written(df: DataFrame, what: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    return path


def stored(df: DataFrame, what: str = "step") -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage is cut and lost executors cost no recomputation.

    It also frees joins of a hot key: Spark knows the size of a stored table, and splits a hot key of the other side, which
    it cannot where an aggregate lies between the join and its shuffle.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_written(df, what))


def settled(make: Callable[[], DataFrame], what: str = "step", spent: list[str] | None = None) -> DataFrame:
    """make()'s rows, stored; what it stored on its way is deleted once they are whole, and so are the tables
    in spent, which then names the new one: a chain of steps hands one list on and leaves only its last table."""
    passing = [] if spent is None else spent
    token = _PASSING.set(passing)
    try:
        df = make()
    finally:
        _PASSING.reset(token)
    path = _written(df, what)
    for old in passing:
        forget(df.sparkSession, old)
    passing[:] = [path]
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most rows of keys that are broadcast.
BROADCAST_KEYS = 500_000


def few(df: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """df (keys and small columns), stored, and to be broadcast if it turns out to have at most `most` rows; beyond, Spark joins by shuffle."""
    df = stored(df, "few")
    return F.broadcast(df) if df.count() <= most else df


#: Rows in an Arrow batch of whole texts, and bytes of text that a packer gathers before it deals them out.
BATCH_ROWS, GATHERED = 1000, 12 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows, unless the session asks for fewer: with whole texts, Spark's default of 10,000 takes much of a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def gathered(batches, limit: int = GATHERED):
    """Batches put together until they hold about limit bytes."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def trim() -> None:
    """Gives memory that a worker no longer uses back to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A string or binary column as binary, nulls as empty."""
    trim()
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return column.fill_null(b"") if column.null_count else column


def slices(column: pa.Array, limit: int = SLICE):
    """(first row, end row, bytes, offsets) of consecutive rows that hold about limit bytes together."""
    if not len(column):
        return
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """64-bit hashes of any ranges of a sequence, from prefix sums of value * M**i modulo 2**64."""

    def __init__(self, seed: int):
        self.seed, self.table = seed, _random(256, seed)
        self.base = (int(_random(1, seed + 1)[0]) * 4 + 5) % (1 << 64)
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            n = max(n + 1, 2 * len(self.powers), 1 << 16)
            back = pow(self.base, -1, 1 << 64)
            for name, base in (("powers", self.base), ("inverse", back)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """values: bytes, or 64-bit words that are already hashes."""
        self._grow(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((self.table[values] if values.dtype == np.uint8 else values) * self.powers[: len(values)], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: Which bytes part words: space and 9 to 13.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of some texts, and for each text the index of its first word (one more at the end)."""
    solid = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins or ends here: no word goes on
    edge[offsets] = True
    begins, stops = solid & edge[:-1], solid & edge[1:]
    begins[1:] |= solid[1:] & ~solid[:-1]
    stops[:-1] |= solid[:-1] & ~solid[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def group_starts(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where the rows' keys (integers) change; the rows are sorted by them."""
    new = np.ones(table.num_rows, bool)
    if table.num_rows:
        new[1:] = False
        for k in keys:
            column = table.column(k).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def whole_groups(batches, keys: list[str]):
    """Tables of whole groups, of a partition whose rows are sorted by keys (integers, without nulls)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(group_starts(batch, keys)[-1])
        first = {k: batch.column(k)[0].as_py() for k in keys}
        if held and any(held[-1].column(k)[-1].as_py() != v for k, v in first.items()):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Of undirected edges (a, b): one row (node, component) for each node, component the least node it reaches.

    Alternates the large-star and small-star steps of Kiveris et al. (2014); each is a minimum by
    node and a join. Every step is stored in the shared folder: minima are combined before their shuffle,
    and as they are stored, a hub's edges are split over tasks in the join. What is stored is deleted at the end.
    """

    def settle() -> DataFrame:
        now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        state = None
        for _ in range(rounds):
            both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
            large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
            least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
            small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
            now = stored(small, "edges")
            was, state = state, tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(a as decimal(38,0)) + b)")).first())
            if state == was:
                return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        raise RuntimeError(f"components did not settle in {rounds} rounds")

    return settled(settle, "components")
