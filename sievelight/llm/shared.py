"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One word, as the contracts of the queries define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An odd factor of 64 bits.
BASE = 0x9E3779B97F4A7C15
#: Words whose hash a Python worker remembers; past it, hashes are computed anew.
HASH_CACHE = 250_000


#: Rows that go to a Python worker at once, at most: with long texts, the session's default of 10,000 takes much memory on both sides.
ROWS_A_BATCH = 2_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Spark deletes the shuffle files of a query when it ends, where this holds.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch in this session, unless they are fewer already."""
    if not 0 < int(spark.conf.get(BATCH, "10000")) <= ROWS_A_BATCH:
        spark.conf.set(BATCH, str(ROWS_A_BATCH))


def release() -> None:
    """Give memory that a Python worker holds for nothing back to the system: workers wait for the next task and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run inside go as soon as each ends."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered, as UTF-8. ``bytes.split`` cuts at exactly the white space that WORD excludes, and
    ``bytes.lower`` changes only A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < HASH_CACHE:
            self[word] = value
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter sequence is one shingle as a whole, none gives none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, k)
    value = np.zeros(n - width + 1, np.uint64)
    for i in range(width):  # one odd factor a place, so the order of words counts
        value += hashes[i : n - width + 1 + i] * np.uint64((BASE * (2 * i + 1) ** 7) & (2**64 - 1))
    return np.unique(mix(value + np.uint64(width)))


def map_batches(df: DataFrame, each: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | dict | None]], schema: str | T.StructType) -> DataFrame:
    """Apply a function to Arrow batches. ``each`` runs once a task and returns the function, which may return a dict of
    columns in the order of the schema, or None for nothing."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = each()
        for batch in batches:
            if batch.num_rows and (out := one(batch)) is not None:
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(out.values(), arrow, strict=True)], schema=arrow)
                yield out
        del one
        release()

    return df.mapInArrow(run, kind)


def lists(values: np.ndarray, counts: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. A session in local mode that has none gets one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = kept.get() if kept.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: its lineage ends there, and a lost executor loses nothing. Its shuffle
    files go as soon as it is written."""
    spark, path = df.sparkSession, work_dir(df.sparkSession)
    bounded(spark)
    with cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``written`` stored, once nothing needs it."""
    if path := getattr(df, "_stored_at", None):
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration() if hasattr(df.sparkSession, "_jsc") else df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def keyed(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """The table with a column ``name``, a different integer for each row, rising in the order of ids, null ids last. Where ids are
    whole, different numbers they are that column. Else the rows are numbered in the order of (id, md5 of the text) and written
    once; rows equal in both are numbered as they come, which spreads them over partitions, too."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if ids.groupBy("id").agg(F.count("*").alias("n")).where("id is null or n > 1").isEmpty():
        return docs.withColumn(name, F.col(id_col).cast("long"))
    place, text = unused(docs, "place"), unused(docs, "text_md5")
    order = [F.col(id_col).cast("long").asc_nulls_last(), F.col(text).asc_nulls_last(), F.col(place)]
    marked = docs.withColumn(place, F.monotonically_increasing_id()).withColumn(text, F.md5(F.col(text_col).cast("binary")))
    parts = max(1, -(-docs.count() // 100_000))
    dealt = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop(place, text)
    return written(dealt.withColumn(name, F.monotonically_increasing_id()))


def fold_of(column: str, parts: int) -> Column:
    """crc32 of an id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


#: Bytes hashed at once, about, which stay in a core's cache; a longer run without white space is taken whole.
BLOCK_BYTES = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)


def chunks(column: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of about ``size`` bytes each, which bounds a worker's memory; a longer text is taken whole."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    a = 0
    while a < len(column):
        b = max(int(np.searchsorted(offsets, int(offsets[a]) + size)), a + 1)
        yield a, column.slice(a, b - a)
        a = b


class FlatWords:
    """Hashes all words of a column at once, with A-Z lowered: prefix sums of byte times power give each word's polynomial, which
    is scrambled together with its length."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, BLOCK_BYTES + 2**16)
            self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, BASE, np.uint64)])
            self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, pow(BASE, -1, 2**64), np.uint64)])

    def block(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.powers(len(data))
        total = np.cumsum(_LOWER[data] * self.up[: len(data)])
        before = np.where(starts > 0, total[starts - 1], np.uint64(0))
        return mix((total[ends - 1] - before) * self.down[starts] + (ends - starts).astype(np.uint64))

    def __call__(self, column: pa.Array) -> "FlatTexts":
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        wide = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        word = np.r_[False, ~_SPACE[data], False]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(word[1:] & (~word[:-1] | edge) & np.r_[word[1:-1], False])
        ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
        return FlatTexts(data, offsets, starts, ends, self.blocks(data, starts, ends))

    def blocks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = np.empty(len(starts), np.uint64)
        a = 0
        while a < len(starts):
            b = max(int(np.searchsorted(ends, starts[a] + BLOCK_BYTES, "right")), a + 1)
            hashes[a:b] = self.block(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a])
            a = b
        return hashes

    def hashed(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hashes of words that stand next to each other, of the given sizes."""
        ends = np.cumsum(sizes)
        return self.blocks(data, ends - sizes, ends)


class FlatTexts:
    """Words of a column: hashes of all, and the place of each text among them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        self.data, self.offsets, self.starts, self.ends, self.hashes = data, offsets, starts, ends, hashes
        self.bounds = np.searchsorted(starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, k: int) -> np.ndarray:
        return self.hashes[self.bounds[k] : self.bounds[k + 1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and line in it (from 0) of each word."""
        breaks = np.flatnonzero(self.data == 10)
        text = np.repeat(np.arange(len(self)), np.diff(self.bounds))
        line = np.searchsorted(breaks, self.starts)
        return text, line - np.searchsorted(breaks, self.offsets)[text]
