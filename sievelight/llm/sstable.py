"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their identifier:

    data blocks | block index | Bloom filter | footer

A block holds records until it reaches BLOCK_BYTES. A record is: bytes that its key shares with the key before (varint), bytes of
the rest of the key (varint), number of ids (varint), the rest of the key, the ids as little-endian 16- or 32-bit integers (as the
footer says). Keys are 9 bytes whose order is the order of ids: 0x00 for a null id, else 0x01 and the id, big-endian, sign
flipped. The index has for each block the last key (length as varint, bytes), offset, length and crc32 of the block and its
records and ids, all varints. The Bloom filter is its number of hashes (one byte) and its bits. The footer is of a fixed size:
offsets and lengths of index and filter, number of documents and of ids, bytes per id, and the magic.

A lookup asks the filter, finds the block by binary search in the index, and reads that block alone.

Shards are ranges of identifiers, one task each, written under a temporary name and renamed, so a task that runs twice leaves one
whole file. Files are reached by ``pyarrow.fs``, so any store it knows will do.

Defined cases: null and empty texts are a document of the end id alone. Rows with equal ids are all kept, next to each other in
the order of a hash of their text, and may span shards, so many rows of one id are no heavier than others. A null id comes first.
Text that looks like a special token is one, as the library does by default. Other columns are neither read nor touched.
"""

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import chunks, release, table, work_dir, written
from .tokens import encoder

MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<QQQQQQB8s")
BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 12, 8
END = 0
#: Rows and bytes of text of a shard, about, whichever are reached first; shards whose ids are summed together.
SHARD_ROWS, SHARD_BYTES, SHARDS_A_GROUP = 8_000, 32 << 20, 1_000


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def key_of(id_: int | None) -> bytes:
    return b"\x00" if id_ is None else b"\x01" + struct.pack(">Q", id_ + 2**63)


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - 2**63


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & (2**64 - 1) | 1
    return [(a + i * b) % 2**64 % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard to a binary stream; keys must come in order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.last, self.keys, self.index = bytearray(), b"", [], []
        self.records = self.ids = self.docs = self.all_ids = 0

    def add(self, id_: int | None, ids: bytes) -> None:
        key = key_of(id_)
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        n = len(ids) // self.width
        self.block += varint(shared) + varint(len(key) - shared) + varint(n) + key[shared:] + ids
        self.last = key
        self.keys.append(key)
        self.records += 1
        self.ids += n
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.records:
            self.out.write(self.block)
            self.index.append(varint(len(self.last)) + self.last + varint(self.at) + varint(len(self.block)) + varint(zlib.crc32(self.block)) + varint(self.records) + varint(self.ids))
            self.at += len(self.block)
            self.docs += self.records
            self.all_ids += self.ids
            self.block, self.last, self.records, self.ids = bytearray(), b"", 0, 0

    def close(self) -> None:
        self.flush()
        index = varint(len(self.index)) + b"".join(self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[probes(key, bits)] = 1
        bloom = bytes([BLOOM_HASHES]) + np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.all_ids, self.width, MAGIC))


class Reader:
    """Reads one shard; ``source`` is an opened random-access file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        if size < FOOTER.size:
            raise ValueError("not a shard")
        index_at, index_size, bloom_at, bloom_size, self.docs, self.ids, self.width, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        data, self.blocks = self.read(index_at, index_size), []
        n, at = read_varint(data, 0)
        for _ in range(n):
            size, at = read_varint(data, at)
            entry = [data[at : at + size]]
            at += size
            for _ in range(5):
                value, at = read_varint(data, at)
                entry.append(value)
            self.blocks.append(tuple(entry))
        bloom = self.read(bloom_at, bloom_size)
        self.bloom = bloom[1:]

    def read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, crc, _, _ = self.blocks[k]
        data, key, at = self.read(at, size), b"", 0
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {k} is damaged")
        while at < size:
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n * self.width]
            at += n * self.width

    def rows(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.blocks)):
            for key, ids in self.block(k):
                yield id_of(key), ids

    def get(self, id_: int | None) -> list[np.ndarray]:
        """Ids of all documents with this identifier."""
        key = key_of(id_)
        bits = len(self.bloom) * 8
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, bits)):
            return []
        out, k = [], bisect_left(self.blocks, (key,))
        while k < len(self.blocks):
            found = [ids for own, ids in self.block(k) if own == key]
            out += [np.frombuffer(x, f"<u{self.width}") for x in found]
            if self.blocks[k][0] != key or not found:
                break
            k += 1
        return out


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards; returns (shard, path, docs, ids) of each, in order of shards."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    shards = max(1, -(-n // shard_rows), -(-size // shard_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    # The row's number deals out what is equal in both.
    dealt = rows.repartitionByRange(shards, *order, F.col("row")).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = place(folder)
        writer = out = None
        path, last = f"{root}/shard-{task.partitionId():06d}.sst", b""
        part = f"{path}.{task.taskAttemptId()}"
        encode = encoder(vocabulary)
        stop = np.array([end], encode.kind).tobytes()
        for batch in batches:
            for first, texts in chunks(batch["text"], 4 << 20):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(part)
                    writer = Writer(out, encode.width)
                flat, bounds = encode(texts)
                data, bounds = flat.tobytes(), (bounds * encode.width).tolist()
                for k, id_ in enumerate(batch["id"].slice(first, len(texts)).to_pylist()):
                    writer.add(id_, data[bounds[k] : bounds[k + 1]] + stop)
        if writer is not None:
            writer.close()
            out.close()
            if store.get_file_info(path).type != fs.FileType.NotFound:  # of a task that ran before
                store.delete_file(path)
            store.move(part, path)
            release()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([path]), pa.array([writer.docs], pa.int64()), pa.array([writer.all_ids], pa.int64())], ["shard", "path", "docs", "ids"])

    return dealt.mapInArrow(run, "shard int, path string, docs long, ids long")


def read(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """Every document of the shards: id, start (ids of all documents before it), n_tokens and ids_crc32."""
    # Sums within groups of shards, and over the groups: no task sees all shards.
    group = F.floor(F.col("shard") / SHARDS_A_GROUP)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = shards.groupBy(group.alias("group")).agg(F.sum("ids").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(upto(Window.orderBy("group"))), F.lit(0)))
    inside = F.coalesce(F.sum("ids").over(upto(Window.partitionBy("group").orderBy("shard"))), F.lit(0))
    per = shards.withColumn("group", group).withColumn("inside", inside).join(groups.hint("merge"), "group").select("shard", "path", (F.col("base") + F.col("inside")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = place(folder)
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["before"].to_pylist()):
                with store.open_input_file(path) as source:
                    reader, rows = Reader(source), []
                    for id_, ids in reader.rows():
                        wide = np.frombuffer(ids, f"<u{reader.width}").astype("<u4")
                        rows.append((id_, start, len(wide), zlib.crc32(wide.tobytes())))
                        start += len(wide)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["id", "start", "n_tokens", "ids_crc32"])

    n = per.count()
    return per.repartition(max(1, n), "shard").select("path", "before").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def lookup(folder: str, path: str, id_: int | None) -> list[np.ndarray]:
    """Ids of the documents with this identifier in one shard."""
    store, _ = place(folder)
    with store.open_input_file(path) as source:
        return Reader(source).get(id_)


def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = work_dir(spark)
    shards = written(write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json")))
    return read(spark, folder, shards).withColumnRenamed("id", "doc_id")
