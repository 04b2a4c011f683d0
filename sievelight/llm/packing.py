"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted at once. Pieces go, longest first, into the open sequence with the least room that holds
them. Where none does, a sequence is opened, of the permitted length with the least cost a token: the cost of a length
(attention makes long ones dearer) over the tokens that the next pieces would put into it. Finally each sequence shrinks to the
least permitted length that holds its content.

Texts become ids of a public vocabulary, with an end id each. Documents are dealt out by a hash of their id and ids to groups of
about GROUP_ROWS rows or GROUP_BYTES, each packed alone with its ids at hand: they move once, tasks stay bounded and none waits for
another, and a group of thousands wastes as little as the whole would. A document longer than the longest sequence is cut into full
sequences and a rest, so every token is placed.

Defined cases: null and empty texts hold the end id alone. Rows with equal ids, null ids included, are packed one by one; equal rows
of one task are dealt to different groups, so many copies are no heavier than others. Other columns are neither read nor touched.
"""

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import chunks, lists, map_batches, mix, release, signed, table
from .tokens import encoder, gathered

LENGTHS, ATTENTION, GROUP_ROWS, GROUP_BYTES, LOOK_AHEAD, END = (512, 1024, 2048, 4096), 0.25, 8_000, 32 << 20, 6, 0
#: Tokens of the sequences that go out at once, about: a whole group at once takes some hundred MB on both sides.
TOKENS_A_BATCH = 1 << 18
U = np.uint64


def costs(lengths: tuple[int, ...], attention: float) -> list[float]:
    """Cost of a sequence of each length; at the longest, attention adds the share ``attention`` to the linear part."""
    return [n * (1 + attention * n / max(lengths)) for n in lengths]


def best_fit(pieces: list[int], lengths: tuple[int, ...] = LENGTHS, attention: float = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """Pack pieces sorted from long to short. Returns each piece's sequence and offset in it, and the sequences' lengths."""
    lengths = tuple(sorted(lengths))
    price = costs(lengths, attention)
    rising, n = pieces[::-1], len(pieces)
    room: list[tuple[int, int]] = []  # (room, sequence), rising
    used: list[int] = []
    where, offset = [0] * n, [0] * n
    for i, piece in enumerate(pieces):
        at = bisect_left(room, (piece, -1))
        if at < len(room):
            left, to = room.pop(at)
        else:
            least, left = float("inf"), 0
            for length, cost in zip(lengths, price):
                if length < piece:
                    continue
                # What the pieces to come would fill: again and again the longest that still fits.
                free, end = length - piece, n - i - 1
                for _ in range(LOOK_AHEAD):
                    if not (k := bisect_right(rising, free, 0, end)):
                        break
                    free, end = free - rising[k - 1], k - 1
                if (a_token := cost / (length - free)) < least:
                    least, left = a_token, length
            to = len(used)
            used.append(0)
        where[i], offset[i] = to, used[to]
        used[to] += piece
        if left > piece:
            insort(room, (left - piece, to))
    return where, offset, [lengths[bisect_left(lengths, u)] for u in used]


def encoded(docs: DataFrame, vocabulary: str, groups: int, id_col: str, text_col: str, end: int) -> DataFrame:
    """(group, doc_id, h, ids): ids of each text and the end id, as bytes, with a hash of them."""

    def each():
        encode, seen = encoder(vocabulary), Counter()
        stop = np.array([end], encode.kind).tobytes()

        def one(batch: pa.RecordBatch) -> dict:
            found, h, salt = [], [], []
            of = batch["id"].to_pylist()
            for a, texts in chunks(batch["text"], 4 << 20):
                flat, bounds = encode(texts)
                data, bounds = flat.tobytes(), (bounds * encode.width).tolist()
                for k in range(len(texts)):
                    ids = data[bounds[k] : bounds[k + 1]] + stop
                    key = xxhash.xxh3_64_intdigest(ids, seed=0 if of[a + k] is None else 1 + of[a + k] % (2**64 - 1))
                    found.append(ids)
                    h.append(key)
                    salt.append(seen[key])
                    seen[key] += 1
                del flat, data, texts
                release()
            h = np.array(h, U)
            return {"group": (mix(h + mix(np.array(salt, U))) % U(groups)).astype(np.int64), "doc_id": batch["id"], "h": signed(h), "ids": pa.array(found, pa.binary())}

        return one

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(texts, each, "group long, doc_id long, h long, ids binary")


SEQUENCES = "sequence long, capacity int, filled int, doc_ids array<long>, starts array<int>, counts array<int>, input_ids array<int>"


def packed(group: int, doc_ids: pa.Array, h: np.ndarray, ids: pa.Array, kind: str, lengths: tuple[int, ...], attention: float) -> Iterator[pa.RecordBatch]:
    """Sequences of one group, some at a time."""
    longest, width = max(lengths), np.dtype(kind).itemsize
    ids = ids.cast(pa.large_binary())
    bounds = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
    flat = np.frombuffer(ids.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(kind)
    size = np.diff(bounds) // width
    first = np.cumsum(size) - size
    count = -(-size // longest)
    of = np.repeat(np.arange(len(ids)), count)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * longest
    length = np.minimum(size[of] - start, longest)
    order = np.lexsort((start, h[of], -length))
    where, offset, capacity = best_fit(length[order].tolist(), lengths, attention)
    place = np.lexsort((offset, where))
    piece = order[place]
    parts = np.bincount(where, minlength=len(capacity))
    filled = np.bincount(np.array(where, np.int64), length[order], len(capacity)).astype(np.int64)
    ends, upto = np.cumsum(parts), np.cumsum(filled)
    a = 0
    while a < len(capacity):
        b = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + TOKENS_A_BATCH, "right")), a + 1)
        some, n = piece[ends[a] - parts[a] : ends[b - 1]], parts[a:b]
        tokens = flat[gathered((first[of] + start)[some], length[some])].astype(np.int32)
        columns = [pa.array(group * 2**31 + np.arange(a, b)), pa.array(capacity[a:b], pa.int32()), pa.array(filled[a:b].astype(np.int32))]
        columns += [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), doc_ids.take(pa.array(of[some]))), lists(start[some].astype(np.int32), n, pa.int32()), lists(length[some].astype(np.int32), n, pa.int32()), lists(tokens, filled[a:b], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SEQUENCES.split(", ")])
        a = b


def pack(docs: DataFrame, vocabulary: str, lengths: tuple[int, ...] = LENGTHS, attention: float = ATTENTION, group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """SEQUENCES: capacity and filled length of each, its pieces in order (document, first token of it, number of tokens), and the
    ids of all, one after the other."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    groups = max(1, -(-n // group_rows), -(-size // group_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, group = encoder(vocabulary).kind, [], None

        def out() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            held.clear()
            doc_ids, h, ids = rows["doc_id"].combine_chunks(), rows["h"].to_numpy(), rows["ids"].combine_chunks()
            del rows
            release()
            yield from packed(group, doc_ids, h, ids, kind, lengths, attention)

        for batch in batches:
            own = batch["group"].to_numpy()
            edges = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)] if len(own) else []
            for a, b in zip(edges, edges[1:]):
                if group is not None and own[a] != group:
                    yield from out()
                group = int(own[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from out()
        release()

    rows = encoded(docs, vocabulary, groups, id_col, text_col, end)
    return rows.repartition(F.col("group")).sortWithinPartitions("group").mapInArrow(run, SEQUENCES)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of all documents."""
    return pack(docs, vocabulary())
