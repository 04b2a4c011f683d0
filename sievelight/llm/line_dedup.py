"""Line dedup by an exact set-similarity self-join.

A line is the set of its words. A line goes if an earlier line of the corpus, in the order of (doc_id, line number), has a
Jaccard likeness to it of THRESHOLD per cent or more; whether that line goes itself does not matter. Every line that has a word
takes part, unless ``least`` asks for more different words.

1. Word frequencies go into a counting sketch of a fixed size, which orders words by rarity (any total order is exact).
2. The first line of each set settles the others with that set: they are later matches of it. A task settles those of its own
   lines before anything moves, so a line that repeats everywhere is one row a task. Only first lines go on.
3. Each first line is posted under the rarest words of its set, its prefix: two sets above the threshold share one. A common word
   is posted together with each later word of a prefix longer by one instead, as such sets share two words there; so groups don't
   grow with the table as its common words do. Postings are counted, and under keys that have very many are dealt to pairs of
   blocks, so that no key's group is unbounded. A set so small that no other set can be near it (n / (n + 1) below the threshold)
   needs no posting: step 2 finds all its matches.
4. Inside a word's group, lines are sorted by length and compared by length, by position (the bound that holds where their first
   common word is) and by a parity bitmap (a lower bound of the sets' difference); each later line puts forward its nearest earlier
   lines, not all pairs.
5. The nearest candidate of each line is verified on full sets; then, for lines not settled, all others; where a group held more
   candidates than were put forward, it is gone through again for the unsettled lines without that limit.

Defined cases: null texts have no line, empty ones one, without words. Rows with equal ids are rows of their own, in the order of
their texts' md5; null ids come last. Other columns are neither read nor touched.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import FlatWords, chunks, cleaning, discard, keyed, lists, map_batches, mix, release, signed, table, unused, written

THRESHOLD, LEAST_WORDS, SKETCH_LOG2, BLOCK_ROWS, PUT_FORWARD = 80, 1, 21, 40_000, 16
#: A word with more occurrences is common: it is posted in pairs, by sets of up to PAIRED words; longer ones are few.
COMMON, PAIRED = 5_000, 200
#: Bytes that are taken at once, which bounds a worker's memory; a longer text is taken whole.
CHUNK_BYTES = 2 << 20
#: Sets that a task remembers at least, to settle their copies by itself.
SEEN = 500_000
U = np.uint64
#: Parts of the sketch that are summed apart, in as many tasks at most.
PARTS = 1_024
#: Rows of three integers up to which a table of leftover keys or lines goes to all tasks; past it, it is joined by shuffle.
FEW = 200_000


def need(n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    """Least common words of sets of n and m words at the threshold."""
    return -(-threshold * (n + m) // (100 + threshold))


def hashes_of_words() -> Callable[[pa.Array], np.ndarray]:
    """Hashes of all words of a column of texts."""
    flat = FlatWords()
    return lambda column: np.concatenate([flat(part).hashes for _, part in chunks(column, CHUNK_BYTES)] or [np.empty(0, U)])


def hashes_of_keys() -> Callable[[pa.Array], np.ndarray]:
    """All values of a column of lists of hashes."""
    return lambda column: column.flatten().to_numpy(zero_copy_only=False).view(U)


def sketch(rows: DataFrame, column: str, log2: int, hashes: Callable[[], Callable[[pa.Array], np.ndarray]] = hashes_of_words) -> np.ndarray:
    """Occurrences of words, by the leading bits of their hash; the size doesn't depend on the table. ``hashes`` is called once a
    task."""
    part = (1 << log2) // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = hashes(), np.zeros(1 << log2, np.int64)
        for batch in batches:
            np.add.at(total, (of(batch.column(0)) >> U(64 - log2)).astype(np.int64), 1)
        sent = []
        for k in range(PARTS):
            at = np.flatnonzero(total[k * part : (k + 1) * part])
            sent.append((k, at.astype(np.int32).tobytes(), np.minimum(total[k * part + at], 2**31 - 1).astype(np.int32).tobytes()))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in sent], pa.int32()), pa.array([r[1] for r in sent], pa.binary()), pa.array([r[2] for r in sent], pa.binary())], ["k", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, n in zip(batch["k"].to_pylist(), batch["at"].to_pylist(), batch["n"].to_pylist()):
                total.setdefault(k, np.zeros(part, np.int64))[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int32)
        for k, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(n, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())], ["k", "n"])

    with cleaning(rows.sparkSession):
        got = rows.select(F.col(column)).mapInArrow(count, "k int, at binary, n binary").repartition(F.col("k")).mapInArrow(add, "k int, n binary").collect()
    out = np.zeros(1 << log2, np.int32)
    for r in got:
        out[r["k"] * part : (r["k"] + 1) * part] = np.frombuffer(r["n"], np.int32)
    return out


def rarity(freq: np.ndarray) -> np.ndarray:
    """Twelve bits that rise with the frequency at any size: the exponent and seven more bits of it."""
    return (np.maximum(freq, 1).astype(np.float32).view(np.int32) >> 16) - (127 << 7)


def paired(h: np.ndarray, start: np.ndarray, own: np.ndarray, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings (set, position, key) of the words at ``at`` together with each later one of their sets up to the place ``last``. Two
    sets whose first common words these are have no more in common than one and what follows from the second on; the position
    says so."""
    count = np.maximum(last - at, 0)
    own, at = np.repeat(own, count), np.repeat(at, count)
    second = at + 1 + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    return own, second - 1, mix(h[start[own] + at] * U(31) + mix(h[start[own] + second] + U(9)))


def dealt(own: np.ndarray, at: np.ndarray, key: np.ndarray, freq: np.ndarray, h1: np.ndarray, rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings (set, position, key) under keys of their own for each pair of blocks, of about ``rows``, where a key is very common."""
    blocks = np.maximum(freq // rows, 1).astype(np.int64)
    if (blocks > 1).any():
        mine = (mix(h1[own] ^ U(3)) % blocks.astype(U)).astype(np.int64)
        other = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        own, at, key, mine, blocks = (np.repeat(v, blocks) for v in (own, at, key, mine, blocks))
        low, high = np.minimum(mine, other), np.maximum(mine, other)
        key = np.where(blocks > 1, mix(key + (low * blocks + high).astype(U)), key)
    return own, at, key


class Seen:
    """Sets that a task has met, by hash, with the place of one of their lines; past ``SEEN`` it starts anew, which costs
    postings and loses nothing."""

    def __init__(self):
        self.h, self.row, self.line = np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)

    def copies(self, h: np.ndarray, row: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Which of these lines have an earlier one of the same set, here or before."""
        all_h, all_row, all_line = np.concatenate([self.h, h]), np.concatenate([self.row, row]), np.concatenate([self.line, line])
        order = np.lexsort((all_line, all_row, all_h))
        all_h = all_h[order]
        first = np.r_[True, all_h[1:] != all_h[:-1]][: len(all_h)]
        out = np.empty(len(all_h), bool)
        out[order] = ~first
        if first.sum() <= SEEN:
            keep = order[first]
            self.h, self.row, self.line = all_h[first], all_row[keep], all_line[keep]
        else:
            self.__init__()
        return out[len(out) - len(h) :]


def prefixes(docs: DataFrame, row_col: str, text_col: str, counts: np.ndarray, threshold: int, least: int) -> DataFrame:
    """Every line with enough words: row, line, n (different words), h1 and h2 (hash of the set), b1 and b2 (parity bitmap), keys
    (of its prefix; several for a common word) and at (their positions in the order). A line whose set this task has met in
    an earlier line has n = 0, hashes of its own, and no keys."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    log2 = int(len(counts)).bit_length() - 1

    def each():
        flat, counts, seen = FlatWords(), sent.value, Seen()

        def some(ids: np.ndarray, column: pa.Array) -> list:
            texts = flat(column)
            h = texts.hashes
            if not len(h):
                return []
            text, line = texts.lines()
            new = np.r_[True, (text[1:] != text[:-1]) | (line[1:] != line[:-1])]
            first, of = np.flatnonzero(new), np.cumsum(new) - 1
            text, line = text[first], line[first]
            freq = counts[(h >> U(64 - log2)).astype(np.int64)]
            # Line, rarity and hash in one integer; the rare cases that it can't tell apart are sorted by all three.
            key = (of.astype(U) << U(44)) | (rarity(freq).astype(U) << U(32)) | (h >> U(32))
            order = np.argsort(key)
            key, h, freq = key[order], h[order], freq[order]
            if len(first) >= 2**20 or ((key[1:] == key[:-1]) & (h[1:] != h[:-1])).any():
                back = np.argsort(order)
                h, freq = h[back], freq[back]
                order = np.lexsort((h, rarity(freq), of))
                h, freq = h[order], freq[order]
                of = of[order]
            else:
                of = (key >> U(44)).astype(np.int64)
            fresh = np.r_[True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])]
            h, of, freq = h[fresh], of[fresh], freq[fresh]
            n = np.bincount(of, minlength=len(first))
            if least > 1:
                ok = n >= least
                h, freq, text, line, n = h[ok[of]], freq[ok[of]], text[ok], line[ok], n[ok]
                if not len(h):
                    return []
            start = np.cumsum(n) - n
            m = mix(h + U(5))
            h1 = np.add.reduceat(m, start)
            row = ids[text]
            # The later lines of a set are settled, and so is a set that no other can be near: the nearest to a set of n words that
            # is not the same has a likeness of n / (n + 1).
            copy = seen.copies(h1, row, line.astype(np.int64))
            post = ~copy & (100 * n >= threshold * (n + 1))
            live = np.repeat(~copy, n)
            h2 = np.zeros(len(n), U)
            b1, b2 = np.zeros(len(n), U), np.zeros(len(n), U)
            keep = n[~copy]
            if len(keep):
                begin, mine, hash_ = np.cumsum(keep) - keep, m[live], h[live]
                h2[~copy] = np.add.reduceat(mix(hash_ + U(2)), begin)
                bit = U(1) << (mine & U(63))
                half = (mine >> U(6)) & U(1) == 0
                b1[~copy], b2[~copy] = np.bitwise_xor.reduceat(np.where(half, bit, U(0)), begin), np.bitwise_xor.reduceat(np.where(half, U(0), bit), begin)
            # A word seen once in all can't be shared.
            least_common = -(-threshold * n // 100)
            prefix = np.where(post, n - least_common + 1, 0)
            own = np.repeat(np.arange(len(n)), prefix)
            at = np.arange(len(own)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
            pick = start[own] + at
            shared = freq[pick] > 1
            own, at, pick = own[shared], at[shared], pick[shared]
            common = freq[pick] > COMMON
            if common.any():
                # Sets that may match with one common word, or one of which is too long for pairs, are posted under the word too.
                alone = (least_common < 2) | (100 * n > threshold * PAIRED)
                two, one = common & (n <= PAIRED)[own], ~common | alone[own]
                o2, at2, h2_ = paired(h, start, own[two], at[two], np.minimum(n - least_common + 1, n - 1)[own[two]])
                own, at, h = np.r_[own[one], o2], np.r_[at[one], at2], np.r_[h[pick[one]], h2_]
                order = np.argsort(own, kind="stable")
                own, at, h = own[order], at[order], h[order]
            else:
                h = h[pick]
            h1[copy], h2[copy] = mix(row[copy].view(U) * U(31) + line[copy].astype(U)), 0
            return [row, line.astype(np.int32), np.where(copy, 0, n).astype(np.int32), signed(h1), signed(h2), signed(b1), signed(b2), np.bincount(own, minlength=len(n)), signed(h), at.astype(np.int32)]

        def one(batch: pa.RecordBatch) -> dict | None:
            ids = batch["id"].to_numpy(zero_copy_only=False)
            got = [g for a, texts in chunks(batch["text"], CHUNK_BYTES) if (g := some(ids[a:], texts))]
            if not got:
                return None
            row, line, n, h1, h2, b1, b2, count, keys, at = (np.concatenate(x) for x in zip(*got))
            return {"row": row, "line": line, "n": n, "h1": h1, "h2": h2, "b1": b1, "b2": b2, "keys": lists(keys, count, pa.int64()), "at": lists(at, count, pa.int32())}

        return one

    texts = docs.select(F.col(row_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(texts, each, "row long, line int, n int, h1 long, h2 long, b1 long, b2 long, keys array<long>, at array<int>")


def settled(lines: DataFrame) -> DataFrame:
    """The lines with ``copy``: whether an earlier line has the same set. Rows of a set are at most one a task and SEEN sets."""
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("row", "line")) == 1
    copy = (F.col("n") == 0) | ~first
    return lines.withColumn("copy", copy).select("row", "line", "n", "h1", "b1", "b2", *(F.when(F.col("copy"), None).otherwise(F.col(c)).alias(c) for c in lines.columns if c in ("keys", "at", "set")), "copy")


def spread(lines: DataFrame) -> DataFrame:
    """The lines with their postings dealt to pairs of blocks under each key that has very many."""
    counts = sketch(lines.where("keys is not null"), "keys", SKETCH_LOG2, hashes_of_keys)
    if counts.max() < 2 * BLOCK_ROWS:
        return lines
    sent = lines.sparkSession.sparkContext.broadcast(counts)

    def each():
        def one(batch: pa.RecordBatch) -> dict:
            keys = batch["keys"].flatten().to_numpy(zero_copy_only=False).view(U)
            count = np.nan_to_num(batch["keys"].value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            at = batch["at"].flatten().to_numpy(zero_copy_only=False)
            freq = sent.value[(keys >> U(64 - SKETCH_LOG2)).astype(np.int64)]
            own, at, keys = dealt(np.repeat(np.arange(len(count)), count), at, keys, freq, batch["h1"].to_numpy(zero_copy_only=False).view(U), BLOCK_ROWS)
            count = np.bincount(own, minlength=len(count))
            return {c: batch[c] for c in batch.schema.names} | {"keys": lists(signed(keys), count, pa.int64()), "at": lists(at.astype(np.int32), count, pa.int32())}

        return one

    return map_batches(lines, each, lines.schema)


class Groups:
    """Candidates inside the groups of one key; rows come sorted by key and number of words."""

    #: Pairs of rows that are compared at once, about.
    LARGE = 1 << 16

    def __init__(self, threshold: int, limit: int):
        self.threshold, self.limit = threshold, limit

    def ready(self, r: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The rows with what each pair asks for: words from the place of the key on, unsigned bitmaps, and the greatest difference of
        two bitmaps by the sum of both numbers of words."""
        both = np.arange(2 * int(r["n"].max(initial=0)) + 1)
        return r | {"left": r["n"] - r["at"], "b1": r["b1"].view(U), "b2": r["b2"].view(U), "most": both - 2 * need(both, 0, self.threshold)}

    def near(self, r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs of rows i and j, of both words together, those that may match, with the later line first, and the difference of
        their bitmaps. The bound by position is that of ``need`` without its division."""
        ok = np.flatnonzero((100 + self.threshold) * np.minimum(r["left"][i], r["left"][j]) >= self.threshold * both)
        i, j, both = i[ok], j[ok], both[ok]
        apart = np.bitwise_count(r["b1"][i] ^ r["b1"][j]) + np.bitwise_count(r["b2"][i] ^ r["b2"][j])  # 128 at most
        ok = np.flatnonzero(apart <= r["most"][both])
        i, j, apart = i[ok], j[ok], apart[ok].astype(np.int64)
        di, dj, li, lj = r["row"][i], r["row"][j], r["line"][i], r["line"][j]
        later, same = (di > dj) | ((di == dj) & (li > lj)), (di == dj) & (li == lj)
        other = (r["h"][i] != r["h"][j]) | (r["n"][i] != r["n"][j]) | (apart > 0)
        i, j = np.where(later, i, j), np.where(later, j, i)
        ok = r["open"][i] & ~same & other
        return i[ok], j[ok], apart[ok]

    def __call__(self, r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Later and earlier rows of the candidates, their bitmap difference, and whether the later one has more in its group."""
        size, r, n = len(r["key"]), self.ready(r), r["n"]
        # Each row meets those before it in its group from the first that is long enough; pairs of many rows are gone through at once.
        group = np.cumsum(np.r_[False, r["key"][1:] != r["key"][:-1]][:size]) * (100 * (int(n.max(initial=0)) + 1))
        from_ = np.searchsorted(group + 100 * n, group + self.threshold * n)
        pairs = np.arange(size) - from_
        total = np.cumsum(pairs)
        found: list[tuple[np.ndarray, ...]] = []
        held, most, a = 0, 1_000_000, 0
        while a < size:
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + self.LARGE, "right")))
            count = pairs[a:b]
            i = np.repeat(np.arange(a, b), count)
            j = np.arange(len(i)) + np.repeat(from_[a:b] - (np.cumsum(count) - count), count)
            found.append(self.near(r, i, j, n[i] + n[j]))
            held += len(found[-1][0])
            if self.limit and held > most:  # nothing but the nearest is needed of each
                found = [self.nearest(*(np.concatenate(x) for x in zip(*found)), self.limit + 1)]
                held = len(found[0][0])
                most = held + 1_000_000
            a = b
        if not found:
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, bool),)
        i, j, apart = self.nearest(*(np.concatenate(x) for x in zip(*found)), self.limit + 1 if self.limit else 0)
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
        count = np.diff(np.r_[first, len(i)])
        more = np.repeat(count > self.limit, count) if self.limit else np.zeros(len(i), bool)
        keep = np.arange(len(i)) - np.repeat(first, count) < self.limit if self.limit else np.ones(len(i), bool)
        return i[keep], j[keep], apart[keep], more[keep]

    @staticmethod
    def nearest(i: np.ndarray, j: np.ndarray, apart: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted by i and nearness; at most ``limit`` of each i, or all if 0."""
        order = np.lexsort((j, apart, i))
        i, j, apart = i[order], j[order], apart[order]
        if limit:
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
            keep = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < limit
            i, j, apart = i[keep], j[keep], apart[keep]
        return i, j, apart


def few(df: DataFrame) -> DataFrame:
    """The table for a join: sent to all tasks if it is small, else by shuffle."""
    return F.broadcast(df) if df.count() <= FEW else df.hint("merge")


def candidates(lines: DataFrame, threshold: int, limit: int, only: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """(xd, xl, yd, yl, apart, more): later line x, earlier line y; for each x of a group the ``limit`` nearest, or all if 0. With
    ``only`` and ``keys``, just for those x and under those keys. A posting is six integers."""
    half = F.lit(2**32 - 1)
    posts = lines.where(F.size("keys") > 0).select(F.explode(F.arrays_zip("keys", "at")).alias("p"), "row", "b1", "b2", F.shiftleft(F.col("line").cast("long"), 32).bitwiseOR(F.col("h1").bitwiseAND(half)).alias("line_h"), F.shiftleft(F.col("n").cast("long"), 32).alias("n_"))
    posts = posts.select(F.col("p.keys").alias("key"), "row", "line_h", F.col("n_").bitwiseOR(F.col("p.at").cast("long")).alias("n_at"), "b1", "b2")
    if keys is not None:
        place = posts.join(few(keys), "key", "left_semi").withColumn("line", F.shiftright("line_h", 32).cast("int"))
        posts = place.join(few(only.withColumn("open", F.lit(True))), ["row", "line"], "left").withColumn("n_at", F.when(F.col("open"), F.col("n_at")).otherwise(F.col("n_at").bitwiseOR(F.lit(2**31)))).select(*posts.columns)
    names = ["key", "row", "line_h", "n_at", "b1", "b2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held = Groups(threshold, limit), None

        def out(r: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((r["n_at"] >> 32, r["key"]))
            r = {k: v[order] for k, v in r.items()}
            low = r["n_at"] & (2**32 - 1)
            r = {"key": r["key"], "row": r["row"], "line": r["line_h"] >> 32, "h": r["line_h"] & (2**32 - 1), "n": r["n_at"] >> 32, "at": low & (2**31 - 1), "open": low < 2**31, "b1": r["b1"], "b2": r["b2"]}
            i, j, apart, more = groups(r)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(r["row"][i]), pa.array(r["line"][i].astype(np.int32)), pa.array(r["row"][j]), pa.array(r["line"][j].astype(np.int32)), pa.array(apart.astype(np.int32)), pa.array(more)], ["xd", "xl", "yd", "yl", "apart", "more"])

        for batch in batches:
            r = {k: batch[k].to_numpy(zero_copy_only=False) for k in names}
            if held is not None:
                r = {k: np.concatenate([held[k], r[k]]) for k in names}
            # The last group may go on in the next batch.
            cut = int(np.searchsorted(r["key"], r["key"][-1])) if len(r["key"]) else 0
            held = {k: v[cut:] for k, v in r.items()}
            if cut:
                yield from out({k: v[:cut] for k, v in r.items()})
        if held is not None:
            yield from out(held)
        held = None
        release()

    return posts.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(run, "xd long, xl int, yd long, yl int, apart int, more boolean")


def sets_of(docs: DataFrame, wanted: DataFrame, row_col: str, text_col: str, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(row, line, set) of the wanted lines: sorted word hashes as bytes."""

    def each():
        flat = FlatWords()

        def one(batch: pa.RecordBatch) -> dict:
            row, line, found = [], [], []
            ids, wanted = batch["id"].to_pylist(), batch["lines"].to_pylist()
            for a, column in chunks(batch["text"], CHUNK_BYTES):
                texts = flat(column)
                _, of = texts.lines()
                for k in range(len(texts)):
                    h, lines = texts[k], of[texts.bounds[k] : texts.bounds[k + 1]]
                    for x in wanted[a + k]:
                        i, j = np.searchsorted(lines, [x, x + 1])
                        row.append(ids[a + k])
                        line.append(x)
                        found.append(np.unique(h[i:j]).tobytes())
            return {"row": row, "line": line, "set": pa.array(found, pa.binary())}

        return one

    per = wanted.groupBy(F.col("row").alias("id")).agg(F.collect_set("line").alias("lines"))
    texts = docs.select(F.col(row_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(texts.join(side(per), "id").select("id", "text", "lines"), each, "row long, line int, set binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int, kind: str = "<u8") -> DataFrame:
    """Distinct (xd, xl) of the pairs that reach the threshold; sets are sorted integers as bytes."""

    def each():
        def one(batch: pa.RecordBatch) -> dict:
            keep = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
                x, y = np.frombuffer(x, kind), np.frombuffer(y, kind)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= threshold * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            return {"xd": batch["xd"].filter(mask), "xl": batch["xl"].filter(mask)}

        return one

    x = sets.select(F.col("row").alias("xd"), F.col("line").alias("xl"), F.col("set").alias("x")).hint("merge")
    y = sets.select(F.col("row").alias("yd"), F.col("line").alias("yl"), F.col("set").alias("y")).hint("merge")
    both = pairs.select("xd", "xl", "yd", "yl").join(x, ["xd", "xl"]).join(y, ["yd", "yl"])
    return map_batches(both.select("xd", "xl", "x", "y"), each, "xd long, xl int").distinct()


def ends_of(pairs: DataFrame) -> DataFrame:
    """(row, line) of both ends."""
    return pairs.select(F.col("xd").alias("row"), F.col("xl").alias("line")).union(pairs.select(F.col("yd").alias("row"), F.col("yl").alias("line"))).distinct()


def later_matches(lines: DataFrame, sets_for: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame], threshold: int, kind: str = "<u8") -> tuple[DataFrame, list[DataFrame]]:
    """(xd, xl) of the lines that have an earlier match among these, which have different sets, and the tables made on the way.
    ``sets_for`` gives (row, line, set) of wanted lines; it is told how to join them."""
    found = written(candidates(lines, threshold, PUT_FORWARD).groupBy("xd", "xl", "yd", "yl").agg(F.min("apart").alias("apart"), F.max("more").alias("more")))
    sets = written(sets_for(ends_of(found), lambda df: df.hint("merge")))
    nearest = found.groupBy("xd", "xl").agg(F.min(F.struct("apart", "yd", "yl")).alias("b")).select("xd", "xl", "b.yd", "b.yl")
    gone = written(verified(nearest, sets, threshold, kind))
    unsettled = found.join(gone, ["xd", "xl"], "left_anti")
    gone2 = written(verified(unsettled.join(nearest, ["xd", "xl", "yd", "yl"], "left_anti"), sets, threshold, kind))
    all_gone, made = gone.union(gone2), [found, sets, gone, gone2]
    again = found.where("more").select("xd", "xl").distinct().join(all_gone, ["xd", "xl"], "left_anti")
    again = written(again.select(F.col("xd").alias("row"), F.col("xl").alias("line")))
    made.append(again)
    if not again.isEmpty():
        keys = written(lines.join(few(again), ["row", "line"]).select(F.explode("keys").alias("key")).distinct())
        rest = written(candidates(lines, threshold, 0, again, keys).select("xd", "xl", "yd", "yl").distinct().join(found, ["xd", "xl", "yd", "yl"], "left_anti"))
        more = written(sets_for(ends_of(rest), few))
        all_gone = all_gone.union(verified(rest, more, threshold, kind))
        made += [keys, rest, more]
    return all_gone, made


def removals(docs: DataFrame, row_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, least: int = LEAST_WORDS) -> DataFrame:
    """(row, line) of the lines that go; lines count from 0. ``row_col`` tells rows apart and gives their order (see ``keyed``)."""
    counts = sketch(docs, text_col, SKETCH_LOG2)
    lines = written(settled(prefixes(docs, row_col, text_col, counts, threshold, least)))
    gone, made = later_matches(spread(lines), lambda wanted, side: sets_of(docs, wanted, row_col, text_col, side), threshold)
    out = written(lines.where("copy").select("row", "line").union(gone.withColumnsRenamed({"xd": "row", "xl": "line"})))
    for one in (lines, *made):
        discard(one)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed_lines", **options: int) -> DataFrame:
    """The table with one more column, the sorted numbers of the lines of each text that go; null where none goes. A column of that
    name is an error."""
    if removed_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the table has a column {removed_col}")
    name = unused(docs, "row_key")
    rows = keyed(docs, id_col, text_col, name)
    return with_removals(rows, removals(rows, name, text_col, **options), name, removed_col).drop(name)


def with_removals(rows: DataFrame, gone: DataFrame, row_col: str, removed_col: str) -> DataFrame:
    of = unused(rows, "of_row")
    per = gone.groupBy(F.col("row").alias(of)).agg(F.sort_array(F.collect_list("line")).alias(removed_col))
    return rows.join(per.hint("merge"), rows[row_col] == per[of], "left").drop(of)


def without(texts: pa.Array, removed: pa.Array) -> pa.Array:
    """Texts without the lines of the given numbers."""
    out = []
    for text, lines in zip(texts.to_pylist(), removed.to_pylist()):
        if lines is not None and text is not None:
            gone = set(lines)
            text = "\n".join(one for k, one in enumerate(text.split("\n")) if k not in gone)
        out.append(text)
    return pa.array(out, pa.string())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", "row_key")
    gone = removals(rows, "row_key")
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    out = with_removals(rows.select("doc_id", "row_key", n.alias("n_lines")), gone, "row_key", "removed")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that go, with n_chars of the new text; those that lose all their words go too."""
    name, text = unused(docs, "removed_lines"), unused(docs, "text_left")
    left = F.when(F.col(name).isNull(), F.col("text")).otherwise(F.arrow_udf(without, "string")("text", name))
    out = dedup_lines(docs, removed_col=name).withColumn(text, left).where(F.col(name).isNull() | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    kinds = dict(docs.dtypes)
    new = {"text": F.col(text), "n_chars": F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(kinds["n_chars"])) if "n_chars" in kinds else None}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


#: The same in SQL. Any total order of words gives an exact prefix join; here it is the exact frequency.
OP10_SQL = r"""
WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST, md5(text) NULLS LAST) AS r, string_split(text, chr(10)) AS s FROM documents),
l AS (
  SELECT r, line, list_sort(list_distinct(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS ws
  FROM (SELECT r, unnest(range(len(s))) AS line, unnest(s) AS t FROM s)),
k AS (SELECT *, len(ws) AS n, row_number() OVER (PARTITION BY ws ORDER BY r, line) AS rn FROM l WHERE len(ws) > 0),
f AS (SELECT *, row_number() OVER () AS id FROM k WHERE rn = 1),
w AS (SELECT id, n, unnest(ws) AS w FROM f),
q AS (SELECT w, count(*) AS df FROM w GROUP BY w),
p AS (SELECT id, n, w FROM (SELECT id, n, w.w, row_number() OVER (PARTITION BY id ORDER BY df, w.w) AS pos FROM w JOIN q USING (w)) WHERE pos <= n - ceil(n * 80 / 100.0) + 1),
c AS (SELECT DISTINCT a.id AS x, b.id AS y FROM p a JOIN p b ON a.w = b.w AND a.id <> b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
g AS (
  SELECT DISTINCT x.r, x.line FROM c JOIN f x ON c.x = x.id JOIN f y ON c.y = y.id
  WHERE (y.r, y.line) < (x.r, x.line) AND 100 * len(list_intersect(x.ws, y.ws)) >= 80 * (x.n + y.n - len(list_intersect(x.ws, y.ws)))
  UNION ALL SELECT r, line FROM k WHERE rn > 1),
o AS (SELECT r, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS gone FROM g GROUP BY r)
SELECT s.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_lines, coalesce(o.n, 0)::BIGINT AS n_removed, coalesce(o.gone, '') AS removed_lines
FROM s LEFT JOIN o USING (r)
"""
