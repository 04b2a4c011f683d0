"""Document fingerprints by SpotSigs.

A signature starts at an anchor, one of the commonest words of a language, and is the chain of the CHAIN next content words
(words that are no anchors). The set of a document's signatures is its fingerprint, written as base64 of their sorted 32-bit
hashes. The likeness of two fingerprints is the Jaccard likeness of their sets. Near-duplicates are found by length: sets that share
a signature are sorted by size, and two are compared only where their sizes and the signatures still to come allow the threshold.

A text without a full chain has one signature for each content word, or else (only anchors, or too short) one for its word
sequence, so that only texts without words have no signature; the likeness of two of those is 1, of one and another 0.

Defined cases: null texts count as empty. In the row order (descending id) rows with equal ids are in descending order of the md5 of
their text, and null ids come last; a row is near an earlier one in ascending order, where null ids come last as well. Other columns
are neither read nor touched.
"""

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_dedup import SKETCH_LOG2, Seen, dealt, later_matches, settled, sketch
from .shared import WordHashes, discard, keyed, lists, map_batches, mix, release, signed, table, unused, written

U = np.uint64
CHAIN, ROWS_A_RANGE, THRESHOLD = 3, 4_000, 75
#: The commonest words of English, French, German and Spanish.
ANCHORS = """
a an the of to in and is are was were be been it its that this these those with for on at by from as or not have has had he she they we you i
le la les un une des du de et est en que qui dans pour par sur pas au aux ce cette il elle
der die das den dem des ein eine und ist in zu von mit auf für sich nicht es als auch
el los las un una unos del y es que se por con para no su al lo como más
""".split()
ENDS = b".,;:!?\"'()[]{}<>*#$%&|-_"


class Spotter:
    """Signatures of word sequences."""

    def __init__(self, chain: int = CHAIN):
        self.hashes, self.chain = WordHashes(), chain
        self.anchors = {w.encode() for w in ANCHORS}
        self.anchor_hashes = np.array(sorted(self.hashes[w] for w in self.anchors), U)

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct 32-bit signatures."""
        found = [w.strip(ENDS) for w in text.encode("utf-8", "surrogatepass").lower().split()]
        if not found:
            return np.empty(0, np.uint32)
        h = self.hashes.of(found)
        at = np.minimum(np.searchsorted(self.anchor_hashes, h), len(self.anchor_hashes) - 1)
        anchor = self.anchor_hashes[at] == h
        content = h[~anchor]
        if not len(content):
            return (mix(np.array([self.hashes[b" ".join(found)]], U)) >> U(32)).astype(np.uint32)
        # Content words before each anchor: the chain starts there.
        start = np.cumsum(~anchor)[anchor]
        start = start[start + self.chain <= len(content)]
        if not len(start):
            return np.unique((mix(content + U(7)) >> U(32)).astype(np.uint32))
        value = h[anchor][: len(start)]
        for k in range(self.chain):
            value = mix(value * U(0x9E3779B97F4A7C15) + content[start + k])
        return np.unique((value >> U(32)).astype(np.uint32))


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    n = len(np.intersect1d(x, y, assume_unique=True))
    return n / (len(x) + len(y) - n)


def text_of(found: np.ndarray) -> str:
    return base64.b64encode(found.astype("<u4").tobytes()).decode()


def set_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def edited(text: str, other: str) -> str:
    """The text with its second half replaced by as much of the other's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def in_order(docs: DataFrame, id_col: str, row_col: str, text_col: str, range_rows: int, marked: DataFrame) -> DataFrame:
    """Rows (range, guest, id, row, text), partitioned by range and sorted in descending order of ids; after the own rows of a range
    come, as guests, the first rows of the next one (after the last: of the first). Texts move once. Rows of ``marked`` (row, id)
    come with them, without a text, right before the row they mark."""
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"))
    ranges = max(1, -(-docs.count() // range_rows))
    dealt = ids.repartitionByRange(ranges, F.col("id").desc()).select("id", F.spark_partition_id().alias("p"))
    tops = np.sort(np.array([r[0] for r in dealt.groupBy("p").agg(F.max("id")).select("max(id)").collect()], np.int64))  # one a range
    sent = docs.sparkSession.sparkContext.broadcast(tops)

    def place(id_: pa.Array) -> pa.Array:
        tops = sent.value
        ids = id_.to_numpy(zero_copy_only=False)
        at = np.searchsorted(tops, ids)
        top = tops[np.minimum(at, len(tops) - 1)] == ids
        return pa.array([[a, (a + 1) % len(tops)] if t else [a] for a, t in zip(at.tolist(), top.tolist())], pa.list_(pa.int32()))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(row_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.union(marked.select("id", "row", F.lit(None).cast("string")))
    rows = rows.withColumn("in", F.arrow_udf(place, "array<int>")(F.coalesce("id", F.lit(-(2**63)))))
    rows = rows.select("id", "row", "text", F.posexplode("in").alias("guest", "range"))
    # Twice as many parts as ranges, so that few parts have several.
    return rows.repartition(2 * ranges, F.col("range")).sortWithinPartitions(F.col("range"), F.col("guest"), F.col("id").desc_nulls_last(), F.col("row").desc(), F.col("text").isNotNull())


def sets_in(docs: DataFrame, row_col: str, text_col: str, chain: int) -> DataFrame:
    """(id, set): the sorted signatures of each row that has any, as bytes."""

    def each():
        spot = Spotter(chain)

        def one(batch: pa.RecordBatch) -> dict:
            found = [spot(t).astype("<u4").tobytes() for t in batch["text"].to_pylist()]
            some = pa.array([len(f) > 0 for f in found])
            return {"id": batch["id"].filter(some), "set": pa.array(found, pa.binary()).filter(some)}

        return one

    rows = docs.select(F.col(row_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(rows, each, "id long, set binary")


def scattered(column: pa.Array) -> np.ndarray:
    """64-bit hashes of the signatures of a column of sets."""
    return mix(np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(U) + U(5))


def prefixes(sets: DataFrame, counts: np.ndarray, threshold: int) -> DataFrame:
    """Fingerprints as sets to join, one a row: row, line (0), n, h1 and h2 (hash of the set), b1 and b2 (parity bitmap), keys and at
    (its prefix in the order of rarity, and positions), and the set. A row whose set this task has met in an earlier row has n = 0, a
    hash of its own, and no keys."""
    sent = sets.sparkSession.sparkContext.broadcast(counts)
    log2 = len(counts).bit_length() - 1

    def each():
        counts, seen = sent.value, Seen()

        def one(batch: pa.RecordBatch) -> dict:
            n = np.array([len(x) // 4 for x in batch["set"].to_pylist()], np.int64)
            m = scattered(batch["set"])
            start = np.cumsum(n) - n
            of = np.repeat(np.arange(len(n)), n)
            h1, h2 = np.add.reduceat(m, start), np.add.reduceat(mix(m + U(2)), start)
            bit = U(1) << (m & U(63))
            half = (m >> U(6)) & U(1) == 0
            b1, b2 = np.bitwise_xor.reduceat(np.where(half, bit, U(0)), start), np.bitwise_xor.reduceat(np.where(half, U(0), bit), start)
            freq = counts[(m >> U(64 - log2)).astype(np.int64)]
            order = np.lexsort((m, freq, of))
            m, freq, at = m[order], freq[order], np.arange(len(m)) - start[of]
            # The nearest to a set of n signatures that is not the same has a likeness of n / (n + 1); a signature seen once in all
            # can't be shared.
            row = batch["id"].to_numpy()
            copy = seen.copies(h1, row, np.zeros(len(n), np.int64))  # settled here: many copies are one row a task
            prefix = np.where(~copy & (100 * n >= threshold * (n + 1)), n - -(-threshold * n // 100) + 1, 0)
            pick = np.flatnonzero((at < prefix[of]) & (freq > 1))
            own, at, keys = dealt(of[pick], at[pick], m[pick], freq[pick], h1)
            count = np.bincount(own, minlength=len(n))
            h1[copy], h2[copy] = mix(row[copy].view(U) * U(31)), 0
            return {"row": batch["id"], "line": np.zeros(len(n), np.int32), "n": np.where(copy, 0, n).astype(np.int32), "h1": signed(h1), "h2": signed(h2), "b1": signed(b1), "b2": signed(b2), "keys": lists(signed(keys), count, pa.int64()), "at": lists(at.astype(np.int32), count, pa.int32()), "set": batch["set"]}

        return one

    return map_batches(sets, each, "row long, line int, n int, h1 long, h2 long, b1 long, b2 long, keys array<long>, at array<int>, set binary")


def near_duplicates(docs: DataFrame, row_col: str, text_col: str = "text", threshold: int = THRESHOLD, chain: int = CHAIN) -> DataFrame:
    """(row) of the documents whose fingerprint has a likeness of the threshold in per cent or more to that of an earlier row;
    ``row_col`` tells rows apart and gives their order. Equal fingerprints meet by a hash, and only the first of each goes on. It is
    posted under the rarest signatures, its prefix; sets under one signature are sorted by length, each is compared with those alone whose length,
    signatures still to come and bitmap allow the threshold, and what is left is counted on the full sets. Texts without a
    signature match nothing."""
    sets = written(sets_in(docs, row_col, text_col, chain))
    counts = sketch(sets, "set", SKETCH_LOG2, lambda: scattered)
    made = written(settled(prefixes(sets, counts, threshold)))
    discard(sets)
    full = made.select("row", "line", "set")
    gone, more = later_matches(made, lambda wanted, side: full.join(side(wanted), ["row", "line"], "left_semi"), threshold, "<u4")
    out = written(made.where("copy").select("row").union(gone.select(F.col("xd").alias("row"))).distinct())
    for one in (made, *more):
        discard(one)
    return out


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_earlier boolean"


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN, range_rows: int = ROWS_A_RANGE, threshold: int = THRESHOLD) -> DataFrame:
    """FIELDS for each row: its fingerprint, that of its edited text, the likeness to that and to the next row's, and whether an
    earlier row (in ascending order of ids) is near."""
    name = unused(docs, "row_key")
    rows = keyed(docs.select(id_col, text_col), id_col, text_col, name)
    near = near_duplicates(rows, name, text_col, threshold, chain)
    marked = near.withColumn("id", F.col("row"))
    if hasattr(rows, "_stored_at"):  # rows have numbers of their own
        marked = rows.select(F.col(name).alias("row"), F.col(id_col).cast("long").alias("id")).join(near.hint("merge"), "row", "left_semi").select("row", "id")
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, before, mark, out = Spotter(chain), None, None, []

        def result(row: tuple, after: tuple) -> tuple:
            new = edited(row[2], after[2])
            found = spot(new)
            return (row[1], len(row[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), text_of(row[3]), text_of(found), likeness(row[3], found), likeness(row[3], after[3]), row[4])

        for batch in batches:
            for range_, guest, id_, key, text in zip(*(batch[k].to_pylist() for k in ("range", "guest", "id", "row", "text"))):
                if text is None:
                    mark = key
                    continue
                if guest and (before is None or before[0] != range_):
                    continue  # a further guest of a range that is done
                row = (range_, id_, text, spot(text), mark == key)
                if before is not None and before[0] == range_:
                    out.append(result(before, row))
                before = None if guest else row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        release()

    return in_order(rows, id_col, name, text_col, range_rows, marked).mapInArrow(run, FIELDS)


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
