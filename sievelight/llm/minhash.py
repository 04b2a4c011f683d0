"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations give all coordinates of a signature (C-MinHash): sigma scatters the shingles over a circle, and coordinate k is
the least pi over the set shifted by k. As the shifts of one shingle are neighbours in pi, a signature is the running minimum of
contiguous slices. Bands of ROWS coordinates put documents into buckets.

No bucket is expanded into pairs. Documents with equal sets form a class first, and only class representatives have bands.
Each bucket links its members to its smallest one; the distinct links are verified on full sets, and components follow. Only
buckets that still hold several components are looked at again, once for each different membership: inside such a bucket,
members of different components whose signatures agree well enough are verified, nearest first, and united at once, so that
members of one component are never compared. Only links that unite come out.

Buckets of more than FULL_BUCKET members are first divided by further bands, made of all SKETCH coordinates; parts that hold one
component are done, and parts that are still as large are dealt to pairs of blocks, which is complete. So a task holds at most
about FULL_BUCKET sets at a time.

What can be missed, for a pair at exactly 0.75: with 48 bands of 5, no common bucket at all with probability 2e-6; in open buckets
a sketch that agrees too little, 1e-10; in divided buckets no further common band, 4e-9. All are far less above 0.75.

Defined cases: null, empty and blank texts have no shingle and are linked with nothing. Rows with equal ids, null ids included, are
nodes of their own, in the order of their texts' md5 and null ids last: ``kept`` is the first row of each component, whose id is
``component_id``. Order of rows never matters. Other columns are neither read nor touched.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import FlatWords, chunks, discard, keyed, lists, map_batches, mix, release, shingles, signed, table, unused, written

SHINGLE, THRESHOLD = 5, 75  # words, per cent
CIRCLE_LOG2, BANDS, ROWS, SEED = 20, 48, 5, 11
#: Members of an open bucket past which it is divided.
FULL_BUCKET = 2_000
#: Bytes of a signature that are kept, one a coordinate, and those that must agree for members of an open bucket to be verified:
#: at 0.75, 276 are expected to, and 222 is 6.5 standard deviations below.
SKETCH, SKETCH_LEAST = 368, 222


class Circulant:
    """Signatures from sigma, a scramble of the hash, and pi, a permutation of the circle."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, k = bands, rows, max(bands * rows, SKETCH)
        pi = rng.permutation(1 << CIRCLE_LOG2).astype(np.int32)
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k)
        self.factor = rng.integers(1, 2**62, rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, found: np.ndarray) -> np.ndarray:
        at = (mix(found + np.uint64(SEED)) >> np.uint64(64 - CIRCLE_LOG2)).astype(np.int64)
        out = self.slices[at[:256]].min(0)
        for i in range(256, len(at), 256):
            np.minimum(out, self.slices[at[i : i + 256]].min(0), out=out)
        return out

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """One hash a band, of the band's number and coordinates."""
        rows = signature[: self.bands * self.rows].astype(np.uint64).reshape(self.bands, self.rows)
        return mix((mix(rows + np.uint64(1)) * self.factor).sum(1, dtype=np.uint64) + self.band)

    def sketch(self, signature: np.ndarray) -> bytes:
        """One byte of each coordinate."""
        return (mix(signature[:SKETCH].astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes()


def set_hash(found: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a set, by which equal sets meet."""
    if not len(found):
        return 0, 0
    value = xxhash.xxh3_128_intdigest(found.tobytes())
    return (value >> 64) - 2**63, (value & (2**64 - 1)) - 2**63


def sets_in(column: pa.Array, flat: FlatWords, shingle: int) -> Iterator[np.ndarray]:
    """The shingle set of each text."""
    for _, part in chunks(column):
        texts = flat(part)
        for k in range(len(texts)):
            yield shingles(texts[k], shingle)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, n, h1, h2, keys, sketch) of each document."""

    def each():
        flat, circulant = FlatWords(), Circulant(bands, rows)

        def one(batch: pa.RecordBatch) -> dict:
            n, h, keys, sketch = [], [], [], []
            for found in sets_in(batch["text"], flat, shingle):
                n.append(len(found))
                h.append(set_hash(found))
                if len(found):
                    signature = circulant.signature(found)
                    keys.append(circulant.keys(signature))
                    sketch.append(circulant.sketch(signature))
                else:
                    keys.append(np.empty(0, np.uint64))
                    sketch.append(None)
            h = np.array(h, np.int64).reshape(-1, 2)
            return {"id": batch["id"], "n": n, "h1": h[:, 0], "h2": h[:, 1], "keys": lists(signed(np.concatenate(keys)), [len(k) for k in keys], pa.int64()), "sketch": pa.array(sketch, pa.binary())}

        return one

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), each, "id long, n long, h1 long, h2 long, keys array<long>, sketch binary")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, set) of the documents in ``wanted``: sorted shingle hashes as bytes."""

    def each():
        flat = FlatWords()

        def one(batch: pa.RecordBatch) -> dict:
            return {"id": batch["id"], "set": pa.array([x.tobytes() for x in sets_in(batch["text"], flat, shingle)], pa.binary())}

        return one

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    return map_batches(texts, each, "id long, set binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= threshold * union."""

    def each():
        def one(batch: pa.RecordBatch) -> dict:
            keep = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = sorted((len(x), len(y)))
                if not small or 100 * small < threshold * large:
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= threshold * (small + large - common))
            mask = pa.array(keep, pa.bool_())
            return {"a": batch["a"].filter(mask), "b": batch["b"].filter(mask)}

        return one

    # Two sort-merge joins: a hub with very many partners is split by AQE.
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
    return map_batches(both.select("a", "b", "x", "y"), each, "a long, b long")


def common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def united(ids: list[int], component: list[int], sketches: np.ndarray, sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Links that unite components of one bucket."""
    up = {c: c for c in component}

    def find(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    out = []
    for i in range(1, len(ids)):
        roots = np.array([find(c) for c in component[:i]])
        other = np.flatnonzero(roots != find(component[i]))
        if not len(other):
            continue
        alike = (sketches[other] == sketches[i]).sum(1)
        near = np.flatnonzero(alike >= SKETCH_LEAST)
        for j in other[near[np.argsort(-alike[near], kind="stable")]]:
            a, b = find(component[i]), find(component[j])
            if a != b:
                n = common(sets[i], sets[j])
                if 100 * n >= threshold * (len(sets[i]) + len(sets[j]) - n):
                    up[max(a, b)] = min(a, b)
                    out.append((ids[i], ids[j]))
    return out


def several(members: DataFrame) -> DataFrame:
    """(key, size) of the groups (key, id, c) that hold several components, once for each membership."""
    of = members.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("who")).where("least < most")
    return of.groupBy("who", "size", "least", "most").agg(F.min("key").alias("key")).select("key", "size")


def divided(full: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, id, c) of parts of full buckets that hold several components: members that agree in a further band, and of such parts
    that are full again, all pairs of blocks."""
    rows = SKETCH // ROWS
    factor = np.random.default_rng(SEED + 1).integers(1, 2**62, ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def each():
        band = mix(np.arange(1, rows + 1, dtype=np.uint64))

        def one(batch: pa.RecordBatch) -> dict:
            n = batch.num_rows
            sketch = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint8).reshape(n, SKETCH)[:, : rows * ROWS].astype(np.uint64).reshape(n, rows, ROWS)
            of = mix((mix(sketch + np.uint64(1)) * factor).sum(2, dtype=np.uint64) + band)
            key = mix(of + batch["key"].to_numpy().view(np.uint64)[:, None] * np.uint64(3))
            return {"key": signed(key.ravel()), "id": np.repeat(batch["id"].to_numpy(), rows), "c": np.repeat(batch["c"].to_numpy(), rows)}

        return one

    parts = map_batches(full.join(reps.select("id", "sketch").hint("merge"), "id").select("key", "id", "c", "sketch"), each, "key long, id long, c long")
    parts = written(parts)
    left = parts.join(several(parts).hint("merge"), "key")
    blocks = F.ceil(F.col("size") / F.lit(FULL_BUCKET // 2))
    mine = F.pmod(F.xxhash64("id"), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    dealt = left.where(F.col("size") > FULL_BUCKET).select("key", "id", "c", mine.alias("mine"), other.alias("other"))
    dealt = written(dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "id", "c"))
    return left.where(F.col("size") <= FULL_BUCKET).select("key", "id", "c").union(dealt.join(several(dealt).hint("merge"), "key").select("key", "id", "c"))


def across(buckets: DataFrame, joined: DataFrame, reps: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components so far."""
    inside = buckets.join(joined.hint("merge"), F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    open_ = written(several(inside))
    left = inside.join(open_.hint("merge"), "key")
    rows = left.where(F.col("size") <= FULL_BUCKET).select("key", "id", "c")
    if not open_.where(F.col("size") > FULL_BUCKET).isEmpty():
        rows = rows.union(divided(left.where(F.col("size") > FULL_BUCKET).select("key", "id", "c"), reps))
    rows = rows.join(reps.select("id", "sketch").hint("merge"), "id").join(sets.hint("merge"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            _, ids, component, sketch, sets = zip(*held)
            found = united(list(ids), list(component), np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, SKETCH), [np.frombuffer(x, np.uint64) for x in sets], threshold) if len(ids) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch[k].to_pylist() for k in ("key", "id", "c", "sketch", "set"))):
                if held and held[0][0] != row[0]:
                    yield from out()
                    held = []
                held.append(row)
        if held:
            yield from out()
        held = []
        release()

    return rows.repartition(F.col("key")).sortWithinPartitions("key", "id").select("key", "id", "c", "sketch", "set").mapInArrow(run, "a long, b long").distinct()


def joined_rows(docs: DataFrame, row_col: str, text_col: str, shingle: int, threshold: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, n) of each row, and (node, component) of rows that are linked; ids are those of ``row_col``."""
    made = written(signatures(docs, row_col, text_col, shingle, bands, rows))
    some = made.where("n > 0")
    classes = some.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))
    reps = written(some.join(classes.hint("merge"), ["h1", "h2", "n"]).where("id = rep").select("id", "keys", "sketch"))
    bands_of = reps.select("id", F.explode("keys").alias("key"))
    hubs = bands_of.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1").select("key", "hub")
    buckets = written(bands_of.join(hubs.hint("merge"), "key").select("key", "id", "hub").distinct())
    first = written(buckets.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    sets = written(full_sets(docs, buckets.select("id").distinct(), row_col, text_col, shingle))
    # Rows of a class are linked with its representative.
    copies = some.join(classes.hint("merge"), ["h1", "h2", "n"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    joined = written(components(verified(first, sets, threshold).union(copies)))
    more = written(across(buckets.select("key", "id"), joined, reps, sets, threshold))
    if not more.isEmpty():
        joined = written(components(more.union(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))))
    for one in (reps, buckets, first, sets, more):
        discard(one)
    return made, joined


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row of ``docs``."""
    name = unused(docs, "row_key")
    given = keyed(docs.select(id_col, text_col), id_col, text_col, name)
    made, joined = joined_rows(given, name, text_col, shingle, threshold, bands, rows)
    out = made.select("id", F.col("n").alias("n_shingles")).join(joined.hint("merge"), F.col("id") == F.col("node"), "left").select("id", "n_shingles", F.coalesce("component", "id").alias("c"))
    if hasattr(given, "_stored_at"):  # rows have numbers of their own
        of = given.select(F.col(name).alias("r"), F.col(id_col).cast("long").alias("doc"))
        least = of.select(F.col("r").alias("c"), F.col("doc").alias("component_id"))
        out = out.join(of.hint("merge"), F.col("id") == F.col("r")).join(least.hint("merge"), "c")
        return out.select(F.col("doc").alias("id"), "n_shingles", "component_id", (F.col("r") == F.col("c")).alias("kept"))
    return out.select("id", "n_shingles", F.col("c").alias("component_id"), (F.col("id") == F.col("c")).alias("kept"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("kept"))).withColumnRenamed("id", "doc_id")


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the least id (of equal ids, that with the least md5 of its text)."""
    name = unused(docs, "row_key")
    rows = keyed(docs, "doc_id", "text", name)
    _, joined = joined_rows(rows, name, "text", SHINGLE, THRESHOLD, BANDS, ROWS)
    gone = joined.where("node <> component").select(F.col("node").alias(unused(docs, "gone")))
    return rows.join(gone.hint("merge"), rows[name] == gone[gone.columns[0]], "left_anti").drop(name)


#: The same in SQL: shared shingles are counted for all pairs, and the smallest id spreads along the links.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS found FROM w),
n AS (SELECT doc_id, len(found)::BIGINT AS n, hash(list_sort(found)) AS h FROM s),
r AS (SELECT n, h, min(doc_id) AS rep FROM n WHERE n > 0 GROUP BY ALL),
m AS (SELECT n.doc_id, n.n, coalesce(r.rep, n.doc_id) AS rep FROM n LEFT JOIN r ON n.n = r.n AND n.h = r.h),
x AS (SELECT s.doc_id, unnest(found) AS sh FROM s WHERE doc_id IN (SELECT rep FROM r)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
t AS (SELECT rep AS node, rep AS seen FROM r UNION SELECT e.b, t.seen FROM t JOIN e ON t.node = e.a AND t.seen < e.b),
c AS (SELECT node, min(seen) AS component FROM t GROUP BY node)
SELECT m.doc_id, m.n AS n_shingles, coalesce(c.component, m.doc_id) AS component_id,
  m.doc_id = coalesce(c.component, m.doc_id) AS kept
FROM m LEFT JOIN c ON m.rep = c.node
"""
