"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

The known words are the leaves of a tree of classes, Huffman's over their training counts: the root parts all words into BRANCHES
classes, each of these into as many, until each holds one word. One leaf stands for all words beyond the KNOWN most frequent ones.
The probability of a word given the history is the product of the softmaxes on its way down, so every known word depends on its
history, at a cost of a few softmaxes a token; a word beyond the known ones has the share of their common leaf that its smoothed
training count gives. All probabilities of a history sum to 1. Features of a history are a bias, the word before, the word two
places before (skip) and the pair before (n-gram), where a word that isn't known is known by its last two bytes. A feature and a
class of the tree hash into a row of BRANCHES weights, multiples of 1 / STEPS in a byte each; the table is sized by the number of tokens, up to
2^MOST_ROWS_LOG2 rows.

Training goes over all training texts once, in ROUNDS, each over a share of the rows. Each task sums the gradient of its texts:
for every row and branch the observed and the expected count. The sums of all tasks meet slice by slice, and the driver moves each
weight along its gradient, scaled by RATE over the mean of both counts (and CALM). The bias rows are the log-frequencies. Expected
counts are summed as whole multiples of 2^-16, so that the order and number of tasks change nothing. Texts are scored in sparse
numpy batches.

Token counts are a distributed table, by 64-bit hash of the word. Counts of the KNOWN most frequent words go to all tasks (a fixed
number); those of the other words meet their documents in a join.

Defined cases: null and empty texts are the end token alone. Rows with equal ids are scored one by one, and all count. Without
training texts every count is 0. Other columns are neither read nor touched.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BASE, FlatWords, chunks, cleaning, fold_of, lists, map_batches, mix, release, signed, table, written

U = np.uint64
BRANCHES, KNOWN, ROUNDS, RATE, CALM, STEPS = 8, 1 << 19, 3, 0.3, 4.0, 20
#: Tokens in a batch; bytes taken at once.
BATCH, CHUNK_BYTES = 1 << 14, 2 << 20
#: Hashed rows as a power of two: at least, and at most, which bounds memory. Rows of a slice of the summed gradient.
LEAST_ROWS_LOG2, MOST_ROWS_LOG2, SLICE_ROWS = 13, 19, 256
#: Tokens that a training task goes over, about: at least, and at most where there are more than a task for each core.
LEAST_TOKENS, TASK_TOKENS = 2_000_000, 16_000_000
#: Expected counts are whole multiples of one over this; so many tokens fit into 32 bits.
UNIT = float(1 << 16)
END_HASH = 0


def counts_of(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, c): occurrences of each word of the texts, and of the end token under END_HASH."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, ends = FlatWords(), 0
        h, c = np.empty(0, U), np.empty(0, np.int64)
        waiting: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new = np.sort(np.concatenate(waiting)) if waiting else np.empty(0, U)
            first = np.flatnonzero(np.r_[True, new[1:] != new[:-1]][: len(new)])
            all_h, weight = np.concatenate([h, new[first]]), np.concatenate([c, np.diff(np.r_[first, len(new)])])
            order = np.argsort(all_h, kind="stable")
            all_h, weight = all_h[order], weight[order]
            first = np.flatnonzero(np.r_[True, all_h[1:] != all_h[:-1]][: len(all_h)])
            return all_h[first], np.add.reduceat(weight, first) if len(first) else weight

        def out() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(h), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[a : a + 500_000])), pa.array(c[a : a + 500_000], pa.int64())], ["h", "c"])

        for batch in batches:
            ends += batch.num_rows
            for _, column in chunks(batch.column(0)):
                waiting.append(flat(column).hashes)
                if sum(map(len, waiting)) > 2_000_000:
                    h, c = merged()
                    waiting = []
                    if len(h) > 2_000_000:  # bounds a worker's memory
                        yield from out()
                        h, c = h[:0], c[:0]
        h, c = merged()
        if ends:
            h, c = np.r_[U(END_HASH), h], np.r_[ends, c]
        yield from out()

    return docs.select(text_col).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Lookup:
    """Places of 64-bit hashes among the known ones, by a table with open addresses."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        log2 = max(4, (4 * len(hashes)).bit_length())
        self.shift, self.mask = U(64 - log2), (1 << log2) - 1
        self.slots = np.full(1 << log2, -1, np.int32)
        left, at = np.arange(len(hashes)), (hashes >> self.shift).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # the last of several stays
            wait = self.slots[at] != left
            left, at = left[wait], at[wait] + 1 & self.mask

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Places, -1 where a hash isn't known."""
        at = (h >> self.shift).astype(np.int64)
        out = self.slots[at]
        if not len(self.hashes):
            return out
        open_ = np.flatnonzero((out >= 0) & (self.hashes[out] != h))
        while len(open_):
            at[open_] = at[open_] + 1 & self.mask
            got = self.slots[at[open_]]
            out[open_] = got
            open_ = open_[(got >= 0) & (self.hashes[got] != h[open_])]
        return out


@dataclass
class Model:
    """Known words in order of falling counts, totals, the tree of classes, and the weights."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    vocabulary: int
    end_count: int
    #: Leaf of each known word; that of all others.
    leaf: np.ndarray
    rare: int
    #: Where the way to each leaf starts, and its nodes and branches from the root.
    way: np.ndarray
    nodes: np.ndarray
    branches: np.ndarray
    bias: np.ndarray
    #: Hashed rows, in STEPS.
    weights: np.ndarray

    @property
    def rare_total(self) -> float:
        """Counts of the words beyond the known ones, each one higher, and one unknown word."""
        return float(self.tokens - int(self.counts.sum()) + self.vocabulary - len(self.counts) + 1)


def tree(mass: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Huffman's tree over leaves of falling mass: their ways (starts, nodes, branches) and the log-share of each node's branches."""
    n = len(mass)
    if n == 1:
        return np.zeros(2, np.int64), np.empty(0, np.int32), np.empty(0, np.int8), np.zeros((1, width), np.float32)
    empty = -(n - 1) % (width - 1)
    nodes = (n + empty - 1) // (width - 1)
    leaves = np.r_[np.zeros(empty), mass[::-1]].tolist()  # rising
    merged: list[float] = []
    up, at = np.zeros(len(leaves) + nodes, np.int64), np.zeros(len(leaves) + nodes, np.int64)
    share = np.zeros((nodes, width))
    i = j = 0
    for k in range(nodes):
        for b in range(width):
            if i < len(leaves) and (j >= len(merged) or leaves[i] <= merged[j]):
                share[k, b], child, i = leaves[i], i, i + 1
            else:
                share[k, b], child, j = merged[j], len(leaves) + j, j + 1
            up[child], at[child] = k, b
        merged.append(float(share[k].sum()))
    # Up from all leaves at once, step by step; the last node is the root.
    depth, here, own = np.zeros(n, np.int64), len(leaves) - 1 - np.arange(n), np.arange(n)
    while len(own):
        depth[own] += 1
        on = up[here] != nodes - 1
        own, here = own[on], len(leaves) + up[here[on]]
    way = np.r_[0, np.cumsum(depth)]
    node, branch = np.empty(way[-1], np.int32), np.empty(way[-1], np.int8)
    here, own, to = len(leaves) - 1 - np.arange(n), np.arange(n), way[1:] - 1
    while len(own):
        node[to], branch[to] = up[here], at[here]
        on = up[here] != nodes - 1
        own, to, here = own[on], to[on] - 1, len(leaves) + up[here[on]]
    return way, node, branch, np.log(np.maximum(share / share.sum(1, keepdims=True), 1e-13)).astype(np.float32)


def start(counts: DataFrame) -> Model:
    """The model before training: the most frequent words, their classes and log-frequencies."""
    totals = counts.agg(F.sum("c"), F.count("*"), F.coalesce(F.sum(F.when(F.col("h") == END_HASH, F.col("c"))), F.lit(0))).first()
    tokens, vocabulary = int(totals[0] or 0), int(totals[1])
    # The least count of which all words fit into KNOWN; very high counts are one bin.
    bins = counts.groupBy(F.least("c", F.lit(1_000_000)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.col("c").desc())
    least, room = 1_000_001, KNOWN
    for b in bins.toLocalIterator():
        if (room := room - b["n"]) < 0:
            break
        least = b["c"]
    most = counts.where(F.col("c") >= least).toArrow()
    return made(most["h"].to_numpy().view(U), most["c"].to_numpy(), tokens, vocabulary, int(totals[2]))


def made(h: np.ndarray, c: np.ndarray, tokens: int, vocabulary: int, end_count: int) -> Model:
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    model = Model(h, c, tokens, vocabulary, end_count, *(None,) * 7)
    mass = np.r_[c + 1.0, model.rare_total]
    order = np.argsort(-mass, kind="stable")
    leaf = np.empty(len(mass), np.int64)
    leaf[order] = np.arange(len(mass))
    model.leaf, model.rare = leaf[:-1], int(leaf[-1])
    model.way, model.nodes, model.branches, model.bias = tree(mass[order], BRANCHES)
    rows = 1 << min(MOST_ROWS_LOG2, max(LEAST_ROWS_LOG2, (tokens // 128).bit_length()))
    model.weights = np.zeros((rows, BRANCHES), np.int8)
    return model


class Tokens:
    """Tokens of a column of texts, ends included: their text, hash, place among the known words, leaf, and features."""

    def __init__(self, model: Model):
        self.model, self.flat, self.known = model, FlatWords(), Lookup(model.hashes)
        end = self.known(np.array([END_HASH], U))[0]
        self.end = int(end)
        # A row of weights is one integer.
        self.rows = model.weights.view(np.int64).ravel()
        self.salts = mix(np.arange(1, len(model.bias) + 1, dtype=U) * U(BASE))
        self.shift = U(65 - len(model.weights).bit_length())

    def __call__(self, column: pa.Array) -> None:
        m, texts = self.model, self.flat(column)
        n, per = len(texts), np.diff(texts.bounds)
        size = len(texts.hashes) + n
        self.text = np.repeat(np.arange(n), per + 1)
        word = np.ones(size, bool)
        word[texts.bounds[1:] + np.arange(n)] = False
        place = self.known(texts.hashes)
        self.h = np.full(size, U(END_HASH))
        self.h[word] = texts.hashes
        self.place = np.full(size, self.end, np.int64)
        self.place[word] = place
        self.leaf = m.leaf[self.place] if len(m.leaf) else np.full(size, m.rare, np.int64)
        self.leaf[self.place < 0] = m.rare
        # What later tokens see: a known word, or the last two bytes of another.
        last, before = texts.data[texts.ends - 1].astype(np.int64), np.where(texts.ends - texts.starts > 1, texts.data[np.maximum(texts.ends - 2, 0)], 0).astype(np.int64)
        last, before = (b + 32 * ((b >= 65) & (b <= 90)) for b in (last, before))
        tail = (last * 256 + before) * 40503 % 65536 // 64
        sign = np.zeros(size, np.int64)
        sign[word] = np.where(place >= 0, place, len(m.hashes) + tail)
        since = np.arange(size) - np.repeat(texts.bounds[:-1] + np.arange(n), per + 1)
        none = len(m.hashes) + 1024
        back = []
        for k in (1, 2):
            b = np.full(size, none, np.int64)
            b[k:] = sign[: max(size - k, 0)]
            b[since < k] = none
            back.append(b.astype(U))
        self.features = [mix(back[0] + U(1 << 20)), mix(back[1] + U(2 << 20)), mix(back[0] * U(1 << 21) + back[1] + U(1 << 44))]

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
        """For BATCH tokens at a time all softmaxes on their ways: token, branch, rows of the table by feature, their exponentials
        and sums."""
        m = self.model
        for a in range(0, len(self.leaf), BATCH):
            leaf = self.leaf[a : a + BATCH]
            first, steps = m.way[leaf], m.way[leaf + 1] - m.way[leaf]
            of = np.repeat(np.arange(len(leaf)), steps)
            at = np.arange(len(of)) + np.repeat(first - (np.cumsum(steps) - steps), steps)
            node, branch = m.nodes[at], m.branches[at]
            salt = self.salts[node]
            rows = [(((f[a : a + BATCH][of] ^ salt) * U(BASE)) >> self.shift).view(np.int64) for f in self.features]
            z = sum(self.rows[r].view(np.int8).reshape(-1, BRANCHES).astype(np.int16) for r in rows) * np.float32(1 / STEPS)
            z += m.bias[node]
            np.exp(z, out=z)  # weights are bounded, so nothing overflows
            yield of + a, branch.astype(np.int64), rows, z, halves(z)


def halves(z: np.ndarray) -> np.ndarray:
    """Sums of rows, each in the same order whatever the number of rows."""
    while z.shape[1] > 1:
        half = z.shape[1] // 2
        z = z[:, :half] + z[:, half:]
    return z[:, 0]


class Gradient:
    """Observed and expected counts of each row and branch."""

    def __init__(self, model: Model):
        size = model.weights.size
        self.observed, self.expected = np.zeros(size, np.int32), np.zeros(size, np.int64)
        self.recent, self.held = [np.zeros(size, np.uint32) for _ in range(2)], 0

    def add(self, tokens: Tokens) -> None:
        pairs = np.arange(BRANCHES // 2)  # two counts of 32 bits are added as one integer
        recent = self.recent[1].view(np.uint64)
        for of, branch, rows, z, total in tokens.batches():
            if self.held + BATCH > 1 << 15:
                self.settle()
            self.held += BATCH
            z *= (UNIT / total)[:, None]
            expected = np.rint(z, out=z).astype(np.uint32).view(np.uint64).ravel()
            for r in rows:
                np.add.at(recent, ((r * len(pairs))[:, None] + pairs).ravel(), expected)
                np.add.at(self.recent[0], r * BRANCHES + branch, np.uint32(1))

    def settle(self) -> None:
        self.observed += self.recent[0].view(np.int32)
        self.expected += self.recent[1]
        for new in self.recent:
            new[:] = 0
        self.held = 0

    def slices(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        width = SLICE_ROWS * BRANCHES
        used = np.flatnonzero(self.observed.reshape(-1, width).any(1) | self.expected.reshape(-1, width).any(1))
        for a in range(0, len(used), 64):
            some = used[a : a + 64].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([zlib.compress(x[k * width : (k + 1) * width].tobytes(), 1) for k in some], pa.binary()) for x in (self.observed, self.expected))], ["slice", "observed", "expected"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps of the slices, by their sums over all tasks; one array a slice, whatever the number of tasks that sent it."""
    all_: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for k, o, e in zip(batch["slice"].to_pylist(), batch["observed"].to_pylist(), batch["expected"].to_pylist()):
            o, e = np.frombuffer(zlib.decompress(o), np.int32), np.frombuffer(zlib.decompress(e), np.int64)
            if k in all_:
                all_[k][0] += o
                all_[k][1] += e
            else:
                all_[k] = [o.astype(np.int64), e.copy()]
    for k, (o, e) in all_.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([moves(o, e / UNIT).tobytes()], pa.binary())], ["slice", "move"])


def moves(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Steps along the gradient, observed less expected, scaled by the mean of both."""
    return (RATE * (observed - expected) / ((observed + expected) / 2 + CALM)).astype(np.float32)


def steps_of(weights: np.ndarray) -> np.ndarray:
    """Weights as whole numbers of steps, in a byte each."""
    return np.clip(np.rint(weights * STEPS), -127, 127).astype(np.int8)


def trained(docs: DataFrame, model: Model, text_col: str, share: Column) -> Model:
    """Go over the texts once; ``share`` is a hash of the row that deals texts to rounds."""
    spark = docs.sparkSession
    tokens_a_round = -(-model.tokens // ROUNDS)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, tokens_a_round // LEAST_TOKENS), -(-tokens_a_round // TASK_TOKENS))
    width, kind = SLICE_ROWS * BRANCHES, "slice int, observed binary, expected binary"
    exact = np.zeros(model.weights.size, np.float32)
    for r in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = Tokens(sent.value)
            gradient = Gradient(sent.value)
            for batch in batches:
                for _, column in chunks(batch.column(0), CHUNK_BYTES):
                    tokens(column)
                    gradient.add(tokens)
            yield from gradient.slices()
            del tokens, gradient
            release()

        parts = docs.where(F.pmod(share, F.lit(ROUNDS)) == r).select(text_col).coalesce(tasks).mapInArrow(run, kind)
        slices = -(-len(model.weights) // SLICE_ROWS)
        with cleaning(spark):
            sums = parts.repartition(min(slices, 4 * tasks), "slice").mapInArrow(summed, "slice int, move binary").collect()
        for row in sums:
            exact[row["slice"] * width : (row["slice"] + 1) * width] += np.frombuffer(row["move"], np.float32)
        model.weights = steps_of(exact).reshape(model.weights.shape)
        sent.destroy()
    return model


def scored(docs: DataFrame, model: Model, counts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of each row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def each():
        m = sent.value
        tokens, rare_total = Tokens(m), np.log(m.rare_total)

        def some(column: pa.Array) -> list:
            tokens(column)
            n, text = len(column), tokens.text
            p = np.zeros(len(text))
            for of, branch, _, z, total in tokens.batches():
                got = np.log(z[np.arange(len(of)), branch] / total)
                p += np.bincount(of, got, len(p)) if len(p) <= BATCH else 0
                if len(p) > BATCH and len(of):
                    a = int(of[0])
                    part = np.bincount(of - a, got)
                    p[a : a + len(part)] += part
            count = m.counts[tokens.place] if len(m.counts) else np.zeros(len(text), np.int64)
            count = np.where(tokens.place >= 0, count, 0)
            p[tokens.leaf == m.rare] -= rare_total
            rest = np.flatnonzero(tokens.place < 0)
            rest = rest[tokens.h[rest] != U(END_HASH)]
            return [np.bincount(text, minlength=n), np.bincount(text[count > 0], minlength=n), np.bincount(text, np.log10(count + 1.0), n), np.bincount(text, p, n) / np.log(10), np.bincount(text[rest], minlength=n), signed(tokens.h[rest])]

        def one(batch: pa.RecordBatch) -> dict:
            size, known, base, score, count, rest = (np.concatenate(x) for x in zip(*[some(c) for _, c in chunks(batch["text"], CHUNK_BYTES)]))
            return {"id": batch["id"], "n": size, "known": known, "base": base, "score": score, "rest": lists(rest, count, pa.int64())}

        return one

    rows = map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), each, f"id {dict(docs.dtypes)[id_col]}, n long, known long, base double, score double, rest array<long>")
    total = float(np.log10(model.tokens + model.vocabulary + 1))
    if model.vocabulary == len(model.counts):  # every counted word is known
        made = rows.withColumn("known2", F.lit(0).cast("long")).withColumn("more", F.lit(0.0))
    else:
        kept = written(rows.withColumn("row", F.monotonically_increasing_id()))
        rest = kept.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count("*").alias("tf"))
        found = rest.join(counts.hint("merge"), "h").groupBy("row").agg(F.sum("tf").alias("known2"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more"))
        made = kept.drop("rest").join(found.hint("merge"), "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    base = F.col("base") + more - F.col("n") * F.lit(total)
    return made.select("id", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), base.alias("base_score"), (F.col("score") + more).alias("score"))


def score_texts(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """Learn from ``training`` and score ``docs``."""
    counts = written(counts_of(training, text_col))
    share = F.xxhash64(F.col(id_col).cast("string"), F.octet_length(text_col))
    model = trained(training, start(counts), text_col, share)
    return scored(docs, model, counts, id_col, text_col), model


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, model = score_texts(docs, docs.where(fold_of("doc_id", 7) != 2))
    return out.select(F.col("id").alias("doc_id"), (fold_of("id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
