"""Quality classifier: naive Bayes support vectors (NBSVM).

Indicators of n-grams (words and word shapes) hash into a fixed number of buckets. Each indicator is scaled by the log-count
ratio of its bucket between the classes, and a linear hinge-loss model is fitted to the scaled indicators by dual coordinate
descent. A logistic curve, fitted on rows that the descent did not see, turns margins into scores from 0 to 1.

The fit uses at most ``sample_rows`` labelled ids, chosen by a hash; scoring reads whole texts of all rows.

Defined cases: null and empty texts have no n-gram and score as the bias alone. Labels that are null, and labelled ids without
a document, are ignored. Of several labels of an id the greatest counts, of several texts of an id the least (by bytes). Rows with
the same id are scored one by one. Without labels of both classes every score is 1 or 0, as the one class seen says, and 1 with no
label at all. A column of the score's name is an error. Other columns are neither read nor touched.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import FlatTexts, FlatWords, chunks, fold_of, map_batches, mix, table, unused

BUCKETS_LOG2 = 18
SAMPLE_ROWS = 10_000
#: Bytes taken at once, which bounds a worker's memory; a longer text is taken whole.
CHUNK_BYTES = 1 << 20
#: Kinds of bytes: upper-case, lower-case (and what isn't ASCII), digits; other signs are a kind each.
KINDS = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b >= 128 else 3 if 48 <= b <= 57 else b for b in range(256)], np.uint8)
U = np.uint64


class Features:
    """Buckets of the n-gram indicators of texts: word 1- and 2-grams; 1- to 3-grams of word shapes (runs of a kind of byte are one
    sign), where a word that repeats the one before has a shape of its own; and each shape with the binary order of its share of
    the words."""

    def __init__(self, buckets_log2: int):
        self.flat, self.log2 = FlatWords(), buckets_log2

    def shapes(self, texts: FlatTexts) -> np.ndarray:
        kinds = KINDS[texts.data]
        size = texts.ends - texts.starts
        inside = np.repeat(texts.starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        kinds = kinds[inside]
        first = np.cumsum(size) - size
        keep = np.r_[True, kinds[1:] != kinds[:-1]]
        keep[first] = True
        return self.flat.hashed(kinds[keep], np.add.reduceat(keep, first, dtype=np.int64))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Different buckets of each text, rising, flat, and the bounds of each text among them."""
        texts = self.flat(column)
        h, n = texts.hashes, len(texts)
        if not len(h):
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
        text = np.repeat(np.arange(n), np.diff(texts.bounds)).astype(U)
        two = text[1:] == text[:-1]
        three = two[1:] & two[:-1]
        s = self.shapes(texts)
        s[1:][two & (h[1:] == h[:-1])] ^= U(0x5851F42D4C957F2D)
        # Shapes of each text and how often they occur, by the leading bits of their hash.
        key = np.sort(text << U(44) | s >> U(20))
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        own, kind = (key[new] >> U(44)), key[new] << U(20)
        share = np.diff(np.r_[new, len(key)]) / np.diff(texts.bounds)[own.astype(np.int64)]
        order = np.maximum(np.log2(share), -9).astype(np.int64).view(U)
        found = [(text, h + U(1)), (text[1:][two], (h[:-1] * U(3) + h[1:] + U(2))[two]), (own, kind + U(4)), (own, kind * U(5) + order)]
        found += [(text[1:][two], (s[:-1] * U(7) + s[1:] + U(6))[two]), (text[2:][three], ((s[:-2] * U(7) + s[1:-1]) * U(7) + s[2:] + U(8))[three])]
        key = np.sort(np.concatenate([t << U(self.log2) | mix(v) >> U(64 - self.log2) for t, v in found]))
        key = key[np.r_[True, key[1:] != key[:-1]]]
        return (key & U((1 << self.log2) - 1)).astype(np.uint32), np.searchsorted(key >> U(self.log2), np.arange(n + 1, dtype=U))


@dataclass
class Model:
    """Weights by bucket (already times the log-count ratio), bias, slope and offset of the logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    buckets_log2: int

    def margins(self, found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of texts with the buckets ``found``, flat."""
        size = np.diff(bounds)
        sums = np.bincount(np.repeat(np.arange(len(size)), size), self.weights[found], len(size))
        return sums / np.sqrt(np.maximum(size, 1)) + self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss: each step solves for one row's dual variable in [0, cost]."""
    rng, w, bias = np.random.default_rng(seed), np.zeros(len(ratio), np.float32), 0.0
    x = [ratio[r] / np.float32(max(len(r), 1) ** 0.5) for r in rows]
    square = np.array([float(v @ v) + 1 for v in x])
    alpha = np.zeros(len(rows))
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], x[i]
            gradient = y[i] * (float(w[r] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            if (step := new - alpha[i]) != 0:
                alpha[i] = new
                w[r] += np.float32(step * y[i]) * v
                bias += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3 * cost:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve by Newton's steps; the targets are drawn in a little, as Platt does."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, at = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(at[0]), 1e-3), float(at[1])


def sample(labels: DataFrame, id_col: str, label_col: str, sample_rows: int, seed: int) -> DataFrame:
    """(k, y) of at most ``sample_rows`` labelled ids, those of the least hashes. A bound on the hash comes first, so that no more
    than about as many ids meet in one place, whatever the number of partitions."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y is not null")
    of = known.groupBy("k").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("k", F.lit(seed)))
    share = 1.2 * sample_rows / max(known.count(), 1)
    if share < 1:
        of = of.where(F.col("h") < int(-(2**63) + 2**64 * share))
    return of.orderBy("h", "k").limit(sample_rows).select("k", "y")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, buckets_log2: int = BUCKETS_LOG2, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> Model:
    """Fit to at most ``sample_rows`` labelled documents. The chosen ids are at most that many, so they go to all tasks; one text
    an id moves, and only its indicators reach the driver."""
    chosen = sample(labels, id_col, label_col, sample_rows, seed)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("text").alias("text"))

    def each():
        features = Features(buckets_log2)

        def one(batch: pa.RecordBatch) -> dict:
            out = []
            for _, column in chunks(batch["text"], CHUNK_BYTES):
                found, bounds = features(column)
                out += [found[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            return {"k": batch["k"].cast(pa.string()), "y": batch["y"], "f": pa.array(out, pa.binary())}

        return one

    got = map_batches(rows, each, "k string, y int, f binary").collect()
    got.sort(key=lambda r: (xxh(r["k"]), r["k"]))
    y = np.array([1.0 if r["y"] == 1 else -1.0 for r in got])
    found = [np.frombuffer(r["f"], np.uint32) for r in got]
    width = 1 << buckets_log2
    if len(set(y)) < 2:
        return Model(np.zeros(width, np.float32), 0.0, 1.0, -30.0 if len(y) and y[0] < 0 else 30.0, buckets_log2)
    held = np.arange(len(got)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    fit_rows, fit_y = [f for f, h in zip(found, held) if not h], y[~held]
    counts = [np.bincount(np.concatenate([f for f, v in zip(fit_rows, fit_y) if v == c] or [np.empty(0, np.uint32)]), minlength=width) for c in (1, -1)]
    n1, n0 = (fit_y > 0).sum(), (fit_y < 0).sum()
    p1, p0 = n1 / len(fit_y), n0 / len(fit_y)
    ratio = (np.log((counts[0] + p1) / (counts[1] + p0)) - np.log(p1 / p0)).astype(np.float32)  # 0 for what was never seen
    w, bias = descend(fit_rows, fit_y, ratio, cost, epochs, seed)
    model = Model(w * ratio, bias, 1.0, 0.0, buckets_log2)
    on = [i for i in range(len(got)) if held[i]] or list(range(len(got)))
    bounds = np.r_[0, np.cumsum([len(found[i]) for i in on])]
    model.slope, model.offset = logistic(model.margins(np.concatenate([found[i] for i in on]), bounds), y[on])
    return model


def xxh(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The table with one more column, the score of each text (double, 0 to 1). The model has a fixed size."""
    if score_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the table has a column {score_col}")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        features = Features(m.buckets_log2)
        for texts in batches:
            yield pa.array(np.concatenate([m.score(m.margins(*features(column))) for _, column in chunks(texts, CHUNK_BYTES)] or [np.empty(0)]))

    return docs.withColumn(score_col, scored(F.col(text_col)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold_of("doc_id", 5) != 0))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(fold_of("doc_id", 5) != 0))
    name = unused(docs, "score")
    return score(docs, model, score_col=name).where(F.col(name) >= 0.3).drop(name)
