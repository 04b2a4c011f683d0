"""Quality classifier: indicators, weights and scores against plain versions, held-out accuracy, and defined cases."""

import math
import random
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelight.llm.quality import Features, descend, fit, op3_quality, quality_stage, sample, score

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def text(rng, good):
    words = ["".join(rng.choice(["th", "an", "re", "on", "é", "ti"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
    if good:
        return ". ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    kind = rng.randrange(3)
    return " ".join(w.upper() + "!!" for w in words) if kind == 0 else " | ".join(words) if kind == 1 else " ".join(w for w in words[:10] for _ in range(12))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, root = random.Random(1), tmp_path_factory.mktemp("quality")
    rows = [(i, text(rng, i % 6 > 0), "en", None, None, 0.5) for i in range(400)] + [(900, None, None, None, None, None), (901, "", "en", "s", 0, 1.0), (902, "word " * 60_000, "en", "s", 0, 1.0), (1, "again the same id", "en", "s", 1, 1.0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(i, int(i % 6 > 0), 0) for i in range(400)] + [(5000, 1, 0), (None, 1, 0), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_held_out(spark, folder):
    rows = op3_quality(spark, folder).collect()
    assert len(rows) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 40 and sum(r["predicted"] == (r["doc_id"] % 6 > 0) for r in held) >= 0.95 * len(held)


def test_stage_keeps_rows_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = quality_stage(spark, docs, folder)
    assert out.columns == docs.columns and 250 < out.count() < 380
    assert quality_stage(spark, docs.where("false"), folder).count() == 0


def test_sample_bound_and_one_class(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    assert fit(docs, labels, sample_rows=50).weights.any()
    ones = fit(docs, labels.where("quality = 1"))
    assert score(docs, ones, score_col="s").where("s < 0.9").count() == 0
    assert score(docs, fit(docs, labels.where("quality = 0")), score_col="s").where("s > 0.1").count() == 0
    assert score(docs, fit(docs, labels.where(F.lit(False))), score_col="s").where("s < 0.9").count() == 0


M64 = 2**64 - 1


def mix64(v):
    v &= M64
    v = ((v ^ v >> 33) * 0xFF51AFD7ED558CCD) & M64
    v = ((v ^ v >> 33) * 0xC4CEB9FE1A85EC53) & M64
    return v ^ v >> 33


def hashed(raw):
    return mix64(sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 2**64) for k, b in enumerate(raw)) + len(raw))


def plain_features(text, log2):
    raw = text.encode().split()
    if not raw:
        return []
    h = [hashed(w.lower()) for w in raw]
    kind = lambda b: 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b >= 128 else 3 if 48 <= b <= 57 else b
    s = [hashed(bytes(k for k, _ in groupby(map(kind, w)))) for w in raw]
    s = [x ^ 0x5851F42D4C957F2D if i and h[i] == h[i - 1] else x for i, x in enumerate(s)]
    out = {mix64(x + 1) for x in h} | {mix64(a * 3 + b + 2) for a, b in zip(h, h[1:])}
    for x, n in Counter(x >> 20 << 20 for x in s).items():
        out |= {mix64(x + 4), mix64(x * 5 + int(max(math.log2(n / len(raw)), -9)))}
    out |= {mix64(a * 7 + b + 6) for a, b in zip(s, s[1:])} | {mix64((a * 7 + b) * 7 + c + 8) for a, b, c in zip(s, s[1:], s[2:])}
    return sorted({x >> 64 - log2 for x in out})


def test_features_and_margins_as_a_plain_version(spark, folder):
    rng = random.Random(2)
    parts = ["Word", "word", "A1b2", "--!!--", "x", "\n", " ", "É", "日本語", "9999", "Aa", "\t", "UPPER", "a.b.c", "z" * 300]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 3, 10, 60]))) for _ in range(200)] + ["", " ", "one"]
    features = Features(18)
    found, bounds = features(pa.array(texts).slice(7))
    for k, t in enumerate(texts[7:]):
        assert found[bounds[k] : bounds[k + 1]].tolist() == plain_features(t, 18), repr(t)
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = fit(docs, labels, sample_rows=100)
    for r in score(docs.where("doc_id % 20 = 0 or text is null"), model, score_col="s").collect():
        f = plain_features(r["text"] or "", 18)
        margin = sum(float(model.weights[x]) for x in f) / max(len(f), 1) ** 0.5 + model.bias
        assert math.isclose(r["s"], 1 / (1 + math.exp(-min(max(model.slope * margin + model.offset, -30), 30))), rel_tol=1e-4, abs_tol=1e-9)


def test_descent_reaches_the_optimum():
    """The hinge-loss optimum: a dual value that equals the primal one proves both."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    y = np.array([1.0 if (r < 12).sum() + rng.random() > 4 else -1.0 for r in rows])
    ratio = rng.normal(size=30).astype(np.float32)
    w, bias = descend(rows, y, ratio, 1.0, 3000, 1)
    x = np.zeros((60, 31))
    for k, r in enumerate(rows):
        x[k, r], x[k, 30] = ratio[r] / len(r) ** 0.5, 1
    full = np.r_[w, bias]
    primal = full @ full / 2 + np.maximum(0, 1 - y * (x @ full)).sum()
    best = min((v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum()) for v in full + rng.normal(scale=0.02, size=(3000, 31)))
    alpha = np.linalg.lstsq((y[:, None] * x).T, full, rcond=None)[0]
    assert primal <= best + 1e-3 and np.allclose((y[:, None] * x).T @ alpha, full, atol=1e-3)


def test_sample_is_bounded_and_one_row_an_id(spark):
    labels = spark.range(5000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    assert sample(labels, "doc_id", "quality", 300, 7).count() == 300
    assert sample(labels, "doc_id", "quality", 9000, 7).count() == 5000
    docs = spark.createDataFrame([(1, f"copy {k}") for k in range(500)] + [(2, "other")], "doc_id long, text string")
    some = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    assert fit(docs, some).weights.any()


def test_clashing_name_and_very_long_text(spark):
    docs = spark.createDataFrame([(1, "x " * 1_000_000, 0.0), (2, "y" * 2_000_000, 0.0), (3, None, 0.0)], "doc_id long, text string, Score double")
    model = fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    with pytest.raises(ValueError):
        score(docs, model)
    assert score(docs, model, score_col="s").count() == 3
