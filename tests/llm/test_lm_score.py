"""LM scoring: base scores by counting, scores and gradients against plain loops, probabilities that sum to 1, gain on held-out text."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import sievelight.llm.lm_score as m
from sievelight.llm.lm_score import score_texts


def tokens(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            if word:
                out.append("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in word))
            word = ""
        else:
            word += c
    return [*out, None]


def corpus(seed, n):
    """Two languages of words with fixed successors, so that the history tells much."""
    rng = random.Random(seed)
    rows = [(-1, None), (-2, ""), (-3, "Unseen ONLY here")]
    for i in range(n):
        language, word, out = rng.choice("ab"), 0, []
        for _ in range(rng.choice([5, 30, 80])):
            word = (word * 3 + rng.choice([1, 1, 1, 5])) % 40
            out.append(f"{language}{word}" if rng.random() < 0.9 else f"É{rng.randrange(5000)}")
        rows.append((i, " ".join(out)))
    return rows


@pytest.mark.parametrize("known", [1 << 19, 20])
def test_scores(spark, monkeypatch, known):
    monkeypatch.setattr(m, "KNOWN", known)
    rows = corpus(1, 300)
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n long").repartition(3)
    seen = [t for i, t in rows if i >= 0 and i % 4]
    out, model = score_texts(df, df.where("doc_id >= 0 and doc_id % 4 <> 0"))
    got = {r["id"]: r for r in out.collect()}
    c = Counter(w for t in seen for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.vocabulary) == (n, v)
    gain = 0.0
    for i, t in rows:
        w, r = tokens(t), got[i]
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(c[x] > 0 for x in w))
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r["score"] < 0
        gain += (r["score"] - r["base_score"]) * (i >= 0 and i % 4 == 0)
    if known > 20:
        assert gain > 100


def mix64(v):
    v = ((v ^ v >> 33) * 0xFF51AFD7ED558CCD) % 2**64
    v = ((v ^ v >> 33) * 0xC4CEB9FE1A85EC53) % 2**64
    return v ^ v >> 33


def hashed(word):
    if word is None:
        return m.END_HASH
    raw = word.encode()
    return mix64((sum((b + 1) * pow(m.BASE, k, 2**64) for k, b in enumerate(raw)) + len(raw)) % 2**64)


def plain_steps(model, text):
    """For each token its word and, for each softmax on its way, the rows, branch and probabilities."""
    place = {int(h): k for k, h in enumerate(model.hashes)}
    rows_log2 = len(model.weights).bit_length() - 1
    none = len(model.hashes) + 1024
    quantised = model.weights / m.STEPS
    before = [none, none]
    for word in tokens(text):
        k = place.get(hashed(word), -1)
        leaf = model.rare if k < 0 else int(model.leaf[k])
        features = [mix64(before[0] + (1 << 20)), mix64(before[1] + (2 << 20)), mix64(before[0] * (1 << 21) + before[1] + (1 << 44))]
        way = []
        for at in range(model.way[leaf], model.way[leaf + 1]):
            node, branch = int(model.nodes[at]), int(model.branches[at])
            salt = mix64((node + 1) * m.BASE % 2**64)
            rows = [((f ^ salt) * m.BASE % 2**64) >> 64 - rows_log2 for f in features]
            z = np.exp(model.bias[node] + sum(quantised[r] for r in rows))
            way.append((rows, branch, z / z.sum()))
        yield word, k, leaf, way
        if word is not None:
            raw = b"\x00" + word.encode()
            sign = k if k >= 0 else none - 1024 + (raw[-1] * 256 + raw[-2]) * 40503 % 65536 // 64
            before = [sign, before[0]]


@pytest.mark.parametrize("known", [1 << 19, 30])
def test_scores_and_gradient_against_plain_loops(spark, monkeypatch, known):
    monkeypatch.setattr(m, "KNOWN", known)
    rows = corpus(4, 40) + [(99, "long " * 3000 + "a1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out, model = score_texts(df, df.where("doc_id % 3 <> 0"))
    assert np.abs(model.weights).max() > 2
    c = Counter(w for i, t in rows if i % 3 for w in tokens(t))
    for r in out.collect():
        want = 0.0
        for word, k, leaf, way in plain_steps(model, dict(rows)[r["id"]]):
            want += sum(math.log10(p[b]) for _, b, p in way)
            if leaf == model.rare:
                want += math.log10((c[word] + 1) / model.rare_total)
        assert math.isclose(r["score"], want, rel_tol=1e-4, abs_tol=1e-3)
    gradient, t = m.Gradient(model), m.Tokens(model)
    some = [x or "" for _, x in rows[:20]]
    t(pa.array(some))
    gradient.add(t)
    gradient.settle()
    observed, expected = np.zeros(model.weights.shape), np.zeros(model.weights.shape)
    for text in some:
        for _, _, _, way in plain_steps(model, text):
            for at, b, p in way:
                for r in at:
                    observed[r, b] += 1
                    expected[r] += p
    assert (gradient.observed == observed.ravel()).all()
    assert np.allclose(gradient.expected / m.UNIT, expected.ravel(), atol=2e-2)


def test_probabilities_sum_to_one(spark):
    rows = corpus(2, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, model = score_texts(df, df.where("doc_id % 2 = 0"))
    words = sorted({w for i, t in rows if i % 2 == 0 for w in tokens(t) if w})
    t = m.Tokens(model)
    for before in ("a1 b2", "", "nie gesehen"):
        t(pa.array([f"{before} {w}" for w in words] + [before, f"{before} unseen1"]))  # every word, the end, the rest
        last = np.r_[np.flatnonzero(t.text[1:] != t.text[:-1]) - 1, len(t.text) - 2]
        last[-2] += 1
        p = np.zeros(len(t.text))
        for of, branch, _, z, total in t.batches():
            np.add.at(p, of, np.log(z[np.arange(len(of)), branch] / total))
        assert len(model.counts) == len(words) + 1 and t.leaf[last[-1]] == model.rare
        assert math.isclose(np.exp(p[last]).sum(), 1, rel_tol=1e-3)
    assert math.isclose(model.rare_total, 1)


def test_number_of_tasks_changes_nothing(spark):
    rows = corpus(5, 200)
    scores = []
    for parts in (1, 3, 8):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        out, _ = score_texts(df, df)
        scores.append({r["id"]: r["score"] for r in out.collect()})
    assert scores[0] == scores[1] == scores[2]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 15, 64, 1000])
def test_tree_is_a_prefix_code(n):
    mass = np.sort(np.random.default_rng(n).pareto(1.0, n) + 1e-3)[::-1]
    way, nodes, branches, bias = m.tree(mass, 8)
    ways = [tuple(zip(nodes[way[k] : way[k + 1]].tolist(), branches[way[k] : way[k + 1]].tolist())) for k in range(n)]
    assert len(set(ways)) == n
    share = np.array([math.exp(sum(bias[a, b] for a, b in w)) for w in ways])
    assert np.allclose(share, mass / mass.sum(), rtol=1e-3)
    assert all(w[0][0] == len(bias) - 1 for w in ways if w) and not any(a != b and b[: len(a)] == a for a in ways[:20] for b in ways)


def test_nothing_to_learn_from_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    out, model = score_texts(df, df.where("false"))
    assert model.tokens == 0 and sorted(r["n_tokens"] for r in out.collect()) == [1, 3, 3]
    out, model = score_texts(df, df)
    assert model.tokens == 7 and all(r["n_known"] == r["n_tokens"] for r in out.collect())
    empty = df.where("false")
    assert score_texts(empty, empty)[0].count() == 0


def test_history_decides_among_rare_words(spark):
    """Words at the far end of the tree depend on the word before, too."""
    rng = random.Random(3)
    rows = [(-1, " ".join(f"h{k}" for k in range(1000)) + " " + "h1 " * 20_000)]
    for i in range(300):
        at = rng.randrange(100)
        rows.append((i, " ".join(f"t{(at + k) % 100}" for k in range(8))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, model = score_texts(df, df)
    t, likely = m.Tokens(model), 0
    for before in range(100):
        t(pa.array([f"t{(before + 99) % 100} t{before} t{(before + 1) % 100}", f"t{(before + 49) % 100} t{(before + 50) % 100} t{(before + 1) % 100}"]))
        p = np.zeros(len(t.text))
        for of, branch, _, z, total in t.batches():
            np.add.at(p, of, np.log(z[np.arange(len(of)), branch] / total))
        likely += p[2] > p[6] + 1
    assert likely > 80


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 400_000), (2, "x" * 3_000_000), (3, "word")], "doc_id long, text string")
    got = {r["id"]: r for r in score_texts(df, df)[0].collect()}
    assert [got[k]["n_tokens"] for k in (1, 2, 3)] == [400_001, 2, 2]
