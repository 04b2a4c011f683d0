"""Near-duplicates against brute force over all pairs."""

import random

import pytest

from sievelight.llm.minhash import minhash_stage, near_duplicates

SPACE = " \t\n\v\f\r"


def word_list(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            if word:
                out.append("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in word))
            word = ""
        else:
            word += c
    return out


def brute(rows):
    """(id, n, component, kept) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = word_list(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                up[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{k}é" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(-5, None), (-4, ""), (-3, " \n\t"), (-2, "One two"), (-1, "one  TWO"), (0, "one")]
    for base in range(25):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 40, 200]))]
        if base % 3 == 0:
            text = text[:20] + passage + text[20:]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3, " ".join(copy)))
    rows += [(1000 + k, "a b c d e f g h i j k l m n o p q r s " + f"t{k // 2}") for k in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, key int")
    assert sorted(map(tuple, near_duplicates(df).collect())) == brute(rows)


@pytest.mark.parametrize("full", [2, 6])
def test_full_buckets_are_divided(spark, monkeypatch, full):
    import sievelight.llm.minhash as m

    monkeypatch.setattr(m, "FULL_BUCKET", full)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df).collect())) == brute(rows)


def chains(seed, n):
    """A chain of texts, each near the next and the far ones not, and others that share its bands by a common passage."""
    rng = random.Random(seed)
    words, rows = [f"w{k}" for k in range(3000)], []
    text = [rng.choice(words) for _ in range(120)]
    for k in range(n):
        at = rng.randrange(len(text) - 4)
        text = [*text[:at], *(rng.choice(words) for _ in range(3)), *text[at + 3 :]]
        rows.append((k, " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("full", [3, 2_000])
def test_recall_on_a_large_group_of_near_copies(spark, monkeypatch, full):
    import sievelight.llm.minhash as m

    monkeypatch.setattr(m, "FULL_BUCKET", full)
    rows = chains(4, 150)
    assert sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_repeated_and_null_ids_and_long_text(spark):
    long = " ".join(f"w{i % 977}-{i}" for i in range(60_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j k l m"), (2, "g h i j k l m"), (None, "a b c d e f"), (3, long), (4, long + " x"), (None, "only null ids here"), (None, "only null ids here"), (None, None)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert [r for r in got if r[0] == 2] == [(2, 3, 1, False)]
    assert [r for r in got if r[0] == 1] == [(1, 2, 1, False), (1, 2, 1, True), (1, 3, 1, True)]
    assert [r for r in got if r[0] is None] == [(None, 0, None, True), (None, 1, None, False), (None, 1, None, True), (None, 2, 1, False)]
    assert [r[2] for r in got if r[0] in (3, 4)] == [3, 3]


def test_stage_keeps_one_row_of_each_group(spark):
    rows = [(1, "a b c d e f", 0), (1, "a b c d e f", 1), (1, "g h i j k l m", 2), (None, "A b c d e f", 3), (None, "x y z", 4), (7, None, 5), (7, None, 6), (None, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key int")
    out = minhash_stage(spark, df, "")
    assert out.columns == df.columns
    texts = sorted(((r["text"] or "").lower() for r in out.collect()))
    assert texts == ["", "", "", "a b c d e f", "g h i j k l m", "x y z"]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
