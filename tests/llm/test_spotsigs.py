"""SpotSigs fingerprints, row order and pairs against plain Python."""

import hashlib
import random

import numpy as np

from sievelight.llm.spotsigs import ANCHORS, Spotter, compared, edited, likeness, near_duplicates, set_of


def plain(text, chain=3):
    words = [w.strip(".,;:!?\"'()[]{}<>*#$%&|-_") for w in text.lower().split()]
    content = [w for w in words if w not in ANCHORS]
    if not content:
        return {tuple(words)} if words else set()
    out = set()
    for i, w in enumerate(words):
        if w in ANCHORS:
            rest = [v for v in words[i + 1 :] if v not in ANCHORS][:chain]
            if len(rest) == chain:
                out.add((w, *rest))
    return out or {(w,) for w in content}


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(60)] + ["the", "of", "la", "und"] * 6
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 60, 150]))]
        for _ in range(rng.choice([1, 1, 3])):
            copy = list(base)
            if copy and rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = "changed."
            out.append(" ".join(copy))
    return out


def test_signatures():
    spot = Spotter()
    for t in texts(1, 60):
        assert len(spot(t)) == len(plain(t))
    a, b = "the one two three of four five six la", "the one two three of four five seven la"
    assert likeness(spot(a), spot(b)) == len(plain(a) & plain(b)) / len(plain(a) | plain(b))
    assert likeness(spot(""), spot("  ")) == 1 and likeness(spot(""), spot("x")) == 0


def test_rows_and_their_next(spark):
    rng = random.Random(2)
    all_ = texts(3, 50)
    ids = rng.sample(range(-200, 400), len(all_))
    rows = list(zip(ids, all_)) + [(1000, None), (1001, "é" * 7), (1002, "𝒳yz the end of it")]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in compared(spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, range int").repartition(7), range_rows=9).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        after, r = order[(k + 1) % len(order)][1], got[i]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        assert new == edited(t, after)
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        x, y, z = plain(t), plain(new), plain(after)
        assert len(set_of(r["fingerprint"])) == len(x) and len(set_of(r["edited_fingerprint"])) == len(y)
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r["near_edited"] - like(x, y)) < 1e-9 and abs(r["near_next"] - like(x, z)) < 1e-9


def test_one_row_repeated_rows_and_null_ids(spark):
    one = compared(spark.createDataFrame([(1, "the a b c")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    rows = [(1, "x y"), (1, "x y"), (None, "z"), (None, "z"), (2, "w")]
    assert sorted(str(r["doc_id"]) for r in compared(spark.createDataFrame(rows, "doc_id long, text string"), range_rows=1).collect()) == ["1", "1", "2", "None", "None"]
    assert compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def earlier(rows):
    """Rows that an earlier one is near to, in the order of ids (null last) and texts' md5."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, hashlib.md5((r[1] or "").encode()).hexdigest()))
    sets = [plain(t or "") for _, t in order]
    return [(i, t, any(a and b and 100 * len(a & b) >= 75 * len(a | b) for b in sets[:k])) for k, ((i, t), a) in enumerate(zip(order, sets))]


def test_near_an_earlier_row(spark):
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts(5, 60))]
    want = {i for i, _, near in earlier(rows) if near}
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id").collect()
    assert {r["row"] for r in got} == want and 5 < len(want) < 100
    out = compared(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), range_rows=7).collect()
    assert {r["doc_id"] for r in out if r["near_earlier"]} == want


def test_near_with_repeated_and_null_ids(spark):
    same, other = "the one two three of four five six la seven eight nine", "a short text"
    rows = [(1, same), (1, same + "."), (1, other), (None, same), (None, None), (None, None), (2, ""), (3, other), (None, "something of its own")]
    out = compared(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), range_rows=2).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["near_earlier"]) for r in out) == sorted((str(i), len(t or ""), near) for i, t, near in earlier(rows))


def test_many_copies_and_long_texts(spark):
    rows = [(k, "the same words of this text and nothing else in it") for k in range(300)] + [(400, "the word of it " * 30_000), (401, "x" * 1_000_000)]
    out = compared(spark.createDataFrame(rows, "doc_id long, text string"), range_rows=50).collect()
    assert {r["doc_id"] for r in out if not r["near_earlier"]} == {0, 400, 401}
