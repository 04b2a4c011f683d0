"""Mixing against plain Python: water-filled targets, key order, cuts."""

import hashlib
import math
import random

import pytest

import sievelight.llm.mixing as m
from sievelight.llm.mixing import mix, mixing_stage, taken

DOCS = "doc_id long, text string, source string, n_chars long, key double, size string, times int"


def size(text):
    return len([w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w])


def brute(rows):
    """{(id, source): (source_size, target, times)}."""
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s] + 1e-9]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
            open_.remove(s)
    out = {}
    for s in sources:
        epochs = min(int(target[s] / sizes[s] + 1e-12), 3) if sizes[s] else 0
        rest = target[s] - epochs * sizes[s]
        keyed = []
        for i, t, src, *_ in rows:
            if src == s and size(t):
                u = (int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                solid = "".join(c for c in t if c not in " \t\n\v\f\r")
                keyed.append((-math.log(u) / max(sum(c.isalnum() for c in solid) / len(solid), 0.05), i, size(t)))
        keyed.sort()
        total, chosen = 0, set()
        for _, i, n in keyed:
            if total + n > rest:
                break
            total += n
            chosen.add(i)
        gap = rest - total
        more = [(abs(n - gap), k, i) for k, i, n in keyed if i not in chosen and abs(n - gap) < gap]
        if more:
            chosen.add(min(more)[2])
        for i, t, src, *_ in rows:
            if src == s:
                out[i] = (sizes[s], target[s], (epochs + (i in chosen)) if size(t) else 0)
    return out


def corpus(seed, n=300):
    rng = random.Random(seed)
    names = ["a", "b", "B", "é", "z", None]
    rows = [(i, " ".join(rng.choice(["word", "x#", "é", "***"]) for _ in range(rng.choice([0, 1, 5, 40, 300 if i % 40 == 0 else 9]))), rng.choice(names[:1] * 6 + names)) for i in range(n)]
    return [*rows, (1000, None, "a"), (1001, "", "only empty"), (1002, " \n", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, monkeypatch, seed):
    monkeypatch.setattr(m, "ROWS_A_RANGE", 2)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, 2.0, "s", 4) for r in rows], DOCS).repartition(3)
    got = {r["id"]: (r["source_size"], r["target"], r["times"]) for r in taken(*mix(df)).collect()}
    want = brute(rows)
    assert {i: (a, c) for i, (a, _, c) in got.items()} == {i: (a, c) for i, (a, _, c) in want.items()}
    assert all(math.isclose(got[i][1], want[i][1], rel_tol=1e-9, abs_tol=1e-9) for i in want)


def test_stage_repeats_rows(spark):
    rows = corpus(3, 120)
    df = spark.createDataFrame([(*r, 1, 2.0, "s", 4) for r in rows], DOCS)
    out = mixing_stage(spark, df, "")
    assert out.columns == df.columns
    times = {i: c for i, (_, _, c) in brute(rows).items()}
    got = [r["doc_id"] for r in out.collect()]
    assert sorted(got) == sorted(i for i, c in times.items() for _ in range(c))


def test_repeated_and_null_ids_and_empty(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "x", "t"), (None, "x", "t"), (2, "y z", "t")]
    got = taken(*mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    assert len(got) == 5 and len({r["times"] for r in got if r["id"] == 1}) == 1
    assert taken(*mix(spark.createDataFrame([], "doc_id long, text string, source string"))).count() == 0


def test_few_slots_at_a_time(spark, monkeypatch):
    for name, value in (("SLOTS", 3), ("ROWS_A_RANGE", 2)):
        monkeypatch.setattr(m, name, value)
    rows = corpus(5)
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert {r["id"]: r["times"] for r in taken(*mix(df)).collect()} == {i: c for i, (_, _, c) in want.items()}


def test_very_long_text(spark):
    rows = [(1, "w " * 500_000, "a"), (2, "x" * 2_000_000, "a"), (3, "w w", "b")]
    got = {r["id"]: r["size"] for r in taken(*mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert got == {1: 500_000, 2: 1, 3: 2}
