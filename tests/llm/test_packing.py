"""Packing: every token placed once, permitted lengths, ids as the library gives them, best fit against the optimum."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sievelight.llm import packing
from sievelight.llm.packing import best_fit, costs, pack, packed

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_50k.json")


def plain():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(VOCABULARY)
    return lambda text: [*model.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, sequences, lengths):
    """All pieces of all rows, with the right ids, in sequences of the least permitted length that holds them."""
    encode, pieces = plain(), Counter()
    for s in sequences:
        assert s["filled"] == sum(s["counts"]) == len(s["input_ids"]) <= s["capacity"] == min(x for x in lengths if x >= s["filled"])
        at = 0
        for i, start, n in zip(s["doc_ids"], s["starts"], s["counts"]):
            pieces[i, start, tuple(s["input_ids"][at : at + n])] += 1
            at += n
    want = Counter()
    for i, text in rows:
        ids = encode(text)
        for a in range(0, len(ids), max(lengths)):
            want[i, a, tuple(ids[a : a + max(lengths)])] += 1
    assert pieces == want
    assert len({s["sequence"] for s in sequences}) == len(sequences)


def test_whole_documents(spark):
    rng, lengths = random.Random(1), (8, 16, 64)
    rows = [(i, "w " * rng.choice([0, 1, 3, 7, 15, 30, 63, 64, 500])) for i in range(300)] + [(7, "again x"), (7, "again x"), (None, None), (None, "null id"), (2**62 + 1, "large id"), (-(2**63), "least id"), (5000, "long " * 30_000)]
    df = spark.createDataFrame([(t, i, 1, "x") for i, t in rows], "text string, doc_id long, sequence int, ids string").repartition(4)
    out = pack(df, VOCABULARY, lengths, group_rows=60).collect()
    check(rows, out, lengths)
    again = pack(df.repartition(2), VOCABULARY, lengths, group_rows=60).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    assert pack(df.where("false"), VOCABULARY).count() == 0


def test_copies_are_dealt_out(spark):
    rows = [(None, "the same text")] * 400 + [(3, "another text")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = pack(df, VOCABULARY, (16, 64), group_rows=20).collect()
    check(rows, out, (16, 64))
    groups = Counter(s["sequence"] >> 31 for s in out for _ in s["doc_ids"])
    assert len(groups) > 20 and max(groups.values()) < 60


def test_a_group_goes_out_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "TOKENS_A_BATCH", 100, raising=False)
    rng = random.Random(4)
    rows = [[rng.randrange(1, 2**16) for _ in range(rng.randrange(1, 200))] + [0] for _ in range(300)]
    ids = pa.array([b"".join(t.to_bytes(2, "little") for t in r) for r in [[7], *rows]], pa.binary()).slice(1)
    out = list(packed(3, pa.array(range(300)), np.arange(300, dtype=np.int64), ids, "<u2", (16, 64), 0.25))
    assert len(out) > 100 and all(b.num_rows == 1 or sum(b["filled"].to_pylist()) <= 100 for b in out)
    sequences = [s for b in out for s in b.to_pylist()]
    assert [s["sequence"] for s in sequences] == [3 * 2**31 + k for k in range(len(sequences))]
    pieces = {}
    for s in sequences:
        at = 0
        for i, start, n in zip(s["doc_ids"], s["starts"], s["counts"]):
            assert (i, start) not in pieces
            pieces[i, start] = s["input_ids"][at : at + n]
            at += n
        assert at == s["filled"] == len(s["input_ids"]) <= s["capacity"]
    assert [sum((pieces[i, a] for a in range(0, len(r), 64)), []) for i, r in enumerate(rows)] == rows


def total(bins, lengths, attention):
    price = dict(zip(sorted(lengths), costs(tuple(sorted(lengths)), attention)))
    return sum(price[min(x for x in lengths if x >= b)] for b in bins)


def optimum(pieces, lengths, attention):
    """Least cost over all ways to part the pieces."""
    best = float("inf")

    def go(k, bins):
        nonlocal best
        if k == len(pieces):
            best = min(best, total(bins, lengths, attention))
            return
        for j in range(len(bins)):
            if bins[j] + pieces[k] <= max(lengths):
                go(k + 1, [*bins[:j], bins[j] + pieces[k], *bins[j + 1 :]])
        go(k + 1, [*bins, pieces[k]])

    go(0, [])
    return best


def test_near_the_optimum_of_small_inputs():
    rng, ratios = random.Random(5), []
    for lengths, attention in itertools.product([(8,), (4, 8), (4, 8, 16)], [0.0, 0.25]):
        for _ in range(12):
            pieces = sorted((rng.randrange(1, 9) for _ in range(7)), reverse=True)
            where, _, sizes = best_fit(pieces, lengths, attention)
            used = defaultdict(int)
            for w, p in zip(where, pieces):
                used[w] += p
            assert sizes == [min(x for x in lengths if x >= used[k]) for k in range(len(sizes))]
            ratios.append(total(used.values(), lengths, attention) / optimum(pieces, lengths, attention))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) <= 1.5 and sum(ratios) / len(ratios) < 1.06


def test_best_fit_takes_the_least_room():
    where, offset, sizes = best_fit([10, 6, 4, 2], (10, 12))
    assert where[0] != where[1] and sizes[where[0]] in (10, 12)
    where, offset, sizes = best_fit([7, 5, 3, 2, 1], (10,), 0.0)
    assert (where[2], where[4]) == (where[0], where[1]) or sum(sizes) == 20
    rng = random.Random(2)
    pieces = sorted((rng.randrange(1, 513) for _ in range(3000)), reverse=True)
    _, _, sizes = best_fit(pieces, (512, 1024, 2048))
    assert sum(pieces) / sum(sizes) > 0.99
