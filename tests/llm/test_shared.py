"""Vectorised hashing of words against word-by-word splitting, row keys, intermediate tables."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import sievelight.llm.shared as shared
from sievelight.llm.shared import FlatWords, keyed, shingles, words


def texts(seed):
    rng = random.Random(seed)
    parts = ["a", "B", "É", "日本", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\xa0", "abc", "ABC", "z" * 300, "\x00"]
    return [None, "", " ", "a", "A"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(200)] + ["a", "b c"]


@pytest.mark.parametrize("block", [1, 50, 1 << 21])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_same_words_same_hashes(monkeypatch, block, kind):
    monkeypatch.setattr(shared, "BLOCK_BYTES", block)
    all_ = texts(block)
    flat = FlatWords()(pa.array(all_, kind))
    seen = {}
    for k, t in enumerate(all_):
        found = words(t)
        assert len(flat[k]) == len(found)
        for w, h in zip(found, flat[k].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    text, line = flat.lines()
    expected = [(k, i) for k, t in enumerate(all_) for i, one in enumerate((t or "").encode().split(b"\n")) for _ in one.split()]
    assert list(zip(text.tolist(), line.tolist())) == expected


def test_slices_and_empty():
    column = pa.array(["x y", None, "z", "x"]).slice(1, 3)
    flat = FlatWords()(column)
    assert [len(flat[k]) for k in range(3)] == [0, 1, 1]
    assert flat[2][0] == FlatWords()(pa.array(["q", "X"]))[1][0]
    assert len(FlatWords()(pa.array([], pa.string()))) == 0 and len(FlatWords()(pa.array([None, None], pa.string())).hashes) == 0


def test_shingles():
    h = np.arange(1, 8, dtype=np.uint64)
    assert len(shingles(h, 5)) == 3 and len(shingles(h[:3], 5)) == 1 and len(shingles(h[:0], 5)) == 0
    assert len(shingles(np.ones(9, np.uint64), 5)) == 1


def test_keyed_gives_rows_of_their_own_in_order(spark):
    unique = spark.createDataFrame([(5, "x"), (-3, "y")], "doc_id long, text string")
    out = keyed(unique, "doc_id", "text", "row")
    assert {(r["doc_id"], r["row"]) for r in out.collect()} == {(5, 5), (-3, -3)}
    rows = [(None, "b"), (2, "z"), (2, "a"), (None, "b"), (1, None), (None, None), (2, "a"), (1, "q")]
    out = keyed(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, place int").repartition(3), "doc_id", "text", "row").orderBy("row").collect()
    assert len({r["row"] for r in out}) == len(rows) and out[0].asDict().keys() == {"doc_id", "text", "place", "row"}
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, hashlib.md5((r[1] or "").encode()).hexdigest()))
    assert [(r["doc_id"], r["text"]) for r in out] == want


def test_written_cleans_its_shuffles_and_restores_the_setting(spark):
    before = spark.conf.get(shared.CLEAN, None)
    out = shared.written(spark.range(100).repartition(5, "id"))
    assert out.count() == 100 and spark.conf.get(shared.CLEAN, None) == before
    assert 0 < int(spark.conf.get(shared.BATCH)) <= shared.ROWS_A_BATCH
    shared.discard(out)
    with pytest.raises(Exception):
        out.count()
