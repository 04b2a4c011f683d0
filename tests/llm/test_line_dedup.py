"""Line dedup against comparing all pairs of lines."""

import hashlib
import random

import numpy as np
import pytest

import sievelight.llm.line_dedup as m
from sievelight.llm.line_dedup import dedup_lines, line_dedup_stage, op10_line_dedup, removals

SPACE = " \t\v\f\r"


def line_set(line):
    out, word = set(), ""
    for c in line + " ":
        if c in SPACE:
            if word:
                out.add("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in word))
            word = ""
        else:
            word += c
    return out


def brute(rows):
    """(id, text, removed lines) of each row, in the order of ids (null last) and texts' md5."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, hashlib.md5((r[1] or "").encode()).hexdigest()))
    lines = [(d, k, s) for d, (_, t) in enumerate(order) if t is not None for k, x in enumerate(t.split("\n")) if (s := line_set(x))]
    gone = {(i, k) for i, k, s in lines if any((j, q) < (i, k) and 100 * len(s & z) >= 80 * len(s | z) for j, q, z in lines)}
    return sorted(((i, t, sorted(k for x, k in gone if x == d)) for d, (i, t) in enumerate(order)), key=repr)


def result(df):
    return sorted(((r["doc_id"], r["text"], r["removed_lines"] or []) for r in dedup_lines(df).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(80)] + ["the", "of"] * 30
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 12, 40, 250]))] for _ in range(30)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(0, 7)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2, len(line) // 6])):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            rng.shuffle(line)
            lines.append("\t ".join(line).upper() if rng.random() < 0.3 else " ".join(line))
        rows.append((d * 3 - 50, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, "alpha beta gamma delta epsilon"), (None, "zeta eta theta iota kappa"), (900, "zeta eta theta iota kappa")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, row string, line int").repartition(3)
    assert result(df) == brute(rows)


def test_unique_ids(spark):
    rows = [(i, t) for i, t in dict(corpus(5)).items() if i is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df) == brute(rows)
    assert {tuple(r) for r in removals(df).collect()} == {(i, k) for i, _, gone in brute(rows) for k in gone}


def test_blocks_limits_and_large_groups(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 7), ("PUT_FORWARD", 1), ("SEEN", 3), ("CHUNK_BYTES", 300)):
        monkeypatch.setattr(m, name, value)
    monkeypatch.setattr(m.Groups, "LARGE", 4)
    rows = corpus(3)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)) == brute(rows)


@pytest.mark.parametrize(("common", "paired", "rows"), [(1, 200, 40_000), (3, 30, 7), (10, 8, 7)])
def test_common_words_are_posted_in_pairs(spark, monkeypatch, common, paired, rows):
    for name, value in (("COMMON", common), ("PAIRED", paired), ("BLOCK_ROWS", rows)):
        monkeypatch.setattr(m, name, value)
    for docs in (corpus(6), short_corpus(7)):
        assert result(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == brute(docs)
    docs = short_corpus(8)[:40]
    for threshold in (30, 50):
        lines = [(d, k, s) for d, t in docs for k, x in enumerate(t.split("\n")) if (s := line_set(x))]
        gone = {(i, k) for i, k, s in lines if any((j, q) < (i, k) and 100 * len(s & z) >= threshold * len(s | z) for j, q, z in lines)}
        assert {tuple(r) for r in removals(spark.createDataFrame(docs, "doc_id long, text string"), threshold=threshold).collect()} == gone


def test_groups_of_a_larger_table_stay_small(spark):
    """The words of a table many times as large are as many times as frequent: prefixes must still take the rarest, and the lines
    that meet must not grow with it."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    weights = [1 / (k + 1) for k in range(3000)]
    docs = spark.createDataFrame([(d, "\n".join(" ".join(rng.choices(vocabulary, weights, k=40)) for _ in range(5))) for d in range(300)], "doc_id long, text string")
    counts = m.sketch(docs, "text", m.SKETCH_LOG2)

    def pairs(counts):
        return m.prefixes(docs, "doc_id", "text", counts, 80, 1).selectExpr("explode(keys) as k").groupBy("k").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]

    assert pairs(np.minimum(counts.astype(np.int64) * 10_000, 2**31 - 1).astype(np.int32)) <= pairs(counts)


def test_rows_without_an_id_of_their_own_lose_only_their_lines(spark):
    a, b = "alpha beta gamma delta epsilon", "another line of quite different words"
    for i in (None, 5):
        rows = [(1, a), (i, a), (i, b), (i, b), (7, b)]
        out = line_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in out.collect()) == ([(False, 1, a), (False, 7, b)] if i is None else [(False, 1, a), (False, 5, b)])
    rows = [(None, a)] * 3 + [(None, None), (None, ""), (2, "\n".join([a, b]))]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_very_long_text(spark):
    word = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, word), (2, word.upper()), (3, "\n".join(["short line of a few words"] * 20_000))]
    got = {i: gone for i, _, gone in result(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[1] == [] and got[2] == [0] and got[3] == list(range(1, 20_000))


def test_column_of_the_same_name(spark):
    with pytest.raises(ValueError):
        dedup_lines(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, Removed_Lines int"))


def test_stage(spark):
    rows = [(1, "one two three four five\nx", "s", 25), (2, "ONE two three four five", "s", 23), (3, "one two three four five\n y z", None, 28), (4, None, "s", None), (5, "", "s", 0)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, n_chars long, removed_lines int")
    out = line_dedup_stage(spark, df, "")
    assert out.columns == df.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {1: (rows[0][1], 25), 3: (" y z", 4), 4: (None, None), 5: ("", 0)}


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def short_corpus(seed):
    rng = random.Random(seed)
    words = [f"s{k}" for k in range(12)]
    return [(d, "\n".join(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 9]))) for _ in range(rng.randrange(1, 6)))) for d in range(80)]


def numbers(rows):
    return {(r["doc_id"], int(k)) for r in rows for k in r["removed_lines"].split(",") if k}


def test_query_takes_short_lines(spark, tmp_path):
    rows = short_corpus(4) + [(90, "buy now buy now buy now"), (91, "les.\nall rights reserved"), (92, "Les.\nbuy NOW\nreserved all rights")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = numbers(op10_line_dedup(spark, str(tmp_path)).collect())
    assert got == {(i, k) for i, _, gone in brute(rows) for k in gone}
    assert {(92, 0), (92, 1), (92, 2)} <= got


def test_stage_takes_short_lines(spark):
    rows = [(1, "les.\none two"), (2, "all rights\nLES."), (3, "two one")]
    got = {r["doc_id"]: r["text"] for r in line_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {1: rows[0][1], 2: "all rights"}


def test_rows_of_a_large_group_meet_in_bulk(monkeypatch):
    """Pairs are compared many at once, so that a group of many rows doesn't cost a round of calls for each row."""
    g = np.random.default_rng(3)
    size, calls = 2_000, []
    n = np.sort(g.integers(4, 120, size))
    b1, b2 = g.integers(0, 2, size) << g.integers(0, 62, size), np.full(size, 7)
    rows = {"key": np.zeros(size, np.int64), "row": g.permutation(size), "line": np.zeros(size, np.int64), "h": g.integers(0, 2**32, size), "n": n, "at": np.zeros(size, np.int64), "open": np.ones(size, bool), "b1": b1, "b2": b2}
    near = m.Groups.near
    monkeypatch.setattr(m.Groups, "near", lambda self, *a: calls.append(1) or near(self, *a))
    i, j, _, _ = m.Groups(80, 0)(rows)
    assert len(calls) < 100
    wanted = set()
    for x in range(size):
        y = np.arange(x)
        least = m.need(n[x], n[y], 80)
        ok = (100 * n[y] >= 80 * n[x]) & (n[y] >= least) & (np.bitwise_count(b1[x] ^ b1[y]) <= n[x] + n[y] - 2 * least)
        wanted |= {(x, k) if rows["row"][x] > rows["row"][k] else (k, x) for k in y[ok].tolist()}
    assert set(zip(i.tolist(), j.tolist())) == wanted
