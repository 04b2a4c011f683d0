"""Shards: exact round trips, lookups and damage."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs

from sievelight.llm import tokens
from sievelight.llm.sstable import Reader, Writer, lookup, probes, read, write

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_50k.json")


def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kept", [20, 500_000])
def test_encoder_equals_whole_texts(monkeypatch, kept):
    monkeypatch.setattr(tokens, "REMEMBERED", kept)
    rng, encode, reference = random.Random(3), tokens.Encoder(VOCABULARY), plain()
    assert encode.apart
    parts = ["a", "B", "'s", "'", " ", " ", "  ", "\n", "\t", "é", "à", "日本", "1", "!", "?!", "don't", "<|endoftext|>", "\r\n", "ﬁ", "🙂", "　", "\xa0", "\x85", "\x1c", "\u2009", "。", "x y", " 's", "long" * 20]
    for _ in range(3000):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(rng.randrange(1, 4))]
        flat, bounds = encode(pa.array(texts).slice(len(texts) // 3))
        for k, text in enumerate(texts[len(texts) // 3 :]):
            assert flat[bounds[k] : bounds[k + 1]].tolist() == reference(text), repr(text)


def test_calls_of_the_library_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CALL", 1_000, raising=False)
    monkeypatch.setattr(tokens, "AT_ONCE", 7, raising=False)
    rng, encode = random.Random(6), tokens.Encoder(VOCABULARY)
    texts = [" ".join(str(rng.randrange(10**9)) for _ in range(60)) + rng.choice(["", " ", "\n"]) for _ in range(40)]
    calls, model = [], encode.model

    class Counted:
        def encode_batch_fast(self, some, **kind):
            calls.append(sum(map(len, some)) - len(some[-1]))
            return model.encode_batch_fast(some, **kind)

    encode.model = Counted()
    flat, bounds = encode(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [model.encode(t, add_special_tokens=False).ids for t in texts]
    flat, counts = encode.whole(texts)
    assert flat.tolist() == [i for t in texts for i in model.encode(t, add_special_tokens=False).ids] and len(counts) == 40
    assert len(calls) > 40 and max(calls) < 1_000


def test_special_token_is_one_as_the_library_does():
    flat, bounds = tokens.Encoder(VOCABULARY)(pa.array(["a <|endoftext|> b", "", "plain"]))
    assert flat[: bounds[1]].tolist() == [64, 220, 50256, 275] == plain()("a <|endoftext|> b") and bounds[1] == bounds[2]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_vocabularies_are_encoded_whole(name):
    from tokenizers import Tokenizer

    encode, model, texts = tokens.Encoder(P.path(name)), Tokenizer.from_file(P.path(name)), ["Hello  World\n", "", "é x"]
    flat, bounds = encode(pa.array(texts))
    assert not encode.apart and [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [model.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("width", [2, 4])
def test_file(tmp_path, width):
    rng = random.Random(5)
    rows = sorted({rng.randrange(-(10**12), 10**12) for _ in range(3000)})
    rows = [(None, 3)] + [(k, rng.choice([1, 5, 300, 20_000 if k % 50 == 0 else 2])) for k in rows]
    rows += [(rows[-1][0], 7)] * 3
    data = [(k, np.arange(n, dtype=f"<u{width}")) for k, n in rows]
    path = str(tmp_path / "a.sst")
    with fs.LocalFileSystem().open_output_stream(path) as out:
        w = Writer(out, width)
        for k, ids in data:
            w.add(k, ids.tobytes())
        w.close()
    with fs.LocalFileSystem().open_input_file(path) as source:
        r = Reader(source)
        assert [(k, len(i) // width) for k, i in r.rows()] == rows
        assert r.docs == len(rows) and r.ids == sum(n for _, n in rows) and len(r.blocks) > 3
        for k, ids in rng.sample(data[:-4], 50):
            assert [x.tolist() for x in r.get(k)] == [ids.tolist()]
        assert len(r.get(rows[-1][0])) == 4 and r.get(10**15) == []
        assert sum(bool(all(r.bloom[p >> 3] >> (p & 7) & 1 for p in probes(b"no%d" % i, len(r.bloom) * 8))) for i in range(2000)) < 60
    raw = bytearray(open(path, "rb").read())
    raw[10] ^= 255
    open(path, "wb").write(raw)
    with fs.LocalFileSystem().open_input_file(path) as source, pytest.raises(ValueError):
        list(Reader(source).rows())


def test_order_of_keys_is_enforced(tmp_path):
    with fs.LocalFileSystem().open_output_stream(str(tmp_path / "b")) as out:
        w = Writer(out, 2)
        w.add(5, b"")
        with pytest.raises(ValueError):
            w.add(4, b"")


def test_write_and_read(spark, tmp_path):
    rng = random.Random(6)
    texts = [(i * 7 - 50, rng.choice([None, "", "Hello world", "one two\nthree " * rng.randrange(1, 50)])) for i in range(60)]
    texts += [(3000, "x " * 50_000), (None, "no id"), (13, "again"), (None, "a <|endoftext|> b")] + [(77, "same")] * 50
    df = spark.createDataFrame([(t, i, 1) for i, t in texts], "text string, doc_id long, start int").repartition(5)
    shards = write(df, str(tmp_path / "s"), VOCABULARY, shard_rows=20).cache()
    got = read(spark, str(tmp_path / "s"), shards).collect()
    encode, start = plain(), 0
    assert len(got) == len(texts) and len({r["path"] for r in shards.collect()}) > 1
    by = {}
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
        by.setdefault(r["id"], []).append((r["n_tokens"], r["ids_crc32"]))
    order = [(-(2**63) if r["id"] is None else r["id"]) for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)
    for i in {i for i, _ in texts}:
        ids = [np.array(encode(t) + [0], "<u4") for k, t in texts if k == i]
        assert sorted(by[i]) == sorted((len(x), zlib.crc32(x.tobytes())) for x in ids)
    paths = [r["path"] for r in shards.collect()]
    assert sum(len(x) for p in paths for x in lookup(str(tmp_path / "s"), p, 3000)) == len(encode("x " * 50_000)) + 1
    shards.unpersist()


def test_empty(spark, tmp_path):
    shards = write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), VOCABULARY)
    assert read(spark, str(tmp_path / "e"), shards).count() == 0
