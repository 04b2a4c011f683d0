"""Fertility rules against plain counting."""

import math
import random
from collections import Counter

import pytest

from sievelight.llm.fertility import BANDS, duplicate_lines, judged, measures, repeated_words, script_of

P = pytest.importorskip("public_tokenizers")
VOCABULARIES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
SPACE = " \t\n\v\f\r"


def split(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out


def repeated(words, width=8):
    windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    inside = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + width)}
    return len(inside)


def test_counts(spark):
    rng = random.Random(4)
    words = ["a", "bé", "c#", "日本", "d*|", "<e>", "ﬁ", " f"]
    texts = [None, "", " \n ", "x", "a\nb\na\n\n \na ", "one two " * 30]
    for _ in range(40):
        part = [rng.choice(words) for _ in range(rng.choice([3, 9, 30, 80]))]
        texts.append("".join(w + rng.choice([" ", "\n", "\t", "\n\n"]) for w in part + part[: rng.choice([0, 9, 20])]))
    df = spark.createDataFrame([(i, "en", t, 1) for i, t in enumerate(texts)], "doc_id long, lang string, text string, n_words int")
    got = {r["id"]: r for r in judged(measures(df, *VOCABULARIES)).collect()}
    for i, text in enumerate(texts):
        w, r = split(text), got[i]
        lines = [x for x in (text or "").split("\n") if split(x)]
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeated(w)
        assert r["base_failed"] == (len(w) < 20 or 100 * repeated(w) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])


def plain_fertility(text):
    """Tokens, single bytes and entropy of both vocabularies, by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    pieces, model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARIES[0]), Tokenizer.from_file(VOCABULARIES[1])
    sign = {i: t for t, i in model.get_vocab().items()}
    entropy = lambda ids: -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())
    a = [i for w in split(text) for i in pieces.encode(w)]
    b = model.encode(text, add_special_tokens=False).ids
    raw = text.encode()
    single, at = 0, 0
    for i in b:
        single += len(sign[i]) == 1 and raw[at] >= 128
        at += len(sign[i])
    return len(a), sum(pieces.is_byte(i) for i in a), entropy(a), len(b), single, entropy(b)


def plain_kept(text, lang, counts):
    words = split(text)
    if len(words) < 20 or 100 * repeated(words) > 30 * len(words):
        return False
    band = BANDS[lang if lang in ("en", "de", "fr", "es") else script_of("".join(words).encode())]
    chars = sum(map(len, words))
    for (n, single, entropy), (low, high, most, least) in zip((counts[:3], counts[3:]), band):
        if not (low <= chars / n <= high and single / n <= most and entropy / min(math.log2(n), 9) >= least):
            return False
    return True


def test_tokens_and_verdict_against_the_libraries(spark):
    rng = random.Random(8)
    words = "the committee read letter été naïve straße niño café noted asked answered 日本語 наука ☃ x1 QX9 zzzz".split()
    rows = [(i, rng.choice(["en", "fr", "xx", None]), " ".join(rng.choice(words[: rng.choice([8, 14, len(words)])]) for _ in range(rng.choice([19, 20, 40, 200])))) for i in range(60)]
    rows += [(100, "en", "long " * 100_000 + "x" * 100_000)]
    got = {r["id"]: r for r in judged(measures(spark.createDataFrame(rows, "doc_id long, lang string, text string"), *VOCABULARIES)).collect()}
    kept = 0
    for i, lang, text in rows:
        r, want = got[i], plain_fertility(text)
        assert (r["n_tokens"], r["n_byte_tokens"], r["b_tokens"], r["b_single"]) == (want[0], want[1], want[3], want[4])
        assert math.isclose(r["entropy"], want[2], abs_tol=1e-9) and math.isclose(r["b_entropy"], want[5], abs_tol=1e-9)
        if i < 100:
            assert r["kept"] == plain_kept(text, lang, want), text
            kept += r["kept"]
    assert 0 < kept < 60


def test_bands(spark):
    english = "The committee read every letter, noted what each writer asked for and answered the oldest question first because people had waited long enough already."
    noise = " ".join("qxzjvkwqxzjvkw"[i % 7 :] + "ъʘ☃"[i % 3] for i in range(40))
    rows = [(1, "en", english), (2, "en", "☃❄⚡☂✈✇✂✆✉ " * 3 + noise), (3, None, " ".join(f"a{'b' * (i % 2)}" for i in range(60))), (4, "xx", english)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r["id"]: r for r in judged(measures(df, *VOCABULARIES)).collect()}
    assert got[1]["kept"] and not got[2]["kept"] and got[4]["kept"]
    assert got[2]["byte_share"] > 0.1 and got[2]["b_byte_share"] > 0.1 and not got[3]["kept"]
    assert [got[k]["band"] for k in (1, 2, 3, 4)] == ["en", "en", "latin", "latin"]
    assert judged(measures(df.drop("lang"), *VOCABULARIES)).where("id = 1").first()["band"] == "latin"


def test_helpers():
    assert script_of("наука и жизнь".encode()) == "cyrillic" and script_of(b"123") == "other" and script_of(b"abc") == "latin"
    assert duplicate_lines(b"a\n\na\nb\na") == 2
    assert repeated_words([b"w"] * 9) == 9 and repeated_words([b"w"] * 8) == 0


def test_empty(spark):
    assert measures(spark.createDataFrame([], "doc_id long, lang string, text string"), *VOCABULARIES).count() == 0
