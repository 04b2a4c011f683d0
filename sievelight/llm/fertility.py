"""Quality rules from tokeniser fertility.

Public vocabularies show whether a text looks like language. Two are asked, one of pieces with byte fallback and one of bytes: each
gives characters per token, the share of tokens that fall back to single bytes (of the byte vocabulary: tokens that are one byte of
a longer character), and the entropy of the tokens. All are held against rejection bands of that vocabulary for the text's language
where a band names it, or else for its script (most frequent among its letters). Texts of few words are not judged by these bands.

Words are segmented one by one with the piece vocabulary (its pieces never cross a space), and a worker remembers the segments
of frequent words; that changes nothing in the result.

Beside the method, plain rules count words, symbols, repeated lines and words in repeated 8-word windows of whole texts.

Defined cases: null texts count as without words, so they fail the base rules and are not kept. A table without the language column,
and null or unknown languages, are judged by script. Rows with equal ids are judged one by one; null ids and other columns don't
matter.
"""

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import FlatTexts, FlatWords, chunks, map_batches, mix, table
from .tokens import Memory, encoder, gathered

#: Fixed values of the base rules.
LEAST_WORDS, WINDOW, MOST_REPEATED, SYMBOLS = 20, 8, 30, "[#*$%&|<>]"
SYMBOL_SET = b"#*$%&|<>"
#: Bytes of a code point after its first.
CONTINUATION = bytes(range(0x80, 0xC0))
NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
#: Words below which the bands don't apply.
LEAST_JUDGED = 20
#: Bytes taken at once, which bounds a worker's memory; a longer text is taken whole.
CHUNK_BYTES = 4 << 20
SPACE = b" \t\n\v\f\r"
#: Scripts by the code points of their letters, first and last.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)],
    "greek": [(0x370, 0x3FF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF)],
    "devanagari": [(0x900, 0x97F)],
    "han": [(0x3400, 0x9FFF)],
    "kana": [(0x3040, 0x30FF)],
    "hangul": [(0xAC00, 0xD7AF)],
}
#: Bands by language or script, for the piece and the byte vocabulary: least and most characters per token, most byte-fallback share,
#: least entropy in bits relative to the entropy of as many equally frequent tokens. Those of languages leave a margin around all
#: texts of sf0.1 that are labelled good (per language, characters per token 1.65 to 2.5, evenness from 0.68, single bytes to 0.09).
BANDS = {
    "en": ((1.6, 6.0, 0.05, 0.67), (1.7, 6.0, 0.12, 0.67)),
    "de": ((1.7, 6.0, 0.05, 0.67), (1.65, 6.0, 0.12, 0.67)),
    "fr": ((1.5, 6.0, 0.05, 0.66), (1.5, 6.0, 0.13, 0.66)),
    "es": ((1.55, 6.0, 0.05, 0.66), (1.4, 6.0, 0.14, 0.65)),
    "latin": ((1.35, 6.0, 0.10, 0.65), (1.2, 6.0, 0.30, 0.63)),
    "greek": ((0.7, 5.0, 0.35, 0.5), (0.4, 3.0, 0.95, 0.4)),
    "cyrillic": ((0.9, 6.0, 0.25, 0.5), (0.4, 3.0, 0.95, 0.4)),
    "hebrew": ((0.5, 4.0, 0.6, 0.45), (0.3, 3.0, 1.0, 0.35)),
    "arabic": ((0.5, 4.0, 0.6, 0.45), (0.3, 3.0, 1.0, 0.35)),
    "devanagari": ((0.3, 3.0, 0.8, 0.4), (0.2, 3.0, 1.0, 0.3)),
    "han": ((0.3, 2.5, 0.8, 0.4), (0.2, 2.5, 1.0, 0.3)),
    "kana": ((0.3, 2.5, 0.8, 0.4), (0.2, 2.5, 1.0, 0.3)),
    "hangul": ((0.3, 2.5, 0.8, 0.4), (0.2, 2.5, 1.0, 0.3)),
    "other": ((0.25, 8.0, 0.9, 0.4), (0.15, 8.0, 1.0, 0.3)),
}


NAMES = [*SCRIPTS, "other"]
SCRIPT_AT = np.full(2**16, len(SCRIPTS), np.uint8)
for _k, _ranges in enumerate(SCRIPTS.values()):
    for _a, _b in _ranges:
        SCRIPT_AT[_a : _b + 1] = _k


def script_of(joined: bytes) -> str:
    """The script of most letters; "other" without any."""
    if joined.isascii():
        return "latin" if joined.translate(None, NOT_LETTERS) else "other"
    chars = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    counts = np.bincount(SCRIPT_AT[np.minimum(chars, 2**16 - 1)], minlength=len(NAMES))[:-1]
    return NAMES[int(counts.argmax())] if counts.any() else "other"


class Pieces:
    """Piece ids of the words of a column. Different words of a column are looked up at once among the remembered ones (REMEMBERED at
    most, of up to LONGEST bytes), and those not seen yet are segmented together."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.bytes = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        if len(self.bytes) >= 2**16:
            raise ValueError("the vocabulary has more than 65,535 pieces")
        self.memory = Memory(np.dtype("<u2"))

    def __call__(self, texts: FlatTexts) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the bounds of each text among them."""
        if not len(texts.starts):
            return np.empty(0, np.uint16), np.zeros(len(texts) + 1, np.int64)
        # A word goes with the white space up to the next: so words stand next to each other and need no copy.
        edges = np.r_[texts.starts, texts.ends[-1]].astype(np.int64)
        codes, source, starts, sizes = self.memory.ids(edges, texts.data, self.segment)
        each = sizes[codes]
        return source[gathered(starts[codes], each)], np.r_[0, np.cumsum(each)][texts.bounds]

    def segment(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        made = self.model.encode([w.strip(SPACE).decode("utf-8", "replace") for w in new.to_pylist()], num_threads=1)
        counts = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.uint16, int(counts.sum())), counts


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur at least twice."""
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = mix(np.fromiter([number.setdefault(w, len(number)) for w in words], np.uint64, n) + np.uint64(1))
    at = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        at = at * np.uint64(0x9E3779B97F4A7C15) + ids[i : n - width + 1 + i]
    order = np.argsort(at, kind="stable")
    same = at[order][1:] == at[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, n_byte_tokens long, entropy double, script string, b_tokens long, b_single long, b_entropy double"


def token_counts(flat: np.ndarray, bounds: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: tokens, those that are marked, and their entropy."""
    n, tokens = len(bounds) - 1, np.diff(bounds)
    text = np.repeat(np.arange(n), tokens)
    key = np.sort(text << 32 | flat.astype(np.int64))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    of = key[first] >> 32
    share = np.diff(np.r_[first, len(key)]) / tokens[of]
    return tokens, np.bincount(text[single[flat]], minlength=n), np.bincount(of, -share * np.log2(share), n) + 0.0


def measures(docs: DataFrame, pieces: str, byte_level: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts and fertility of every text by both vocabularies: id, lang and FIELDS."""

    def each():
        segment, encode, words_of = Pieces(pieces), encoder(byte_level), FlatWords()

        def one(batch: pa.RecordBatch) -> dict:
            rows, more = [], [[] for _ in range(6)]
            for _, texts in chunks(batch["text"], CHUNK_BYTES):
                for x, y in zip(more, (*token_counts(*segment(words_of(texts)), segment.bytes), *token_counts(*encode(texts), encode.parts))):
                    x.append(y)
                for text in texts.to_pylist():
                    raw = text.encode("utf-8", "surrogatepass")
                    words = raw.split()
                    joined = b"".join(words)
                    rows.append((len(words), len(joined.translate(None, CONTINUATION)), len(raw) - len(raw.translate(None, SYMBOL_SET)), duplicate_lines(raw), repeated_words(words), script_of(joined)))
            *counts, script = (list(v) for v in zip(*rows))
            a, b, c, *rest = (np.concatenate(x) for x in more)
            return dict(id=batch["id"], lang=batch["lang"], **{str(k): v for k, v in enumerate([*counts, a, b, c, script, *rest])})

        return one

    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(rows, each, f"id long, lang string, {FIELDS}")


def judged(rows: DataFrame, bands: dict[str, tuple[tuple[float, float, float, float], ...]] = BANDS) -> DataFrame:
    """The measures with chars_per_token, byte_share and evenness (entropy relative to the most that as many tokens, or all pieces
    seen, could have), the same of the byte vocabulary (b_...), base_failed and kept."""
    out = rows
    names = (("n_tokens", "n_byte_tokens", "entropy", ""), ("b_tokens", "b_single", "b_entropy", "b_"))
    for tokens, single, entropy, p in names:
        n = F.col(tokens)
        out = out.withColumn(f"{p}chars_per_token", F.when(n > 0, F.col("word_chars") / n)).withColumn(f"{p}byte_share", F.when(n > 0, F.col(single) / n)).withColumn(f"{p}evenness", F.when(n > 1, F.col(entropy) / F.least(F.log2(n.cast("double")), F.lit(9.0))))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    languages = [b for b in bands if b not in SCRIPTS and b != "other"]
    band = F.when(F.col("lang").isin(*languages), F.col("lang")).otherwise(F.col("script"))
    inside = F.lit(None).cast("boolean")
    for name, limits in bands.items():
        ok = F.lit(True)
        for (*_, p), (low, high, most_bytes, least_even) in zip(names, limits):
            ok = ok & F.col(f"{p}chars_per_token").between(low, high) & (F.col(f"{p}byte_share") <= most_bytes) & (F.col(f"{p}evenness") >= least_even)
        inside = F.when(F.col("band") == name, ok).otherwise(inside)
    fine = F.when(F.col("n_words") < LEAST_JUDGED, F.lit(True)).otherwise(F.coalesce(inside, F.lit(True)))
    return out.withColumn("band", band).withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = judged(measures(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy", "b_tokens", "b_chars_per_token", "b_byte_share", "b_entropy", "script", "band")
