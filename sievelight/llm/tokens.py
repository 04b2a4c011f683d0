"""Ids of texts by a public vocabulary of the tokenizers library, a column at a time.

Byte-level BPE with its usual pattern never joins a character that isn't white space with white space after it. So texts are cut
there, each different segment (white space and what follows it up to the next cut) is encoded once a call, and the ids of common
segments are remembered. Where the cut can't be told from ASCII (white space of other kinds before it), there is none: a longer
segment gives the same ids. Texts that hold the text of an added token are encoded whole, as the library cuts there first, and so
is everything for vocabularies of another kind.
"""

import json
import os
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Segments that a worker remembers, and the longest one it does, in bytes: both bound its memory.
REMEMBERED, LONGEST = 500_000, 32
#: Characters that go to the library in one string, and in one call, about, and segments that are joined at once: what the library
#: returns takes some hundred bytes a token.
JOINED, CALL, AT_ONCE = 8_192, 1 << 17, 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Last bytes of other white space (U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000), and U+001C to
#: U+001F, which some call white space.
_MAYBE = np.zeros(256, bool)
_MAYBE[[*range(0x1C, 0x20), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def offsets_of(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)


def cuts(data: np.ndarray) -> np.ndarray:
    """Places of ASCII white space that follows a character which is surely not white space."""
    at = np.flatnonzero(_SPACE[data])
    at = at[at > 0]
    before = data[at - 1]
    fine = ~_SPACE[before]
    odd = np.flatnonzero(fine & _MAYBE[before])
    if len(odd):  # part of a longer character: only those that may be white space keep from a cut
        two, three = data[np.maximum(at[odd] - 2, 0)], data[np.maximum(at[odd] - 3, 0)]
        fine[odd] = ~((before[odd] < 0x80) | (two == 0xC2) | (three == 0xE1) | (three == 0xE2) | (three == 0xE3))
    return at[fine]


class Memory:
    """Ids of remembered segments: the segments as an Arrow array, their ids in one pool."""

    def __init__(self, kind: np.dtype):
        self.known = pa.array([], pa.large_binary())
        self.starts, self.counts, self.pool = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, kind)

    def ids(self, edges: np.ndarray, data: np.ndarray, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the pieces of ``data`` between the edges: each one's code, and the ids (flat), and start and number of ids by code.
        ``encode`` gives the ids of those not remembered."""
        coded = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        codes, different = coded.indices.to_numpy(), coded.dictionary
        at = pc.fill_null(pc.index_in(different, self.known), -1).to_numpy()
        old = at >= 0
        new = different.filter(pa.array(~old))
        flat, counts = encode(new) if len(new) else (np.empty(0, self.pool.dtype), np.empty(0, np.int64))
        starts, sizes = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        starts[old], sizes[old] = self.starts[at[old]], self.counts[at[old]]
        starts[~old], sizes[~old] = len(self.pool) + np.cumsum(counts) - counts, counts
        source = np.concatenate([self.pool, flat])
        self.keep(new, flat, counts)
        return codes, source, starts, sizes

    def keep(self, new: pa.Array, flat: np.ndarray, counts: np.ndarray) -> None:
        """Remember what has room."""
        pick = np.flatnonzero(pc.binary_length(new).to_numpy() <= LONGEST)[: REMEMBERED - len(self.known)]
        if len(pick):
            ids = flat[gathered((np.cumsum(counts) - counts)[pick], counts[pick])]
            counts = counts[pick].astype(np.int32)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts, dtype=np.int32) - counts])
            self.counts, self.pool = np.concatenate([self.counts, counts]), np.concatenate([self.pool, ids])
            self.known = pa.concat_arrays([self.known, new.take(pa.array(pick))])


class Encoder:
    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as source:
            made = json.load(source)
        vocab = made["model"].get("vocab")
        before = made.get("pre_tokenizer") or {}
        plain = made["model"].get("type") == "BPE" and not any(made["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token"))
        #: Whether cutting is known to change nothing.
        self.apart = plain and not any(made.get(k) for k in ("normalizer", "truncation", "padding")) and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.added = [t["content"] for t in made.get("added_tokens", [])]
        self.width = 2 if self.model.get_vocab_size() <= 2**16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        if self.apart:  # bytes of each id: every sign of a byte-level token stands for one
            self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
            self.bytes[list(vocab.values())] = [len(t) for t in vocab]
            #: Ids of a single byte that is part of a longer character: their sign is not that of an ASCII byte.
            self.parts = np.zeros(len(self.bytes), bool)
            self.parts[[i for t, i in vocab.items() if len(t) == 1 and not ("!" <= t <= "~" or "\u0100" <= t <= "\u0121")]] = True
            self.newline = self.model.encode("\n", add_special_tokens=False).ids
            self.apart = len(self.newline) == 1
        self.memory = Memory(self.kind)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and their number for each, by the library alone."""
        flat, counts, start, size = [np.empty(0, self.kind)], [np.empty(0, np.int64)], 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= CALL or k + 1 == len(texts):
                made = [e.ids for e in self.model.encode_batch_fast(texts[start : k + 1], add_special_tokens=False)]
                counts.append(np.fromiter(map(len, made), np.int64, len(made)))
                flat.append(np.fromiter(chain.from_iterable(made), self.kind, int(counts[-1].sum())))
                start, size = k + 1, 0
        return np.concatenate(flat), np.concatenate(counts)

    def segments(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``whole``, for segments."""
        made = [self.joined(new.slice(a, AT_ONCE)) for a in range(0, len(new), AT_ONCE)]
        return np.concatenate([flat for flat, _ in made]), np.concatenate([counts for _, counts in made])

    def joined(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, many joined to one string; the bytes of the ids tell where each ends."""
        put = new.cast(pa.large_string()).to_pylist()
        # A segment without white space before it gets a line feed, whose id goes again. One with white space at its end, which
        # would meet that of the next, stands last in its string.
        heads = np.array([not s[0].isspace() for s in put], bool)
        for k in np.flatnonzero(heads).tolist():
            put[k] = "\n" + put[k]
        strings, start, size = [], 0, 0
        for k, s in enumerate(put):
            size += len(s)
            if size >= JOINED or s[-1].isspace():
                strings.append("".join(put[start : k + 1]))
                start, size = k + 1, 0
        if start < len(put):
            strings.append("".join(put[start:]))
        flat, _ = self.whole(strings)
        ends = np.cumsum(pc.binary_length(new).to_numpy() + heads)
        upto = np.searchsorted(np.cumsum(self.bytes[flat]), ends) + 1
        counts = np.diff(np.r_[0, upto])
        if heads.any():
            keep = np.ones(len(flat), bool)
            keep[(upto - counts)[heads]] = False
            flat, counts = flat[keep], counts - heads
        return flat, counts

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a column of texts without nulls, and the bounds of each text among them."""
        n = len(column)
        special = np.zeros(n, bool)
        for token in self.added:
            special |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if not self.apart or special.all():
            flat, counts = self.whole(column.to_pylist())
            return flat, np.r_[0, np.cumsum(counts)]
        if special.any():
            some = np.flatnonzero(special)
            flat, bounds = self(column.filter(pa.array(~special)))
            apart, own = self.whole([column[k].as_py() for k in some.tolist()])
            counts, starts = np.empty(n, np.int64), np.empty(n, np.int64)
            counts[~special], starts[~special] = np.diff(bounds), bounds[:-1]
            counts[some], starts[some] = own, len(flat) + np.cumsum(own) - own
            return np.concatenate([flat, apart])[gathered(starts, counts)], np.r_[0, np.cumsum(counts)]
        offsets = offsets_of(column).astype(np.int64)
        data = column.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        edge = np.zeros(len(data) + 1, bool)
        edge[cuts(data)] = True
        edge[offsets] = True
        edges = np.flatnonzero(edge)
        if len(edges) < 2:
            return np.empty(0, self.kind), np.zeros(n + 1, np.int64)
        codes, source, starts, sizes = self.memory.ids(edges, data, self.segments)
        each = sizes[codes]
        return source[gathered(starts[codes], each)], np.r_[0, np.cumsum(each)][np.searchsorted(edges, offsets)]


def gathered(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the ranges, one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


@cache
def encoder(vocabulary: str) -> Encoder:
    """One a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(vocabulary)
