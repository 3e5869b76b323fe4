"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per chunk of texts.

A byte-level tokenizer cuts a text at its added tokens, splits the rest into words by a fixed pattern and merges inside
words only, so the ids of a text are the ids of its words in a row. The split is done here for many texts at once; words
go to the library.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import regex

from lapsewise.llm import spans

END_ID = 0

#: White space of the pattern (Unicode property White_Space), and contractions that it cuts off.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
CONTRACTIONS = [b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"]

OTHER, SPACE, LETTER, NUMBER = 0, 1, 2, 3

#: Words kept with their ids in a worker (some 60 MB); beyond this the memory starts anew.
MEMORY_WORDS = 2_000_000


@cache
def _classes() -> np.ndarray:
    """Class of each code point."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for found in regex.finditer(pattern, every):
            low, high = found.span()
            for a, b in ((low, min(high, 0xD800)), (max(low, 0xD800), high)):
                if a < b:
                    shift = 0x800 if a >= 0xD800 else 0
                    table[a + shift : b + shift] = kind
    table[WHITE_SPACE] = SPACE
    return table


def _byte_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte (that of its character), and whether a character begins there."""
    table = _classes()
    kinds = table[data]
    lead = np.ones(len(data), bool)
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        first = data[at].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = np.where(size == 2, first & 31, np.where(size == 3, first & 15, first & 7))
        for k in (1, 2, 3):
            longer = size > k
            code[longer] = code[longer] << 6 | (data[at[longer] + k] & 63)
        kind = table[code]
        kinds[at] = kind
        for k in (1, 2, 3):
            longer = size > k
            kinds[at[longer] + k] = kind[longer]
            lead[at[longer] + k] = False
    return kinds, lead


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of the tokenizer's pattern begin; each reaches to the next or to its text's end."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    kinds, lead = _byte_classes(data)
    edge = np.zeros(n + 1, bool)  # a text begins
    edge[offsets] = True
    change = edge[:-1].copy()
    change[1:] |= kinds[1:] != kinds[:-1]
    space = kinds == SPACE
    start = change.copy()
    # a blank before a run goes with it
    blank = np.flatnonzero((data[:-1] == 32) & ~space[1:] & ~edge[1:-1])
    start[blank + 1] = False
    # the last white space before a run is apart from those before it
    last = np.flatnonzero(space & lead)
    if len(last):
        following = last + 1
        for _ in range(2):
            inner = (following < n) & ~lead[np.minimum(following, n - 1)]
            following = following + inner
        inside = following < n
        follows = np.minimum(following, n - 1)
        start[last[inside & ~edge[follows] & ~space[follows]]] = True
    quote = np.flatnonzero(start & (data == 39))
    if len(quote):
        ends = offsets[np.searchsorted(offsets, quote, side="right")]
        for tail in CONTRACTIONS:
            stop = quote + 1 + len(tail)
            fits = stop <= ends
            for k, byte in enumerate(tail):
                fits &= data[np.minimum(quote + 1 + k, n - 1)] == byte
            start[quote[fits] + 1] = False
            stop = stop[fits & (stop < n)]
            start[stop] = True
    return np.flatnonzero(start)


class Memory:
    """Ids of words by two 64-bit hashes of the word, in flat arrays: some 30 bytes a word.

    ``main`` and ``recent`` are sorted by the first hash; new words go to ``recent``, which is merged when it is large.
    """

    RECENT = 100_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64)
        self.main = self.recent = (none, none, np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.pool = np.zeros(0, np.uint16)

    def __len__(self) -> int:
        return len(self.main[0]) + len(self.recent[0])

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids begin in the pool (-1: unknown), and how many they are."""
        at, size = np.full(len(first), -1, np.int64), np.zeros(len(first), np.int32)
        order = np.argsort(first)
        for keys, checks, begins, sizes in (self.main, self.recent):
            if len(keys):
                place = np.minimum(np.searchsorted(keys, first[order]), len(keys) - 1)
                hit = (keys[place] == first[order]) & (checks[place] == second[order])
                at[order[hit]], size[order[hit]] = begins[place[hit]], sizes[place[hit]]
        return at, size

    def add(self, first, second, ids: np.ndarray, sizes: np.ndarray) -> None:
        begins = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate([self.pool, ids])
        new = (first, second, begins.astype(np.int64), sizes.astype(np.int32))
        self.recent = self._sorted(self.recent, new)
        if len(self.recent[0]) > self.RECENT:
            self.main = self._sorted(self.main, self.recent)
            self.recent = tuple(x[:0] for x in self.main)

    @staticmethod
    def _sorted(one, other):
        both = [np.concatenate(x) for x in zip(one, other, strict=True)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)


class Encoder:
    """Encodes columns of texts; ``vocabulary`` is the path of a byte-level tokenizer file of at most 65,536 ids."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that take white space or whole words only are not supported")
        longest = sorted({t.content.encode() for t in added}, key=len, reverse=True)
        #: The added tokens, which stand for themselves wherever their strings are.
        self.added = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory = Memory()

    def _places(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids lie in the memory's pool."""
        data, offsets = spans.content_of(words)
        first, second = spans.hashes(data, offsets, 1), spans.hashes(data, offsets, 2)
        if len(self.memory) + len(words) > MEMORY_WORDS:
            self.memory.clear()
        at, sizes = self.memory.find(first, second)
        new = np.flatnonzero(at < 0)
        if len(new):
            found = []
            for low in range(0, len(new), 4096):
                part = words.take(pa.array(new[low : low + 4096])).to_pylist()
                found += [np.array(x.ids, np.uint16) for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            sizes_new = np.fromiter(map(len, found), np.int64, len(found))
            at[new] = len(self.memory.pool) + np.cumsum(sizes_new) - sizes_new
            sizes[new] = sizes_new
            self.memory.add(first[new], second[new], np.concatenate(found), sizes_new)
        return at, sizes

    def _word_starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where words and added tokens begin; an added token parts the words around it as a text's edge does."""
        found = [] if self.added is None else [m.span() for m in self.added.finditer(data.tobytes())]
        if not found:
            return word_starts(data, offsets)
        first, end = np.array(found, np.int64).T
        within = np.searchsorted(offsets, first, "right") == np.searchsorted(offsets, end, "left")
        first, end = first[within], end[within]
        starts = word_starts(data, np.unique(np.concatenate([offsets, first, end])))
        token = np.searchsorted(first, starts, "right") - 1
        inside = (token >= 0) & (starts > first[token]) & (starts < end[token]) if len(first) else np.zeros(len(starts), bool)
        return starts[~inside]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text with the end id after it, and where each text begins."""
        data, offsets = spans.utf8(column)
        starts = self._word_starts(data, offsets)
        texts = len(offsets) - 1
        bounds = np.append(starts, len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        encoded = words.dictionary_encode()
        which = encoded.indices.to_numpy(zero_copy_only=False)
        pool_at, sizes = self._places(encoded.dictionary)
        lengths = sizes[which]
        before = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lengths, out=before[1:])
        word_of_text = np.searchsorted(starts, offsets)
        at = before[word_of_text] + np.arange(texts + 1)
        ids = np.full(at[-1], END_ID, np.uint32)
        real = np.ones(at[-1], bool)
        real[at[1:] - 1] = False
        ids[real] = self.memory.pool[np.arange(before[-1]) + np.repeat(pool_at[which] - before[:-1], lengths)]
        return ids, at


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
