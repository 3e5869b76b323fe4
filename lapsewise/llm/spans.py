"""Words of Arrow text columns, found by whole-array operations on the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer document is worked on alone, whole.
CHUNK_BYTES = 2 << 20

SPACES = b" \t\n\x0b\x0c\r"

_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[list(SPACES)] = False

#: Letters of any script count by their bytes: ASCII letters and all bytes of longer characters.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def texts(column: pa.Array) -> pa.StringArray:
    """The column as strings, null as empty."""
    return pc.fill_null(column.cast(pa.string()), "")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and where each text begins (with the end of the last)."""
    column = texts(column)
    _, bounds, content = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(bounds, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text, at least one row each."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    slice_of = np.cumsum(lengths, dtype=np.int64) // limit
    edges = np.flatnonzero(np.diff(slice_of)) + 1
    for low, high in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        if high > low:
            yield batch.slice(int(low), int(high - low))


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a text's edge ends a run."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space."""
    return _runs(_NOT_SPACE[data], offsets)


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters."""
    return _runs(_LETTER[data], offsets)


def counts_by_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(starts, offsets))


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.BinaryArray]:
    """For each word the index of its spelling, and the spellings."""
    lengths = ends - starts
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=bounds[1:])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    content = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(content)])
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def content_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words in a row and where each begins (with the end of the last)."""
    if len(words) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, content = words.buffers()
    offsets = np.frombuffer(bounds, np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hashes(data: np.ndarray, offsets: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of bytes between two offsets."""
    lengths = np.diff(offsets)
    longest = int(lengths.max(initial=0))
    odd = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    powers = np.cumprod(np.full(longest + 1, odd, np.uint64))
    at = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    weighed = (data.astype(np.uint64) + np.uint64(1)) * powers[at]
    out = lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    some = lengths > 0
    if some.any():
        out[some] += np.add.reduceat(weighed, offsets[:-1][some])
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers, mixed."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
