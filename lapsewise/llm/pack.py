"""Packing of documents into fixed windows of token ids: sum-of-squares online packing.

A document's ids (its text's ids and an end id) fill whole windows of their own as far as they go; the rest goes to the
partly filled window whose level, once the rest is in it, leaves the smallest sum of squared counts of windows per
level. Only the level array decides, so a document is placed once, when it arrives. Each partition packs its own
documents; what is open at its end is cut and joined to full windows, and the last ids to windows of powers of two, so
that no id is padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lapsewise.llm import bpe, shared, spans

WINDOW = 1024

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Sequences of one partition are numbered below this.
PARTITION_SEQUENCES = 1 << 40

BATCH_ROWS = 20_000


class Levels:
    """Counts of partly filled windows by level, and which windows stand at each level."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """Takes the best level for ``size`` (0: a new window) and the window there (-1: a new one)."""
        counts, window = self.counts, self.window
        levels = counts[1 : window - size + 1]
        change = np.where(levels > 0, 2 * (counts[size + 1 :] - levels) + 2, np.iinfo(np.int64).max)
        if len(change) and levels[-1] > 0:
            change[-1] -= 1  # a full window is not partly filled
        best = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else -1
        if best < 0 or change[best] > 2 * counts[size] + 1:
            return 0, -1
        counts[best + 1] -= 1
        return best + 1, self.windows[best + 1].pop()

    def put(self, level: int, number: int) -> None:
        if level < self.window:
            self.counts[level] += 1
            self.windows[level].append(number)


class Packer:
    """Packs documents one after another; rows of placed pieces come out as windows fill."""

    def __init__(self, window: int, first_sequence: int, with_ids: bool):
        self.levels = Levels(window)
        self.window, self.sequence, self.with_ids = window, first_sequence, with_ids
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _new(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _row(self, doc, start, ids, tokens, sequence, offset) -> None:
        row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, sequence, offset)
        self.rows.append((*row, ids.tobytes()) if self.with_ids else row)

    def add(self, doc, ids: np.ndarray) -> None:
        tokens, window = len(ids), self.window
        whole = tokens - tokens % window
        for start in range(0, whole, window):
            self._row(doc, start, ids[start : start + window], tokens, self._new(), 0)
        if whole == tokens:
            return
        rest = ids[whole:]
        level, number = self.levels.place(len(rest))
        if number < 0:
            number = self._new()
            self.open[number] = []
        pieces = self.open[number]
        pieces.append((doc, whole, rest, tokens, level))
        if level + len(rest) == window:
            for d, start, part, n, offset in self.open.pop(number):
                self._row(d, start, part, n, number, offset)
        self.levels.put(level + len(rest), number)

    def close(self) -> None:
        """Cuts and joins what is open: full windows first, then powers of two."""
        left = sum(len(p[2]) for pieces in self.open.values() for p in pieces)
        room, offset, number = 0, 0, -1
        for key in sorted(self.open):
            for doc, start, part, tokens, _ in self.open[key]:
                while len(part):
                    if room == 0:
                        room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                        left -= room
                        offset, number = 0, self._new()
                    now = part[:room]
                    self._row(doc, start, now, tokens, number, offset)
                    part, start = part[len(now) :], start + len(now)
                    room, offset = room - len(now), offset + len(now)
        self.open = {}


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row for each placed piece of each document of ``docs`` (doc_id, text).

    ``doc_id``, ``start`` (ids of the document before the piece), ``length``, ``ids_crc32`` (of the ids as unsigned
    little-endian 32-bit numbers), ``doc_tokens``, ``sequence_id``, ``offset`` (place in the window), and with
    ``with_ids`` the piece's ``ids`` in that form. ``window`` is a power of two.

    A null text is empty: its document is the end id alone. A null doc_id stays null. Repeated rows are packed one by
    one. An empty table gives no rows. Only doc_id and text are read, so other columns do not matter. A very long text
    is tokenized whole. A task that runs again reads its rows in the same order and so gives the same windows.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    shared.shipped(docs.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(vocabulary)
        packer = Packer(window, TaskContext.get().partitionId() * PARTITION_SEQUENCES, with_ids)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids

        def taken() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) if packer.rows else [()] * len(names)
            packer.rows = []
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for part in spans.chunks(batch):
                ids, at = encoder.encode(part.column(1))
                for k, doc in enumerate(part.column(0).to_pylist()):
                    packer.add(doc, ids[at[k] : at[k + 1]].copy())
                if len(packer.rows) >= (BATCH_ROWS // 20 if with_ids else BATCH_ROWS):
                    yield taken()
        packer.close()
        yield taken()

    slim = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return slim.mapInArrow(packed, SCHEMA + (", ids binary" if with_ids else ""))
