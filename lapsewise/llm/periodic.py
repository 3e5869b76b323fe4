"""Runs of words that repeat with a period, by a dictionary of basic factors.

A text's factors of each length 1, 2, 4, ... get names, equal ones the same; the name of a factor is that of the pair of
its halves. Successive places of one factor that are at most twice its length apart form arithmetic progressions, whose
difference is proposed as a period. A stretch of progressions with one difference, begun at neighbouring places, spans a
repetition; it is extended as far as the period holds, and what several lengths propose is reported once.

A repetition of period q that is at least 4 q long shows at the length L with L/2 < q <= L: every factor of it has its
next place exactly q further, because a nearer one would give the repetition a smaller period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.llm import shared, spans

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _extended(words: np.ndarray, start: int, end: int, period: int, low: int, high: int) -> tuple[int, int]:
    """The stretch made as long as words a period apart are equal, within low and high; cost grows with what is added."""
    step = 16
    while start > low:
        far = max(low, start - step)
        odd = np.flatnonzero(words[far:start] != words[far + period : start + period])
        if len(odd):
            start = far + int(odd[-1]) + 1
            break
        start, step = far, step * 2
    step = 16
    while end < high:
        far = min(high, end + step)
        odd = np.flatnonzero(words[end:far] != words[end - period : far - period])
        if len(odd):
            end += int(odd[0])
            break
        end, step = far, step * 2
    return start, end


def runs_of(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Runs of several texts: rows (text, start, length, period), by text, start and period.

    ``words`` has a number for each spelling, all texts in a row; text k has the words from bounds[k] to bounds[k + 1].
    """
    n = len(words)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end_of_text = bounds[1:][text]
    # names of factors by place, -1 where the text has that factor once; texts share no name
    places = np.arange(n)
    keys = text * (int(words.max(initial=0)) + 1) + words
    found = set()
    length = 1
    while len(places):
        _, name, times = np.unique(keys, return_inverse=True, return_counts=True)
        twice = times[name] > 1
        places, name = places[twice], name[twice]
        order = np.argsort(name, kind="stable")  # places stay in order
        at, of = places[order], name[order]
        apart = np.diff(at)
        near = np.flatnonzero((of[1:] == of[:-1]) & (apart <= 2 * length))
        begin, period = at[near], apart[near]
        order = np.lexsort((begin, period))
        begin, period = begin[order], period[order]
        if len(begin):
            cut = np.flatnonzero((np.diff(begin) != 1) | (np.diff(period) != 0)) + 1
            first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(begin)]]) - 1
            start, size, q = begin[first], begin[last] - begin[first] + period[first] + length, period[first]
            for k in np.flatnonzero((size >= LEAST_WORDS) & (size >= LEAST_TIMES * q)).tolist():
                t = int(text[start[k]])
                a, b = _extended(words, int(start[k]), int(start[k] + size[k]), int(q[k]), int(bounds[t]), int(bounds[t + 1]))
                found.add((t, a - int(bounds[t]), b - a, int(q[k])))
        # factors twice as long: both halves occur again, and it ends with its text
        named = np.full(n, -1, np.int64)
        named[places] = name
        second = places + length
        inside = places + 2 * length <= end_of_text[places]
        places, second = places[inside], second[inside]
        whole = named[second] >= 0
        places, second = places[whole], second[whole]
        keys = named[places] * (int(name.max(initial=0)) + 1) + named[second]
        length *= 2
    return np.array(sorted(found), np.int64).reshape(-1, 4)


def _kept(runs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each word stays: no run has it after its first period."""
    edge = np.zeros(int(bounds[-1]) + 1, np.int64)
    base = bounds[runs[:, 0]]
    np.add.at(edge, base + runs[:, 1] + runs[:, 3], 1)
    np.add.at(edge, base + runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(edge[:-1]) == 0


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Of each text its kept words, joined by one blank."""
    starts, ends = starts[kept], ends[kept]
    size = ends - starts + 1  # with a blank after each
    of_text = np.concatenate([[0], np.cumsum(kept)])[bounds]
    begin = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[begin + size - 1] = False
    out[inside] = data[np.arange(int((size - 1).sum())) + np.repeat(starts - (np.cumsum(size - 1) - (size - 1)), size - 1)]
    whole = np.concatenate([begin, [len(out)]])[of_text]
    # the last word of a text has no blank after it
    last = whole[1:][np.diff(of_text) > 0] - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    offsets = whole - np.concatenate([[0], np.cumsum(np.diff(of_text) > 0)])
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out[keep]))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in spans.chunks(batch):
            data, offsets = spans.utf8(part.column(1))
            starts, ends = spans.spaced_words(data, offsets)
            bounds = np.searchsorted(starts, offsets)
            words, _ = spans.distinct(data, starts, ends)
            runs = runs_of(words, bounds)
            listed = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
            at = np.searchsorted(runs[:, 0], np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.record_batch(
                [
                    part.column(0),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at), listed),
                    _joined(data, starts, ends, _kept(runs, bounds), bounds),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )


def runs(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_words, ``runs``, ``collapsed``.

    Words are runs without ASCII white space. ``runs`` lists start (word number), length and period, in order of start,
    then period: each stretch with the smallest period q, at least ``LEAST_WORDS`` and ``LEAST_TIMES`` q long, that no
    neighbouring word extends. ``collapsed`` is the text without what a run repeats after its first period, words joined
    by one blank. Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Repeated rows are worked
    on one by one; a null doc_id stays null. Other columns are not read. An empty table gives no rows. Nothing is
    shuffled: texts are worked on whole, in the task that reads them, in memory of a few numbers per word.
    """
    shared.shipped(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_batches, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")
