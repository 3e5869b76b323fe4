"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit storage.

Every five-word shingle is hashed once; the top bits choose one of ``BINS`` bins, which keeps the smallest rest. An empty
bin takes the value of the first filled bin in an order of its own, drawn once for each bin, so that two texts borrow
alike as far as they are alike. Of each bin the lowest ``BITS`` bits are stored, packed as one hexadecimal digit. The
share of equal digits is corrected for those that are equal by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.llm import sampling, shared, spans

SHINGLE = 5
BINS = 512
BITS = 4
#: Rows of a stretch of neighbouring doc_ids, and stretches at most.
STRETCH_ROWS = 1024
STRETCHES = 1 << 16
#: Filled bins up to which borrowing is looked up bin by bin.
SPARSE = 48

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@cache
def _orders() -> tuple[np.ndarray, np.ndarray]:
    """For each bin (column) the order in which it asks all bins, and each bin's rank in it."""
    order = np.argsort(np.random.default_rng(3).random((BINS, BINS)), axis=0)
    return order, np.argsort(order, axis=0).astype(np.int16)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts and each one's text; a text of fewer words has one of all its words."""
    data, offsets = spans.utf8(column)
    starts, ends = spans.spaced_words(data, offsets)
    which, words = spans.distinct(data, starts, ends)
    hashed = spans.hashes(*spans.content_of(words), seed=11)[which] if len(which) else np.zeros(0, np.uint64)
    counts = spans.counts_by_text(starts, offsets)
    made = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), made)
    first_word = np.cumsum(counts) - counts
    at = np.arange(made.sum()) + np.repeat(first_word - (np.cumsum(made) - made), made)
    size = np.minimum(np.repeat(counts, made), SHINGLE)
    total = size.astype(np.uint64)
    padded = np.concatenate([hashed, np.zeros(SHINGLE, np.uint64)])
    for k in range(SHINGLE):
        odd = np.uint64((0xC2B2AE3D27D4EB4F * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)
        total += np.where(size > k, spans.mixed(padded[at + k] * odd), np.uint64(0))
    return spans.mixed(total), text


def digits(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of texts as rows of BINS small numbers, and which texts have no words (their rows are zero)."""
    n = len(column)
    hashed, text = shingles(column)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    cells = np.full(n * BINS, _NONE)
    np.minimum.at(cells, text * BINS + (hashed >> shift).astype(np.int64), hashed & ((np.uint64(1) << shift) - np.uint64(1)))
    cells = cells.reshape(n, BINS)
    filled = cells != _NONE
    number = filled.sum(1)
    order, rank = _orders()
    for i in np.flatnonzero((number > 0) & (number <= SPARSE)):
        bins = np.flatnonzero(filled[i])
        lender = bins[rank[bins].argmin(0)]
        cells[i] = np.where(filled[i], cells[i], cells[i, lender])
    row, bin_ = np.nonzero(~filled & (number > SPARSE)[:, None])
    turn = 0
    while len(row):
        lender = order[turn, bin_]
        found = filled[row, lender]
        cells[row[found], bin_[found]] = cells[row[found], lender[found]]
        row, bin_ = row[~found], bin_[~found]
        turn += 1
    # a value that stands in several bins gives each of them bits of its own
    own = np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = (spans.mixed(cells + own) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    out[number == 0] = 0
    return out, number == 0


def likeness(one: np.ndarray, other: np.ndarray, one_empty: np.ndarray, other_empty: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles; texts without words are like each other only."""
    chance = 1.0 / (1 << BITS)
    equal = (one == other).mean(1)
    near = np.clip((equal - chance) / (1 - chance), 0.0, 1.0)
    return np.where(one_empty | other_empty, (one_empty & other_empty).astype(float), near)


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _strings(found: np.ndarray) -> pa.Array:
    bounds = np.arange(len(found) + 1, dtype=np.int32) * BINS
    return pa.StringArray.from_buffers(len(found), pa.py_buffer(bounds), pa.py_buffer(_HEX[found].ravel()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fingerprint`` of each row of ``docs`` (doc_id, text); a null text is empty."""
    shared.shipped(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch):
                yield pa.record_batch([part.column(0), _strings(digits(part.column(1))[0])], names=["doc_id", "fingerprint"])

    slim = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return slim.mapInArrow(made, "doc_id long, fingerprint string")


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows (stretch, ahead, doc_id, text) sorted so that the next document in descending order follows each.

    Documents are dealt out by stretches of neighbouring doc_ids, whose bounds are quantiles of a bounded sample of ids;
    the first row of each stretch also goes behind the last of the stretch above it (``ahead``), and the first of all
    behind the last of all. Texts are shuffled once.
    """
    lowest = -(1 << 63)
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("key", F.coalesce("doc_id", F.lit(lowest)))
    ids = slim.select("key")
    rows = ids.count()
    stretches = max(1, min(STRETCHES, rows // STRETCH_ROWS))
    sample = sorted(r[0] for r in sampling.bounded(ids, "key", 20 * stretches, 9).collect())
    inner = sorted({float(sample[len(sample) * k // stretches]) for k in range(1, stretches)}) if sample else []
    if inner:
        cut = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="number", outputCol="stretch")
        placed = cut.transform(slim.withColumn("number", F.col("key").cast("double"))).drop("number")
    else:
        placed = slim.withColumn("stretch", F.lit(0.0))
    heads = {int(r[0]): r[1] for r in placed.groupBy("stretch").agg(F.max("key")).collect()}  # STRETCHES at most
    order = sorted(heads, reverse=True)
    behind = [(heads[s], float(order[k - 1])) for k, s in enumerate(order)]  # the first of all: behind the last
    again = docs.sparkSession.createDataFrame(behind, "key long, target double")
    parts = F.array(
        F.struct(F.col("stretch"), F.lit(False).alias("ahead")),
        F.struct(F.col("target").alias("stretch"), F.lit(True).alias("ahead")),
    )
    dealt = placed.join(F.broadcast(again), "key", "left").withColumn("part", F.explode(parts)).where("part.stretch is not null")
    dealt = dealt.select("part.stretch", "part.ahead", "key", "doc_id", "text")
    return (
        dealt.repartition("stretch")
        .sortWithinPartitions("stretch", "ahead", F.col("key").desc(), F.col("text"))
        .select("stretch", "ahead", "doc_id", "text")
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its edited text, and how alike they are.

    The edited text has the last third of the code points (rounded down) replaced by the first as many of the next
    document in descending order of doc_id, or all of it; the first follows the last. doc_id, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``. A null text is empty, a
    null doc_id comes last; rows of one doc_id are in order of their texts. A text without words has the fingerprint of
    zeros, which is like itself only. An empty table gives no rows. Other columns are not read. Any text is read whole.
    """
    shared.shipped(docs.sparkSession)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in spans.chunks(batch, 3):
                rows = part if held is None else pa.concat_batches([held, part])
                held = rows.slice(rows.num_rows - 1)
                stretch, ahead, ids, texts = (rows.column(k).to_pylist() for k in range(4))
                use = [i for i in range(len(ids) - 1) if not ahead[i]]
                edited = []
                for i in use:
                    third = len(texts[i]) // 3
                    edited.append(texts[i][: len(texts[i]) - third] + texts[i + 1][:third])
                own, empty = digits(rows.column(3))
                other, other_empty = digits(pa.array(edited, pa.string()))
                at = np.array(use, np.int64)
                yield pa.record_batch(
                    [
                        pa.array([ids[i] for i in use], pa.int64()),
                        pa.array([len(texts[i]) for i in use], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                        _strings(own[at]),
                        _strings(other),
                        pa.array(likeness(own[at], other, empty[at], other_empty)),
                        pa.array(likeness(own[at], own[at + 1], empty[at], empty[at + 1])),
                    ],
                    names=[c.split()[0] for c in SCHEMA.split(", ")],
                )

    return _with_next(docs).mapInArrow(compared, SCHEMA)
