"""Near copies by SimHash: fingerprints as points of bit counts, a grid range join, exact verification.

A 64-bit fingerprint is cut into segments, and each segment is mapped to its number of set bits. Two fingerprints that
differ in d bits lie at a Manhattan distance of d or less there, so all pairs within the radius are among the points
within the same radius of the grid. Segments form ``PARTS`` groups; two points at a distance of ``radius`` or less agree
wholly in all but ``radius`` of them, so each point is dealt to one cell for each choice of ``PARTS - radius`` groups,
and points within reach of each other share a cell. In a cell, the distance of the counts is taken first and the
differing bits of what is left. A cell yields links to the first of each of its clusters, never all pairs.

Cells of more than ``CELL`` points (many near copies of one text) are not compared pairwise: there, each fingerprint is
linked with all values that differ from it in ``radius / 2`` bits, as 2 bits apart means one bit from a common value.
That finds exactly the same links in rows that grow with the points.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.llm import components, dedup, shared, spans

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Bits of a segment, and groups of segments whose counts form a cell.
SEGMENT = 2
PARTS = 5
#: Points of a cell that are compared pairwise.
CELL = 1024


def shingle_hashes(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``size`` words, joined by blanks; of all words if there are fewer; of nothing if none."""
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(text, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    found = [digest(text[a:b], seed) for a, b in zip(begins, ends[size - 1 :].tolist(), strict=True)]
    return np.array(found, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes; zero for none."""
    if len(hashes) == 0:
        return 0
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[low : low + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, ``row`` (its place in the files) and ``fp`` (the fingerprint as a signed long) of every row of ``docs``.

    Null, empty and blank texts have fingerprint zero, equal texts equal ones; repeated rows are rows of their own; a null
    doc_id stays null. An empty table gives no rows.
    """
    shared.shipped(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for part in spans.chunks(batch, 2):
                data, offsets = spans.utf8(part.column(2))
                content = data.tobytes().lower()  # bytes: only A-Z change
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    values.append(fingerprint(shingle_hashes(content[a:b].split())))
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(1), fp], names=["doc_id", "row", "fp"])

    docs = shared.scan(docs)
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        shared.place(docs).alias("row"),
        F.col("text").cast("string").alias("text"),
    )
    return slim.mapInArrow(made, "doc_id long, row struct<file: long, at: long>, fp long")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Set bits of each segment: a row of 64 / SEGMENT small numbers for each fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fps), -1, SEGMENT).sum(2, dtype=np.uint8)


def _cells(radius: int):
    """Python function: batches of fp -> rows (cell, fp), a cell for each choice of groups of segments."""
    groups = np.array_split(np.arange(64 // SEGMENT), PARTS)
    choices = [np.concatenate(c) for c in combinations(groups, PARTS - radius)]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for low in range(0, len(whole), 1 << 14):
                fps = whole[low : low + (1 << 14)]
                counts = segment_counts(fps)
                for k, chosen in enumerate(choices):
                    flat = np.ascontiguousarray(counts[:, chosen]).ravel()
                    cell = spans.hashes(flat, np.arange(len(fps) + 1) * len(chosen), k).view(np.int64)
                    yield pa.record_batch([pa.array(cell), pa.array(fps)], names=["cell", "fp"])

    return dealt


def _clusters(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (each point with the first of its cluster) among the points of one cell."""
    n = len(fps)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    counts = segment_counts(fps).astype(np.int16)
    bits = fps.view(np.uint64)
    for i in range(n - 1):
        near = np.flatnonzero(np.abs(counts[i + 1 :] - counts[i]).sum(1) <= radius) + i + 1
        for j in near[np.bitwise_count(bits[near] ^ bits[i]) <= radius].tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(n)])
    moved = np.flatnonzero(roots != np.arange(n))
    yield fps[moved], fps[roots[moved]]


def _linked(radius: int):
    """Python function: (cell, fp) sorted by cell, no cell above CELL points -> links (a, b)."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def within(cells: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            edges = np.flatnonzero(np.diff(cells)) + 1
            lows = np.concatenate([[0], edges]).astype(np.int64)
            highs = np.concatenate([edges, [len(cells)]]).astype(np.int64)
            sizes = highs - lows
            two = lows[sizes == 2]
            if len(two):  # most cells
                one, other = fps[two], fps[two + 1]
                far = np.abs(segment_counts(one).astype(np.int16) - segment_counts(other)).sum(1)
                keep = far <= radius
                keep &= np.bitwise_count(one.view(np.uint64) ^ other.view(np.uint64)) <= radius
                a.append(one[keep])
                b.append(other[keep])
            for k in np.flatnonzero(sizes > 2).tolist():
                for x, y in _clusters(fps[lows[k] : highs[k]], radius):
                    a.append(x)
                    b.append(y)
            return pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            cells = np.concatenate([held_cell, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0
            if cut:
                yield within(cells[:cut], fps[:cut])
            held_cell, held_fp = cells[cut:], fps[cut:]
        if len(held_cell):
            yield within(held_cell, held_fp)

    return linked


def _common_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (value, fp): each fingerprint itself and all 64 values one bit away."""
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False)
        for low in range(0, len(whole), 1 << 12):
            fps = whole[low : low + (1 << 12)]
            values = (fps.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)
            yield pa.record_batch([pa.array(values), pa.array(np.repeat(fps, 65))], names=["value", "fp"])


def links(fps: DataFrame, radius: int = RADIUS, most: int = CELL) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fps`` (fp, distinct) within ``radius`` bits."""
    if radius != RADIUS:
        raise ValueError("cells with many points are exact for 2 bits only")
    shared.shipped(fps.sparkSession)
    cells = shared.stored(fps.select("fp").mapInArrow(_cells(radius), "cell long, fp long"))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("points")).where("points > 1")
    shown = shared.stored(sizes)
    small = (
        cells.join(shown.where(F.col("points") <= most).select("cell"), "cell", "left_semi")
        .repartition("cell")
        .sortWithinPartitions("cell", "fp")
        .mapInArrow(_linked(radius), "a long, b long")
    )
    crowded = cells.join(shown.where(F.col("points") > most).select("cell"), "cell", "left_semi").select("fp").distinct()
    values = crowded.mapInArrow(_common_values, "value long, fp long")
    first = values.groupBy("value").agg(F.min("fp").alias("b"), F.max("fp").alias("most"))
    # members of a value are linked through the value itself, a node of its own
    tied = first.where("b <> most").select("value")
    through = values.join(tied, "value", "left_semi").select(F.col("fp").alias("a"), F.col("value").alias("b"))
    return small.unionByName(through)


def near_copies(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, ``row``, ``fp``, ``component_id``, ``kept``.

    Texts are lower-cased in A-Z and split at ASCII white space; three-word shingles, repeats included, are hashed by
    XXH64. Rows whose fingerprints differ in at most 2 bits are linked; ``component_id`` is the smallest doc_id that is
    reached. A null or empty text has fingerprint zero and is linked like any other. A null doc_id is larger than all;
    a component of null ids has a null component_id. ``kept`` marks the row with the smallest doc_id of a component,
    that with the smallest place if several have it. An empty table gives no rows. Other columns are not read. ``row`` is
    the row's file and number there; what is not a scan of files is written first.
    """
    rows = shared.stored(fingerprints(docs))
    entry = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    points = shared.stored(rows.groupBy("fp").agg(F.min(entry).alias("first")))
    labels = components.components(links(points.select("fp")))
    grouped = points.join(labels, points["fp"] == labels["node"], "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    smallest = grouped.groupBy("label").agg(F.min("first").alias("keep"))
    found = shared.stored(grouped.join(smallest, "label").select("fp", "keep"))
    return rows.join(found, "fp").select(
        "doc_id",
        "row",
        "fp",
        F.col("keep.doc_id").alias("component_id"),
        (F.col("keep.row") == F.col("row")).alias("kept"),
    )


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns as they were.

    Nulls, empty texts, ties and repeated rows are as ``near_copies`` says: of repeated rows one stays, and one of all
    rows without words. An empty table stays empty.
    """
    docs = shared.scan(docs)
    return dedup.rows_kept(docs, near_copies(docs))
