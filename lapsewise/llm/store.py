"""Token ids in files: Re-Pair grammar compression by shard, with random access.

A shard is a run of whole documents in ascending doc_id. Frequent pairs of neighbouring symbols are replaced by new
symbols, round after round, most frequent first, until none is left; within a round, pairs are chosen so that no two can
overlap, and a pair of equal symbols is replaced from left to right. A shard
keeps its rules, how many ids each symbol expands to, and the symbols that remain, two bytes each. The sums of expanded
lengths find the symbol in which any document or id begins, so that a document is decoded without what stands before it.

Shards are rows of Parquet files, written by Spark's own committer: a lost task's output is written again or not at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.llm import bpe, shared, spans

#: Ids of a shard, about; a longer document is a shard of its own.
SHARD_IDS = 1 << 20
#: Times a pair must be there, without overlap, to be replaced.
LEAST = 16
#: Symbols are two bytes: ids of the shard and rules together.
SYMBOLS = 1 << 16

_TABLE_BITS = 20


def _alternate(at: np.ndarray) -> np.ndarray:
    """Which of some ascending places are taken if neighbours exclude each other: every other one of a run."""
    edge = np.concatenate([[True], np.diff(at) != 1])
    first = np.flatnonzero(edge)
    return (np.arange(len(at)) - first[np.cumsum(edge) - 1]) % 2 == 0 if len(at) else np.zeros(0, bool)


def _frequent(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours (left * SYMBOLS + right) that are there ``least`` times or more, and how often.

    A table of hashed counts, none of which is below the true count, leaves few pairs to count exactly.
    """
    keys = x[:-1].astype(np.uint32) * np.uint32(SYMBOLS) + x[1:]
    slot = (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - _TABLE_BITS)
    counts = np.bincount(slot, minlength=1 << _TABLE_BITS)
    maybe = np.sort(keys[counts[slot] >= least])
    if len(maybe) == 0:
        return maybe, maybe
    edge = np.flatnonzero(np.concatenate([[True], maybe[1:] != maybe[:-1]]))
    number = np.diff(np.append(edge, len(maybe)))
    # equal symbols are counted as they would be replaced
    alike = np.flatnonzero(maybe[edge] >> np.uint32(16) == maybe[edge] & np.uint32(SYMBOLS - 1))
    if len(alike):
        at = np.flatnonzero(x[:-1] == x[1:])
        number[alike] = np.bincount(x[at[_alternate(at)]], minlength=SYMBOLS)[maybe[edge[alike]] & np.uint32(SYMBOLS - 1)]
    often = number >= least
    return maybe[edge[often]], number[often]


def _apart(keys: np.ndarray, counts: np.ndarray, room: int) -> np.ndarray:
    """The most frequent pairs such that no symbol is left in one and right in another, ``room`` at most; sorted."""
    lefts, rights, chosen = set(), set(), []
    for key in keys[np.argsort(-counts, kind="stable")].tolist():
        a, b = divmod(key, SYMBOLS)
        if a not in rights and b not in lefts and (a != b or (a not in lefts and a not in rights)):
            lefts.add(a)
            rights.add(b)
            chosen.append(key)
            if len(chosen) == room:
                break
    return np.sort(np.array(chosen, np.uint32))


def compress(ids: np.ndarray, least: int = LEAST) -> dict[str, np.ndarray]:
    """The grammar of ``ids``: ``terminals``, ``rules`` (pairs of symbols), ``lengths`` (ids of each symbol), ``symbols``.

    Symbols up to the number of terminals are places in ``terminals``; the others are rules in order, each of symbols
    before it.
    """
    terminals, x = np.unique(ids, return_inverse=True)
    if len(terminals) > SYMBOLS:
        raise ValueError("a shard may hold 65,536 different ids")
    x = x.astype(np.uint16)
    rules = [np.zeros((0, 2), np.uint16)]
    lengths = [np.ones(len(terminals), np.int64)]
    size = len(terminals)
    while size < SYMBOLS and len(x) >= 2:
        keys, counts = _frequent(x, least)
        chosen = _apart(keys, counts, SYMBOLS - size)
        if len(chosen) == 0:
            break
        pair = np.stack([chosen >> np.uint32(16), chosen & np.uint32(SYMBOLS - 1)], 1).astype(np.uint16)
        known = np.concatenate(lengths)
        rules.append(pair)
        lengths.append(known[pair].sum(1))
        left, right = np.zeros(SYMBOLS, bool), np.zeros(SYMBOLS, bool)
        left[pair[:, 0]] = right[pair[:, 1]] = True
        at = np.flatnonzero(left[x[:-1]] & right[x[1:]])
        key = x[at].astype(np.uint32) * np.uint32(SYMBOLS) + x[at + 1]
        place = np.minimum(np.searchsorted(chosen, key), len(chosen) - 1)
        hit = chosen[place] == key
        at, place = at[hit], place[hit]
        taken = _alternate(at)
        at, place = at[taken], place[taken]
        x[at] = (size + place).astype(np.uint16)
        stay = np.ones(len(x), bool)
        stay[at + 1] = False
        x = x[stay]
        size += len(chosen)
    return {
        "terminals": terminals.astype("<u4"),
        "rules": np.concatenate(rules).astype("<u2"),
        "lengths": np.concatenate(lengths).astype("<u4"),
        "symbols": x.astype("<u2"),
    }


def expansions(terminals: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all symbols in a row, and where each symbol's begin."""
    at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    out = np.empty(at[-1], np.uint32)
    n = len(terminals)
    out[:n] = terminals
    for k, (a, b) in enumerate(rules.tolist()):
        low = at[n + k]
        out[low : low + lengths[a]] = out[at[a] : at[a + 1]]
        out[low + lengths[a] : at[n + k + 1]] = out[at[b] : at[b + 1]]
    return out, at


def expand(grammar: dict[str, np.ndarray], low: int = 0, high: int | None = None) -> np.ndarray:
    """The ids from ``low`` to ``high`` (or the end); only the symbols that hold them are expanded."""
    lengths, symbols = grammar["lengths"], grammar["symbols"]
    pool, at = expansions(grammar["terminals"], grammar["rules"], lengths)
    ends = np.cumsum(lengths[symbols], dtype=np.int64)
    high = (int(ends[-1]) if len(ends) else 0) if high is None else high
    first, last = np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high, side="left") + 1
    part = symbols[first:last]
    sizes = lengths[part].astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    ids = pool[np.arange(sizes.sum()) + np.repeat(at[part] - begins, sizes)]
    skipped = int(ends[first - 1]) if first else 0
    return ids[low - skipped : high - skipped]


_PARTS = {"terminals": "<u4", "rules": "<u2", "lengths": "<u4", "symbols": "<u2"}
_SHARDS = pa.schema(
    [("part", pa.int64()), ("shard", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
     ("doc_lengths", pa.list_(pa.int64()))] + [(name, pa.binary()) for name in _PARTS]
)
SHARDS = (
    "part long, shard long, n_ids long, doc_ids array<long>, doc_lengths array<long>, "
    "terminals binary, rules binary, lengths binary, symbols binary"
)


def write(docs: DataFrame, vocabulary: str, path: str) -> None:
    """Writes the ids of all ``docs`` (doc_id, text) to a folder of shard files, in ascending doc_id.

    Each document ends with the end id; a null text is the end id alone. A null doc_id comes first; rows of one doc_id
    stand in order of a hash of their texts. Only doc_id and text are read. An empty table writes no shards.
    """
    shared.shipped(docs.sparkSession)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = bpe.encoder(vocabulary), TaskContext.get().partitionId()
        names, sizes, runs, held, number = [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            found = compress(np.concatenate(runs))
            values = [part, number, held, names, sizes, *(found[name].tobytes() for name in _PARTS)]
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, _SHARDS, strict=True)], schema=_SHARDS)

        for batch in batches:
            for piece in spans.chunks(batch):
                ids, at = encoder.encode(piece.column(1))
                for k, doc in enumerate(piece.column(0).to_pylist()):
                    names.append(doc)
                    sizes.append(int(at[k + 1] - at[k]))
                    runs.append(ids[at[k] : at[k + 1]])
                    held += sizes[-1]
                    if held >= SHARD_IDS:
                        yield row()
                        names, sizes, runs, held, number = [], [], [], 0, number + 1
        if held:
            yield row()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = slim.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(shards, SHARDS).write.parquet(path)


def _grammar(shard: dict) -> dict[str, np.ndarray]:
    found = {name: np.frombuffer(shard[name], kind) for name, kind in _PARTS.items()}
    return found | {"rules": found["rules"].reshape(-1, 2)}


def read(spark, path: str, with_ids: bool = False) -> DataFrame:
    """A row per stored document, from the files: doc_id, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids_crc32`` (of the ids as unsigned little-endian 32-bit numbers), and with ``with_ids`` the ``ids`` in that form.
    """
    shared.shipped(spark)
    stored = spark.read.schema(SHARDS).parquet(path)
    sizes = stored.groupBy("part", "shard").agg(F.sum("n_ids").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    # one row per partition of the writer, then one per shard of a partition
    earlier = Window.unboundedPreceding, -1
    before_part = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("before_part"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(*earlier)
    begins = sizes.select("part", "shard", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("before")).join(before_part, "part")
    begins = begins.select("part", "shard", (F.col("before") + F.col("before_part")).alias("first"))
    fields = [("part", pa.int64()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("inner", pa.int64()),
              ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in (row for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist()):
                ids = expand(_grammar(shard)).astype("<u4")
                at = np.concatenate([[0], np.cumsum(shard["doc_lengths"])]).astype(np.int64)
                content = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                n = len(content)
                values = [np.full(n, shard["part"]), np.full(n, shard["shard"]), shard["doc_ids"], at[:-1], np.diff(at), list(map(zlib.crc32, content))]
                values += [content] * with_ids
                yield pa.record_batch([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    kinds = "part long, shard long, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    found = stored.mapInArrow(documents, kinds).join(begins, ["part", "shard"])
    extra = ["ids"] if with_ids else []
    return found.select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *extra)


def one_document(shard: dict, doc_id: int) -> np.ndarray:
    """The ids of one document of a shard (a row of the files), without decoding the others."""
    at = np.concatenate([[0], np.cumsum(shard["doc_lengths"])])
    k = list(shard["doc_ids"]).index(doc_id)
    return expand(_grammar(shard), int(at[k]), int(at[k + 1]))
