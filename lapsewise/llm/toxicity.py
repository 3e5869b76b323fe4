"""Toxic spans of texts by a linear-chain conditional random field, and what they say of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.llm import fingerprint, sampling, shared, spans
from lapsewise.llm.chain import Chain, Words, train

#: Labelled rows that the field is fitted on, at most (about; chosen by a hash of doc_id) of either label, and code
#: points of a row that can be among them. Every row is scored whole.
SAMPLE_TOXIC = 1000
SAMPLE_CLEAN = 1500
SAMPLE_CHARS = 20_000
#: A word is a toxic token where toxic documents have it this many times as often as clean ones, and so much likelier
#: than chance (log-likelihood ratio) that of all words this many would get there by chance. Documents are counted over
#: all labelled rows; the model lists so many words, the most telling ones.
LEAST_RATIO = 20.0
BY_CHANCE = 0.1
LIST_WORDS = 20_000
#: Orders of shingles whose smallest ones tell near copies.
ORDERS = 4
REJECT = 0.7
TOKEN = 0.5


@dataclass
class Model:
    field: Chain
    #: Weights of the document's measures, the constant last.
    document: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN,
        chars: int = SAMPLE_CHARS) -> Model | None:
    """A model from texts of rows that are not held out and their ``labels`` (doc_id, toxic); None without both kinds.

    Labels are of documents: tokens are labelled first, toxic where the word tells of toxic documents and stands in one.
    Which words tell is counted over all labelled rows, whole texts, of near copies one; the field is fitted on a bounded
    sample of them. Several labels of a document count as toxic if one is; null labels and null texts do not count.
    """
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~sampling.held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    of_all = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = sampling.bounded(marked.where("toxic = 1"), "doc_id", toxic, 5).unionByName(
        sampling.bounded(marked.where("toxic = 0"), "doc_id", clean, 5)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.col("text").isNotNull() & (F.length("text") <= chars))
    # the sample is bounded by its parameters, so it is small enough to be sent to all
    sample = sorted(tuple(r) for r in texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect())
    sample = [s for s, new in zip(sample, _unlike([t for _, t, _ in sample]), strict=True) if new]
    truth = np.array([t for _, _, t in sample], np.int64)
    if not 0 < truth.sum() < len(truth):
        return None
    counts, rows = _counts(docs, marked)
    # each half is measured by a field and by words of the other half, so that the scores hold for texts not learned from
    half = (_least(pa.array([t for _, t, _ in sample], pa.string()))[:, 0] & np.uint64(1)).astype(np.int64)
    measures = np.zeros((len(truth), 5))
    for k in (0, 1):
        if (half == k).any():
            field = _field([t for (_, t, _), h in zip(sample, half, strict=True) if h != k], truth[half != k], _telling(counts, rows, [1 - k]))
            words = Words.of(pa.array([t for (_, t, _), h in zip(sample, half, strict=True) if h == k], pa.string()))
            measures[half == k] = _measures(field, words)[0]
    # each kind counts as often as among all labelled rows
    share = np.array([of_all.get(0, 1) / max(1, (truth == 0).sum()), of_all.get(1, 1) / max(1, (truth == 1).sum())])
    field = _field([t for _, t, _ in sample], truth, _telling(counts, rows, [0, 1]))
    return Model(field, _logistic(measures, truth, share[truth]))


def _field(texts: list[str], truth: np.ndarray, telling: np.ndarray) -> Chain:
    """A field of toxic tokens from documents' labels and the words that tell of them."""
    words = Words.of(pa.array(texts, pa.string()))
    told = np.isin(words.hashes(), telling)
    of_word = (told[words.which] & (truth[words.text_of()] == 1)).astype(np.int64)
    return train(words, of_word, [0, 1], [telling])


def _least(column: pa.Array) -> np.ndarray:
    """Of each text its smallest shingle in each of a few orders, which near copies share; zeros if it has no words."""
    hashed, text = fingerprint.shingles(column)
    first = np.searchsorted(text, np.arange(len(column)))
    has = np.bincount(text, minlength=len(column)) > 0
    least = np.zeros((len(column), ORDERS), np.uint64)
    if has.any():
        for k in range(ORDERS):
            turned = spans.mixed(hashed ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
            least[has, k] = np.minimum.reduceat(turned, first[has])
    return least


def _unlike(texts: list[str | None]) -> list[bool]:
    """Which texts of the sample share none of their smallest shingles with a text before them; without words none does."""
    kept = []
    seen: set = set()
    for row in _least(pa.array(texts, pa.string())).tolist():
        own = set(enumerate(row)) if any(row) else set()
        kept.append(not own & seen)
        seen |= own
    return kept


def _labelled(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Place, label and half of each labelled row of ``docs``, of those that share a smallest shingle only the first.

    The half is drawn by a text's shingles, so that copies are in one. Texts without words share nothing.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, 3):
                least = _least(part.column(3)).view(np.int64)
                has = least.any(1)
                ends = np.concatenate([[0], np.cumsum(has * ORDERS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(least[has].ravel()))
                yield pa.record_batch([*part.columns[:3], lists], names=["file", "at", "doc_id", "least"])

    slim = docs.select(shared.place(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = slim.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~sampling.held_out(F.col("doc_id")))
    found = slim.select("row.*", "doc_id", "text").mapInArrow(sketched, "file long, at long, doc_id long, least array<long>")
    found = shared.stored(found.join(marked, "doc_id"))
    # rows of one shingle meet in sums and joins that split, never in one task
    keys = found.select(F.struct("doc_id", "file", "at").alias("row"), F.posexplode("least").alias("nth", "key"))
    firsts = keys.groupBy("nth", "key").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = keys.join(firsts, ["nth", "key"]).where(F.col("row") > F.col("first")).select("row.*").distinct()
    kept = found.join(later, ["doc_id", "file", "at"], "left_anti")
    return kept.select("file", "at", "toxic", F.coalesce(F.get("least", F.lit(0)).bitwiseAND(F.lit(1)), F.lit(0)).cast("int").alias("half"))


def _counts(docs: DataFrame, marked: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Documents that have each word (its hash), by label and half, ``n00`` to ``n11``; and all documents so."""
    shared.shipped(docs.sparkSession)
    docs = shared.scan(docs)
    labelled = shared.stored(_labelled(docs, marked))
    rows = np.zeros((2, 2))
    for r in labelled.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect():
        rows[r["toxic"], r["half"]] = r["n"]
    names = [f"n{t}{h}" for t in (0, 1) for h in (0, 1)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, 0):
                words = Words.of(part.column(0))
                kind = part.column(1).to_numpy().astype(np.int64) * 2 + part.column(2).to_numpy()
                pairs = np.unique(words.which.astype(np.int64) * part.num_rows + words.text_of())
                which, kind = pairs // part.num_rows, kind[pairs % part.num_rows]
                n = len(words.spelled_at) - 1
                by_kind = [pa.array(np.bincount(which[kind == k], minlength=n).astype(np.int64)) for k in range(4)]
                yield pa.record_batch([pa.array(words.hashes().view(np.int64)), *by_kind], names=["word", *names])

    texts = docs.select(shared.place(docs).alias("row"), F.col("text").cast("string").alias("text")).select("row.*", "text")
    texts = texts.join(labelled, ["file", "at"]).select("text", "toxic", "half")
    found = texts.mapInArrow(counted, ", ".join(f"{name} long" for name in ["word", *names]))
    return shared.stored(found.groupBy("word").agg(*[F.sum(name).alias(name) for name in names])), rows


def _telling(counts: DataFrame, rows: np.ndarray, halves: list[int], most: int = LIST_WORDS) -> np.ndarray:
    """Hashes, sorted, of the words that tell of toxic documents by the documents of some halves that have them."""
    clean, toxic = (float(n) for n in rows[:, halves].sum(1))
    if not clean or not toxic:
        return np.zeros(0, np.uint64)
    had = lambda t: sum((F.col(f"n{t}{h}") for h in halves), F.lit(0)).cast("double")
    found = counts.select("word", had(1).alias("a"), had(0).alias("b")).where("a + b > 0")
    n = found.count()
    both = (F.col("a") + F.col("b")) / (toxic + clean)
    part = lambda x, size: F.when(x > 0, x * F.log(x / (both * size))).otherwise(0.0)
    found = found.withColumn("gain", 2 * (part(F.col("a"), toxic) + part(F.col("b"), clean)))
    found = found.where((F.col("gain") >= float(2 * np.log(max(1, n) / BY_CHANCE))) & (F.col("a") / toxic >= LEAST_RATIO * (F.col("b") + 0.5) / clean))
    best = found.orderBy(F.desc("gain"), "word").limit(most).select("word").collect()
    return np.sort(np.array([r["word"] for r in best], np.int64).view(np.uint64))


def _measures(field: Chain, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: the surest token, the expected number of toxic tokens, of those that are listed, and their share.

    Also each word's probability and its document.
    """
    p = np.clip(field.marginals(words)[:, 1], 1e-6, 1 - 1e-6)
    text, n = words.text_of(), len(words.offsets) - 1
    listed = np.bincount(text, p * np.isin(words.hashes(), field.lists[0])[words.which], n)
    most = np.full(n, 1e-6)
    np.maximum.at(most, text, p)
    total = np.bincount(text, p, n)
    count = np.bincount(text, minlength=n)
    share = np.sqrt(total / np.maximum(count, 1))
    return np.stack([np.log(most / (1 - most)) / 5, np.log1p(total), np.log1p(listed), share, np.ones(n)], 1), p, text


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100, decay: float = 0.1) -> np.ndarray:
    """Weighted logistic regression by Newton's method, steps halved until they gain; ``decay`` holds all weights but the constant's."""
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], decay)
    hold[-1] = 1e-6
    value = lambda w: (weight * (y * (x @ w) - np.logaddexp(0, x @ w))).sum() - (hold * w * w).sum() / 2
    now = value(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - hold * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step, before = np.linalg.solve(bend, slope), now
        while (now := value(w + step)) < before and np.abs(step).max() > 1e-9:
            step = step / 2
        if now <= before:
            break
        w = w + step
    return w


def _score(model: Model | None, column: pa.Array) -> tuple[np.ndarray, Words | None, np.ndarray, np.ndarray]:
    """Scores of texts, their words, each word's text and toxic probability."""
    n = len(column)
    if model is None:
        return np.zeros(n), None, np.zeros(0, np.int64), np.zeros(0)
    words = Words.of(column)
    x, p, text = _measures(model.field, words)
    return 1 / (1 + np.exp(-np.clip(x @ model.document, -30, 30))), words, text, p


def _spans(words: Words | None, text: np.ndarray, p: np.ndarray, n: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n)]
    toxic = np.flatnonzero(p >= TOKEN)
    if words is None or len(toxic) == 0:
        return out
    edge = np.concatenate([[True], (np.diff(toxic) != 1) | (np.diff(text[toxic]) != 0)])
    first = toxic[edge]
    last = toxic[np.concatenate([edge[1:], [True]])]
    begins, ends = words.code_points(words.starts[first], text[first]), words.code_points(words.ends[last], text[first])
    for k, (t, a, b) in enumerate(zip(text[first].tolist(), begins.tolist(), ends.tolist(), strict=True)):
        out[t].append({"start": a, "end": b, "score": float(p[first[k] : last[k] + 1].max())})
    return out


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, ``score`` (0 to 1), ``predicted`` (1 from 0.7 on) and ``spans``.

    ``spans`` lists the runs of toxic words: start, end (code points) and the surest word's probability. The score
    depends on the whole text alone. Null and empty texts get the score of a text without toxic words and no spans;
    without a model all scores are 0. Only doc_id and text are read; repeated rows are scored alike; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    shared.shipped(spark)
    handed = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch):
                values, words, text, p = _score(handed.value, part.column(1))
                found = _spans(words, text, p, part.num_rows)
                yield pa.record_batch(
                    [part.column(0), pa.array(values), pa.array((values >= REJECT).astype(np.int32)), pa.array(found, kind)],
                    names=["doc_id", "score", "predicted", "spans"],
                )

    slim = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    schema = "doc_id long, score double, predicted int, spans array<struct<start: long, end: long, score: double>>"
    return slim.mapInArrow(scored, schema)


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` with a score under 0.7, all columns as they were; texts are not shuffled.

    Null and empty texts stay unless a text without toxic words is rejected; repeated rows stay or go together; without
    a model all rows stay. An empty table stays empty.
    """
    spark = docs.sparkSession
    shared.shipped(spark)
    handed = spark.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, text):
                yield part.filter(pa.array(_score(handed.value, part.column(text))[0] < REJECT))

    return docs.mapInArrow(kept, docs.schema)
