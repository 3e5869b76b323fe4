"""Language of texts that may switch languages: each word labelled by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.llm import sampling, shared, spans
from lapsewise.llm.chain import Chain, Words, train

#: Labelled rows that the field is fitted on, at most (about; chosen by a hash of doc_id), and code points of a row that
#: can be among them. Languages share the rows evenly, what a rare one leaves goes to the others; each may have so many
#: rows in any case. Every row is labelled whole.
SAMPLE_ROWS = 1500
SAMPLE_EACH = 100
SAMPLE_CHARS = 20_000
#: Languages that are learned, the most frequent ones: labels beyond these are taken for errors.
LANGUAGES = 256
#: Words of a stretch in one language when labelled texts are dealt into training sequences that switch.
STRETCH = 25
#: Telling words kept for each language.
LIST_WORDS = 2000
UNKNOWN = "und"


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Chain | None:
    """A field learned from text and lang of rows that are not held out; None if there are none.

    Labels are of whole texts. Null texts, null labels and labels beyond the ``LANGUAGES`` most frequent ones (ties by
    name) are not learned from; repeated rows count each for itself. So that the field learns transitions, texts are cut into stretches of words, and
    stretches of all languages are dealt into training sequences in random order (a fixed seed).
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~sampling.held_out(F.col("doc_id")))
    known = known.where(F.length("text") <= chars)
    of_each = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in of_each.collect()}
    if not counts:
        return None
    most = max(_even(list(counts.values()), rows), SAMPLE_EACH)
    sample = sorted(tuple(r) for r in sampling.bounded_each(known, "lang", counts, "doc_id", most, 4).select("doc_id", "lang", "text").collect())
    labels = sorted({lang for _, lang, _ in sample})
    if not labels:
        return None
    pieces, truth = [], []
    for _, lang, text in sample:
        words = text.split()
        for low in range(0, len(words), STRETCH):
            pieces.append(" ".join(words[low : low + STRETCH]))
            truth.append(labels.index(lang))
    order = np.random.default_rng(4).permutation(len(pieces))
    words = Words.of(pa.array([pieces[i] for i in order], pa.string()))
    of_word = np.array(truth, np.int64)[order][words.text_of()] if len(order) else np.zeros(0, np.int64)
    return train(words, of_word, labels, _lists(words, of_word, len(labels)), joined=True)


def _even(counts: list[int], rows: int) -> int:
    """The largest number such that at most ``rows`` are taken if each kind gives that many or all it has."""
    left = len(counts)
    for n in sorted(counts):
        if n * left >= rows:
            break
        rows, left = rows - n, left - 1
    return rows // left if left else max(counts)


def _lists(words: Words, truth: np.ndarray, labels: int) -> list[np.ndarray]:
    """For each label the words that tell most for it: the largest gain in log-likelihood over their share elsewhere."""
    hashes = words.hashes()
    counts = np.stack([np.bincount(words.which[truth == c], minlength=len(hashes)) for c in range(labels)], 1)
    share = (counts + 0.5) / (counts.sum(0) + 1)
    lists = []
    for c in range(labels):
        others = (counts.sum(1) - counts[:, c] + 0.5) / (counts.sum() - counts[:, c].sum() + 1)
        gain = counts[:, c] * np.log(share[:, c] / others)
        best = np.argsort(-gain, kind="stable")[:LIST_WORDS]
        lists.append(np.sort(hashes[best[gain[best] > 0]]))
    return lists


def identify(docs: DataFrame, model: Chain | None, with_spans: bool = False) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, ``lang_pred``, ``score``; with ``with_spans`` also ``spans``.

    The prediction is the label with the largest share of the words' probabilities in the whole text, the score that
    share. ``spans`` lists the text's runs of words of one language: start, end (code points), lang. A text that is
    null or has no letters, or any text without a model, is ``und`` with score 0 and no spans. Ties go to the first label
    in order. Only doc_id and text are read; repeated rows are labelled alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared.shipped(spark)
    handed = spark.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = handed.value
        for batch in batches:
            for part in spans.chunks(batch):
                lettered = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                n = part.num_rows
                names, scores, runs = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
                if field is not None:
                    words = Words.of(part.column(1))
                    found = field.marginals(words)
                    text = words.text_of()
                    mass = np.stack([np.bincount(text, found[:, c], n) for c in range(len(field.labels))], 1)
                    share = mass / np.maximum(mass.sum(1, keepdims=True), 1e-12)
                    best = share.argmax(1)
                    seen = lettered & (mass.sum(1) > 0)
                    names = [field.labels[b] if s else UNKNOWN for b, s in zip(best, seen, strict=True)]
                    scores = np.where(seen, np.clip(share.max(1), 0, 1), 0.0)
                    if with_spans and len(text):
                        runs = _runs(words, text, found.argmax(1), field.labels, n)
                columns = [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                if with_spans:
                    columns.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                yield pa.record_batch(columns, names=["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    schema = "doc_id long, lang_pred string, score double"
    return slim.mapInArrow(predicted, schema + (", spans array<struct<start: long, end: long, lang: string>>" if with_spans else ""))


def _runs(words: Words, text: np.ndarray, label: np.ndarray, labels: list, n: int) -> list[list[dict]]:
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(label) != 0)]))
    last = np.concatenate([edge[1:], [len(text)]]) - 1
    begins, ends = words.code_points(words.starts[edge], text[edge]), words.code_points(words.ends[last], text[edge])
    out: list[list[dict]] = [[] for _ in range(n)]
    for t, c, a, b in zip(text[edge].tolist(), label[edge].tolist(), begins.tolist(), ends.tolist(), strict=True):
        out[t].append({"start": a, "end": b, "lang": labels[c]})
    return out
