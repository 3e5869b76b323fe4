"""Conditional random fields: exact inference, language and toxicity on small learnable corpora."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from odd_tables import no_docs, odd_docs, odd_rows, table  # noqa: F401

from lapsewise.llm import chain, langid, sampling, toxicity
from lapsewise.llm.chain import SEQUENCE, Words, forward_backward


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    scores, step = rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    which = np.array([0, 1, 2, 3, 4, 5, 1, 0])
    first, length = np.array([0, 5]), np.array([5, 3])
    found, pairs = forward_backward(scores.astype(np.float32), which, first, length, step.astype(np.float32))
    want, want_pairs = np.zeros((8, 3)), np.zeros((3, 3))
    for low, n in zip(first, length, strict=True):
        total, at, two = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(scores[which[low + t], c] for t, c in enumerate(path)) + sum(step[a, b] for a, b in itertools.pairwise(path)))
            total += p
            for t, c in enumerate(path):
                at[t, c] += p
            for a, b in itertools.pairwise(path):
                two[a, b] += p
        want[low : low + n] = at / total
        want_pairs += two / total
    assert np.allclose(found, want, atol=1e-5) and np.allclose(pairs, want_pairs, atol=1e-4)


def test_long_texts_are_one_chain(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcde") for _ in range(n)) for n in (0, 1, 2, 7, 8, 9, 15, 16, 17, 100, 1, 64)] + [None, "5"]
    field = chain.Chain([0, 1, 2], np.zeros((chain.BUCKETS + 1, 3), np.float32), np.zeros((0, 3), np.float32), [], np.zeros(0, np.uint64), np.zeros(3, np.float32), np.zeros((3, 3), np.float32))
    draw = np.random.default_rng(8)
    scores = draw.normal(scale=3, size=(5, 3)).astype(np.float32)
    field.transitions[...] = draw.normal(scale=3, size=(3, 3))
    monkeypatch.setattr(chain.Chain, "_in_lists", lambda self, hashes: np.zeros((len(hashes), 0), np.float32))
    monkeypatch.setattr(chain.Chain, "scores", lambda self, words: scores)
    words = Words.of(pa.array(texts, pa.string()))
    whole = field.marginals(words)
    for size in (1, 2, 8, 50):
        monkeypatch.setattr(chain, "SEQUENCE", size)
        assert np.allclose(field.marginals(words), whole, atol=2e-5), size
    monkeypatch.setattr(chain, "SEQUENCE", 10_000)
    assert np.allclose(field.marginals(words), whole, atol=2e-5)


def test_words_places_and_sequences():
    texts = ["Été, là!", None, "", "12 3", "x" + " y" * (2 * SEQUENCE)]
    words = Words.of(pa.array(texts, pa.string()))
    text = words.text_of()
    begins, ends = words.code_points(words.starts, text), words.code_points(words.ends, text)
    got = [texts[t][a:b].lower() for t, a, b in zip(text, begins, ends, strict=True)]
    assert got[:3] == ["été", "là", "x"] and set(got[3:]) == {"y"}
    first, length = words.sequences()
    assert length.tolist() == [2, SEQUENCE, SEQUENCE, 1] and first.tolist() == [0, 2, 2 + SEQUENCE, 2 + 2 * SEQUENCE]


SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["schr", "ung", "eit"], "cc": ["eau", "oux", "ère"]}


def speech(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(4)
    rows = []
    for k in range(240):
        lang = rng.choice(list(SYLLABLES))
        rows.append((k, speech(rng, lang, rng.randint(5, 60)), lang, None))
    return rows


def test_language_of_held_out_and_switching_texts(spark, spoken):
    mixed = speech(random.Random(9), "aa", 20) + " " + speech(random.Random(8), "bb", 40)
    extra = [(900, None, "aa", None), (901, "12 -- !", "aa", None), (902, "", None, None), (903, mixed, None, None), (903, mixed, None, None), (None, mixed, None, None)]
    docs = table(spark, spoken + extra)
    model = langid.fit(docs)
    rows = langid.identify(docs, model, with_spans=True).collect()
    lang = {d: code for d, _, code, _ in spoken}
    assert len(rows) == len(spoken) + len(extra)
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows if r.doc_id in lang]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
        if r.doc_id == 903:
            assert r.lang_pred == "bb" and 0.5 < r.score < 0.9
            border = mixed.index(" ", len(speech(random.Random(9), "aa", 20)))
            assert [s.lang for s in r.spans] == ["aa", "bb"] and abs(r.spans[0].end - border) < 40


def test_a_rare_language_is_learned(spark):
    rng = random.Random(7)
    # 8 of 40,000 rows: 0.02%
    rows = [(k, speech(rng, "cc" if k % 5000 == 0 else "aa" if k % 3 else "bb", 12), "cc" if k % 5000 == 0 else "aa" if k % 3 else "bb", None) for k in range(40_000)]
    docs = table(spark, rows)
    model = langid.fit(docs, rows=300)
    assert model.labels == ["aa", "bb", "cc"]
    new = table(spark, [(1, speech(rng, "cc", 30), None, None), (2, speech(rng, "aa", 30), None, None)])
    assert {r.doc_id: r.lang_pred for r in langid.identify(new, model).collect()} == {1: "cc", 2: "aa"}
    assert langid._even([8, 20_000, 20_000], 308) == 150 and langid._even([1, 2], 10) == 2


def test_language_learns_from_no_held_out_row(spark, spoken):
    docs = table(spark, spoken)
    turned = docs.withColumn("lang", __import__("pyspark").sql.functions.expr("case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 'zz' else lang end"))
    assert langid.fit(turned).labels == sorted(SYLLABLES)
    assert (langid.fit(turned).weights == langid.fit(docs).weights).all()


def test_no_labels_no_language(spark, odd_docs, no_docs):
    nothing = langid.fit(table(spark, [(1, "text", None, None)]))
    assert nothing is None and langid.fit(no_docs) is None
    assert {r.lang_pred for r in langid.identify(odd_docs, None).collect()} == {"und"}
    assert langid.identify(odd_docs, langid.fit(odd_docs)).count() == len(odd_rows())
    assert langid.identify(no_docs, None).count() == 0


@pytest.fixture(scope="module")
def rude(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        words = speech(rng, rng.choice(list(SYLLABLES)), rng.randint(10, 60)).split()
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randint(0, len(words)), rng.choice(["Foo!", "bar", "BAZ"]))
        rows.append((k, " ".join(words), "aa", None))
        labels.append((k, 0, int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_on_held_out_rows(spark, rude):
    rows, labels = rude
    docs = table(spark, rows + [(900, None, None, None), (901, "", None, None), (902, "kalo, foo kamilo", None, None), (None, "mimi bar", None, None)])
    marked = spark.createDataFrame(labels + [(None, 1, 1), (902, None, None), (12345, 0, 1)], LABELS)
    model = toxicity.fit(docs, marked)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = {r.doc_id for r in docs.where(sampling.held_out(docs.doc_id)).collect()}
    right = [found[d].predicted == t for d, _, t in labels if d in held]
    assert len(right) > 80 and np.mean(right) > 0.97
    assert all(found[d].predicted == 0 and found[d].spans == [] for d in (900, 901))
    (span,) = found[902].spans
    assert (span.start, span.end) == (6, 9) and found[902].predicted == 1
    kept = toxicity.without_toxic(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {d for d, r in found.items() if not r.predicted}


def test_toxicity_without_labels_keeps_all(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.fit(odd_docs, none) is None
    assert {(r.score, r.predicted) for r in toxicity.score(odd_docs, None).collect()} == {(0.0, 0)}
    kept = toxicity.without_toxic(odd_docs, None)
    assert kept.schema == odd_docs.schema and kept.count() == len(odd_rows())
    assert toxicity.score(no_docs, None).count() == 0


def test_words_are_counted_over_all_labelled_rows(spark, rude, odd_docs):
    rows, labels = rude
    # copies and a row without a label count no further; a long text counts whole
    long = " ".join(["kalo"] * 9000 + ["lomi", "endwort"])
    more = [(2000 + k, rows[0][1], "aa", None) for k in range(50)] + [(3000, "endwort", None, None), (3002, long, None, None), (3003, None, None, None), (None, "bar", None, None)]
    marked = labels + [(d, 0, 1) for d, *_ in more if d != 3000] + [(0, 0, None), (0, 0, labels[0][2])]
    docs = table(spark, rows + more, clashing=True)
    held = {r.doc_id for r in docs.where(sampling.held_out(docs.doc_id)).collect()}
    toxic = {}
    for d, _, t in marked:
        if d is not None and t is not None and d not in held:
            toxic[d] = max(t, toxic.get(d, 0))
    texts = sorted((d, t) for d, t, *_ in rows + more if d in toxic and t is not None)
    seen, want, size = set(), {}, [0, 0]
    for d, t in texts:
        if t in seen:
            continue
        seen.add(t)
        size[toxic[d]] += 1
        for w in set(re.findall(r"[^\W\d_]+", t.lower())):
            want.setdefault(w, [0, 0])[toxic[d]] += 1
    kinds = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    counts, of_rows = toxicity._counts(docs, kinds)
    assert of_rows.sum(1).tolist() == size
    spelled = Words.of(pa.array([" ".join(want)], pa.string()))
    names = [bytes(spelled.spelled[a:b]).decode() for a, b in itertools.pairwise(spelled.spelled_at)]
    of_hash = dict(zip(spelled.hashes().view(np.int64).tolist(), names, strict=True))
    got = {of_hash[r.word]: [r.n00 + r.n01, r.n10 + r.n11] for r in counts.collect()}
    assert got == want and "endwort" in got
    told = {of_hash[h] for h in toxicity._telling(counts, of_rows, [0, 1]).view(np.int64).tolist()}
    assert {"foo", "bar", "baz"} <= told <= {"foo", "bar", "baz"} | {w for w, (a, b) in want.items() if a > 5 and not b}
    assert len(toxicity._telling(counts, of_rows, [0, 1], most=2)) == 2
    kinds = kinds.withColumn("toxic", kinds.toxic * 0)
    assert len(toxicity._telling(*toxicity._counts(odd_docs, kinds), [0, 1])) == 0


def test_texts_without_words_are_no_copies(spark):
    texts = ["", " ", "", "foo bar", "foo bar", None]
    kept = [k for k in range(100) if zlib.crc32(str(k).encode()) % 3 != 1][: len(texts)]
    docs = table(spark, [(d, t, None, None) for d, t in zip(kept, texts, strict=True)])
    kinds = spark.createDataFrame([(d, k % 2) for k, d in enumerate(kept)], "doc_id long, toxic int")
    counts, of_rows = toxicity._counts(docs, kinds)
    assert of_rows.sum(1).tolist() == [2, 2]
    assert sorted((r.n00 + r.n01, r.n10 + r.n11) for r in counts.collect()) == [(0, 1), (0, 1)]


def test_a_word_that_the_sample_misses_is_told(spark, rude):
    rows, labels = rude
    rng = random.Random(12)
    # one toxic row in ten has the word; the sample of 30 toxic rows has it about three times, all rows have it often enough
    more = [(5000 + k, speech(rng, "aa", 12) + (" rarum" if k % 10 == 0 else " foo"), None, None) for k in range(600)]
    docs = table(spark, rows + more)
    marked = spark.createDataFrame(labels + [(d, 0, 1) for d, *_ in more], LABELS)
    model = toxicity.fit(docs, marked, toxic=30, clean=60)
    new = table(spark, [(1, speech(rng, "bb", 20) + " rarum", None, None), (2, speech(rng, "bb", 20), None, None)])
    found = {r.doc_id: r for r in toxicity.score(new, model).collect()}
    assert found[1].score > found[2].score and found[2].predicted == 0


def test_document_weights_are_the_best_ones():
    rng = np.random.default_rng(3)
    # most rows with label 1, measures nearly constant where nothing is found: full steps would swing
    y = np.repeat([1, 1, 0], [25, 6, 60])
    x = np.stack([np.where(np.arange(91) < 25, 1.5, -2.75) + rng.normal(scale=0.01, size=91), np.where(np.arange(91) < 25, 0.7, 0), np.ones(91)], 1)
    weight = np.where(y == 1, 14.6, 3.4)
    w = toxicity._logistic(x, y, weight)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (weight * (y - p)) - np.array([0.1, 0.1, 1e-6]) * w).max() < 1e-3
    # where nothing is found, the share of label 1 by weight
    assert abs(p[y == 0].mean() - 6 * 14.6 / (6 * 14.6 + 60 * 3.4)) < 0.02
