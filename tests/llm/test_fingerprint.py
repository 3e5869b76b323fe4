"""Fingerprints against exact likeness of shingles."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from odd_tables import no_docs, odd_docs, odd_rows, split_words, table  # noqa: F401

from lapsewise.llm import fingerprint


def exact(one, other):
    def shingles(text):
        words = split_words(text)
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    a, b = shingles(one), shingles(other)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("words", [1, 4, 5, 12, 60, 700])
def test_likeness_is_near_the_exact_one(words):
    rng = random.Random(words)
    errors = []
    for _ in range(60):
        text = [f"w{rng.randrange(10_000)}" for _ in range(words)]
        kept = rng.randint(0, words)
        other = text[:kept] + [f"v{rng.randrange(10_000)}" for _ in range(words - kept)]
        a, b = " ".join(text), " ".join(other)
        found, empty = fingerprint.digits(pa.array([a, b]))
        near = fingerprint.likeness(found[:1], found[1:], empty[:1], empty[1:])[0]
        errors.append(near - exact(a, b))
    # few shingles borrow from few bins, which widens the spread but not the mean
    assert abs(np.mean(errors)) < 0.05
    assert np.std(errors) < (0.05 if words >= 60 else 0.2)


def test_texts_of_the_same_words_have_the_same_fingerprint():
    found, empty = fingerprint.digits(pa.array(["a b c d e f", "a  b\nc d e f", "", None, " \t"]))
    assert (found[0] == found[1]).all()
    assert empty.tolist() == [False, False, True, True, True] and not found[2:].any()


@pytest.mark.parametrize("rows", [8, 1024])
def test_edited_pairs(spark, odd_docs, monkeypatch, rows):
    monkeypatch.setattr(fingerprint, "STRETCH_ROWS", rows)
    order = sorted(((d, t or "") for d, t, *_ in odd_rows()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for k, (doc_id, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        want.append((str(doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    found = fingerprint.edited_pairs(odd_docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert all(len(r.fingerprint) == 512 == len(r.edited_fingerprint) for r in found)
    again = {(r.doc_id, r.fingerprint) for r in fingerprint.fingerprints(odd_docs).collect()}
    assert {(r.doc_id, r.fingerprint) for r in found} == again


def test_one_document_follows_itself_and_no_documents(spark, no_docs):
    (only,) = fingerprint.edited_pairs(table(spark, [(5, "abc def ghi", None, None)])).collect()
    assert only.near_next == 1.0 and only.edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest()
    assert fingerprint.edited_pairs(no_docs).count() == 0
