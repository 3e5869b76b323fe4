"""Runs against brute force over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from odd_tables import no_docs, odd_docs, odd_rows, split_words, table  # noqa: F401

from lapsewise.llm import periodic, queries


def brute_runs(words):
    """(start, length, period) of every run: the smallest period, at least 6 words and 4 periods, as long as can be."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                start, length = i, j - i + q
                part = words[start : start + length]
                smallest = next(p for p in range(1, q + 1) if all(part[k] == part[k + p] for k in range(length - p)))
                if smallest == q and length >= max(6, 4 * q):
                    found.add((start, length, q))
            i = max(j, i + 1)
    return sorted(found)


def brute_collapsed(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def made(rng):
    """Words with repetitions inside repetitions, beside each other and overlapping."""
    words = []
    for _ in range(rng.randint(1, 6)):
        root = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.3:
            root = root * rng.randint(2, 6) + [rng.choice("xyz")]
        words += root * rng.randint(1, 7) + root[: rng.randint(0, len(root))]
        words += [rng.choice("abcdxyz") for _ in range(rng.randint(0, 4))]
    return words


def test_runs_of_random_words():
    rng = random.Random(4)
    texts = [made(rng) for _ in range(500)] + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 4 + ["a"], list("abcabcabcab")]
    texts += [[rng.choice("ab") for _ in range(rng.randint(0, 60))] for _ in range(500)]
    spellings = {w: k for k, w in enumerate("abcdxyz")}
    words = np.array([spellings[w] for t in texts for w in t], np.int64)
    bounds = np.cumsum([0, *map(len, texts)])
    got = {k: [] for k in range(len(texts))}
    for k, *run in periodic.runs_of(words, bounds).tolist():
        got[k].append(tuple(run))
    for k, text in enumerate(texts):
        assert got[k] == brute_runs(text), text


def test_long_runs_and_many_runs():
    words = np.concatenate([np.zeros(200_000, np.int64), np.tile(np.arange(1, 5001), 5), np.repeat(np.arange(6000, 26_000), 6)])
    runs = periodic.runs_of(words, np.array([0, len(words)])).tolist()
    assert runs[0] == [0, 0, 200_000, 1] and runs[1] == [0, 200_000, 25_000, 5000]
    assert runs[2:] == [[0, 225_000 + 6 * k, 6, 1] for k in range(20_000)]


def test_odd_tables(spark, odd_docs, no_docs):
    got = sorted((repr(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.runs(odd_docs).collect())
    want = []
    for doc_id, text, *_ in odd_rows():
        words = split_words(text)
        runs = [(0, 30_000, 1)] if len(words) > 20_000 else brute_runs(words)
        want.append((repr(doc_id), len(words), runs, brute_collapsed(words, runs)))
    assert got == sorted(want)
    assert periodic.runs(no_docs).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents as tables hold them, with clashing columns, null ids and repetitions of their own."""
    rng = random.Random(9)
    rows = odd_rows(n=150) + [(7000 + k, " ".join(made(rng)), None, None) for k in range(150)]
    place = tmp_path_factory.mktemp("periodic")
    table(spark, rows, True).write.parquet(f"{place}/documents.parquet")
    return str(place), rows


def test_query(spark, folder):
    place, rows = folder
    want, edited = [], 0
    for doc_id, text, *_ in rows:
        words = split_words(text)
        n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            edited += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = [(0, 30_000, 1)] if len(words) > 20_000 and len(set(words)) == 2 else brute_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        shas = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, brute_collapsed(words, runs))]
        most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *most, *shas))
    got = [tuple(r) for r in queries.op11_periodic(spark, place).collect()]
    assert edited > 10 and sum(w[1] for w in want) > 100
    assert sorted(got, key=repr) == sorted(want, key=repr)
