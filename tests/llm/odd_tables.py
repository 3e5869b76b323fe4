"""Odd tables of documents for the tests of this folder."""

import random
import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators might use themselves.
CLASHING = "row long, size long, copies int, slot int, stretch double, key long, col string, keep_id long, fp long, spans string"


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def table(spark, rows, clashing=False):
    """Rows (doc_id, text, lang, source) as a table of documents; with other columns whose names clash."""
    full = [(d, t, lang, s, len(t) if t is not None else None) for d, t, lang, s in rows]
    if not clashing:
        return spark.createDataFrame(full, DOCS)
    names = CLASHING.split(", ")
    extra = [(7, 8, 9, 1, 2.5, 3, "x", 4, 5, "y")] * len(full)
    return spark.createDataFrame([a + b for a, b in zip(full, extra, strict=True)], ", ".join([DOCS, *names]))


def odd_rows(seed=1, n=60):
    """Nulls in every column, empty and blank texts, ties, repeated rows, near copies and one very long text."""
    rng = random.Random(seed)
    vocabulary = ["der", "die", "das", "the", "and", "of", "été", "là", "x1", "Ärger", "a.b", "12", "<|endoftext|>", "'ll", "日本", "🙂"]
    rows = []
    for k in range(n):
        text = rng.choice([" ", "  ", "\n", "\t"]).join(rng.choices(vocabulary, k=rng.randint(1, 60)))
        rows.append((k * 3, text, rng.choice(["en", "de", None]), rng.choice(["b", "a", "é", None])))
    base = " ".join(rng.choices(vocabulary, k=300))
    rows += [
        (1000, base, "en", "a"),
        (1001, base, "en", "b"),
        (1002, base.replace(" ", "  \n"), "de", "a"),
        (1003, base + " end", "de", "a"),
        (1000, base, "en", "a"),
        (None, base, None, None),
        (None, None, None, None),
        (1010, None, "en", "a"),
        (1011, "", "en", "a"),
        (1012, " \t\r\n", None, "a"),
        (1013, "long " * 30_000 + "tail", "en", "a"),
        (1014, "\x00 zero \u0085 next space", "en", "b"),
    ]
    rng.shuffle(rows)
    return rows


@pytest.fixture(params=[False, True], ids=["plain", "clashing"])
def odd_docs(request, spark):
    return table(spark, odd_rows(), request.param)


@pytest.fixture
def no_docs(spark):
    return table(spark, [])
