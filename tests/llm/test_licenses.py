"""Licence scan against a plain reading of the templates."""

import random
import re
from collections import Counter

import pytest
from odd_tables import no_docs, odd_docs, odd_rows, table  # noqa: F401

from lapsewise.llm import licenses


def words_of(text):
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def brute(text):
    words, found = words_of(text), []
    for t in licenses.TEMPLATES:
        for start in range(-30, len(words)):
            there = [0 <= start + k < len(words) and words[start + k] == w for k, w in t.words]
            if all(there[n] for n in t.needed) and sum(there) >= licenses.LEAST * len(there):
                found.append((t, start, sum(there) / len(there)))
    base = [s for t, s, _ in found if t.base]
    return (
        len(words), len(base), min(base, default=None), max(base, default=None),
        sorted({t.label for t, *_ in found if t.base}), sorted({t.label for t, *_ in found}), max((x for *_, x in found), default=0.0),
    )


def plain_base(text):
    """Places of the base phrases without any index."""
    words = words_of(text)
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    at = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    return sorted(at)


def texts():
    rng = random.Random(5)
    wholes = [t.text for t in licenses.TEMPLATES]
    made = [
        "Released under the MIT License.", "MIT-License, mit\nLICENSE; MITLicense mit licenses", "GNU General Public License, version 3.", "GNU Lesser General Public License",
        "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "general public general public license license", "mit mit license license mit license",
        "worK mit lıcense MİT LICENSE émit license mit licenseé", "apache2 license apache 2 license",
    ]
    for _ in range(150):
        parts = rng.choices(wholes, k=rng.randint(1, 3))
        words = " and so on ".join(parts).split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], ["other"], [words[k], "more"], [words[k].upper()]])
        made.append(rng.choice([" ", ", ", "\n", " -- "]).join(words))
    return made


def seen(row):
    return (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels, row.labels, row.score)


def test_scan(spark):
    rows = [(k, t, None, None) for k, t in enumerate(texts())] + [(3, texts()[3], None, None), (None, "mit license", None, None), (900, None, None, None), (901, "", None, None)]
    got = Counter((r.doc_id, repr(seen(r))) for r in licenses.scan(table(spark, rows, clashing=True)).collect())
    assert got == Counter((d, repr(brute(t))) for d, t, *_ in rows)


def test_base_places_are_all_there(spark):
    rows = [(k, t, None, None) for k, t in enumerate(texts())]
    for r in licenses.scan(table(spark, rows)).collect():
        at = plain_base(texts()[r.doc_id])
        assert r.n_base == len(at) and (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == sorted({label for _, label in at}) and set(r.base_labels) <= set(r.labels)


def test_odd_tables(spark, odd_docs, no_docs):
    assert licenses.scan(odd_docs).count() == len(odd_rows())
    assert {r.score for r in licenses.scan(odd_docs).collect()} == {0.0}
    assert licenses.scan(no_docs).count() == 0


def test_files_are_looked_up_by_their_rarest_words(spark):
    rows = [(k, "license version public general 2 0 apache" if k else "mit license mozilla public license version 2 0", None, None) for k in range(50)]
    files = licenses.frequencies(licenses.found(table(spark, rows)))
    assert files["mozilla"] == 1 and files["license"] == 50
    keys = dict(zip((t.label for t in licenses.TEMPLATES), licenses.rarest(licenses.TEMPLATES, files), strict=True))
    assert keys["mpl-2.0"] == "mozilla" and keys["mit"] == "mit" and keys["bsd"] == "bsd"


def test_no_python_in_the_plan(spark, odd_docs, capsys):
    licenses.places(licenses.found(odd_docs)).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


@pytest.mark.parametrize("template", licenses.TEMPLATES, ids=lambda t: t.label)
def test_templates_are_sound(template):
    assert template.needed and len(template.words) < 60
    for phrase in template.mandatory:
        assert f" {phrase} " in f" {template.text} "
    assert template.base <= (len(template.needed) == len(template.text.split()))
