"""Exact and near copies against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from odd_tables import no_docs, odd_docs, odd_rows, split_words, table  # noqa: F401

from lapsewise.llm import components, dedup, simhash


def last(value):
    """Sorts null after all numbers."""
    return (value is None, value or 0)


def test_copies(spark, odd_docs):
    rows = odd_rows()
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    want = Counter()
    for text, ids in groups.items():
        ids.sort(key=last)
        sha = hashlib.sha256(text.encode()).hexdigest()
        want.update((d, ids[0], len(ids), k == 0, sha) for k, d in enumerate(ids))
    got = dedup.copies(odd_docs).drop("row").collect()
    assert Counter(map(tuple, got)) == want


def test_without_copies_keeps_columns_and_one_of_each(spark, odd_docs):
    kept = dedup.without_copies(odd_docs)
    assert kept.schema == odd_docs.schema
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in odd_rows()})


@pytest.mark.parametrize("runs, fanout", [(1, 2), (3, 2), (512, 8), (7, 100)])
def test_tree_shape_does_not_matter(spark, runs, fanout):
    rows = spark.createDataFrame([(k % 7, k, f"d{k % 5}", k % 5, k % runs) for k in range(100)], "doc_id long, row long, digest string, check long, run int")
    got = {r.digest: (r.keep.doc_id, r.size) for r in dedup.merged(rows, runs, fanout).collect()}
    assert got == {f"d{k}": (0, 20) for k in range(5)}


def test_texts_with_one_digest_but_another_check_stay_apart(spark):
    rows = spark.createDataFrame([(1, 1, "d", 10, 0), (2, 2, "d", 11, 1)], "doc_id long, row long, digest string, check long, run int")
    assert dedup.merged(rows).count() == 2


def brute_fingerprint(text):
    words = split_words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    """Of each value the values it reaches by steps of 2 bits or fewer."""
    left, found = set(values), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= near
            todo += near
        found.update(dict.fromkeys(group, frozenset(group)))
    return found


def test_near_copies(spark, odd_docs):
    rows = odd_rows()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    reach = brute_components(fps)
    want = Counter()
    for (doc_id, *_), fp in zip(rows, fps, strict=True):
        smallest = min((d for (d, *_), f in zip(rows, fps, strict=True) if f in reach[fp]), key=last)
        want[doc_id, fp, smallest] += 1
    found = simhash.near_copies(odd_docs).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == want
    assert sum(r.kept for r in found) == len({reach[f] for f in fps})
    kept = simhash.without_near_copies(odd_docs)
    assert kept.schema == odd_docs.schema and kept.count() == len({reach[f] for f in fps})


@pytest.mark.parametrize("most", [2, 6, 1024])
def test_links_have_all_components_with_and_without_crowded_cells(spark, most):
    rng = random.Random(most)
    values = set()
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            values.add(value)
            for _ in range(rng.randint(1, 3)):
                value ^= 1 << rng.randrange(64)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), most=most)
    labels = {r.node: r.label for r in components.components(links).collect()}
    got = defaultdict(set)
    for v in signed:
        got[labels.get(v, v)].add(v % 2**64)
    assert {frozenset(g) for g in got.values()} == set(brute_components(values).values())


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(9, k) for k in range(1000, 1050)] + [(5, 5), (1000, 9)]
    rng = random.Random(3)
    both = chain + star
    rng.shuffle(both)
    labels = {r.node: r.label for r in components.components(spark.createDataFrame(both, "a long, b long")).collect()}
    assert labels == {k: 100 for k in range(100, 161)} | {k: 9 for k in [9, *range(1000, 1050)]}


def test_empty_tables(spark, no_docs):
    assert dedup.copies(no_docs).count() == 0
    assert simhash.near_copies(no_docs).count() == 0
    assert dedup.without_copies(no_docs).count() == simhash.without_near_copies(no_docs).count() == 0


def test_all_rows_alike(spark):
    docs = table(spark, [(k, "same text here again", "en", "a") for k in range(300)])
    assert {(r.keep_id, r.group_size) for r in dedup.copies(docs).collect()} == {(0, 300)}
    assert {r.component_id for r in simhash.near_copies(docs).collect()} == {0}
    assert dedup.without_copies(docs).count() == 1
