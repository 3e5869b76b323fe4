"""Mixing against plain arithmetic."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from odd_tables import no_docs, odd_docs, odd_rows, split_words, table  # noqa: F401

from lapsewise.llm import mix


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares of all words by weight, what is above a limit shared again among the others until none is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        others = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and Fraction(rest * weight[s], others) > most * sizes[s]}
        if not over:
            return {s: Fraction(most * sizes[s]) if s in full else Fraction(rest * weight[s], others) for s in order}
        full |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {rng.choice([None, f"s{k}", f"S{k}é"]): rng.choice([0, 1, 10, 500, 10_000]) for k in range(rng.randint(1, 12))}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: Fraction(r.top, r.bottom) for r in mix.targets(rows).collect()}
    assert got == brute_targets(sizes)


def test_mix(spark, odd_docs):
    rows = odd_rows()
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(split_words(text))
    goal = brute_targets(sizes)
    found = mix.mix(odd_docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter((d, s, len(split_words(t))) for d, t, _, s in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(goal[r.source]))
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        expected = goal[r.source] / sizes[r.source]
        assert int(expected) <= r.copies <= -int(-expected // 1)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for source, words in taken.items():
        assert abs(words - goal[source]) <= largest[source]
    again = mix.mix(odd_docs).collect()
    assert Counter((r.doc_id, r.source, r.taken) for r in again) == Counter((r.doc_id, r.source, r.taken) for r in found)


def test_mixed_rows_come_as_often_as_taken(spark, odd_docs):
    out = mix.mixed(odd_docs)
    assert out.schema == odd_docs.schema
    want = Counter()
    for r in mix.mix(odd_docs).collect():
        want[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +want


def test_other_seeds_and_weights(spark):
    docs = table(spark, [(k, "w " * (1 + k % 5), "en", "ab"[k % 2]) for k in range(200)])
    assert len({frozenset((r.doc_id, r.taken) for r in mix.mix(docs, seed=s).collect()) for s in range(4)}) > 1
    even = mix.mix(docs, weights=(1,)).groupBy("source").sum("taken").collect()
    assert abs(even[0][1] - even[1][1]) <= 10


def test_nothing_to_mix(spark, no_docs):
    assert mix.mix(no_docs).count() == 0 == mix.mixed(no_docs).count()
    blank = table(spark, [(1, None, None, "a"), (2, " ", None, None)])
    assert [(r.target, r.taken) for r in mix.mix(blank).collect()] == [(0.0, 0)] * 2
