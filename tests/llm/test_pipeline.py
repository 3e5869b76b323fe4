"""The pipeline's stages against brute force on a small odd table."""

import re
from collections import Counter

import pytest
from odd_tables import odd_rows, table
from test_copies import brute_components, brute_fingerprint, last

import corpus_pipeline
from lapsewise.llm import mix, shared, toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones among them, and their labels, as stored tables."""
    place = tmp_path_factory.mktemp("corpus")
    rows = odd_rows()
    calm = [(5000 + k, f"plain words number {k} " + "and more of them " * (k % 9), "en", "ab"[k % 2]) for k in range(150)]
    rude = [(6000 + k, f"words {k} vile foul {'rotten ' * (k % 4)}number {k * 7} more", "en", "a") for k in range(90)]
    table(spark, rows + calm + rude, True).repartition(3).write.parquet(f"{place}/documents.parquet")
    marks = [(d, 1, 0) for d, *_ in calm] + [(d, 0, 1) for d, *_ in rude]
    spark.createDataFrame(marks, LABELS).write.parquet(f"{place}/labels.parquet")
    return str(place), [(d, t) for d, t, *_ in rows + calm], rude


def test_stages(spark, folder):
    place, clean, rude = folder
    docs = spark.read.parquet(f"{place}/documents.parquet")
    schema, after = docs.schema, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.stored(stage(spark, docs, place))
        after[name] = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mix", "pack"]
    for name in ("toxicity", "exact_dedup", "simhash", "mix"):
        assert after[name].schema == schema

    # every toxic document goes, every other stays
    pairs = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    assert pairs(after["toxicity"]) == Counter(clean)

    kept = {}
    for doc_id, text in clean:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        kept[key] = min(kept.get(key, (None, None)), (doc_id, text), key=lambda p: last(p[0])) if key in kept else (doc_id, text)
    unique = pairs(after["exact_dedup"])
    assert sorted(d for d, _ in unique) == sorted(d for d, _ in kept.values())

    reach = brute_components({brute_fingerprint(t) for _, t in unique})
    groups = {}
    for doc_id, text in unique:
        groups.setdefault(reach[brute_fingerprint(text)], []).append(doc_id)
    assert sorted(d for d, _ in pairs(after["simhash"])) == sorted(min(g, key=last) for g in groups.values())

    taken = Counter()
    for r in mix.mix(after["simhash"]).collect():
        taken[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in after["mix"].select("doc_id").collect()) == +taken
    assert {r.doc_id for r in after["pack"].collect()} == {d for d, n in taken.items() if n}
    assert sum(r.length == r.doc_tokens - r.start for r in after["pack"].collect()) == sum(taken.values())


def test_run_gives_the_last_stage(spark, folder):
    place, *_ = folder
    got = corpus_pipeline.run(spark, place)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_copies_in_the_toxicity_sample_count_once():
    texts = ["a b c d e f g", "x", "a b c d e f g", None, "", "other words that are not like the first"]
    assert toxicity._unlike(texts) == [True, True, False, True, True, True]
