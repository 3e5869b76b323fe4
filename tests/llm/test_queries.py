"""The numbered queries on the smallest tables: columns of their contracts, and their SQL where there is some."""

import pytest

import __spark_entry__ as spark_entry
from check import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2": {c: "bigint" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")},
    "op3": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op4": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op7": {c: "bigint" for c in ("doc_id", "start", "n_tokens", "ids_crc32")},
    "op8": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op9": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op10": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op11": {c: "bigint" for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")} | {"runs_sha256": "string", "collapsed_sha256": "string"},
    "op12": {c: "bigint" for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")} | {"ends_sha256": "string"},
    "op13": {c: "bigint" for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")} | {"base_labels": "string", "labels": "string", "score": "double"},
}


@pytest.mark.parametrize("number", COLUMNS)
def test_columns(spark, number):
    (name,) = [q for q in spark_entry.queries() if q.split("_")[0] == number]
    found = dict(spark_entry.queries()[name](spark, SF_DIR).dtypes)
    assert {c: found.get(c) for c in COLUMNS[number]} == COLUMNS[number]


@pytest.mark.parametrize("name", ["op1_mix", "op8_secrets", "op9_exact_dedup", "op13_licenses"])
def test_sql(spark, name):
    ok, n, note = compare(spark, oracle_connection(SF_DIR), SF_DIR, name)
    assert ok and n > 0, note
