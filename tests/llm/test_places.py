"""Rows keep their place however the files are split between two reads."""

from collections import Counter

import pytest
from odd_tables import odd_rows, table  # noqa: F401
from pyspark.sql import functions as F

from lapsewise.llm import dedup, mix, shared, simhash

SPLITS = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "40"}


@pytest.fixture
def split_anew(spark):
    """Changes how files are split, from the second call of a stored table on."""
    before = {k: spark.conf.get(k, None) for k in SPLITS}

    def change():
        for k, v in SPLITS.items():
            spark.conf.set(k, v)

    yield change
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.fixture
def docs(spark, tmp_path):
    rows = [r for n in range(8) for r in odd_rows(seed=n % 5, n=40)]
    frame = table(spark, rows).repartition(5)
    frame.write.option("parquet.block.size", 4096).option("maxRecordsPerFile", 60).parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


@pytest.mark.parametrize("operator", [dedup.without_copies, simhash.without_near_copies, mix.mixed])
def test_another_split_at_the_second_read(docs, operator, split_anew, monkeypatch):
    whole = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())
    want = whole(operator(docs))
    parts = docs.rdd.getNumPartitions()
    kept = shared.stored

    def stored_then_changed(df):
        found = kept(df)
        split_anew()
        return found

    monkeypatch.setattr(shared, "stored", stored_then_changed)
    again = operator(docs)
    assert whole(again) == want
    assert docs.sparkSession.read.parquet(*docs.inputFiles()).rdd.getNumPartitions() != parts


def test_places_are_one_per_row(docs):
    where = docs.select(shared.place(docs).alias("p"))
    assert where.distinct().count() == docs.count()


def test_what_is_no_scan_is_written_first(spark, docs):
    assert shared.scan(docs) is docs
    assert shared.scan(docs.where("doc_id > 3").select("doc_id", "text")).inputFiles() == docs.inputFiles()
    for other in (docs.select(F.explode(F.array(F.lit(1), F.lit(2))), "text"), docs.union(docs), table(spark, odd_rows())):
        assert shared.scan(other).inputFiles() != docs.inputFiles()
        assert shared.scan(other).count() == other.count()


def test_a_column_of_the_name_of_the_metadata(spark, tmp_path):
    spark.range(20).selectExpr("id % 3 as doc_id", "'x' as text", "id as _metadata").write.parquet(str(tmp_path / "t"))
    found = dedup.without_copies(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert len(found) == 1 and found[0]._metadata % 3 == 0 == found[0].doc_id
