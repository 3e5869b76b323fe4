import datetime as dt

import pytest
from pyspark.sql import functions as F

from lapsewise.functions import keys, labels, months


def one(spark, schema, row, expression):
    return spark.createDataFrame([row], schema).select(expression).first()[0]


@pytest.mark.parametrize(
    "prod_id, pack_cd, expected",
    [(42, 7, 42007), (12345678, 7, 1234567007), (0, 0, 0), (None, 7, None), (1, 1234, 1123)],
)
def test_product_key(spark, prod_id, pack_cd, expected):
    got = one(
        spark, "a int, b int", (prod_id, pack_cd), keys.product_key(F.col("a"), F.col("b"))
    )
    assert got == expected


@pytest.mark.parametrize(
    "code, expected", [("12x", None), (None, None), ("00012", 12), ("12", 12), ("", None)]
)
def test_code_number(spark, code, expected):
    assert one(spark, "c string", (code,), keys.code_number(F.col("c"))) == expected


def test_padded_code_cuts_what_is_longer(spark):
    assert one(spark, "c string", ("1234567",), keys.padded_code(F.col("c"), 5)) == "12345"


@pytest.mark.parametrize(
    "key, expected",
    [(201509, dt.date(2015, 9, 1)), (201512, dt.date(2015, 12, 1)), (201513, None), (None, None)],
)
def test_month_start(spark, key, expected):
    assert one(spark, "k int", (key,), months.month_start(F.col("k"))) == expected


def test_month_of_a_date(spark):
    day = dt.date(2016, 2, 29)
    assert one(spark, "d date", (day,), months.month_floor(F.col("d"))) == dt.date(2016, 2, 1)
    assert one(spark, "d date", (day,), months.month_key(F.col("d"))) == 201602


def test_month_index_and_back(spark):
    keys_in = [months.key_plus(199911, n) for n in range(40)]
    df = spark.createDataFrame([(k,) for k in keys_in], "k int")
    index = months.month_index(F.col("k"))
    got = df.select("k", index.alias("i"), months.index_to_key(index).alias("back")).collect()
    assert all(r.back == r.k and r.i == months.key_index(r.k) for r in got)
    assert sorted(r.i for r in got) == list(range(got[0].i, got[0].i + 40))


def test_months_apart(spark):
    row = (dt.date(2016, 5, 1), dt.date(2015, 12, 1))
    assert one(spark, "a date, b date", row, months.months_apart(F.col("a"), F.col("b"))) == 5


def test_key_plus_crosses_years():
    assert months.key_plus(201501, -12) == 201401
    assert months.key_plus(201512, 17) == 201705
    assert months.key_plus(201511, 1) == 201512


@pytest.mark.parametrize("days, expected", [(83, 1), (84, 3), (None, 3)])
def test_fill_weight(spark, spec, days, expected):
    assert one(spark, "d int", (days,), labels.fill_weight(F.col("d"), spec)) == expected


@pytest.mark.parametrize(
    "channel, chain, expected",
    [
        ("MAIL", "101", "Mail"),
        ("MAIL", "032", "Mail"),
        ("MAIL", None, "Mail"),
        ("RETAIL", "955", "Competitor"),
        ("RETAIL", "032", "ATTENTION"),
        ("RETAIL", None, "Stopped Treatment"),
        (None, None, "Stopped Treatment"),
    ],
)
def test_destination(spark, spec, channel, chain, expected):
    got = one(
        spark,
        "channel string, chain string, own string",
        (channel, chain, "032"),
        labels.destination(F.col("channel"), F.col("chain"), F.col("own"), spec),
    )
    assert got == expected


@pytest.mark.parametrize(
    "dest, chain, outlet, expected",
    [
        ("Competitor", "033", "CHAIN", "Loss_Sam"),
        ("Competitor", "955", None, "Loss_WMT"),
        ("Mail", "032", "OTHER", "Loss_WMT"),
        ("Stopped Treatment", None, None, "Off Grid"),
        ("Stopped Treatment", None, "CHAIN", "Loss_Chain"),
        ("Mail", "101", "OTHER", "Loss_Mail"),
        ("Mail", "101", None, "ATTENTION"),
        ("Competitor", "101", "FOOD STORE", "Loss_Food Store"),
    ],
)
def test_destination_detail(spark, spec, dest, chain, outlet, expected):
    got = one(
        spark,
        "dest string, chain string, outlet string",
        (dest, chain, outlet),
        labels.destination_detail(F.col("dest"), F.col("chain"), F.col("outlet"), spec),
    )
    assert got == expected


def test_report_labels(spark, spec):
    df = spark.createDataFrame(
        [("Mail",), ("Competitor",), ("Stopped Treatment",), ("ATTENTION",), (None,)], "d string"
    )
    got = [r[0] for r in df.select(labels.report_destination(F.col("d"), spec)).collect()]
    assert got == ["Lost to Mail", "Lost to Competitor", "Off Grid", "ATTENTION", "ATTENTION"]


def test_rank_and_chain_name_of_unknown_values(spark, spec):
    df = spark.createDataFrame([("39200", "032"), ("00000", "101"), ("20200", None)], "m string, c string")
    got = df.select(labels.market_rank(F.col("m"), spec), labels.chain_name(F.col("c"), spec)).collect()
    assert [tuple(r) for r in got] == [(3, "Supercenter"), (None, "null"), (10, "null")]


def test_names_of_another_retailer(spark):
    """Its own texts, ranks and chains, and none of the defaults."""
    from dataclasses import replace

    from lapsewise.operators import survival
    from lapsewise.spec import Labels, RetentionSpec

    own = Labels(**{name: f"my {name}" for name in Labels.__dataclass_fields__})
    spec = replace(
        RetentionSpec(), cohort_chains=("A", "B"), sister_chain="C", labels=own,
        market_ranks=(("m1", 1),), chain_names=(("A", "Shop A"), ("B", "Shop B")),
    )
    rows = [(ch, o, k) for ch in ("A", "C", "Z", None) for o in ("RETAIL", "MAIL") for k in ("OTHER", "CLUB", None)]
    df = spark.createDataFrame(rows, "chain string, channel string, outlet string")
    dest = labels.destination(F.col("channel"), F.col("chain"), F.lit("B"), spec)
    said = df.withColumn("dest", dest).select(
        "dest",
        labels.destination_detail(F.col("dest"), F.col("chain"), F.col("outlet"), spec).alias("detail"),
        labels.report_destination(F.col("dest"), spec).alias("report"),
    ).collect()
    assert all(str(text).startswith("my ") for row in said for text in row)
    points = spark.createDataFrame(
        [("m1", "M", c, 201501, "NEW", 1, 5, "d", "x", 1, 4, 0.8) for c in ("A", "B")],
        "market string, market_desc string, cohort_chain string, cohort_yyyymm int, status string, "
        "lost_month int, cohort long, lost_dest string, lost_dest_detail string, lost long, survival long, rate double",
    )
    report = survival.labelled(points, spec).collect()
    assert sorted((r["rank"], r["chain_name"]) for r in report) == [(1, "Shop A"), (1, "Shop B")]
