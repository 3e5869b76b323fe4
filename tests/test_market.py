from dataclasses import replace

import pytest

from conftest import PRODUCT_SCHEMA, fill, make_inputs, rows
from lapsewise.operators import market
from lapsewise.plans import fused
from lapsewise.plans.staged import LeanStudy


def products(spark, *items):
    return spark.createDataFrame(list(items), PRODUCT_SCHEMA)


def test_special_flag_keeps_null(spark, spec):
    df = products(
        spark,
        (1, 1, "31100", "A", "null flag", None),
        (2, 1, "31100", "A", "zero", "0"),
        (3, 1, "31100", "A", "special", "9"),
        (4, 1, "99999", "B", "other market", None),
        (1, 1, "31100", "A", "null flag", None),
    )
    got = rows(market.market_by_attribute(df, spec), "prod_desc", "product_key")
    assert got == [("null flag", 1001), ("zero", 2001)]


def test_market_by_code_list(spark, spec):
    df = products(
        spark,
        (1, 1, "31100", "A", "one", None),
        (2, 1, None, None, "two", None),
        (3, 1, None, None, "special", "9"),
        (4, 1, None, None, "not listed", None),
    )
    bridge = spark.createDataFrame(
        [("000000000011", 1, 1), ("000000000022", 2, 1), ("000000000033", 3, 1)],
        "ndc_cd string, prod_id int, pack_cd int",
    )
    codes = spark.createDataFrame([("11",), ("11",), ("0022",), ("33",), (None,)], "ndc string")
    got = rows(market.market_by_code_list(df, bridge, codes, spec))
    assert got == [
        ("39200", "DIABETES", "one", 1001),
        ("39200", "DIABETES", "two", 2001),
    ]
    both = market.market_definition(df, bridge, codes, spec)
    assert rows(both.filter("product_key = 1001"), "market") == [("31100",), ("39200",)]


def test_conflicts_are_found(spark):
    sound = spark.createDataFrame(
        [("a", "A", "x", 1), ("a", "A", "y", 2), ("b", "B", "x", 1)],
        "market string, market_desc string, prod_desc string, product_key long",
    )
    assert market.check_market(sound) is sound
    doubled = sound.union(sound.sparkSession.createDataFrame([("a", "A", "z", 1)], sound.schema))
    renamed = sound.union(sound.sparkSession.createDataFrame([("b", "C", "x", 3)], sound.schema))
    for bad in (doubled, renamed):
        with pytest.raises(ValueError):
            market.check_market(bad)


def test_market_join_hint_follows_the_bound(spark):
    fills = spark.range(3).withColumnRenamed("id", "product_key")
    small = spark.createDataFrame(
        [("a", "A", "x", 1)],
        "market string, market_desc string, prod_desc string, product_key long",
    )

    def plan(df):
        return df._jdf.queryExecution().analyzed().toString()

    assert "ResolvedHint" in plan(market.in_market(fills, small, 10))
    assert "ResolvedHint" not in plan(market.in_market(fills, small, market.BROADCAST_BYTES + 1))
    assert "ResolvedHint" not in plan(market.in_market(fills, small))
    assert rows(market.in_market(fills, small, 10)) == rows(market.in_market(fills, small))


TWICE = [
    (1, 1, "31100", "MARKET ONE", "one", None),
    (1, 1, "31100", "MARKET ONE", "one again", None),
    (2, 1, None, None, "two", None),
]
TWO_NAMES = [
    (1, 1, "31100", "MARKET ONE", "one", None),
    (1, 2, "31100", "MARKET UNO", "two", None),
    (2, 1, None, None, "two", None),
]


@pytest.mark.parametrize("products", [TWICE, TWO_NAMES])
def test_an_ambiguous_market_stops_the_study(spark, spec, products):
    inputs = make_inputs(spark, [fill(1)], products=products)
    for run in (fused.member_outcomes, lambda i, s: LeanStudy(i, s).lost):
        with pytest.raises(Exception, match="market is ambiguous"):
            run(inputs, spec).collect()


def test_a_loose_market_counts_a_product_described_twice_twice(spark, spec):
    loose = replace(spec, strict_market=False)
    inputs = make_inputs(spark, [fill(1)], products=TWICE)
    assert rows(LeanStudy(inputs, loose).lost, "entity_id", "lost_month") == [(1, 1)]
    sound = make_inputs(spark, [fill(1)])
    assert rows(LeanStudy(sound, spec).lost) == rows(LeanStudy(sound, loose).lost) == []
