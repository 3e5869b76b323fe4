import pytest
from pyspark.sql import functions as F

from conftest import rows
from lapsewise.operators import qc, survival

SEGMENT = "'31100' as market, 'A' as market_desc, '032' as cohort_chain, 201501 as cohort_yyyymm"


def members(spark, lost_months, status="NEW"):
    """One member per entry, lost to a competitor, in one segment."""
    df = spark.createDataFrame(list(enumerate(lost_months)), "entity_id long, lost_month int")
    return df.selectExpr(
        *SEGMENT.split(", "),
        f"'{status}' as status",
        "entity_id",
        "lost_month",
        "if(lost_month < 13, 'Competitor', 'not lost') as lost_dest",
        "if(lost_month < 13, 'Loss_Chain', null) as lost_dest_detail",
    )


def curves(members_df, spec):
    """The report by joining points and losses, and from counts."""
    lost = members_df.filter("lost_month <= 12")
    counts = members_df.groupBy(
        *survival.SEGMENT, "lost_month", "lost_dest", "lost_dest_detail"
    ).agg(F.count("*").alias("members"))
    return [
        survival.survival_curve(members_df, lost, spec),
        survival.curve_from_counts(counts, spec),
    ]


def test_curve(spark, spec):
    for curve in curves(members(spark, [1, 1, 3, 13]), spec):
        assert rows(curve, "lost_month", "cohort", "lost", "survival", "rate") == [
            (0, 4, 0, 4, 1.0),
            (1, 4, 2, 2, 0.5),
            (3, 2, 1, 1, 0.25),
        ]


def test_curve_without_a_first_month_has_no_start(spark, spec):
    for curve in curves(members(spark, [3, 13]), spec):
        assert rows(curve, "lost_month", "cohort", "lost", "survival", "rate") == [
            (3, 2, 1, 1, 0.5)
        ]


def test_month_zero_repeats_the_first_months_labels(spark, spec):
    one = members(spark, [1, 13])
    two = members(spark, [1]).selectExpr(
        "* except (entity_id, lost_dest, lost_dest_detail)",
        "9L as entity_id",
        "'Mail' as lost_dest",
        "'Loss_Mail' as lost_dest_detail",
    )
    for curve in curves(one.unionByName(two), spec):
        assert rows(curve, "lost_month", "lost_dest", "lost", "cohort") == [
            (0, "Lost to Competitor", 0, 3),
            (0, "Lost to Mail", 0, 3),
            (1, "Lost to Competitor", 1, 3),
            (1, "Lost to Mail", 1, 3),
        ]


def test_labels_of_the_report(spark, spec):
    for curve in curves(members(spark, [2], "CONTINUING"), spec):
        assert curve.columns == list(survival.CURVE)
        assert rows(curve, "rank", "status", "chain_name", "lost_dest", "lost_dest_detail") == [
            (1, "CONTINUING", "Supercenter", "Lost to Competitor", "Loss_Chain")
        ]


def test_statuses_are_separate_curves(spark, spec):
    both = members(spark, [1, 13]).unionByName(members(spark, [1, 1, 2], "CONTINUING"))
    joined, counted = curves(both, spec)
    assert rows(joined, *survival.CURVE) == rows(counted, *survival.CURVE)
    assert rows(counted.filter("lost_month = 0"), "status", "cohort") == [
        ("CONTINUING", 3),
        ("NEW", 2),
    ]


@pytest.mark.parametrize("unique", [True, False])
def test_unique_counts_agree(spark, unique):
    at_risk = survival.survival_at_risk(members(spark, [1, 1, 3, 13]), unique)
    assert rows(at_risk, "lost_month", "lost", "at_risk", "total") == [
        (1, 2, 4, 4),
        (13, 1, 1, 4),
        (3, 1, 2, 4),
    ]


def test_distinct_entities_are_counted_once(spark):
    twice = members(spark, [1]).unionByName(members(spark, [1]))
    assert survival.survival_at_risk(twice).first()["lost"] == 1


def test_report_topn_order_and_limit(spark, spec):
    curve = curves(members(spark, [1, 2, 3, 13]), spec)[1]
    top = qc.curve_report_topn(curve, 2)
    assert [tuple(r) for r in top.select("lost_month", "cohort", "lost").collect()] == [
        (1, 4, 1),
        (2, 3, 1),
    ]


def test_checks_on_a_curve(spark, spec):
    curve = curves(members(spark, [1, 2, 13]), spec)[1]
    assert rows(qc.curve_totals(curve), "lost", "cohort") == [(2, 3)]
    assert rows(qc.month_zero(curve), "n_details", "n_rows") == [(1, 1)]
    assert rows(qc.distinct_pairs(curve, "lost_dest", "lost_dest_detail")) == [
        ("Lost to Competitor", "Loss_Chain")
    ]


def test_version_diff_shows_both_sides(spark):
    old, new = members(spark, [1, 2]), members(spark, [2, 3, 3])
    got = rows(qc.version_diff(old, new, ("lost_month",)))
    assert got == [(1, 1, 0, -1), (2, 1, 1, 0), (3, 0, 2, 2)]


def test_lost_month_delta(spark):
    df = spark.createDataFrame([(1, 1), (1, 13), (2, 2)], "b int, a int")
    assert rows(qc.lost_month_delta(df, "b", "a")) == [(1, 2, 1), (13, 0, 1), (2, 1, 1)]
