"""What must hold between stages, whatever the data."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conftest import rows
from lapsewise.operators import qc
from lapsewise.operators.cohort import MEMBER
from lapsewise.operators.survival import SEGMENT
from lapsewise.plans import fused
from lapsewise.plans.inputs import StarInputs
from lapsewise.plans.staged import StagedStudy
from lapsewise.sources.star import STAR_SPEC


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    """All steps, through written stages."""
    store = str(tmp_path_factory.mktemp("stages"))
    return StagedStudy(StarInputs(spark, "/root/testdata/sf0.01"), STAR_SPEC, store)


@pytest.fixture(scope="module")
def sizes(study):
    return {r["stage"]: r["n_rows"] for r in qc.stage_ledger(study.stages()).collect()}


def test_sizes_in_step(sizes):
    assert sizes["active_members"] == sizes["status"] == sizes["lost_month"]
    assert sizes["code_users_excluded"] == sizes["own_mail_cleaned"] < sizes["lost_month"]
    assert sizes["lost_outlet_class"] <= sizes["lost_destination"]
    assert sizes["period_dim"] == STAR_SPEC.cohort_count
    assert sizes["market"] > 0


def test_dropped_members_had_one_fill_each(sizes):
    members = sizes["members"] - sizes["active_members"]
    assert members == sizes["cohort_fills"] - sizes["status_fills"] > 0


def test_statuses_add_up(study, sizes):
    parts = {r[0]: r[1] for r in study.status.groupBy("status").count().collect()}
    assert set(parts) == {"NEW", "CONTINUING"}
    assert sum(parts.values()) == sizes["status"]


def test_one_row_per_member(study):
    for stage in (study.status, study.lost, study.destination, study.cleaned, study.outlet_class):
        assert stage.groupBy(*MEMBER).count().filter("count > 1").count() == 0


def test_lost_months_in_range(study):
    low, high = study.lost.agg(F.min("lost_month"), F.max("lost_month")).first()
    assert (low, high) == (1, STAR_SPEC.never_lost)
    assert study.cleaned.filter(F.col("lost_month") > STAR_SPEC.never_lost).count() == 0


def test_one_destination_per_lost_member(study):
    lost = study.lost.filter(F.col("lost_month") < STAR_SPEC.never_lost)
    assert study.destination.count() == lost.count()


def test_no_breach_and_no_alarm(study):
    assert qc.window_breach(study.followup).first()[0] == 0
    assert study.destination.filter("lost_dest is null or lost_dest = 'ATTENTION'").count() == 0


def test_month_counts_add_up(study):
    assert qc.gap_reconcile(study.status_fills).filter("difference <> 0").count() == 0


def test_curve_properties(study):
    curve = study.curve
    points = curve.groupBy("market", "status", "cohort_yyyymm", "chain_name", "lost_month").agg(
        F.max("cohort").alias("cohort"),
        F.max("survival").alias("survival"),
        F.max("rate").alias("rate"),
        F.min("rate").alias("lowest"),
        F.sum("lost").alias("lost"),
    )
    bad = "lost <> cohort - survival or rate <> lowest or rate < 0 or rate > 1"
    assert points.filter(bad).count() == 0
    by_curve = {}
    for r in points.orderBy("lost_month").collect():
        by_curve.setdefault(r[:4], []).append(r.rate)
    assert all(a >= b for rates in by_curve.values() for a, b in zip(rates, rates[1:]))


def test_fused_plan_gives_the_same_report(spark, study):
    fast = fused.survival_curve(StarInputs(spark, "/root/testdata/sf0.01"), STAR_SPEC)
    assert rows(fast) == rows(study.curve)
    for status in ("NEW", "CONTINUING"):
        part = fused.survival_curve(study.inputs, STAR_SPEC, status)
        assert rows(part) == rows(study.curve.filter(F.col("status") == status))


def test_the_ledger_counts_what_it_writes(spark, tmp_path, sizes, monkeypatch):
    """The same numbers, observed while stages are written; no stage is counted by a job of its own."""
    monkeypatch.setattr(DataFrame, "count", lambda self: pytest.fail("counted"))
    again = StagedStudy(StarInputs(spark, "/root/testdata/sf0.01"), STAR_SPEC, str(tmp_path)).ledger()
    assert again == sizes
    with pytest.raises(ValueError):
        StagedStudy(StarInputs(spark, "/root/testdata/sf0.01"), STAR_SPEC).ledger()


def test_checks_in_one_pass_are_those_one_by_one(study):
    found = qc.stage_checks(study.cleaned).collect()
    of = lambda name, *by: sorted((*[r[c] for c in by], r.n_members) for r in found if r.check_name == name)
    hist = qc.lost_month_hist(study.cleaned)
    assert of("segment_month", *SEGMENT, "lost_month") == rows_of(hist)
    dest = qc.lost_month_dest(study.cleaned)
    assert of("month_dest", "lost_month", "lost_dest") == rows_of(dest)
    total = qc.with_grand_total(study.cleaned, unique=True)
    assert of("segment", *SEGMENT) == rows_of(total.drop("grand_total"))
    assert {r.grand_total for r in total.collect()} == {n for (n,) in of("all")}
    pairs = qc.distinct_pairs(study.cleaned, "lost_dest", "lost_dest_detail")
    assert {(r.lost_dest, r.lost_dest_detail) for r in found if r.check_name == "dest_class"} == {tuple(r) for r in pairs.collect()}


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("by", [(), ("market",), ("market", "cohort_chain", "status", "cohort_yyyymm")])
def test_distinct_rollup_is_count_distinct_on_every_level(study, by):
    found = {(r.level, *[r[c] for c in by]): r.n_distinct for r in qc.distinct_rollup(study.status, by).collect()}
    want = {}
    for level in range(len(by) + 1):
        for r in study.status.groupBy(*by[:level]).agg(F.countDistinct("entity_id").alias("n")).collect():
            want[(level, *[r[c] for c in by[:level]], *[None] * (len(by) - level))] = r.n
    assert found == want


def test_distinct_rollup_of_nulls_and_far_numbers(spark):
    values = [0, 1, 32767, 32768, 32769, 2**40, 2**62, 5, 5, None]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 5), ("c", None)], "g string, v long")
    got = {(r.level, r.g): r.n_distinct for r in qc.distinct_rollup(df, ("g",), "v").collect()}
    assert got == {(0, None): 8, (1, "a"): 8, (1, "b"): 1, (1, "c"): 0}


def test_row_by_row_versions(spark):
    old = spark.createDataFrame([(1, "x", "a"), (2, "x", None), (3, "x", "c"), (4, "y", "d")], "k int, g string, m string")
    new = spark.createDataFrame([(1, "x", "a"), (2, "x", None), (3, "x", "C"), (5, "y", "e")], "k int, g string, m string")
    got = rows_of(qc.version_rows(old, new, ("k", "g"), ("m",), ("g",)))
    assert got == [("x", 3, 3, 2, 1, 0, 0), ("y", 1, 1, 0, 0, 1, 1)]
