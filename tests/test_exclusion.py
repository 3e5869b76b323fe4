"""Code users and own-mail members, step by step and fused."""

import pytest

from conftest import fill, make_inputs, rows
from lapsewise.operators import exclusion
from lapsewise.plans import fused
from lapsewise.plans.staged import StagedStudy

LISTED = {"product_key": 2001, "product_code": "2001"}


def members(entity, **change):
    """Two fills in the listed market and two in the other one."""
    return [fill(entity, 201501, **{**LISTED, **change}) for _ in "ab"] + [
        fill(entity, 201501) for _ in "ab"
    ]


def kept(spark, spec, fills, codes):
    inputs = make_inputs(spark, fills, exclusion=codes)
    steps = rows(StagedStudy(inputs, spec).kept, "entity_id", "market")
    assert rows(fused.member_outcomes(inputs, spec), "entity_id", "market") == steps
    return steps


BOTH = [(1, "31100"), (1, "39200")]
OUT = [(1, "31100")]


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, OUT),
        ({"month": 201101}, OUT),
        ({"month": 201101, "chain": "101"}, OUT),
        ({"is_maintenance": 0}, OUT),
        ({"product_key": 3001}, OUT),
        ({"month": 201706}, BOTH),
        ({"channel": "MAIL"}, BOTH),
        ({"supplier_id": 725}, BOTH),
        ({"state": None}, BOTH),
    ],
)
def test_buyer_of_a_listed_code_leaves_one_market(spark, spec, change, expected):
    bought = fill(1, **{"product_code": "777", "month": 201502, **change})
    assert kept(spark, spec, members(1) + [bought], ["777"]) == expected


@pytest.mark.parametrize(
    "code, listed, expected",
    [
        ("12x", "12x", BOTH),
        (None, "12", BOTH),
        ("00012", "12", OUT),
        ("12", "00012", OUT),
        ("12", None, BOTH),
    ],
)
def test_codes_compare_as_numbers(spark, spec, code, listed, expected):
    bought = fill(1, 201502, product_code=code)
    assert kept(spark, spec, members(1) + [bought], [listed, listed]) == expected


def test_own_mail_member_is_not_lost(spark, spec):
    fills = [fill(1, m) for m in (201501, 201504)] + [
        fill(1, 201506, channel="MAIL", supplier_id=348, chain="101"),
        fill(1, 201507, chain="101", days_supply=90),
    ]
    inputs = make_inputs(spark, fills)
    study = StagedStudy(inputs, spec)
    assert rows(study.lost, "cohort_yyyymm", "lost_month") == [(201501, 4)]
    assert rows(study.destination, "lost_dest") == [("Competitor",)]
    assert rows(study.cleaned, "lost_month", "lost_dest") == [(13, "not lost")]
    assert study.outlet_class.count() == 0
    fast = fused.member_outcomes(inputs, spec)
    assert rows(fast, "lost_month_before", "lost_month", "lost_dest", "lost_dest_detail") == [
        (4, 13, "not lost", None)
    ]


def test_own_mail_outside_the_gap_changes_nothing(spark, spec):
    fills = [fill(1, 201501), fill(1, 201501)] + [
        fill(1, m, channel="MAIL", supplier_id=348, chain="101") for m in (201501, 201508)
    ]
    inputs = make_inputs(spark, fills)
    want = [(1, "Stopped Treatment")]
    assert rows(StagedStudy(inputs, spec).cleaned, "lost_month", "lost_dest") == want
    assert rows(fused.member_outcomes(inputs, spec), "lost_month", "lost_dest") == want


def test_member_never_lost_with_own_mail_gets_the_next_number(spark, spec):
    study = StagedStudy(make_inputs(spark, [fill(1, 201501), fill(1, 201506)]), spec)
    never = study.lost.selectExpr("* except (lost_month)", "13 as lost_month")
    with_mail = never.selectExpr("*", "'Mail' as lost_dest", "true as own_mail")
    cleaned = exclusion.own_mail_cleanup(with_mail, spec)
    assert rows(cleaned, "lost_month", "lost_dest") == [(14, "not lost")]
