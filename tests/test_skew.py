"""A hot entity must shrink before anything is shuffled or joined."""

import random

import pytest

from conftest import fill, make_inputs, rows
from lapsewise.functions.months import key_plus
from lapsewise.operators import cohort, destination
from lapsewise.plans import fused
from lapsewise.plans.staged import LeanStudy
from lapsewise.spec import RetentionSpec

SPEC = RetentionSpec()
CLASSES = ["CHAIN", "OTHER", None]


@pytest.fixture(scope="module")
def inputs(spark):
    """Entity 0 has 9,000 of 9,600 fills, at 40 chains."""
    rng = random.Random(7)
    chains = ["032", "955", "033", None] + [f"c{n}" for n in range(36)]
    return make_inputs(
        spark,
        [
            fill(
                0 if n < 9000 else n,
                key_plus(201401, rng.randrange(41)),
                rng.randrange(1, 29),
                chain=rng.choice(chains),
                channel=rng.choice(["RETAIL", "MAIL"]),
                outlet_class=rng.choice(CLASSES),
                supplier_id=rng.choice([1, 348]),
            )
            for n in range(9600)
        ],
    )


def test_activity_does_not_grow_with_fills_or_chains(inputs):
    study = LeanStudy(inputs, SPEC)
    activity = fused.month_activity(inputs.fills_in_market(study.market), SPEC)
    hot = activity.filter("entity_id = 0")
    assert hot.agg({"n_fills": "sum"}).first()[0] == 9000
    # months, chain kinds, channels, classes, mail flag
    assert hot.count() <= 41 * 5 * 2 * len(CLASSES) * 2


def test_month_grain_is_a_row_per_month(inputs):
    study = LeanStudy(inputs, SPEC)
    monthly = cohort.month_grain(study.qualified).filter("entity_id = 0 and chain = '032'")
    assert monthly.count() <= 41


def test_kinds_carry_the_same_weight(inputs):
    study = LeanStudy(inputs, SPEC)
    kinds = destination.fill_kinds(study._any_chain, SPEC).filter("entity_id = 0")
    raw = study._any_chain.filter("entity_id = 0")
    assert rows(kinds.selectExpr("sum(n_fills)", "sum(fill_weight)")) == rows(
        raw.selectExpr("count(*)", "sum(fill_weight)")
    )


def test_forms_agree(inputs):
    fast = fused.survival_curve(inputs, SPEC)
    assert rows(fast) == rows(LeanStudy(inputs, SPEC).curve)
