"""Random small worlds against a plain Python reading of the rules."""

import datetime as dt
import random
from collections import Counter, defaultdict
from dataclasses import replace

import pytest

from conftest import fill, make_inputs, rows
from lapsewise.functions.months import index_key, key_index, key_plus
from lapsewise.operators import destination
from lapsewise.plans import fused
from lapsewise.plans.staged import LeanStudy
from lapsewise.spec import RetentionSpec

MARKETS = {1001: "31100", 2001: "39200"}


def world(seed, entities=250, n=6000):
    rng = random.Random(seed)
    for _ in range(n):
        # one entity holds a third of all fills
        entity = 0 if rng.random() < 0.33 else rng.randrange(1, entities)
        at_home = rng.random() < 0.5
        yield fill(
            entity,
            key_plus(201312, rng.randrange(45)),
            rng.randrange(1, 29),
            product_key=1001 + entity % 2 * 1000 if at_home else rng.choice([1001, 1001, 2001, 2001, 3001]),
            product_code=rng.choice(["1001", "x", None, "2001"] + ["777"] * (rng.random() < 0.1)),
            chain="032" if at_home else rng.choice(["955", "033", "101", "102", None]),
            channel=rng.choice(["RETAIL"] * 4 + ["MAIL", "CLINIC"]),
            outlet_class=rng.choice(["CHAIN", "OTHER", "FOOD STORE", None]),
            days_supply=rng.choice([30, 83, 84, 90, None]),
            supplier_id=rng.choice([1, 2, 3, 4, 5, 6] * 3 + [348, 725, None]),
            state=rng.choice(["TX"] * 8 + ["PR", None]),
            is_maintenance=rng.choice([1] * 9 + [0, None]),
            is_bridge_error=rng.choice([0] * 9 + [1, None]),
        )


def best(followup, label):
    """Heaviest label, then latest, then first by name."""
    weight, date = Counter(), {}
    for f in followup:
        name = label(f)
        weight[name] += 1 if f["days_supply"] is not None and f["days_supply"] < 84 else 3
        date[name] = max(date.get(name, dt.date.min), f["fill_date"])
    return min(weight, key=lambda k: (-weight[k], -date[k].toordinal(), k))


def expected(fills, spec=RetentionSpec()):
    trusted = [
        f
        for f in fills
        if f["is_bridge_error"] == 0
        and f["supplier_id"] not in (None, 725)
        and f["state"] not in (None, "PR", "VI")
    ]
    users = {
        f["entity_id"]
        for f in trusted
        if f["channel"] == "RETAIL" and f["fill_yyyymm"] <= spec.fills_last and f["product_code"] == "777"
    }
    usable = [f for f in trusted if f["is_maintenance"] == 1 and f["product_key"] in MARKETS]
    own, anywhere = defaultdict(list), defaultdict(list)
    for f in usable:
        key = (MARKETS[f["product_key"]], f["entity_id"])
        if f["channel"] in ("RETAIL", "MAIL"):
            anywhere[key].append(f)
        if f["channel"] == "RETAIL" and f["chain"] in ("032", "955"):
            own[(*key, f["chain"])].append(key_index(f["fill_yyyymm"]))
    found = []
    for (market, entity, chain), used in own.items():
        if market == "39200" and entity in users:
            continue
        for cohort in range(key_index(spec.cohort_first), key_index(spec.cohort_last) + 1):
            span = sorted(m for m in used if cohort <= m < cohort + 18)
            if cohort not in used or len(span) < spec.min_fills:
                continue
            status = "NEW" if not any(cohort - 12 <= m < cohort for m in used) else "CONTINUING"
            ends = span[1:] + [cohort + 18]
            gaps = [m for m, upto in zip(span, ends) if upto - m >= 7]
            if not gaps:
                found.append((market, chain, index_key(cohort), entity, status, 13, 13, "not lost", None))
                continue
            start = gaps[0]
            followup = [
                f
                for f in anywhere[(market, entity)]
                if start < key_index(f["fill_yyyymm"]) < start + 7
            ]
            number = start - cohort + 1
            if any(f["supplier_id"] == 348 for f in followup):
                after, dest, detail = 13, "not lost", None
            elif not followup:
                after, dest, detail = number, "Stopped Treatment", "Off Grid"
            else:

                def label(f):
                    if f["channel"] == "MAIL":
                        return "Mail"
                    return "Stopped Treatment" if f["chain"] is None else "Competitor"

                def kind(f):
                    if f["chain"] == "033":
                        return "Loss_Sam"
                    if f["chain"] in ("032", "955"):
                        return "Loss_WMT"
                    if f["outlet_class"] is None:
                        return "Off Grid" if label(f) == "Stopped Treatment" else "ATTENTION"
                    if f["outlet_class"] == "OTHER":
                        return "Loss_Mail"
                    return "Loss_" + f["outlet_class"].title()

                after, dest = number, best(followup, label)
                detail = best([f for f in followup if label(f) == dest], kind)
            found.append((market, chain, index_key(cohort), entity, status, number, after, dest, detail))
    return sorted(found, key=repr)


OUTCOME = (
    "market", "cohort_chain", "cohort_yyyymm", "entity_id", "status", "lost_month_before",
    "lost_month", "lost_dest", "lost_dest_detail",
)


def test_windowed_outcomes(spark):
    fills = list(world(5))
    got = fused.windowed_outcomes(make_inputs(spark, fills, exclusion=["0777"]), RetentionSpec())
    assert rows(got, *OUTCOME) == expected(fills)


@pytest.mark.parametrize("form", [fused.member_outcomes, fused.windowed_outcomes])
def test_a_chain_may_be_named_as_all_others_are(spark, form):
    """The own chain "other" against the own chain "own": names change nothing else."""
    found = []
    for own in ("own", "other"):
        spec = replace(RetentionSpec(), cohort_chains=(own, "955"), sister_chain="other_")
        fills = [
            {**f, "chain": {"032": own, "033": "other_", "101": "zz"}.get(f["chain"], f["chain"])}
            for f in world(6, n=2500)
        ]
        columns = [c for c in OUTCOME if c != "cohort_chain"]
        got = rows(form(make_inputs(spark, fills, exclusion=["0777"]), spec), "cohort_chain", *columns)
        found.append(sorted(("032" if c == own else c, *rest) for c, *rest in got), )
    plain = [
        (chain, market, *rest)
        for market, chain, *rest in expected([f for f in world(6, n=2500)])
    ]
    assert found[0] == found[1]
    assert found[0] == sorted(plain)


@pytest.mark.parametrize(
    "change",
    [{"cohort_first": 201401, "cohort_last": 201812}, {"min_fills": 1}, {"min_fills": 3}],
    ids=["five years", "one fill", "three fills"],
)
def test_studies_of_any_length_and_minimum(spark, change):
    spec = replace(RetentionSpec(), **change)
    assert not fused.fits(spec)
    fills = list(world(7, n=3000))
    got = rows(fused.member_outcomes(make_inputs(spark, fills, exclusion=["0777"]), spec), *OUTCOME)
    assert got == expected(fills, spec)
    curve = fused.survival_curve(make_inputs(spark, fills, exclusion=["0777"]), spec)
    assert rows(curve) == rows(LeanStudy(make_inputs(spark, fills, exclusion=["0777"]), spec).curve)


@pytest.mark.parametrize("seed", range(4))
def test_fused_outcomes(spark, seed):
    fills = list(world(seed))
    want = expected(fills)
    assert len({w[7] for w in want}) == 4
    got = rows(
        fused.member_outcomes(make_inputs(spark, fills, exclusion=["0777"]), RetentionSpec()),
        *OUTCOME,
    )
    assert got == want


@pytest.mark.parametrize("seed", [10, 11])
def test_stages(spark, seed):
    fills = list(world(seed))
    want = expected(fills)
    study = LeanStudy(make_inputs(spark, fills, exclusion=["0777"]), RetentionSpec())
    keys = ("market", "cohort_chain", "cohort_yyyymm", "entity_id", "status")
    assert rows(study.kept, *keys, "lost_month") == [w[:6] for w in want]
    from_fills = destination.lost_destination(
        destination.member_followup(study.followup, study.spec), study.spec
    )
    assert rows(from_fills, *keys, "lost_dest") == rows(study.destination, *keys, "lost_dest")
    assert rows(study.cleaned, *keys, "lost_month", "lost_dest") == sorted(
        (w[:5] + w[6:8] for w in want), key=repr
    )
    assert rows(study.outlet_class, *keys, "lost_month", "lost_dest", "lost_dest_detail") == sorted(
        (w[:6] + w[7:] for w in want if w[6] < 13), key=repr
    )
