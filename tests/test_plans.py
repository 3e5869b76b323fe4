"""What the physical plans must and must not contain."""

import re

import pytest

from lapsewise.operators import reduce
from lapsewise.plans import catalog, fused
from lapsewise.plans.inputs import StarInputs
from lapsewise.plans.staged import LeanStudy, StagedStudy
from lapsewise.sources import stages
from lapsewise.sources.star import STAR_SPEC

SF_DIR = "/root/testdata/sf0.01"
# Write stages while being built.
SKIP = {"stage_ledger", "qc_form_diff", "qc_version_rows"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def flagship(spark):
    return plan_of(catalog.REGISTRY["survival_curve_all"](spark, SF_DIR))


@pytest.mark.parametrize("name", sorted(set(catalog.REGISTRY) - SKIP))
def test_no_product_of_rows_and_no_python(spark, name):
    plan = plan_of(catalog.REGISTRY[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "InPandas", "InArrow"):
        assert bad not in plan


def test_month_bounds_reach_the_scan(flagship):
    scans = [line for line in flagship.split("\n") if "l_shipdate" in line and "FileScan" in line]
    assert len(scans) == 2
    for scan in scans:
        assert re.search(r"PushedFilters: \[.*LessThan\(l_shipdate", scan)
    assert any("GreaterThanOrEqual(l_shipdate" in scan for scan in scans)


def test_scans_read_few_columns(flagship):
    for scan in flagship.split("\n"):
        if "FileScan" in scan:
            assert not re.search(r"l_extendedprice|l_tax|l_comment|o_totalprice|p_retailprice", scan)


@pytest.fixture
def no_broadcasts(spark):
    """Plans as for large tables: only what is hinted, behind a size check, is broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def exchange_keys(plan):
    """Keys of all shuffles between executors, in the plan's order; reuse is not counted."""
    found = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    return [re.sub(r"#\d+L?|, \d+$", "", re.sub(r", \d+, [A-Z_]+.*$", "", keys)) for keys in found]


def keys_only(plan):
    return [", ".join(k for k in keys.split(", ") if not k.isdigit() and not k.isupper()) for keys in exchange_keys(plan)]


def fact_scans(plan):
    return len([line for line in plan.split("\n") if "FileScan" in line and "l_shipdate" in line])


#: Shuffles of the product dimension for the market's own definition.
OF_MARKET = {"market, product_key", "product_key", "market", "ndc_cd", "prod_id, pack_cd"}


def test_shuffles_of_the_fused_plan(spark, no_broadcasts):
    """The fact: one shuffle to its orders in each branch, one for the counts, one to the entity."""
    members = keys_only(plan_of(catalog.REGISTRY["member_outcomes"](spark, SF_DIR)))
    rest = sorted(k for k in members if k not in OF_MARKET)
    assert rest == sorted(
        [
            "l_orderkey",
            "o_orderkey",
            "l_orderkey",
            "o_orderkey",
            "filter_word",
            "entity_id, market, market_desc, month_no, chain, channel, outlet_class, own_mail",
            "entity_id",
            "entity_id",
        ]
    )


@pytest.mark.parametrize("name", ["survival_curve_all", "entity_status", "exclude_code_users", "fills_in_market"])
def test_line_items_meet_outlets_and_products_before_any_shuffle(spark, no_broadcasts, name):
    plan = plan_of(catalog.REGISTRY[name](spark, SF_DIR))
    keys = keys_only(plan)
    assert not {"l_suppkey", "s_suppkey", "l_partkey", "product_code"} & set(keys)
    assert keys.count("l_orderkey") == fact_scans(plan)
    lines = plan.split("\n")
    for k, line in enumerate(lines):
        if "hashpartitioning(l_orderkey" in line:
            depth = re.search(r"[A-Z]", line).start()
            below = []
            for later in lines[k + 1 :]:
                if re.search(r"[A-Z]", later).start() <= depth:
                    break
                below.append(later)
            assert any("BroadcastHashJoin" in x and "l_suppkey" in x for x in below)
            assert any("BroadcastHashJoin" in x and ("l_partkey" in x or "product" in x) for x in below)


@pytest.mark.parametrize(
    "name, most",
    [
        ("cohort_members", 1),
        ("entity_status", 2),
        ("cohort_min_fills", 2),
        ("lost_month", 2),
        ("own_mail_cleanup", 3),
        ("lost_outlet_class", 3),
        ("lost_destination", 2),
        ("lost_window_fills", 2),
        ("survival_month_zero", 2),
        ("survival_curve_joined", 3),
        ("qc_stage_checks", 2),
        ("qc_distinct_rollup", 2),
        ("qc_gap_reconcile", 2),
        ("qc_version_diff", 4),
        ("survival_curve_all", 2),
    ],
)
def test_reads_of_the_fact(spark, name, most):
    assert fact_scans(plan_of(catalog.REGISTRY[name](spark, SF_DIR))) <= most


def below(plan, start):
    """Lines of the subtree under the line that has ``start``."""
    lines = plan.split("\n")
    at = next(k for k, line in enumerate(lines) if start in line)
    depth = re.search(r"[A-Z]", lines[at]).start()
    found = []
    for line in lines[at + 1 :]:
        if not re.search(r"[A-Z]", line) or re.search(r"[A-Z]", line).start() <= depth:
            break
        found.append(line)
    return found


def test_orders_of_few_items_are_filtered_before_their_shuffle(spark, no_broadcasts):
    plan = plan_of(catalog.StagedStudy(StarInputs(spark, SF_DIR), STAR_SPEC)._listed)
    under = below(plan, "hashpartitioning(o_orderkey")
    assert any("BroadcastHashJoin" in line and "filter_word" in line for line in under)
    made_from = [line for line in under if "FileScan" in line and "l_orderkey" in line]
    assert len(made_from) == 1 and "l_shipdate" not in made_from[0]


def test_orders_that_are_broadcast_are_not_filtered(spark):
    assert "filter_word" not in plan_of(catalog.REGISTRY["exclude_code_users"](spark, SF_DIR))


def test_key_filter_keeps_partners_and_drops_most_others(spark):
    keys = spark.range(0, 30_000, 3).toDF("k")
    made = reduce.key_filter(keys, "k", 4096)
    assert made.count() <= 4096
    rows = spark.range(30_000).selectExpr("if(id % 7 = 0, null, id) as k")
    kept = {r.k for r in reduce.may_have(rows, "k", made, 4096).collect()}
    partners = {k for k in range(0, 30_000, 3) if k % 7}
    assert partners <= kept and len(kept - partners) < 0.15 * 30_000 and None not in kept
    assert reduce.may_have(rows, "k", reduce.key_filter(keys.limit(0), "k")).count() == 0


@pytest.mark.parametrize("kind", [StagedStudy, LeanStudy])
def test_stored_stages_join_without_a_shuffle(spark, no_broadcasts, tmp_path, monkeypatch, kind):
    """Only what comes from the fact is shuffled to the entity; stages made of stages are not."""
    plans = {}
    write = stages.write_stage

    def recorded(df, path, partition_by=(), bucket_by=(), buckets=0):
        dealt = df.repartition(buckets, *bucket_by) if bucket_by else df
        plans[path.rsplit("/", 1)[1]] = plan_of(dealt)
        return write(df, path, partition_by, bucket_by, buckets)

    monkeypatch.setattr(stages, "write_stage", recorded)
    study = kind(StarInputs(spark, "/root/testdata/sf0.001"), STAR_SPEC, str(tmp_path))
    study.cleaned, study.status
    assert {"months", "lost", "kinds", "followup_kinds", "outcome", "code_users", "cleaned"} <= set(plans)
    for name in set(plans) - {"market", "qualified", "months", "kinds", "code_users"}:
        assert "hashpartitioning" not in plans[name], name
    with stages.co_located(spark):
        for result in (study.kept, study.destination, study.outlet_class):
            assert "hashpartitioning" not in plan_of(result)
    stages.remove(spark, str(tmp_path))


def test_joined_curve_reads_the_fact_for_its_counts_only(spark):
    study = LeanStudy(StarInputs(spark, SF_DIR), STAR_SPEC)
    assert fact_scans(plan_of(fused.member_counts(study.cleaned))) <= 3
    assert fact_scans(plan_of(catalog.REGISTRY["survival_curve_joined"](spark, SF_DIR))) == 0


def test_form_diff_reads_the_fact_four_times(spark, tmp_path):
    study = StagedStudy(StarInputs(spark, "/root/testdata/sf0.001"), STAR_SPEC, str(tmp_path))
    reads = [fact_scans(plan_of(x)) for x in (study.inputs.fills_in_market(study.market), study._any_chain, study._listed)]
    fusion = fused.member_outcomes(study.inputs, STAR_SPEC, users=study.code_users)
    assert sum(reads) + fact_scans(plan_of(fusion)) <= 4
    stages.remove(spark, str(tmp_path))


def test_lifecycle_shuffles_once_after_the_month_counts(spark):
    plan = plan_of(catalog.REGISTRY["cohort_lifecycle"](spark, SF_DIR))
    keys = [
        re.sub(r"#\d+L?", "", e) for e in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    ]
    assert sum(k.startswith("market, chain, entity_id,") for k in keys) == 1
