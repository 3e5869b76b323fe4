"""Named queries over the star tables: one per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise import spec as S
from lapsewise.functions import keys, labels, months
from lapsewise.operators import cohort, destination, fills, gaps, market, qc, survival
from lapsewise.plans import fused
from lapsewise.plans.inputs import StarInputs
from lapsewise.plans.staged import LeanStudy, StagedStudy
from lapsewise.sources import stages, star

Query = Callable[[SparkSession, str], DataFrame]
SPEC = star.STAR_SPEC
CLAIM = ("claim_order", "claim_line")
REGISTRY: dict[str, Query] = {}


def query(build: Query) -> Query:
    REGISTRY[build.__name__] = build
    return build


def _steps(spark: SparkSession, sf_dir: str, store: str | None = None) -> StagedStudy:
    return StagedStudy(StarInputs(spark, sf_dir), SPEC, store)


def _lean(spark: SparkSession, sf_dir: str) -> LeanStudy:
    return LeanStudy(StarInputs(spark, sf_dir), SPEC)


def _outcomes(spark: SparkSession, sf_dir: str, exclude: bool = True) -> DataFrame:
    return fused.member_outcomes(StarInputs(spark, sf_dir), SPEC, exclude)


def _store(spark: SparkSession) -> str:
    """A folder for stages of one query."""
    return f"{stages.scratch(spark)}/stages-{uuid.uuid4().hex}"


def _small(df: DataFrame) -> DataFrame:
    """The rows of a report, at most a few per cohort, computed now: what they were made from may go."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _still_lost(members: DataFrame) -> DataFrame:
    return members.filter(F.col("lost_month") <= SPEC.last_lost_month)


# Scans and fill predicates


@query
def fills_scan(spark, sf_dir):
    return StarInputs(spark, sf_dir).fills.select(
        *CLAIM, "entity_id", "fill_date", "fill_month", "fill_yyyymm", "product_key", "chain",
        "channel", "outlet_class", "days_supply", "supplier_id", "state",
    )


@query
def fills_qualified(spark, sf_dir):
    rows = fills.qualified_fills(
        StarInputs(spark, sf_dir).fills, SPEC, SPEC.lookback_first, SPEC.fills_last
    )
    return fills.with_weight(rows, SPEC).select(
        *CLAIM, "entity_id", "fill_date", "chain", "channel", "supplier_id", "state", "fill_weight"
    )


@query
def fills_in_market(spark, sf_dir):
    return _steps(spark, sf_dir).qualified.select(
        *CLAIM, "entity_id", "fill_date", "product_key", "market", "market_desc", "prod_desc",
        "chain", "fill_weight",
    )


# Market definition


@query
def market_by_attribute(spark, sf_dir):
    return market.market_by_attribute(StarInputs(spark, sf_dir).products, SPEC)


@query
def market_by_code_list(spark, sf_dir):
    i = StarInputs(spark, sf_dir)
    return market.market_by_code_list(i.products, i.bridge, i.market_codes, SPEC)


@query
def market_definition(spark, sf_dir):
    return _steps(spark, sf_dir).market


# Column functions over whole tables


@query
def fn_product_key(spark, sf_dir):
    return star.Tables(spark, sf_dir)("part").select(
        "p_partkey",
        keys.product_key(F.col("p_partkey"), F.col("p_size")).alias("product_key"),
    )


@query
def fn_code_normalise(spark, sf_dir):
    part_key = F.col("p_partkey").cast("string")
    return star.Tables(spark, sf_dir)("part").select(
        "p_partkey",
        keys.code_number(keys.padded_code(part_key, 12)).alias("from_padded"),
        keys.code_number(part_key).alias("from_short"),
        keys.code_number(F.col("p_brand")).alias("from_dirty"),
    )


@query
def fn_month_parse(spark, sf_dir):
    key = months.month_key(F.col("o_orderdate").cast("date"))
    return star.Tables(spark, sf_dir)("orders").select(
        "o_orderkey", key.alias("order_yyyymm"), months.month_start(key).alias("order_month")
    )


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.Tables(spark, sf_dir)("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("ship_date")
    )


@query
def fn_month_floor(spark, sf_dir):
    return _shipped(spark, sf_dir).withColumn("ship_month", months.month_floor(F.col("ship_date")))


@query
def fn_month_key(spark, sf_dir):
    return _shipped(spark, sf_dir).withColumn("ship_yyyymm", months.month_key(F.col("ship_date")))


@query
def fn_fill_weight(spark, sf_dir):
    return star.Tables(spark, sf_dir)("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        labels.fill_weight(F.col("l_quantity"), SPEC).alias("fill_weight"),
    )


@query
def fn_outlet_label(spark, sf_dir):
    return star.Tables(spark, sf_dir)("part").select(
        "p_partkey", labels.outlet_label(F.col("p_type"), SPEC).alias("outlet_label")
    )


# Cohorts


@query
def cohort_members(spark, sf_dir):
    return _steps(spark, sf_dir).members


@query
def cohort_fills(spark, sf_dir):
    return _steps(spark, sf_dir).cohort_fills.select(
        *CLAIM, "market", "cohort_chain", "cohort_yyyymm", "cohort_month", "entity_id",
        "fill_date", "fill_month", "product_key", "fill_weight",
    )


@query
def period_dim(spark, sf_dir):
    return _steps(spark, sf_dir).period_dim


@query
def cohort_min_fills(spark, sf_dir):
    return _steps(spark, sf_dir).active_members.select(*cohort.MEMBER_WIDE)


@query
def entity_status(spark, sf_dir):
    return _steps(spark, sf_dir).status.select(*cohort.MEMBER_WIDE, "status")


@query
def status_fills(spark, sf_dir):
    study = _lean(spark, sf_dir)
    return cohort.status_fills(study.cohort_fills, study.status).select(
        *CLAIM, "market", "cohort_chain", "cohort_yyyymm", "entity_id", "status", "fill_date",
        "fill_weight",
    )


@query
def fills_by_month(spark, sf_dir):
    return _lean(spark, sf_dir).monthly


# Gaps and lost month


@query
def entity_gaps(spark, sf_dir):
    return _lean(spark, sf_dir).gaps


@query
def first_long_gap(spark, sf_dir):
    return _lean(spark, sf_dir).first_gap


@query
def lost_month(spark, sf_dir):
    return gaps.lost_month(_lean(spark, sf_dir).gaps, SPEC)


@query
def cohort_lifecycle(spark, sf_dir):
    return _lean(spark, sf_dir).lifecycle.drop("fills_in_span")


# Destinations and exclusions


@query
def lost_window_fills(spark, sf_dir):
    return _lean(spark, sf_dir).followup.select(
        *destination.LOSS, "fill_yyyymm", "chain", "channel", "outlet_class", "fill_date",
        "supplier_id", "product_key", "fill_weight", "lost_dest",
    )


@query
def lost_destination(spark, sf_dir):
    return _lean(spark, sf_dir).destination


@query
def exclude_code_users(spark, sf_dir):
    return _lean(spark, sf_dir).kept


@query
def own_mail_cleanup(spark, sf_dir):
    return _lean(spark, sf_dir).cleaned.select(*destination.LOSS, "lost_dest")


@query
def lost_outlet_class(spark, sf_dir):
    return _lean(spark, sf_dir).outlet_class


@query
def member_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


# Survival curves


@query
def lost_by_destination(spark, sf_dir):
    return survival.lost_by_destination(_still_lost(_outcomes(spark, sf_dir)), SPEC, unique=True)


@query
def survival_at_risk(spark, sf_dir):
    return survival.survival_at_risk(_outcomes(spark, sf_dir), unique=True)


@query
def survival_rate(spark, sf_dir):
    return survival.survival_rate(survival_at_risk(spark, sf_dir), SPEC)


@query
def survival_month_zero(spark, sf_dir):
    return survival.survival_month_zero(survival_rate(spark, sf_dir))


@query
def survival_curve_new(spark, sf_dir):
    return fused.survival_curve(StarInputs(spark, sf_dir), SPEC, S.NEW)


@query
def survival_curve_cont(spark, sf_dir):
    return fused.survival_curve(StarInputs(spark, sf_dir), SPEC, S.CONTINUING)


@query
def survival_curve_all(spark, sf_dir):
    return fused.survival_curve(StarInputs(spark, sf_dir), SPEC)


@query
def survival_curve_joined(spark, sf_dir):
    """The report as a join of the curve with its destinations, from stored member counts."""
    counts = fused.member_counts(_lean(spark, sf_dir).cleaned)
    return survival.curve_by_join(stages.write_stage(counts, f"{_store(spark)}/counts"), SPEC)


@query
def survival_rate_dense(spark, sf_dir):
    return survival.dense_rate(survival_at_risk(spark, sf_dir), SPEC)


@query
def curve_report_topn(spark, sf_dir):
    return qc.curve_report_topn(survival_curve_all(spark, sf_dir), 200)


# Checks


@query
def distinct_pairs(spark, sf_dir):
    return qc.distinct_pairs(_lean(spark, sf_dir).followup, "channel", "lost_dest")


@query
def distinct_pairs_class(spark, sf_dir):
    lost = _still_lost(_outcomes(spark, sf_dir))
    return qc.distinct_pairs(lost, "lost_dest", "lost_dest_detail")


@query
def distinct_pairs_curve(spark, sf_dir):
    curve = survival_curve_all(spark, sf_dir)
    return qc.distinct_pairs(curve, "lost_dest", "lost_dest_detail")


@query
def preview(spark, sf_dir):
    return qc.preview(_outcomes(spark, sf_dir), cohort.MEMBER)


@query
def stage_ledger(spark, sf_dir):
    """Runs the steps through written stages, each computed once, and leaves none of them.

    The ledger itself is a row per stage, counted while the stage was written.
    """
    store = _store(spark)
    try:
        ledger = _steps(spark, sf_dir, store).ledger()
        return spark.createDataFrame(list(ledger.items()), "stage string, n_rows long")
    finally:
        stages.remove(spark, store)


@query
def qc_market_size(spark, sf_dir):
    return qc.market_size(_steps(spark, sf_dir).market)


@query
def qc_entity_counts(spark, sf_dir):
    return qc.entity_counts(_lean(spark, sf_dir).status, (*qc.COHORT, "status"), unique=True)


@query
def qc_entity_counts_fills(spark, sf_dir):
    study = _steps(spark, sf_dir)
    copies = cohort.cohort_fills(study.months, study.members, SPEC)
    return qc.entity_counts(copies, weight="n_fills")


@query
def qc_entity_counts_followup(spark, sf_dir):
    """Follow-up fills and their entities by segment."""
    kinds = _lean(spark, sf_dir).followup_kinds.filter(F.col("lost_month") < SPEC.never_lost)
    return qc.entity_counts(kinds, survival.SEGMENT, "n_fills")


@query
def qc_entity_counts_destination(spark, sf_dir):
    return qc.entity_counts(_lean(spark, sf_dir).destination, survival.SEGMENT, unique=True)


@query
def qc_entity_counts_excluded(spark, sf_dir):
    kept = _lean(spark, sf_dir).kept
    lost = kept.filter(F.col("lost_month") <= SPEC.last_lost_month)
    return qc.entity_counts(lost, survival.SEGMENT, unique=True)


@query
def qc_entity_counts_cleaned(spark, sf_dir):
    return qc.entity_counts(_lean(spark, sf_dir).cleaned, survival.SEGMENT, unique=True)


@query
def qc_gap_reconcile(spark, sf_dir):
    return qc.gap_reconcile(_lean(spark, sf_dir).status_fills)


@query
def qc_lost_month_hist(spark, sf_dir):
    return qc.lost_month_hist(_lean(spark, sf_dir).lost)


@query
def qc_lost_month_delta(spark, sf_dir):
    return qc.lost_month_delta(_outcomes(spark, sf_dir), "lost_month_before", "lost_month")


@query
def qc_lost_month_dest(spark, sf_dir):
    return qc.lost_month_dest(_outcomes(spark, sf_dir))


@query
def qc_dest_counts(spark, sf_dir):
    kinds = _lean(spark, sf_dir).followup_kinds
    return qc.dest_counts(kinds.filter(F.col("lost_month") < SPEC.never_lost))


@query
def qc_grand_total_before(spark, sf_dir):
    return qc.with_grand_total(_lean(spark, sf_dir).lost, unique=True)


@query
def qc_grand_total(spark, sf_dir):
    return qc.with_grand_total(_outcomes(spark, sf_dir), unique=True)


@query
def qc_grand_total_lost(spark, sf_dir):
    members = _outcomes(spark, sf_dir)
    lost = members.filter(F.col("lost_month_before") <= SPEC.last_lost_month)
    return qc.with_grand_total(lost, unique=True)


@query
def qc_window_breach(spark, sf_dir):
    return qc.window_breach(_lean(spark, sf_dir).followup)


@query
def qc_outlet_class(spark, sf_dir):
    return qc.outlet_class_counts(_still_lost(_outcomes(spark, sf_dir)), unique=True)


@query
def qc_month_zero(spark, sf_dir):
    return qc.month_zero(survival_curve_all(spark, sf_dir))


@query
def qc_curve_totals(spark, sf_dir):
    return qc.curve_totals(survival_curve_all(spark, sf_dir))


@query
def qc_version_diff(spark, sf_dir):
    """The step-by-step members against those of the windows, counted."""
    return qc.version_diff(
        _steps(spark, sf_dir).lost,
        _lean(spark, sf_dir).lost,
        ("market", "cohort_chain", "cohort_yyyymm", "lost_month"),
    )


@query
def qc_form_diff(spark, sf_dir):
    """The step-by-step members and their outcomes against the fused ones, row by row.

    The steps run through stored stages, so that each is computed once; both forms leave out the same stored code users.
    """
    columns = (*cohort.MEMBER, "status", "lost_month", "lost_dest", "lost_dest_detail")
    still_lost = F.col("lost_month") <= SPEC.last_lost_month
    store = _store(spark)
    try:
        study = _steps(spark, sf_dir, store)
        steps = study.cleaned.withColumn("lost_dest_detail", F.when(still_lost, F.col("lost_dest_detail")))
        fusion = fused.member_outcomes(study.inputs, SPEC, users=study.code_users)
        return _small(qc.row_diff(steps, fusion, columns))
    finally:
        stages.remove(spark, store)


@query
def qc_version_rows(spark, sf_dir):
    """Members' status against the version stored before, which looked back half as far, row by row."""
    store = _store(spark)
    short = replace(SPEC, lookback_months=SPEC.lookback_months // 2)
    try:
        for spec in (short, SPEC):
            new = LeanStudy(StarInputs(spark, sf_dir, spec), spec, store).status
        old = stages.read_stage(spark, f"{store}/status", 1)
        with stages.co_located(spark):
            return _small(qc.version_rows(old, new, cohort.MEMBER, ("status",), ("market", "cohort_chain", "cohort_yyyymm")))
    finally:
        stages.remove(spark, store)


@query
def qc_stage_checks(spark, sf_dir):
    """All checks on the cleaned members in one pass."""
    return qc.stage_checks(_outcomes(spark, sf_dir))


@query
def qc_distinct_rollup(spark, sf_dir):
    """Entities per market, chain and status, per market and chain, per market and in all, each counted once."""
    return qc.distinct_rollup(_outcomes(spark, sf_dir), ("market", "cohort_chain", "status"))
