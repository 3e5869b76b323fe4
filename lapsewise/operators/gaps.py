"""Gaps between fill months, and the first one long enough to mean a loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.functions.months import index_to_key, month_index, month_key, months_apart
from lapsewise.operators.cohort import MEMBER, MEMBER_WIDE, cohort_fills
from lapsewise.spec import RetentionSpec


def fills_by_month(monthly: DataFrame, members: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Fills and weighted fills per member (with status) and month.

    Fills are counted per month before they meet the cohorts, so nothing is
    grouped afterwards.
    """
    return cohort_fills(monthly, members, spec).select(
        *MEMBER_WIDE, "status", "fill_month", "fill_yyyymm", "n_fills", "weighted_fills"
    )


def entity_gaps(monthly: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Months to the next fill month, or to the end of the span after the last."""
    later = Window.partitionBy(*MEMBER_WIDE).orderBy("fill_yyyymm")
    upto = F.coalesce(
        F.lead("fill_month").over(later), F.add_months("cohort_month", spec.span_months)
    )
    return (
        monthly.withColumn("gap_end_month", upto)
        .withColumn("gap_start", F.col("fill_yyyymm"))
        .withColumn("gap_end", month_key(F.col("gap_end_month")))
        .withColumn("month_gap", months_apart(F.col("gap_end_month"), F.col("fill_month")))
    )


def first_long_gap(gaps: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Last fill month before each member's first long gap, if it has one."""
    return (
        gaps.filter(F.col("month_gap") >= spec.gap_months)
        .groupBy(*MEMBER)
        .agg(
            F.min("fill_month").alias("last_fill_month"),
            F.min("gap_start").alias("before_gap_start"),
            month_key(F.add_months(F.min("fill_month"), spec.gap_months)).alias("after_gap_end"),
        )
    )


def lost_month(gaps: DataFrame, spec: RetentionSpec) -> DataFrame:
    """All members, numbered by the month of their loss; the last number is never.

    Every member has a row in ``gaps`` (its cohort month at least), so the members
    without a long gap are kept by the aggregation itself, not by an outer join.
    """
    start = F.min(F.when(F.col("month_gap") >= spec.gap_months, F.col("fill_month")))
    distance = months_apart(F.col("last_fill_month"), F.col("cohort_month"))
    return (
        gaps.groupBy(*MEMBER_WIDE, "status")
        .agg(start.alias("last_fill_month"))
        .select(
            "*",
            month_key(F.col("last_fill_month")).alias("before_gap_start"),
            month_key(F.add_months("last_fill_month", spec.gap_months)).alias("after_gap_end"),
            F.coalesce(distance + 1, F.lit(spec.never_lost)).alias("lost_month"),
        )
    )


def cohort_lifecycle(monthly: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Membership, status and lost month from month-grain fills alone.

    Gives what members, minimum fills, status, gaps and lost month give in turn,
    but fills are never copied per cohort: range frames look ahead and back from
    each month. ``monthly`` runs from the lookback to the last span month; ``fill_months`` is handed on.
    """
    per_entity = Window.partitionBy("market", "chain", "entity_id").orderBy("month_idx")
    span = per_entity.rangeBetween(0, spec.span_months - 1)
    lookback = per_entity.rangeBetween(-spec.lookback_months, -1)
    onward = per_entity.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    idx = F.col("month_idx")
    last_start = idx + (spec.span_months - spec.gap_months)
    lost = F.col("gap_idx") <= last_start
    last_fill = F.when(lost, F.col("gap_idx"))
    handed_on = [c for c in monthly.columns if c == "fill_months"]
    return (
        monthly.withColumn("month_idx", month_index(F.col("fill_yyyymm")))
        .withColumn("fills_in_span", F.sum("n_fills").over(span))
        .withColumn("months_before", F.count("*").over(lookback))
        .withColumn("next_idx", F.lead("month_idx").over(per_entity))
        .withColumn(
            "long_gap_idx",
            F.when(
                F.col("next_idx").isNull() | (F.col("next_idx") - idx >= spec.gap_months), idx
            ),
        )
        .withColumn("gap_idx", F.min("long_gap_idx").over(onward))
        .filter(
            F.col("fill_yyyymm").between(spec.cohort_first, spec.cohort_last)
            & (F.col("fills_in_span") >= spec.min_fills)
        )
        .select(
            "market",
            "market_desc",
            F.col("chain").alias("cohort_chain"),
            F.col("fill_yyyymm").alias("cohort_yyyymm"),
            "entity_id",
            F.when(F.col("months_before") > 0, "CONTINUING").otherwise("NEW").alias("status"),
            index_to_key(last_fill).alias("before_gap_start"),
            index_to_key(last_fill + spec.gap_months).alias("after_gap_end"),
            F.coalesce(last_fill - idx + 1, F.lit(spec.never_lost)).alias("lost_month"),
            "fills_in_span",
            *handed_on,
        )
    )
