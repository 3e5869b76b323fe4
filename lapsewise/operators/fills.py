"""Predicates on the fill fact; each stage has its own set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.functions.labels import fill_weight
from lapsewise.spec import RetentionSpec


def trusted_fills(fills: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Drop bridge errors and excluded suppliers and states.

    A NULL in any of the three also drops the row, as SQL comparison does.
    """
    return fills.filter(
        (F.col("is_bridge_error") != 1)
        & ~F.col("supplier_id").isin(*spec.excluded_suppliers)
        & ~F.col("state").isin(*spec.excluded_states)
    )


def with_weight(fills: DataFrame, spec: RetentionSpec) -> DataFrame:
    return fills.withColumn("fill_weight", fill_weight(F.col("days_supply"), spec))


def qualified_fills(
    fills: DataFrame, spec: RetentionSpec, first: int, last: int
) -> DataFrame:
    """Maintenance fills at the cohort chains, retail, in a closed month range."""
    return trusted_fills(fills, spec).filter(
        F.col("fill_yyyymm").between(first, last)
        & F.col("channel").isin(*spec.cohort_channels)
        & F.col("chain").isin(*spec.cohort_chains)
        & (F.col("is_maintenance") == 1)
    )


def followup_fills(fills: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Maintenance fills at any chain, retail or mail."""
    return trusted_fills(fills, spec).filter(
        F.col("fill_yyyymm").between(spec.cohort_first, spec.fills_last)
        & F.col("channel").isin(*spec.followup_channels)
        & (F.col("is_maintenance") == 1)
    )


def exclusion_fills(fills: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Retail fills of any product, at any chain, from the first month on record."""
    return trusted_fills(fills, spec).filter(
        (F.col("fill_yyyymm") <= spec.fills_last)
        & (F.col("channel") == spec.retail_channel)
    )
