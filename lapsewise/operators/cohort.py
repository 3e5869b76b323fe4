"""Cohorts: who is in, what they bought, and whether they were there before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsewise import spec as S
from lapsewise.functions.months import month_index, month_start, months_apart
from lapsewise.spec import RetentionSpec

MEMBER = ("market", "cohort_chain", "cohort_yyyymm", "entity_id")
#: What members hand on to their fills, if they have it.
HANDED_ON = ("status", "fills_in_span")
MEMBER_WIDE = (
    "market", "market_desc", "cohort_chain", "cohort_yyyymm", "cohort_month", "entity_id",
)


def cohort_members(market_fills: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Every (market, chain, month, entity) with a fill in the cohort months.

    ``market_fills`` are qualified fills with their market. An entity enters
    each month in which it buys, not only its first.
    """
    return (
        market_fills.filter(
            F.col("fill_yyyymm").between(spec.cohort_first, spec.cohort_last)
        )
        .select(
            "market",
            "market_desc",
            F.col("chain").alias("cohort_chain"),
            F.col("fill_yyyymm").alias("cohort_yyyymm"),
            "entity_id",
        )
        .distinct()
        .withColumn("cohort_month", month_start(F.col("cohort_yyyymm")))
        .select(*MEMBER_WIDE)
    )


def month_grain(market_fills: DataFrame) -> DataFrame:
    """Qualified fills counted per market, chain, entity and month.

    A hot entity shrinks to a row per month on the map side, before any shuffle.
    Fills of no known entity join nothing later, so they go here.
    """
    return market_fills.filter(F.col("entity_id").isNotNull()).groupBy(
        "market", "market_desc", "chain", "entity_id", "fill_month", "fill_yyyymm"
    ).agg(F.count("*").alias("n_fills"), F.sum("fill_weight").alias("weighted_fills"))


def month_grain_of_all(market_fills: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Month grain with the months in which the entity bought anywhere; one read serves both.

    ``market_fills`` are trusted maintenance fills of any chain with their market and weight, retail or mail, from the
    lookback to the last span month. ``fill_months`` lists the entity's months with a follow-up fill, as
    ``destination.followed_months`` does; both sums need one shuffle of fills, already counted.
    """
    month = F.col("fill_yyyymm")
    own = F.col("channel").isin(*spec.cohort_channels) & F.col("chain").isin(*spec.cohort_chains)
    later = month.between(spec.cohort_first, spec.fills_last) & F.col("channel").isin(*spec.followup_channels)
    counted = (
        market_fills.filter(F.col("entity_id").isNotNull() & (own | later))
        .withColumn("chain", F.when(own, F.col("chain")))
        .groupBy("market", "market_desc", "chain", "entity_id", "fill_month", "fill_yyyymm")
        .agg(
            F.count("*").alias("n_fills"),
            F.sum("fill_weight").alias("weighted_fills"),
            F.max(later).alias("later"),
        )
    )
    months = F.collect_set(F.when(F.col("later"), month)).over(Window.partitionBy("market", "entity_id"))
    return counted.withColumn("fill_months", months).filter(F.col("chain").isNotNull()).drop("later")


def cohort_fills(market_fills: DataFrame, members: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Each member's fills at its own chain, from the cohort month to the span's end.

    A fill is repeated for every cohort it follows (at most one per month of the
    span). Takes single fills or month-grain counts alike; what goes on to count
    fills should pass the latter. Members that have a status or a sum of fills hand it on.
    """
    status = [c for c in members.columns if c in HANDED_ON]
    keys = members.select(
        "market",
        F.col("cohort_chain").alias("chain"),
        "entity_id",
        "cohort_yyyymm",
        "cohort_month",
        *status,
    )
    distance = months_apart(F.col("fill_month"), F.col("cohort_month"))
    return (
        market_fills.join(keys, ["entity_id", "chain", "market"])
        .filter(distance.between(0, spec.span_months - 1))
        .withColumn("cohort_chain", F.col("chain"))
    )


def period_dim(market_fills: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Per cohort month in the data: dates seen, calendar bounds, and horizons.

    Horizons come from the calendar, not from the dates seen, so a month without
    a fill on its first day keeps its cohort.
    """
    begin = F.col("cohort_begin")
    return (
        market_fills.filter(
            F.col("fill_yyyymm").between(spec.cohort_first, spec.cohort_last)
        )
        .groupBy(F.col("fill_yyyymm").alias("cohort_yyyymm"))
        .agg(F.min("fill_date").alias("first_fill"), F.max("fill_date").alias("last_fill"))
        .withColumn("cohort_begin", month_start(F.col("cohort_yyyymm")))
        .withColumns(
            {
                "cohort_end": F.last_day(begin),
                "lookback_begin": F.add_months(begin, -spec.lookback_months),
                "lookback_end": F.date_sub(begin, 1),
                "lookforward_end": F.last_day(F.add_months(begin, spec.span_months - 1)),
            }
        )
    )


def member_history(members: DataFrame, monthly: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Members with their fills in the span and their fill months in the lookback.

    ``monthly`` is month-grain and reaches back ``lookback_months``. One band join
    serves both: a month lies in the span or before the cohort. Both ends are whole
    calendar months, so the bounds of ``period_dim`` are month arithmetic here. Every
    member has its own cohort month, so none is lost, and all its columns are carried
    along: nothing is joined back.
    """
    keys = members.select(*MEMBER_WIDE).withColumnsRenamed(
        {"market_desc": "member_desc", "cohort_chain": "chain"}
    )
    distance = month_index(F.col("fill_yyyymm")) - month_index(F.col("cohort_yyyymm"))
    return (
        monthly.select("market", "chain", "entity_id", "fill_yyyymm", "n_fills")
        .join(keys, ["entity_id", "chain", "market"])
        .withColumn("distance", distance)
        .filter(F.col("distance").between(-spec.lookback_months, spec.span_months - 1))
        .groupBy(
            "market",
            F.col("member_desc").alias("market_desc"),
            F.col("chain").alias("cohort_chain"),
            "cohort_yyyymm",
            "cohort_month",
            "entity_id",
        )
        .agg(
            F.coalesce(F.sum(F.when(F.col("distance") >= 0, F.col("n_fills"))), F.lit(0)).alias("fills_in_span"),
            F.count_if(F.col("distance") < 0).alias("months_before"),
        )
    )


def cohort_min_fills(history: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Members with enough fills in the span; two on one day are two."""
    return history.filter(F.col("fills_in_span") >= spec.min_fills)


def entity_status(active: DataFrame) -> DataFrame:
    """NEW, or CONTINUING if the entity bought at this chain in the lookback."""
    status = F.when(F.col("months_before") > 0, S.CONTINUING).otherwise(S.NEW)
    return active.select(*MEMBER_WIDE, status.alias("status"), "fills_in_span")


def status_fills(fills_of_cohort: DataFrame, members: DataFrame) -> DataFrame:
    """Cohort fills of the members that remain, with their status."""
    more = [c for c in members.columns if c in HANDED_ON]
    return fills_of_cohort.join(members.select(*MEMBER, *more), list(MEMBER))
