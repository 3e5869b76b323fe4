"""Checks on stages and reports, as reusable queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.operators.survival import SEGMENT, entities
from lapsewise.spec import Labels

COHORT = ("market", "market_desc", "cohort_yyyymm", "cohort_chain")


def market_size(market: DataFrame) -> DataFrame:
    return (
        market.groupBy("market", "market_desc")
        .agg(F.count("*").alias("n_products"))
        .orderBy("market", "market_desc")
    )


def entity_counts(
    rows: DataFrame,
    by: tuple[str, ...] = COHORT,
    weight: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """Rows and distinct entities per cohort; ``weight`` names a count per row.

    ``unique`` states that an entity has one row per group, which saves a shuffle.
    """
    n_rows = F.sum(weight) if weight else F.count("*")
    return (
        rows.groupBy(*by)
        .agg(n_rows.alias("n_rows"), entities(unique).alias("n_entities"))
        .orderBy(*by)
    )


def gap_reconcile(member_fills: DataFrame) -> DataFrame:
    """Month-grain sums of fills must add up to the fills themselves.

    ``member_fills`` are single cohort fills of members that hand on
    ``fills_in_span``, the sum over the month grain.
    """
    return (
        member_fills.groupBy(*SEGMENT, "entity_id")
        .agg(F.count("*").alias("n_fills"), F.max("fills_in_span").alias("n_rolled_up"))
        .groupBy(*SEGMENT)
        .agg(F.sum("n_fills").alias("n_fills"), F.sum("n_rolled_up").alias("n_rolled_up"))
        .withColumn("difference", F.col("n_fills") - F.col("n_rolled_up"))
    )


def lost_month_hist(members: DataFrame) -> DataFrame:
    keys = [*SEGMENT, "lost_month"]
    return members.groupBy(*keys).agg(F.count("*").alias("n_members")).orderBy(*keys)


def lost_month_delta(members: DataFrame, before: str, after: str) -> DataFrame:
    """Members per lost month before and after a cleanup, in one pass.

    ``before`` and ``after`` name two columns of the same members.
    """
    both = F.array(
        F.struct(F.col(before).alias("lost_month"), F.lit(1).alias("b"), F.lit(0).alias("a")),
        F.struct(F.col(after).alias("lost_month"), F.lit(0).alias("b"), F.lit(1).alias("a")),
    )
    return (
        members.groupBy(before, after)
        .agg(F.count("*").alias("n"))
        .select("n", F.inline(both))
        .groupBy("lost_month")
        .agg(
            F.sum(F.col("n") * F.col("b")).alias("n_before"),
            F.sum(F.col("n") * F.col("a")).alias("n_after"),
        )
        .orderBy("lost_month")
    )


def lost_month_dest(cleaned: DataFrame) -> DataFrame:
    return (
        cleaned.groupBy("lost_month", "lost_dest")
        .agg(F.count("*").alias("n_members"))
        .orderBy("lost_month", F.asc_nulls_last("lost_dest"))
    )


def dest_counts(kinds: DataFrame) -> DataFrame:
    """Follow-up fills and entities per destination, from fill kinds."""
    return entity_counts(kinds, (*SEGMENT, "lost_dest"), "n_fills")


def outlet_class_counts(classes: DataFrame, unique: bool = False) -> DataFrame:
    keys = [*SEGMENT, "lost_month", "lost_dest", "lost_dest_detail"]
    return (
        classes.groupBy(*keys).agg(entities(unique).alias("n_entities")).orderBy(*keys)
    )


def distinct_pairs(rows: DataFrame, *columns: str) -> DataFrame:
    """Combinations that occur, to see unexpected ones."""
    return rows.select(*columns).distinct()


def with_grand_total(members: DataFrame, unique: bool = False) -> DataFrame:
    """Entities per segment beside the sum over all segments.

    The window sees the segments, a few rows, not the members; it is one partition on purpose.
    """
    return (
        members.groupBy(*SEGMENT)
        .agg(entities(unique).alias("n_entities"))
        .withColumn("grand_total", F.sum("n_entities").over(Window.partitionBy()))
    )


def window_breach(followup: DataFrame) -> DataFrame:
    """Number of follow-up fills outside their gap; must be zero."""
    month = F.col("fill_yyyymm")
    outside = (month <= F.col("before_gap_start")) | (month >= F.col("after_gap_end"))
    return followup.agg(F.count_if(outside).alias("n_breaches"))


def window_breaches(followup: DataFrame) -> DataFrame:
    """The follow-up fills outside their gap, if any."""
    month = F.col("fill_yyyymm")
    return followup.filter(
        (month <= F.col("before_gap_start")) | (month >= F.col("after_gap_end"))
    )


def month_zero(curve: DataFrame, dest: str = Labels().report_competitor) -> DataFrame:
    """Details that one destination shows at the curve's start."""
    keys = ["market", "status", "cohort_yyyymm", "chain_name"]
    return (
        curve.filter((F.col("lost_month") == 0) & (F.col("lost_dest") == dest))
        .groupBy(*keys)
        .agg(
            F.countDistinct("lost_dest_detail").alias("n_details"), F.count("*").alias("n_rows")
        )
        .orderBy(*keys)
    )


def curve_totals(curve: DataFrame) -> DataFrame:
    """Lost in all, and the cohort's size, per curve."""
    keys = ["market", "status", "cohort_yyyymm", "chain_name"]
    return (
        curve.groupBy(*keys)
        .agg(F.sum("lost").alias("lost"), F.max("cohort").alias("cohort"))
        .orderBy("market", "status", "cohort_yyyymm", F.desc("chain_name"))
    )


def version_diff(
    old: DataFrame, new: DataFrame, keys: tuple[str, ...], measure: str = "entity_id"
) -> DataFrame:
    """Distinct entities per key in two versions of a table, side by side."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.countDistinct(measure).alias(name))

    return (
        counted(old, "n_old")
        .join(counted(new, "n_new"), list(keys), "full")
        .na.fill(0, ["n_old", "n_new"])
        .withColumn("difference", F.col("n_new") - F.col("n_old"))
    )


def row_diff(old: DataFrame, new: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Whole rows of two versions of a table: how many there are in each, and how many differ.

    Rows are compared by all ``columns``, repeats counted, in one aggregation.
    """
    both = old.select(*columns, F.lit(1).alias("is_old"), F.lit(0).alias("is_new")).unionByName(
        new.select(*columns, F.lit(0).alias("is_old"), F.lit(1).alias("is_new"))
    )
    return (
        both.groupBy(*columns)
        .agg(F.sum("is_old").alias("n_old"), F.sum("is_new").alias("n_new"))
        .agg(
            F.sum("n_old").alias("n_old"),
            F.sum("n_new").alias("n_new"),
            F.sum(F.abs(F.col("n_old") - F.col("n_new"))).alias("n_differ"),
        )
    )


def version_rows(
    old: DataFrame, new: DataFrame, keys: tuple[str, ...], measures: tuple[str, ...], by: tuple[str, ...]
) -> DataFrame:
    """Two versions of a stage row by row: per ``by``, rows of each, and rows that are alike, changed, gone or new.

    ``keys`` are unique in each version. Versions kept in buckets of one of the keys meet without a shuffle.
    """
    there = lambda df, name: df.select(*keys, F.struct(*measures).alias(name))
    both = there(old, "old").join(there(new, "new"), list(keys), "full")
    was, is_ = F.col("old").isNotNull(), F.col("new").isNotNull()
    alike = F.col("old").eqNullSafe(F.col("new"))
    return both.groupBy(*by).agg(
        F.count_if(was).alias("n_old"),
        F.count_if(is_).alias("n_new"),
        F.count_if(was & is_ & alike).alias("n_same"),
        F.count_if(was & is_ & ~alike).alias("n_changed"),
        F.count_if(was & ~is_).alias("n_gone"),
        F.count_if(is_ & ~was).alias("n_added"),
    )


#: Checks on members of a stage, by what they are counted by.
CHECKS = {
    "segment": SEGMENT,
    "segment_month": (*SEGMENT, "lost_month"),
    "segment_dest": (*SEGMENT, "lost_dest"),
    "month_dest": ("lost_month", "lost_dest"),
    "dest_class": ("lost_dest", "lost_dest_detail"),
    "all": (),
}


def stage_checks(members: DataFrame) -> DataFrame:
    """All of ``CHECKS`` in one pass: check_name, the columns it is counted by (others null), n_members.

    Members are read and counted once; the checks are grouping sets over those counts. Each member has one row, so that
    members of a segment are its entities.
    """
    columns = (*SEGMENT, "lost_month", "lost_dest", "lost_dest_detail")
    counts = members.groupBy(*columns).agg(F.count("*").alias("n"))
    # the grouping id has a bit for each column that a set leaves out, the first column's the highest
    left_out = {name: sum(1 << k for k, c in enumerate(reversed(columns)) if c not in by) for name, by in CHECKS.items()}
    name = reduce(lambda found, item: found.when(F.grouping_id() == item[1], item[0]), left_out.items(), F.when(F.lit(False), ""))
    return counts.groupingSets([[F.col(c) for c in by] for by in CHECKS.values()], *columns).agg(
        name.alias("check_name"), F.sum("n").alias("n_members")
    )


def distinct_rollup(rows: DataFrame, by: tuple[str, ...], measure: str = "entity_id") -> DataFrame:
    """Exact distinct counts of ``measure`` (a number) for ``by`` and each of its beginnings: level, ``by``, n_distinct.

    ``level`` is the number of columns counted by. Numbers are bits of bitmaps of 32,768 neighbours. Rows are shuffled
    once, by bitmap; coarser levels are unions of the bitmaps of finer ones in the same task, and only sizes of bitmaps
    are shuffled again. A null is not counted; a group of nulls alone has none.
    """
    bits = rows.select(
        *by,
        F.bitmap_bucket_number(measure).alias("bucket"),
        F.bitmap_bit_position(measure).alias("bit"),
    ).repartition("bucket")
    fine = bits.groupBy("bucket", *by).agg(F.bitmap_construct_agg("bit").alias("bits"))
    levels = fine.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(by)))))
    cut = levels.select(
        "bucket", "level", "bits", *[F.when(F.col("level") > k, F.col(c)).alias(c) for k, c in enumerate(by)]
    )
    return (
        cut.groupBy("bucket", "level", *by)
        .agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
        .groupBy("level", *by)
        .agg(F.sum(F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(0)).alias("n_distinct"))
    )


def curve_report_topn(curve: DataFrame, n: int = 200) -> DataFrame:
    """First rows of the combined report, in a total order."""
    keys = [
        "rank", "market", "market_desc", "status", "cohort_yyyymm", "chain_name", "lost_month",
        "lost_dest", "lost_dest_detail",
    ]
    return (
        curve.filter(F.col("lost_month") > 0)
        .groupBy(*keys)
        .agg(
            F.max("cohort").alias("cohort"),
            F.sum("lost").alias("lost"),
            F.max("rate").alias("rate"),
        )
        .orderBy(
            F.asc_nulls_last("rank"),
            "market",
            "market_desc",
            F.desc("status"),
            "cohort_yyyymm",
            F.desc("chain_name"),
            "lost_month",
            "lost_dest",
            "lost_dest_detail",
            "cohort",
        )
        .limit(n)
    )


def preview(rows: DataFrame, by: tuple[str, ...], n: int = 30) -> DataFrame:
    """The first rows in the order of ``by``."""
    return rows.orderBy(*[F.asc_nulls_last(c) for c in by]).limit(n)


def stage_ledger(stages: dict[str, DataFrame]) -> DataFrame:
    """Row count per named stage."""
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        for name, df in stages.items()
    ]
    return reduce(DataFrame.unionByName, counts)
