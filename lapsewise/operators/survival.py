"""Survival curves by market, chain, cohort month and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.functions import labels
from lapsewise.spec import RetentionSpec

SEGMENT = ("market", "market_desc", "cohort_chain", "cohort_yyyymm", "status")
CURVE = (
    "rank", "market", "market_desc", "status", "cohort_yyyymm", "chain_name", "lost_month",
    "cohort", "lost_dest", "lost_dest_detail", "lost", "survival", "rate",
)


def entities(unique: bool) -> Column:
    """Distinct entities; a plain count where each can occur only once."""
    return F.count("*") if unique else F.countDistinct("entity_id")


def lost_by_destination(
    classes: DataFrame, spec: RetentionSpec, unique: bool = False
) -> DataFrame:
    """Lost entities per segment, month of loss, reported destination and class.

    ``unique`` states that each member has one row, which saves a shuffle.
    """
    return (
        classes.withColumn("dest", labels.report_destination(F.col("lost_dest"), spec))
        .groupBy(*SEGMENT, "lost_month", F.col("dest").alias("lost_dest"), "lost_dest_detail")
        .agg(entities(unique).alias("lost"))
    )


def survival_at_risk(members: DataFrame, unique: bool = False) -> DataFrame:
    """Per segment and lost month: lost, still at risk before it, and in total."""
    return at_risk(members.groupBy(*SEGMENT, "lost_month").agg(entities(unique).alias("lost")))


def at_risk(per_month: DataFrame) -> DataFrame:
    """As ``survival_at_risk``, from ``lost`` per segment and lost month; windows over a few rows per segment."""
    segment = Window.partitionBy(*SEGMENT)
    downward = segment.orderBy(F.desc("lost_month")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return per_month.withColumn("at_risk", F.sum("lost").over(downward)).withColumn(
        "total", F.sum("lost").over(segment)
    )


def survival_rate(at_risk: DataFrame, spec: RetentionSpec) -> DataFrame:
    """The curve's points: at risk, surviving, and surviving as a share of all.

    Members never lost are in the totals but have no point of their own.
    """
    left = F.col("at_risk") - F.col("lost")
    return at_risk.filter(F.col("lost_month") <= spec.last_lost_month).select(
        *SEGMENT,
        "lost_month",
        F.col("at_risk").alias("cohort"),
        left.alias("survival"),
        (left / F.col("total")).alias("rate"),
    )


def dense_rate(at_risk: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Curve points for every month from 0 to the last, also those in which nobody was lost.

    A month without a row survives as the month before it; month 0 is whole. The
    months are made per segment, a few rows each.
    """
    segment = Window.partitionBy(*SEGMENT).orderBy("lost_month")
    so_far = segment.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    months = F.sequence(F.lit(0), F.lit(spec.last_lost_month))
    every = at_risk.select(*SEGMENT, "total").distinct().withColumn("lost_month", F.explode(months))
    lost = at_risk.select(*SEGMENT, "lost_month", F.col("lost").alias("in_month"))
    gone = F.sum("in_month").over(so_far)
    return (
        every.join(lost, [*SEGMENT, "lost_month"], "left")
        .withColumn("in_month", F.coalesce("in_month", F.lit(0)))
        .withColumn("survival", F.col("total") - gone)
        .select(
            *SEGMENT,
            "lost_month",
            (F.col("survival") + F.col("in_month")).alias("cohort"),
            "survival",
            (F.col("survival") / F.col("total")).alias("rate"),
        )
    )


def _with_month_zero(df: DataFrame, at_zero: dict[str, Column]) -> DataFrame:
    """Each month-1 row once more as month 0, with some columns replaced; ``df`` is planned and read once."""
    month = F.col("lost_month")
    shown = F.when(month == 1, F.array(F.lit(1), F.lit(0))).otherwise(F.array(month))
    is_zero = F.col("shown") == 0
    columns = {"lost_month": F.col("shown")} | {n: F.when(is_zero, c).otherwise(F.col(n)) for n, c in at_zero.items()}
    return df.withColumn("shown", F.explode(shown)).withColumns(columns).drop("shown")


def survival_month_zero(points: DataFrame) -> DataFrame:
    """Curve points with a starting point, where a first month exists."""
    return _with_month_zero(points, {"survival": F.col("cohort"), "rate": F.lit(1.0)})


def lost_month_zero(lost: DataFrame) -> DataFrame:
    return _with_month_zero(lost, {"lost": F.lit(0).cast("bigint")})


def curve_report(points: DataFrame, lost: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Report rows: every point with each of its destinations.

    ``points`` and ``lost`` include month 0; both are small counts. A month in
    which nobody was lost has no row.
    """
    keys = [*SEGMENT, "lost_month"]
    return labelled(points.join(lost, keys), spec)


def labelled(rows: DataFrame, spec: RetentionSpec) -> DataFrame:
    return rows.select(
        labels.market_rank(F.col("market"), spec).alias("rank"),
        "market",
        "market_desc",
        "status",
        "cohort_yyyymm",
        labels.chain_name(F.col("cohort_chain"), spec).alias("chain_name"),
        "lost_month",
        "cohort",
        "lost_dest",
        "lost_dest_detail",
        "lost",
        "survival",
        "rate",
    )


def survival_curve(
    members: DataFrame, classes: DataFrame, spec: RetentionSpec, status: str | None = None
) -> DataFrame:
    """Curve of one status, or of both."""
    if status is not None:
        members = members.filter(F.col("status") == status)
        classes = classes.filter(F.col("status") == status)
    points = survival_month_zero(survival_rate(survival_at_risk(members), spec))
    return curve_report(points, lost_month_zero(lost_by_destination(classes, spec)), spec)


def curve_by_join(counts: DataFrame, spec: RetentionSpec) -> DataFrame:
    """The report as a join of the curve's points with their destinations, both from member counts.

    ``counts`` is as for ``curve_from_counts`` and is read twice: it should be stored, or cheap.
    """
    per_month = counts.groupBy(*SEGMENT, "lost_month").agg(F.sum("members").alias("lost"))
    points = survival_month_zero(survival_rate(at_risk(per_month), spec))
    lost = (
        counts.filter(F.col("lost_month") <= spec.last_lost_month)
        .withColumn("lost_dest", labels.report_destination(F.col("lost_dest"), spec))
        .groupBy(*SEGMENT, "lost_month", "lost_dest", "lost_dest_detail")
        .agg(F.sum("members").alias("lost"))
    )
    return curve_report(points, lost_month_zero(lost), spec)


def curve_from_counts(counts: DataFrame, spec: RetentionSpec) -> DataFrame:
    """The same report from member counts, without joining the curve to itself.

    ``counts`` has ``members`` per segment, lost month, destination and class,
    with every member in exactly one row. Peers of a lost month share its sums:
    the range frame takes them together.
    """
    segment = Window.partitionBy(*SEGMENT)
    month = Window.partitionBy(*SEGMENT, "lost_month")
    downward = segment.orderBy(F.desc("lost_month")).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    left = F.col("cohort") - F.col("lost_in_month")
    points = (
        counts.withColumn("cohort", F.sum("members").over(downward))
        .withColumn("total", F.sum("members").over(segment))
        .withColumn("lost_in_month", F.sum("members").over(month))
        .filter(F.col("lost_month") <= spec.last_lost_month)
        .select(
            *SEGMENT,
            "lost_month",
            "cohort",
            labels.report_destination(F.col("lost_dest"), spec).alias("lost_dest"),
            "lost_dest_detail",
            F.col("members").alias("lost"),
            left.alias("survival"),
            (left / F.col("total")).alias("rate"),
        )
    )
    shown = F.when(F.col("lost_month") == 1, F.array(F.lit(1), F.lit(0))).otherwise(
        F.array("lost_month")
    )
    at_zero = F.col("shown") == 0
    return labelled(
        points.withColumn("shown", F.explode(shown))
        .withColumn("lost", F.when(at_zero, 0).otherwise(F.col("lost")))
        .withColumn("survival", F.when(at_zero, F.col("cohort")).otherwise(F.col("survival")))
        .withColumn("rate", F.when(at_zero, 1.0).otherwise(F.col("rate")))
        .withColumn("lost_month", F.col("shown")),
        spec,
    )

