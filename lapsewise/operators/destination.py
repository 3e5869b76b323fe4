"""Where lost members went: follow-up fills, chosen destination, outlet class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.functions import labels
from lapsewise.operators.cohort import MEMBER_WIDE
from lapsewise.spec import RetentionSpec

LOSS = (*MEMBER_WIDE, "status", "last_fill_month", "before_gap_start", "after_gap_end", "lost_month")
#: Parts in which a hot entity's follow-up fills are dealt.
DEALS = 8
FILL_COLUMNS = (
    "fill_yyyymm", "chain", "channel", "outlet_class", "fill_date", "supplier_id",
    "product_key", "fill_weight",
)


def _losses(lost: DataFrame, spec: RetentionSpec, *more: str) -> DataFrame:
    return lost.filter(F.col("lost_month") < spec.never_lost).select(*LOSS, *more)


def _inside(month: str) -> Column:
    """Both ends of the gap are outside."""
    return (F.col("before_gap_start") < F.col(month)) & (F.col(month) < F.col("after_gap_end"))


def _labelled(rows: DataFrame, spec: RetentionSpec) -> DataFrame:
    """With the destination; a loss without a fill weighs as a long fill."""
    return rows.withColumn(
        "lost_dest",
        labels.destination(F.col("channel"), F.col("chain"), F.col("cohort_chain"), spec),
    ).withColumn("fill_weight", F.coalesce("fill_weight", F.lit(spec.long_fill_weight)))


def followed_months(followup: DataFrame) -> DataFrame:
    """Months with a follow-up fill per market and entity; fills, kinds or any other grain with the month serve."""
    return followup.groupBy("market", "entity_id").agg(F.collect_set("fill_yyyymm").alias("fill_months"))


def lost_window_fills(
    lost: DataFrame,
    market_fills: DataFrame,
    spec: RetentionSpec,
    months: DataFrame | None = None,
    deals: int = DEALS,
) -> DataFrame:
    """Fills of lost members inside their gap, at any chain; at least one row each.

    ``market_fills`` are weighted follow-up fills with their market. A member without such a fill keeps one row with
    NULL fill columns. ``lost`` may bring ``fill_months``, the entity's months with a follow-up fill; otherwise they come
    from ``months`` (see ``followed_months``), or from the fills themselves.

    The months tell which losses have a fill at all. Fills are dealt in ``deals`` parts, so that no task has a hot
    entity's fills whole; a loss with a fill meets each part and one without meets none, all in one left join.
    """
    if "fill_months" in lost.columns:
        losses = _losses(lost, spec, "fill_months")
    else:
        months = followed_months(market_fills) if months is None else months
        losses = _losses(lost, spec).join(months, ["market", "entity_id"], "left")
    inside = F.exists("fill_months", lambda m: (F.col("before_gap_start") < m) & (m < F.col("after_gap_end")))
    parts = F.sequence(F.lit(0), F.lit(deals - 1))
    dealt = losses.withColumn("has_fill", F.coalesce(inside, F.lit(False))).withColumn(
        "deal", F.explode(F.when(F.col("has_fill"), parts).otherwise(F.array(F.lit(-1))))
    )
    right = market_fills.select(
        F.col("market").alias("m_market"),
        F.col("entity_id").alias("m_entity"),
        F.pmod(F.hash(*FILL_COLUMNS), F.lit(deals)).alias("m_deal"),
        *FILL_COLUMNS,
    )
    joined = dealt.join(
        right,
        (F.col("market") == F.col("m_market"))
        & (F.col("entity_id") == F.col("m_entity"))
        & (F.col("deal") == F.col("m_deal"))
        & _inside("fill_yyyymm"),
        "left",
    )
    # a loss with fills leaves an empty row for each part in which it has none
    kept = joined.filter(~F.col("has_fill") | F.col("m_entity").isNotNull())
    return _labelled(kept.drop("fill_months", "has_fill", "deal", "m_market", "m_entity", "m_deal"), spec)


def fill_kinds(market_fills: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Follow-up fills summed per entity, month and kind of outlet.

    All that ranks destinations and classes adds up, so this loses nothing they
    need, and no entity keeps more than a few rows per month. Chains and suppliers
    that no rule names are not kept apart.
    """
    own_mail = F.when(
        F.col("supplier_id") == spec.own_mail_supplier, F.col("supplier_id")
    ).alias("supplier_id")
    chain = labels.chain_kind(F.col("chain"), spec).alias("chain")
    return market_fills.groupBy(
        "market", "entity_id", "fill_yyyymm", chain, "channel", "outlet_class", own_mail
    ).agg(
        F.count("*").alias("n_fills"),
        F.sum("fill_weight").alias("fill_weight"),
        F.max("fill_date").alias("fill_date"),
    )


def lost_window_kinds(lost: DataFrame, kinds: DataFrame, spec: RetentionSpec) -> DataFrame:
    """As ``lost_window_fills``, from fill kinds; a plain left join, with no hot key.

    Members never lost match nothing and keep one row without a destination, so that
    what follows needs no second look at the members.
    """
    right = kinds.withColumnsRenamed({"market": "k_market", "entity_id": "k_entity"})
    is_lost = F.col("lost_month") < spec.never_lost
    joined = lost.select(*LOSS).join(
        right,
        (F.col("market") == F.col("k_market"))
        & (F.col("entity_id") == F.col("k_entity"))
        & is_lost
        & _inside("fill_yyyymm"),
        "left",
    )
    return (
        _labelled(joined.drop("k_market", "k_entity"), spec)
        .withColumn("lost_dest", F.when(is_lost, F.col("lost_dest")))
        .withColumn("n_fills", F.coalesce("n_fills", F.lit(1)))
    )


def first_choice(*named: str) -> Column:
    """Of rows with weight and last_date: the heaviest, then latest (a date before none), then first by name."""
    late = F.coalesce(-F.unix_date("last_date"), F.lit(2**31 - 1))
    return F.min(F.struct((-F.col("weight")).alias("w"), late.alias("d"), *named))


def chosen(per_class: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: its destination, the class of outlet behind that, and whether own mail was used.

    ``per_class`` has weight, last_date and own_mail summed by key, ``lost_dest`` and ``lost_dest_detail``. The class is
    chosen within each destination, then the destination; each step aggregates the one before.
    """
    per_dest = per_class.groupBy(*keys, "lost_dest").agg(
        first_choice("lost_dest_detail").getField("lost_dest_detail").alias("lost_dest_detail"),
        F.sum("weight").alias("weight"),
        F.max("last_date").alias("last_date"),
        F.max("own_mail").alias("own_mail"),
    )
    return (
        per_dest.groupBy(*keys)
        .agg(first_choice("lost_dest", "lost_dest_detail").alias("best"), F.max("own_mail").alias("own_mail"))
        .select(*keys, "best.lost_dest", "best.lost_dest_detail", "own_mail")
    )


def member_followup(followup: DataFrame, spec: RetentionSpec) -> DataFrame:
    """One row per member of ``followup``: LOSS, ``lost_dest``, ``lost_dest_detail``, ``own_mail``.

    Follow-up fills and fill kinds serve alike. Everything later stages ask of the follow-up is a column here.
    """
    detail = labels.destination_detail(
        F.col("lost_dest"), F.col("chain"), F.col("outlet_class"), spec
    )
    own_mail = F.coalesce(F.col("supplier_id") == spec.own_mail_supplier, F.lit(False))
    per_class = (
        followup.withColumn("lost_dest_detail", F.when(F.col("lost_dest").isNotNull(), detail))
        .groupBy(*LOSS, "lost_dest", "lost_dest_detail")
        .agg(
            F.sum("fill_weight").alias("weight"),
            F.max("fill_date").alias("last_date"),
            F.max(own_mail).alias("own_mail"),
        )
    )
    return chosen(per_class, list(LOSS))


def lost_destination(members: DataFrame, spec: RetentionSpec) -> DataFrame:
    """One destination per lost member, of ``member_followup``."""
    return _losses(members, spec, "lost_dest")


def lost_outlet_class(cleaned: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Outlet class behind the destination of each member still lost after the cleanup."""
    lost = cleaned.filter(F.col("lost_month") <= spec.last_lost_month)
    return lost.select(*LOSS, "lost_dest", "lost_dest_detail")
