"""The study as one straight plan, for large data.

Fills are read once, joined and filtered as far as that needs no shuffle, and counted
per entity and month before they are shuffled to the entity.
An entity's activity at a chain then fits one integer, a bit per month, and
membership, status and losses are bit arithmetic on it. A fill follows at most
one loss per chain, because losses are at least ``gap_months`` apart, so the
follow-up needs no join either. After the one shuffle on the entity all that remains,
the exclusion of code users included, runs without another one, down to the counts.

No group grows with the fills of a hot entity: the first aggregation leaves a
row per month, chain, channel, class and mail flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise import spec as S
from lapsewise.functions import labels
from lapsewise.functions.months import index_to_key, key_index, month_index
from lapsewise.operators import destination, exclusion, fills, market, survival
from lapsewise.plans.inputs import Inputs
from lapsewise.plans.staged import LeanStudy
from lapsewise.spec import RetentionSpec

# The entity comes first: sorts on these keys then mostly compare one number.
ENTITY = ("entity_id", "market", "market_desc")
TRACK = (*ENTITY, "cohort_chain", "active", "busy")


def fits(spec: RetentionSpec) -> bool:
    """Whether the study's months fit the bits of one integer, and its rules the plan.

    A study that does not fit runs on month-grain windows up to the lost month: see ``member_outcomes``.
    """
    months = key_index(spec.fills_last) - key_index(spec.lookback_first) + 1
    return (
        months + spec.gap_months <= 63
        and spec.min_fills == 2
        and set(spec.cohort_channels) <= set(spec.followup_channels)
    )


def _base(spec: RetentionSpec) -> int:
    return key_index(spec.lookback_first)


def _bit(offset: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), offset)


def _down(bits: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", bits, by)


def _low(bits: Column, n: int) -> Column:
    return bits.bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))


def month_activity(market_fills: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Fills per market, entity, month and kind of outlet.

    ``market_fills`` are trusted maintenance fills, retail or mail, with their
    market. ``month_no`` counts months from the first lookback month. Chains that
    no rule names are counted as one.
    """
    return (
        fills.with_weight(market_fills.filter(F.col("entity_id").isNotNull()), spec)
        .withColumn("chain", labels.chain_kind(F.col("chain"), spec))
        .withColumn("month_no", month_index(F.col("fill_yyyymm")) - _base(spec))
        .withColumn(
            "own_mail", F.coalesce(F.col("supplier_id") == spec.own_mail_supplier, F.lit(False))
        )
        .groupBy(*ENTITY, "month_no", "chain", "channel", "outlet_class", "own_mail")
        .agg(
            F.count("*").alias("n_fills"),
            F.sum("fill_weight").alias("weight"),
            F.max("fill_date").alias("last_date"),
        )
    )


def _tracks(activity: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Each activity row once per cohort chain its entity may be a member at.

    ``active`` has a bit per month with a cohort fill at the chain, ``busy`` a
    bit per month with at least two.
    """
    by_month = Window.partitionBy(*ENTITY, "chain", "channel", "month_no")
    by_entity = Window.partitionBy(*ENTITY)
    bit = _bit(F.col("month_no"))
    rows = activity.withColumn("n_month", F.sum("n_fills").over(by_month))
    masks, tracks = {}, []
    for n, chain in enumerate(spec.cohort_chains):
        own = (F.col("chain") == chain) & F.col("channel").isin(*spec.cohort_channels)
        busy = own & (F.col("n_month") >= spec.min_fills)
        masks[f"active_{n}"] = F.bit_or(F.when(own, bit).otherwise(0)).over(by_entity)
        masks[f"busy_{n}"] = F.bit_or(F.when(busy, bit).otherwise(0)).over(by_entity)
        tracks.append(
            F.struct(
                F.lit(chain).alias("cohort_chain"),
                F.col(f"active_{n}").alias("active"),
                F.col(f"busy_{n}").alias("busy"),
            )
        )
    cohort_months = F.lit(_span_bits(spec.lookback_months, spec.cohort_count))
    active, busy = F.col("active"), F.col("busy")
    return (
        rows.withColumns(masks)
        .withColumn("track", F.explode(F.array(*tracks)))
        .select("*", "track.*")
        .filter(
            (active.bitwiseAND(cohort_months) != 0)
            & ((F.bit_count(active) >= spec.min_fills) | (busy != 0))
        )
        .select(
            *TRACK, "month_no", "chain", "channel", "outlet_class", "own_mail", "weight",
            "last_date",
        )
    )


def _span_bits(first: int, count: int) -> int:
    return ((1 << count) - 1) << first


def _gap_starts(active: Column, spec: RetentionSpec) -> Column:
    """Bits of the months that begin a gap, as far as a cohort can reach."""
    reach = _span_bits(spec.lookback_months, spec.cohort_count + spec.last_lost_month - 1)
    followed = F.lit(0).cast("bigint")
    for n in range(1, spec.gap_months):
        followed = followed.bitwiseOR(_down(active, F.lit(n)))
    return active.bitwiseAND(F.bitwise_not(followed)).bitwiseAND(F.lit(reach))


def _lowest(bits: Column) -> Column:
    """Position of the lowest bit that is set."""
    return F.bit_count(bits.bitwiseAND(-bits) - 1)


def _outcomes(tracks: DataFrame, spec: RetentionSpec) -> DataFrame:
    """One row per (market, entity, chain), with what followed each of its losses.

    Of a chain's rows only those that follow a loss matter, and one to stand for
    the chain itself: its first month. ``outcomes`` maps the month of a loss to
    its outcome; it has at most one entry per ``gap_months`` of the study.
    """
    width = spec.gap_months - 1
    month = F.col("month_no")
    starts = _gap_starts(F.col("active"), spec)
    before = _low(_down(F.call_function("shiftleft", starts, F.lit(width)), month), width)
    loss_no = F.when(before != 0, month - width + _lowest(before))
    dest = labels.destination(F.col("channel"), F.col("chain"), F.col("cohort_chain"), spec)
    detail = labels.destination_detail(
        F.col("lost_dest"), F.col("chain"), F.col("outlet_class"), spec
    )
    followed = F.col("loss_no").isNotNull()
    own = (F.col("chain") == F.col("cohort_chain")) & F.col("channel").isin(*spec.cohort_channels)
    stands = own & (month == _lowest(F.col("active")))
    per_class = (
        tracks.withColumn("loss_no", loss_no)
        .filter(followed | stands)
        .withColumn("lost_dest", F.when(followed, dest))
        .withColumn("lost_dest_detail", F.when(followed, detail))
        .groupBy(*TRACK, "loss_no", "lost_dest", "lost_dest_detail")
        .agg(
            F.sum("weight").alias("weight"),
            F.max("last_date").alias("last_date"),
            F.max("own_mail").alias("own_mail"),
        )
    )

    per_loss = destination.chosen(per_class, [*TRACK, "loss_no"])
    entry = F.struct("loss_no", F.struct("lost_dest", "lost_dest_detail", "own_mail"))
    listed = F.collect_list(F.when(F.col("loss_no").isNotNull(), entry))
    return per_loss.groupBy(*TRACK).agg(F.map_from_entries(listed).alias("outcomes"))


def _members(outcomes: DataFrame, spec: RetentionSpec) -> DataFrame:
    """One row per cohort member, with its status, loss and destination."""
    first = spec.lookback_months
    numbers = F.array(*[F.lit(first + n) for n in range(spec.cohort_count)])
    no = F.col("cohort_no")
    onward = _down(F.col("active"), no)
    is_member = (_low(onward, 1) == 1) & (
        (F.bit_count(_low(onward, spec.span_months)) >= spec.min_fills)
        | (_low(_down(F.col("busy"), no), 1) == 1)
    )
    earlier = _low(_down(F.col("active"), no - spec.lookback_months), spec.lookback_months)
    losses = _low(_down(_gap_starts(F.col("active"), spec), no), spec.last_lost_month)
    lost = F.col("loss_no").isNotNull()
    moved = F.coalesce(F.col("found.own_mail"), F.lit(False))
    still_lost = lost & ~moved
    start = F.when(lost, F.col("loss_no") + _base(spec))
    raw = F.coalesce(F.col("loss_no") - no + 1, F.lit(spec.never_lost))
    return (
        outcomes.withColumn("cohort_no", F.explode(numbers))
        .filter(is_member)
        .withColumn("losses", losses)
        .withColumn("loss_no", F.when(F.col("losses") != 0, no + _lowest(F.col("losses"))))
        .withColumn("found", F.col("outcomes")[F.col("loss_no")])
        .select(
            "market",
            "market_desc",
            "cohort_chain",
            index_to_key(no + _base(spec)).alias("cohort_yyyymm"),
            "entity_id",
            F.when(earlier != 0, S.CONTINUING).otherwise(S.NEW).alias("status"),
            index_to_key(start).alias("before_gap_start"),
            index_to_key(start + spec.gap_months).alias("after_gap_end"),
            raw.alias("lost_month_before"),
            F.when(still_lost, raw).otherwise(spec.never_lost).alias("lost_month"),
            F.when(still_lost, F.coalesce(F.col("found.lost_dest"), F.lit(spec.labels.stopped)))
            .otherwise(spec.labels.not_lost)
            .alias("lost_dest"),
            F.when(
                still_lost,
                F.when(F.col("found").isNull(), spec.labels.detail_off_grid).otherwise(
                    F.col("found.lost_dest_detail")
                ),
            ).alias("lost_dest_detail"),
        )
    )


def member_outcomes(
    inputs: Inputs, spec: RetentionSpec, exclude: bool = True, users: DataFrame | None = None
) -> DataFrame:
    """Every cohort member that is left after the exclusion, with its outcome.

    ``users`` are the entities to leave out, with their market, where they are known already.
    A study of any length and any minimum of fills: what does not fit one integer
    per customer takes the form that works on windows over months.
    """
    if not fits(spec):
        return windowed_outcomes(inputs, spec, exclude, users)
    s = spec
    products = market.market_definition(
        inputs.products, inputs.bridge, inputs.market_codes, s
    )
    raw = fills.trusted_fills(inputs.fills_in_market(products), s).filter(
        F.col("fill_yyyymm").between(s.lookback_first, s.fills_last)
        & F.col("channel").isin(*s.followup_channels)
        & (F.col("is_maintenance") == 1)
    )
    # on the entity alone: every later key, the anti join's too, has it
    activity = month_activity(raw, s).repartition("entity_id")
    outcomes = _outcomes(_tracks(activity, s), s)
    if exclude:
        if users is None:
            users = exclusion.code_users(fills.exclusion_fills(inputs.history_of_codes(), s), s)
        outcomes = exclusion.without_users(outcomes, users)
    return _members(outcomes, s)


def windowed_outcomes(
    inputs: Inputs, spec: RetentionSpec, exclude: bool = True, users: DataFrame | None = None
) -> DataFrame:
    """The same rows from ``LeanStudy``, without a bound on months or fills."""
    study = LeanStudy(inputs, spec)
    before = F.col("lost_month").alias("lost_month_before")
    outcome = study.outcome.select("*", before)
    if exclude:
        outcome = exclusion.without_users(outcome, study.code_users if users is None else users)
    still_lost = F.col("lost_month") <= spec.last_lost_month
    return exclusion.own_mail_cleanup(outcome, spec).select(
        "market",
        "market_desc",
        "cohort_chain",
        "cohort_yyyymm",
        "entity_id",
        "status",
        "before_gap_start",
        "after_gap_end",
        "lost_month_before",
        "lost_month",
        "lost_dest",
        F.when(still_lost, F.col("lost_dest_detail")).alias("lost_dest_detail"),
    )


def member_counts(members: DataFrame) -> DataFrame:
    """Members per segment, month of loss, destination and class; a small table."""
    return members.groupBy(
        *survival.SEGMENT, "lost_month", "lost_dest", "lost_dest_detail"
    ).agg(F.count("*").alias("members"))


def survival_curve(
    inputs: Inputs, spec: RetentionSpec, status: str | None = None
) -> DataFrame:
    """The report, of one status or of both."""
    members = member_outcomes(inputs, spec)
    if status is not None:
        members = members.filter(F.col("status") == status)
    return survival.curve_from_counts(member_counts(members), spec)
