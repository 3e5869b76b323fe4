"""Weights and labels decided row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapsewise.spec import RetentionSpec


def fill_weight(days_supply: Column, spec: RetentionSpec) -> Column:
    """1 for a short fill; a long one, or one of unknown length, counts more."""
    return F.when(days_supply < spec.long_fill_days, 1).otherwise(spec.long_fill_weight)


def destination(channel: Column, chain: Column, own_chain: Column, spec: RetentionSpec) -> Column:
    """Where a follow-up fill was bought; the first matching rule decides.

    No fill at all and a retail fill of unknown chain both read as stopped.
    """
    return (
        F.when(channel == spec.mail_channel, spec.labels.mail)
        .when((own_chain != chain) & (channel == spec.retail_channel), spec.labels.competitor)
        .when(own_chain == chain, spec.labels.attention)
        .when(chain.isNull(), spec.labels.stopped)
    )


def other_chain(spec: RetentionSpec) -> str:
    """A name for all chains that no rule names; no named chain has it."""
    name = "other"
    while name in (*spec.cohort_chains, spec.sister_chain):
        name += "_"
    return name


def chain_kind(chain: Column, spec: RetentionSpec) -> Column:
    """A chain that some rule names, or one value for all others; NULL stays."""
    named = chain.isin(*spec.cohort_chains, spec.sister_chain)
    return F.when(named, chain).when(chain.isNotNull(), other_chain(spec))


def outlet_label(outlet_class: Column, spec: RetentionSpec) -> Column:
    return F.concat(F.lit(spec.labels.detail_prefix), F.initcap(outlet_class))


def destination_detail(
    dest: Column, chain: Column, outlet_class: Column, spec: RetentionSpec
) -> Column:
    """Class of outlet behind a destination; the first matching rule decides."""
    text = spec.labels
    return (
        F.when(chain == spec.sister_chain, text.detail_sister)
        .when(chain.isin(*spec.cohort_chains), text.detail_own)
        .when((dest == text.stopped) & outlet_class.isNull(), text.detail_off_grid)
        .when(outlet_class == spec.outlet_class_mail, text.detail_mail)
        .when(outlet_class.isNull(), text.attention)
        .otherwise(outlet_label(outlet_class, spec))
    )


def report_destination(dest: Column, spec: RetentionSpec) -> Column:
    text = spec.labels
    return (
        F.when(dest == text.mail, text.report_mail)
        .when(dest == text.competitor, text.report_competitor)
        .when(dest == text.stopped, text.report_off_grid)
        .otherwise(text.attention)
    )


def _lookup(pairs: tuple[tuple[str, object], ...], key: Column, kind: str) -> Column:
    if not pairs:
        return F.lit(None).cast(kind)
    return F.create_map(*[F.lit(v) for pair in pairs for v in pair])[key]


def market_rank(market: Column, spec: RetentionSpec) -> Column:
    """Report position of a market, NULL if it has none."""
    return _lookup(spec.market_ranks, market, "int")


def chain_name(chain: Column, spec: RetentionSpec) -> Column:
    return F.coalesce(_lookup(spec.chain_names, chain, "string"), F.lit(spec.labels.chain_unknown))
