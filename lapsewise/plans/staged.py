"""The study step by step: every intermediate stage is a DataFrame of its own.

Each stage is lazy and built on first use, so asking for one stage plans only
what it needs. Status is a column: new and continuing members run in one pass.

``StagedStudy`` takes every step. ``LeanStudy`` gets membership, status and lost
month from month-grain windows and goes on from there.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.functions.months import month_start
from lapsewise.operators import cohort, destination, exclusion, fills, gaps, market, survival
from lapsewise.plans.inputs import Inputs
from lapsewise.sources import stages
from lapsewise.spec import RetentionSpec


def _kept(build, by_entity: bool):
    def kept(self):
        return self._keep(build.__name__, build(self), by_entity)

    kept.__name__, kept.__doc__ = build.__name__, build.__doc__
    return cached_property(kept)


def stage(build):
    """A lazy stage, kept in the study's store if it has one."""
    return _kept(build, by_entity=False)


def entity_stage(build):
    """A stage of sums or members: kept in buckets by entity, so that such stages join without a shuffle.

    Where rows have a cohort month, files are split by it.
    """
    return _kept(build, by_entity=True)


class StagedStudy:
    """``store`` names a shared folder: each stage that others build on is then
    written there once and read back; without it all stays one lazy plan. Stages
    of single fills (cohort, status and follow-up fills) are results only: the
    rest works on sums, so they are never written.

    A store may hold earlier versions of the stages: each run adds its own (see
    ``sources.stages``)."""

    def __init__(self, inputs: Inputs, spec: RetentionSpec, store: str | None = None):
        self.inputs = inputs
        self.spec = spec
        self.store = store

    def _keep(self, name: str, df: DataFrame, by_entity: bool) -> DataFrame:
        if not self.store:
            return df
        path = f"{self.store}/{name}"
        if not by_entity:
            return stages.write_stage(df, path)
        spark = df.sparkSession
        months = [c for c in ("cohort_yyyymm",) if c in df.columns]
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        with stages.co_located(spark):
            return stages.write_stage(df, path, months, ["entity_id"], buckets)

    @stage
    def market(self) -> DataFrame:
        i = self.inputs
        return market.market_definition(i.products, i.bridge, i.market_codes, self.spec)

    @stage
    def qualified(self) -> DataFrame:
        """Qualified fills of any market, from the lookback to the last span month."""
        s = self.spec
        rows = self.inputs.fills_in_market(self.market)
        return fills.with_weight(fills.qualified_fills(rows, s, s.lookback_first, s.fills_last), s)

    @entity_stage
    def members(self) -> DataFrame:
        """From the month grain, which has every (market, chain, month, entity) once."""
        return cohort.cohort_members(self.months, self.spec)

    @entity_stage
    def months(self) -> DataFrame:
        return cohort.month_grain(self.qualified)

    @cached_property
    def cohort_fills(self) -> DataFrame:
        return cohort.cohort_fills(self.qualified, self.members, self.spec)

    @stage
    def period_dim(self) -> DataFrame:
        return cohort.period_dim(self.qualified, self.spec)

    @entity_stage
    def active_members(self) -> DataFrame:
        history = cohort.member_history(self.members, self.months, self.spec)
        return cohort.cohort_min_fills(history, self.spec)

    @entity_stage
    def status(self) -> DataFrame:
        return cohort.entity_status(self.active_members)

    @cached_property
    def status_fills(self) -> DataFrame:
        return cohort.status_fills(self.cohort_fills, self.status)

    @cached_property
    def monthly(self) -> DataFrame:
        return gaps.fills_by_month(self.months, self.status, self.spec)

    @entity_stage
    def gaps(self) -> DataFrame:
        return gaps.entity_gaps(self.monthly, self.spec)

    @cached_property
    def first_gap(self) -> DataFrame:
        return gaps.first_long_gap(self.gaps, self.spec)

    @entity_stage
    def lost(self) -> DataFrame:
        return gaps.lost_month(self.gaps, self.spec)

    @property
    def _any_chain(self) -> DataFrame:
        rows = self.inputs.fills_in_market(self.market)
        return fills.with_weight(fills.followup_fills(rows, self.spec), self.spec)

    @cached_property
    def followup(self) -> DataFrame:
        months = destination.followed_months(self.kinds)
        return destination.lost_window_fills(self.lost, self._any_chain, self.spec, months)

    @entity_stage
    def kinds(self) -> DataFrame:
        """Follow-up fills summed by kind."""
        return destination.fill_kinds(self._any_chain, self.spec)

    @entity_stage
    def followup_kinds(self) -> DataFrame:
        """The follow-up as the later stages need it."""
        return destination.lost_window_kinds(self.lost, self.kinds, self.spec)

    @entity_stage
    def outcome(self) -> DataFrame:
        """Every member with what its follow-up says."""
        return destination.member_followup(self.followup_kinds, self.spec)

    @cached_property
    def destination(self) -> DataFrame:
        return destination.lost_destination(self.outcome, self.spec)

    @property
    def _listed(self) -> DataFrame:
        return fills.exclusion_fills(self.inputs.history_of_codes(), self.spec)

    @entity_stage
    def code_users(self) -> DataFrame:
        return exclusion.code_users(self._listed, self.spec)

    @cached_property
    def kept(self) -> DataFrame:
        return exclusion.without_users(self.lost, self.code_users)

    @entity_stage
    def cleaned(self) -> DataFrame:
        left = exclusion.without_users(self.outcome, self.code_users)
        return exclusion.own_mail_cleanup(left, self.spec)

    @cached_property
    def outlet_class(self) -> DataFrame:
        return destination.lost_outlet_class(self.cleaned, self.spec)

    @stage
    def curve(self) -> DataFrame:
        return survival.survival_curve(self.cleaned, self.outlet_class, self.spec)

    def stages(self) -> dict[str, DataFrame]:
        """The stages whose sizes tell how a run went."""
        return {name: getattr(self, made) for name, made in SHOWN.items()}

    def ledger(self) -> dict[str, int]:
        """Rows of each stage of ``stages``, counted while the stage was written or, a result, made.

        Only for a study with a store: no stage is computed twice, and none is read again to be counted.
        """
        if not self.store:
            raise ValueError("a ledger is kept by a study with a store")
        found = {}
        for name, made in SHOWN.items():
            df = getattr(self, made)
            written = stages.versions(df.sparkSession, f"{self.store}/{made}")
            if written:
                found[name] = written[-1].rows
            else:
                with stages.co_located(df.sparkSession):
                    found[name] = stages.observed_rows(df)
        return found


#: Names of the stages that are shown, and what makes them.
SHOWN = {
    "market": "market",
    "members": "members",
    "cohort_fills": "cohort_fills",
    "period_dim": "period_dim",
    "active_members": "active_members",
    "status": "status",
    "status_fills": "status_fills",
    "gaps": "gaps",
    "lost_month": "lost",
    "lost_window_fills": "followup",
    "lost_destination": "destination",
    "code_users_excluded": "kept",
    "own_mail_cleaned": "cleaned",
    "lost_outlet_class": "outlet_class",
    "survival_curve": "curve",
}


def _with_months(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.select(
        "*",
        month_start(F.col("cohort_yyyymm")).alias("cohort_month"),
        month_start(F.col("before_gap_start")).alias("last_fill_month"),
    )


class LeanStudy(StagedStudy):
    """The same stages after the lost month, without the copies before it."""

    @cached_property
    def lifecycle(self) -> DataFrame:
        return gaps.cohort_lifecycle(self.months, self.spec)

    @cached_property
    def followup(self) -> DataFrame:
        """Losses and the months of their follow-up come from one read of the fact, the fills from another."""
        s = self.spec
        rows = fills.trusted_fills(self.inputs.fills_in_market(self.market), s).filter(
            F.col("fill_yyyymm").between(s.lookback_first, s.fills_last) & (F.col("is_maintenance") == 1)
        )
        months = cohort.month_grain_of_all(fills.with_weight(rows, s), s)
        lost = _with_months(gaps.cohort_lifecycle(months, s)).select(*destination.LOSS, "fill_months")
        return destination.lost_window_fills(lost, self._any_chain, s)

    @entity_stage
    def status(self) -> DataFrame:
        month = month_start(F.col("cohort_yyyymm")).alias("cohort_month")
        return self.lifecycle.select("*", month).select(*cohort.MEMBER_WIDE, "status", "fills_in_span")

    @cached_property
    def status_fills(self) -> DataFrame:
        return cohort.cohort_fills(self.qualified, self.status, self.spec)

    @entity_stage
    def lost(self) -> DataFrame:
        return _with_months(self.lifecycle).select(*destination.LOSS)
