"""The tables a study reads."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from lapsewise.operators import exclusion, market
from lapsewise.sources import star
from lapsewise.spec import RetentionSpec


class Inputs:
    """Tables of a study.

    ``history`` is the fill fact back to its first month; ``fills`` may start at
    the lookback, so that its scan can skip older data. ``market_bytes`` and
    ``codes_bytes`` bound the stored size of the market and of the list of
    exclusion codes, where that is known: small ones are broadcast.
    """

    market_bytes: int | None = None
    codes_bytes: int | None = None

    def __init__(
        self,
        fills: DataFrame,
        history: DataFrame,
        products: DataFrame,
        bridge: DataFrame,
        market_codes: DataFrame,
        exclusion_codes: DataFrame,
        market_bytes: int | None = None,
        codes_bytes: int | None = None,
    ):
        self.fills = fills
        self.history = history
        self.products = products
        self.bridge = bridge
        self.market_codes = market_codes
        self.exclusion_codes = exclusion_codes
        self.market_bytes = market_bytes
        self.codes_bytes = codes_bytes

    def fills_in_market(self, products: DataFrame) -> DataFrame:
        """Fills of a market's products, with the market's columns."""
        return market.in_market(self.fills, products, self.market_bytes)

    def history_of_codes(self) -> DataFrame:
        """Fills of the exclusion codes, back to the first month."""
        return exclusion.of_codes(self.history, self.exclusion_codes, self.codes_bytes)


class StarInputs(Inputs):
    """The star tables, each bound when first used.

    Line items meet the market, or the codes, before they meet their orders.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, spec: RetentionSpec = star.STAR_SPEC):
        self.tables, self.spec = star.Tables(spark, sf_dir), spec

    @cached_property
    def fills(self) -> DataFrame:
        return star.fills(self.tables, self.spec.lookback_first, self.spec.fills_last)

    @cached_property
    def history(self) -> DataFrame:
        return star.fills(self.tables, None, self.spec.fills_last)

    def fills_in_market(self, products: DataFrame) -> DataFrame:
        return star.fills(
            self.tables,
            self.spec.lookback_first,
            self.spec.fills_last,
            lambda items: market.in_market(items, products, self.market_bytes),
            ("market", "market_desc", "prod_desc"),
        )

    def history_of_codes(self) -> DataFrame:
        return star.fills(
            self.tables,
            None,
            self.spec.fills_last,
            lambda items: exclusion.of_codes(items, self.exclusion_codes, self.codes_bytes),
            few=True,
        )

    @cached_property
    def market_bytes(self) -> int:
        """Each product gives at most one row by attribute and one by code list."""
        return 2 * star.stored_bytes(self.tables("part"))

    @cached_property
    def codes_bytes(self) -> int:
        return star.stored_bytes(self.tables("part"))

    @cached_property
    def products(self) -> DataFrame:
        return star.products(self.tables)

    @cached_property
    def bridge(self) -> DataFrame:
        return star.product_codes(self.tables)

    @cached_property
    def market_codes(self) -> DataFrame:
        return star.market_codes(self.tables)

    @cached_property
    def exclusion_codes(self) -> DataFrame:
        return star.exclusion_codes(self.tables)
