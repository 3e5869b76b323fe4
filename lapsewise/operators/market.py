"""Market definition: which products belong to which market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.functions.keys import padded_code, product_key
from lapsewise.spec import RetentionSpec

# Stored bytes of a table that may be broadcast; in memory it is several times as large.
BROADCAST_BYTES = 32 << 20


def _ordinary(products: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Products not flagged special; an unknown flag counts as ordinary."""
    flag = F.col("special_flag")
    return products.filter((flag != spec.special_flag) | flag.isNull())


def _once(rows: DataFrame, spec: RetentionSpec, named: bool = False) -> DataFrame:
    """Each product once per market.

    A strict study fails, when it runs, on a product with two descriptions or a market with two: either would count
    fills twice. The check is part of the plan: products cost no more shuffles than leaving out repeated rows, and the
    descriptions of markets are summed up to a row per market, not brought to one task. ``named`` markets have one
    description by construction.
    """
    if not spec.strict_market:
        return rows.distinct()
    once = rows.groupBy("market", "product_key").agg(
        F.min("market_desc").alias("market_desc"), F.min("prod_desc").alias("prod_desc"), _unlike("prod_desc").alias("unlike")
    )
    if not named:
        # as many rows as the study has markets
        markets = rows.groupBy("market").agg(_unlike("market_desc").alias("unlike_market"))
        once = once.join(F.broadcast(markets), "market").withColumn("unlike", F.col("unlike") | F.col("unlike_market"))
    error = F.raise_error(F.concat(F.lit("market is ambiguous: "), F.col("market"), F.lit(", product "), F.col("product_key")))
    sound = F.when(~F.col("unlike"), F.lit(True)).otherwise(error.cast("boolean"))
    return once.filter(sound).select("market", "market_desc", "prod_desc", "product_key")


def _unlike(name: str) -> Column:
    """Whether a group has different values of the column, or some and null; an aggregate of numbers only."""
    value = F.coalesce(F.xxhash64(name), F.lit(0))
    return (F.min(value) != F.max(value)) | (F.min(F.col(name).isNull()) != F.max(F.col(name).isNull()))


def market_by_attribute(products: DataFrame, spec: RetentionSpec) -> DataFrame:
    return (
        _ordinary(products, spec)
        .filter(F.col("market").isin(*spec.attribute_markets))
        .select(
            "market",
            "market_desc",
            "prod_desc",
            product_key(F.col("prod_id"), F.col("pack_cd")).alias("product_key"),
        )
        .transform(_once, spec)
    )


def market_by_code_list(
    products: DataFrame, bridge: DataFrame, codes: DataFrame, spec: RetentionSpec
) -> DataFrame:
    """One market from a list of codes, through the code-to-product bridge."""
    listed = codes.select(padded_code(F.col("ndc"), spec.code_length).alias("ndc_cd"))
    return (
        bridge.select("ndc_cd", "prod_id", "pack_cd")
        .join(listed, "ndc_cd", "left_semi")
        .join(
            _ordinary(products, spec).select("prod_id", "pack_cd", "prod_desc"),
            ["prod_id", "pack_cd"],
        )
        .select(
            F.lit(spec.list_market).alias("market"),
            F.lit(spec.list_market_desc).alias("market_desc"),
            "prod_desc",
            product_key(F.col("prod_id"), F.col("pack_cd")).alias("product_key"),
        )
        .transform(_once, spec, named=True)
    )


def market_definition(
    products: DataFrame, bridge: DataFrame, codes: DataFrame, spec: RetentionSpec
) -> DataFrame:
    return market_by_attribute(products, spec).unionByName(
        market_by_code_list(products, bridge, codes, spec)
    )


def market_conflicts(market: DataFrame) -> DataFrame:
    """Products described twice in a market, and markets described twice.

    Either doubles fills further on. An empty result means the market is sound.
    """
    twice = (
        market.groupBy("market", "product_key")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("market", F.col("product_key").cast("string").alias("item"), "n")
    )
    described = (
        market.groupBy("market")
        .agg(F.countDistinct("market_desc").alias("n"))
        .filter("n > 1")
        .select("market", F.lit("market_desc").alias("item"), "n")
    )
    return twice.unionByName(described)


def check_market(market: DataFrame) -> DataFrame:
    """The market itself, or an error if it would duplicate fills."""
    found = market_conflicts(market).take(5)
    if found:
        raise ValueError(f"market is ambiguous, for example {found}")
    return market


def hinted(side: DataFrame, stored_bytes: int | None) -> DataFrame:
    """``side`` marked for broadcast if a bound on its stored bytes is known and small."""
    return F.broadcast(side) if stored_bytes is not None and stored_bytes <= BROADCAST_BYTES else side


def in_market(
    fills: DataFrame, market: DataFrame, market_bytes: int | None = None
) -> DataFrame:
    """Fills of products in any market, once per market.

    ``market_bytes`` bounds the stored size of the market. Up to
    ``BROADCAST_BYTES`` the market is broadcast and the fact is not shuffled;
    above it, or without a bound, the join is left to statistics, and adaptive
    execution may split a hot product.
    """
    side = market.select("product_key", "market", "market_desc", "prod_desc")
    return fills.join(hinted(side, market_bytes), "product_key")
