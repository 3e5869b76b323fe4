"""Binds a line-item star schema to the study's tables.

The study needs a fact of dated fills, a product dimension, a bridge from
product codes to products, and two code lists. Each function below names the
columns it reads, so the Parquet scan reads no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.functions.months import month_floor, month_key
from lapsewise.operators import reduce
from lapsewise.operators.market import hinted
from lapsewise.spec import RetentionSpec

OWN_MAIL = -1

STAR_SPEC = RetentionSpec(
    cohort_first=199801,
    cohort_last=199812,
    excluded_suppliers=(7,),
    excluded_states=("NATION_3",),
    own_mail_supplier=OWN_MAIL,
    long_fill_days=42,
)


class Tables:
    """The tables of one folder by name, each bound once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._bound: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._bound:
            self._bound[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._bound[name]


def stored_bytes(df: DataFrame) -> int:
    """Stored size of a plain table, as its files say; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shuffled(df: DataFrame) -> bool:
    """Whether a plain table is too large for Spark to broadcast it by itself."""
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return stored_bytes(df) > most


def _month_text(yyyymm: int) -> str:
    return f"{yyyymm // 100:04d}-{yyyymm % 100:02d}-01"


def _with_products(items: DataFrame) -> DataFrame:
    part = F.col("l_partkey")
    return items.withColumns({"product_key": part, "product_code": part.cast("string")})


def fills(
    tables: Tables,
    first: int | None = None,
    last: int | None = None,
    narrow: Callable[[DataFrame], DataFrame] | None = None,
    narrowed: tuple[str, ...] = (),
    few: bool = False,
) -> DataFrame:
    """Fill fact; ``first``/``last`` (YYYYMM) cut the scan itself.

    The month bounds are put on the stored timestamp, where Parquet row groups
    can be skipped, and not only on the derived month. ``narrow`` joins line items
    with what they must match (by ``product_key`` or ``product_code``) and may add
    the columns ``narrowed``. All that depends on the outlet and the product is
    joined and filtered before the orders, so that only surviving line items are
    shuffled, once. With ``few`` they are few: orders that are to be shuffled are then
    reduced to those of narrowed line items first, by a filter of their keys. It costs one
    more read of the keys and products of line items, and spares the shuffle of most orders.
    """
    shipped = F.col("l_shipdate")
    items = tables("lineitem")
    if first is not None:
        items = items.filter(shipped >= F.lit(_month_text(first)))
    if last is not None:
        after = last + 1 if last % 100 < 12 else (last // 100 + 1) * 100 + 1
        items = items.filter(shipped < F.lit(_month_text(after)))
    items = _with_products(items)
    orders = tables("orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"
    )
    nations = tables("nation").select("n_nationkey", "n_name", "n_regionkey")
    outlets = (
        tables("supplier")
        .select("s_suppkey", "s_nationkey")
        .join(hinted(nations, stored_bytes(nations)), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    # an outlet row is a supplier's and its nation's: no more than thrice the supplier's bytes
    outlets = hinted(outlets, 3 * stored_bytes(tables("supplier")))
    items = items.join(outlets, F.col("l_suppkey") == F.col("s_suppkey"))
    if narrow is not None:
        items = narrow(items)
    if narrow is not None and few and shuffled(tables("orders")):
        wanted = narrow(_with_products(tables("lineitem").select("l_orderkey", "l_partkey")))
        orders = reduce.may_have(orders, "o_orderkey", reduce.key_filter(wanted, "l_orderkey"))

    region = F.col("n_regionkey")
    fill_date = shipped.cast("date")
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("entity_id"),
            fill_date.alias("fill_date"),
            month_floor(fill_date).alias("fill_month"),
            month_key(fill_date).alias("fill_yyyymm"),
            "product_key",
            "product_code",
            F.when(region.isin(0, 1), "032")
            .when(region.isin(2, 3), "955")
            .when(F.col("n_nationkey") % 2 == 0, "033")
            .otherwise("101")
            .alias("chain"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "MAIL")
            .otherwise("RETAIL")
            .alias("channel"),
            F.when(F.col("o_orderstatus") == "O", "OTHER")
            .when(F.col("o_orderstatus") == "F", "CHAIN")
            .alias("outlet_class"),
            F.col("l_quantity").cast("int").alias("days_supply"),
            F.when(F.col("l_suppkey") % 20 == 5, OWN_MAIL)
            .otherwise(F.col("l_suppkey"))
            .cast("bigint")
            .alias("supplier_id"),
            F.col("n_name").alias("state"),
            F.lit(1).alias("is_maintenance"),
            F.lit(0).alias("is_bridge_error"),
            F.col("l_orderkey").alias("claim_order"),
            F.col("l_linenumber").alias("claim_line"),
            *narrowed,
        )
    )


def products(tables: Tables) -> DataFrame:
    """Product dimension: the part key split into a product and a pack number."""
    kind = F.col("p_type")
    return tables("part").select(
        F.floor(F.col("p_partkey") / 1000).cast("int").alias("prod_id"),
        (F.col("p_partkey") % 1000).cast("int").alias("pack_cd"),
        F.when(kind.isin("ECONOMY", "LARGE"), "31100")
        .when(kind.isin("MEDIUM", "SMALL"), "32100")
        .alias("market"),
        F.when(kind.isin("ECONOMY", "LARGE"), "GROUP A")
        .when(kind.isin("MEDIUM", "SMALL"), "GROUP B")
        .alias("market_desc"),
        F.col("p_name").alias("prod_desc"),
        F.when(F.col("p_size") == 50, "9").when(F.col("p_size") % 2 == 0, "0").alias("special_flag"),
    )


def product_codes(tables: Tables) -> DataFrame:
    """Bridge from twelve-digit codes to products."""
    return tables("part").select(
        F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("ndc_cd"),
        F.floor(F.col("p_partkey") / 1000).cast("int").alias("prod_id"),
        (F.col("p_partkey") % 1000).cast("int").alias("pack_cd"),
    )


def market_codes(tables: Tables) -> DataFrame:
    """Code list that defines the listed market."""
    brands = [f"Brand#{n}" for n in range(1, 9)]
    return (
        tables("part")
        .filter(F.col("p_brand").isin(*brands))
        .select(F.col("p_partkey").cast("string").alias("ndc"))
    )


def exclusion_codes(tables: Tables) -> DataFrame:
    """Code list whose buyers leave the listed market's cohorts."""
    return (
        tables("part")
        .filter(F.col("p_partkey") % 100 == 3)
        .select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("ndc"))
    )
