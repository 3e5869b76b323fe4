"""Members taken out, or no longer counted as lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.functions.keys import code_number
from lapsewise.operators.market import hinted
from lapsewise.spec import RetentionSpec


def of_codes(fills: DataFrame, codes: DataFrame, codes_bytes: int | None = None) -> DataFrame:
    """Fills (or anything with a ``product_code``) of listed codes.

    Codes are compared as numbers; a dirty code matches nothing. ``codes_bytes``
    bounds the stored size of the list, as for a market.
    """
    listed = codes.select(code_number(F.col("ndc")).alias("listed_code"))
    same = code_number(F.col("product_code")) == F.col("listed_code")
    return fills.join(hinted(listed, codes_bytes), same, "left_semi")


def code_users(listed_fills: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Entities that bought a listed code, tagged with the market they leave.

    ``listed_fills`` are exclusion fills of listed codes.
    """
    return (
        listed_fills.select("entity_id")
        .distinct()
        .withColumn("market", F.lit(spec.exclusion_market))
    )


def exclude_code_users(
    lost: DataFrame, listed_fills: DataFrame, spec: RetentionSpec
) -> DataFrame:
    """Members without those of the exclusion market who ever bought a listed code."""
    return without_users(lost, code_users(listed_fills, spec))


def without_users(lost: DataFrame, users: DataFrame) -> DataFrame:
    """Members without ``users``, entities with the market they leave."""
    return lost.join(users, ["market", "entity_id"], "left_anti")


def own_mail_cleanup(members: DataFrame, spec: RetentionSpec) -> DataFrame:
    """Members who moved to the chain's own mail house count as not lost.

    ``members`` have ``lost_month``, and of their follow-up ``lost_dest`` and
    ``own_mail`` (see ``destination.member_followup``). A member never lost who
    still used the mail house would get the number after never; follow-up fills
    exist for lost members only, so none does.
    """
    number = F.col("lost_month")
    never = number == spec.never_lost
    moved = F.coalesce(F.col("own_mail"), F.lit(False))
    return members.withColumns(
        {
            "lost_dest": F.when(
                never | ((number < spec.never_lost) & moved), spec.labels.not_lost
            ).otherwise(F.col("lost_dest")),
            "lost_month": F.when(never & moved, spec.never_lost + 1)
            .when((number < spec.never_lost) & moved, spec.never_lost)
            .otherwise(number),
        }
    )
