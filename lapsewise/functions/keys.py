"""Product keys and code normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def product_key(prod_id: Column, pack_cd: Column) -> Column:
    """Seven digits of product, three of pack, as one number."""
    return F.concat(
        F.lpad(prod_id.cast("string"), 7, "0"), F.lpad(pack_cd.cast("string"), 3, "0")
    ).cast("bigint")


def code_number(code: Column) -> Column:
    """A product code as a number, so that padding does not matter; NULL if dirty."""
    return code.try_cast("bigint")


def padded_code(code: Column, length: int) -> Column:
    return F.lpad(code, length, "0")
