"""Held-out rows and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNIT = 1 << 32


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from learning: crc32 of the id as text leaves 1 when divided by 3 (null as empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def bounded(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """About ``most`` of ``rows`` at most, chosen by a hash of ``key``: the same whenever it is asked for."""
    share = min(1.0, most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_UNIT)) < int(share * _UNIT))


def bounded_each(rows: DataFrame, kind: str, counts: dict, key: str, most: int, seed: int) -> DataFrame:
    """As ``bounded``, about ``most`` of each ``kind``; ``counts`` has the number of rows of each."""
    limits = [(value, int(min(1.0, most / n) * _UNIT)) for value, n in counts.items()]
    limits = rows.sparkSession.createDataFrame(limits, f"{kind} string, below long")
    chosen = rows.join(F.broadcast(limits), kind).where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_UNIT)) < F.col("below"))
    return chosen.select(*rows.columns)
