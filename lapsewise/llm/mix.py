"""Mixing of sources to target weights: systematic sampling of documents.

Sources share all words by weight, no source above ``MOST`` times its own words. Within a source, documents stand in
order of size, each expects target / size copies, and these are summed up one after another from a random offset; a
document is taken once for each whole number that its stretch of the sum crosses. Because neighbours are alike in size,
the words taken come near the target.

No task holds a source: documents are numbered in cells of one source, one size and one of ``SLOTS`` slots, and only the
counts of cells are summed up along a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.llm import shared

#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: A source's words are taken at most so often.
MOST = 3
#: Parts of the documents of one source and size.
SLOTS = 256

WORD = r"[^\x20\x09-\x0D]+"

_UNIT = 1 << 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _md5_number(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """For each source of ``sizes`` (source, source_size; a row per source): target words as top / bottom, and target.

    Sources are in order of code points, null last. What a source may not take is shared again by weight among the
    others: sources fill up in the order of limit / weight, and the rest shares what is left. Sizes of zero get zero.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = sizes.withColumn(
        "weight", F.element_at(cycle, (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("limit", F.col("source_size") * most)
    filling = Window.orderBy(
        (F.col("limit").cast("decimal(38,12)") / F.col("weight")), F.col("source").isNull(), "source"
    )
    so_far = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(so_far), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(so_far), F.lit(0))).alias("others"),
    ).withColumn("full", F.col("limit") * F.col("others") <= F.col("weight") * F.col("left"))
    # the first that does not fill up sets the share of all that follow
    open_ = F.max(F.when(~F.col("full"), F.struct("others", "left"))).over(everything)
    top = F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * open_["left"])
    bottom = F.when(F.col("full"), F.lit(1)).otherwise(open_["others"])
    return shares.select("source", "source_size", top.cast("long").alias("top"), bottom.cast("long").alias("bottom"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text, source) with how often the mix takes it.

    doc_id, ``row`` (its place in the files), ``source``, ``size`` (its words), ``source_size``, ``target`` (words of its
    source in the mix), ``copies`` and ``taken`` (words: copies times size). A null text has size zero; null is a source
    of its own, the last. Rows with the same doc_id and size are taken alike up to one copy. Runs agree, and so do lost
    tasks that run again. Sources without words have target zero and their documents no copies. An empty table gives no
    rows. Only the three columns are read; texts stay where they are read.
    """
    docs = shared.scan(docs)
    rows = shared.stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            shared.place(docs).alias("row"),
            F.col("source").cast("string").alias("source"),
            words(F.col("text")).alias("size"),
        ).withColumn("slot", _md5_number(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 2))
    )
    cells = rows.groupBy("source", "size", "slot").agg(F.count(F.lit(1)).alias("docs"))
    sizes = cells.groupBy("source", "size").agg(F.sum("docs").alias("docs"))
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    goals = targets(sources, weights, most)
    earlier = Window.unboundedPreceding, -1
    by_size = sizes.select(
        "source",
        "size",
        F.coalesce(F.sum("docs").over(Window.partitionBy("source").orderBy("size").rowsBetween(*earlier)), F.lit(0)).alias(
            "smaller"
        ),
    )
    slots = cells.select(
        "source",
        "size",
        "slot",
        F.coalesce(
            F.sum("docs").over(Window.partitionBy("source", "size").orderBy("slot").rowsBetween(*earlier)), F.lit(0)
        ).alias("before"),
    )
    same = lambda one, other, names: F.expr(" and ".join(f"{one}.{n} <=> {other}.{n}" for n in names))
    begin = (
        slots.alias("a")
        .join(by_size.alias("b"), same("a", "b", ["source", "size"]))
        .join(goals.alias("g"), same("a", "g", ["source"]))
        .select("a.source", "a.size", "a.slot", (F.col("before") + F.col("smaller")).alias("first"), "source_size", "top", "bottom")
    )
    numbered = rows.withColumn(
        "nth",
        F.row_number().over(
            Window.partitionBy("source", "size", "slot").orderBy(F.col("doc_id").isNull(), "doc_id", "row")
        )
        - 1,
    )
    placed = numbered.alias("r").join(begin.alias("c"), same("r", "c", ["source", "size", "slot"])).select(
        "r.doc_id", "r.row", "r.source", "r.size", "c.source_size", "c.top", "c.bottom", (F.col("first") + F.col("nth")).alias("place")
    )
    named = F.coalesce(F.col("source"), F.lit("\u0000"))
    offset = _md5_number(F.concat_ws(":", F.lit(str(seed)), named), 8)
    # copies each document of the source expects: top / (bottom * source_size); the offset is in units of 1 / 2^32
    wide = "cast({} as decimal(38,0))"
    crossed = "((({n}) * {top} * {unit} + {offset} * {bottom} * {size}) div ({bottom} * {size} * {unit}))".format(
        n="{}", top=wide.format("top"), unit=wide.format(_UNIT), offset=wide.format("offset"), bottom=wide.format("bottom"), size=wide.format("source_size")
    )
    counted = placed.withColumn("offset", offset).withColumn(
        "copies",
        F.when(F.col("source_size") == 0, F.lit(0)).otherwise(
            F.expr(f"{crossed.format('place + 1')} - {crossed.format('place')}")
        ),
    )
    return counted.select(
        "doc_id",
        "row",
        "source",
        "size",
        "source_size",
        (F.col("top").cast("double") / F.col("bottom")).alias("target"),
        "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: ``docs`` with every row as often as it is taken, all columns as they were.

    Rows are taken by their place in the files, so rows with the same doc_id, null or repeated ones, count each for
    itself. Rows without words are never taken. An empty table stays empty.
    """
    docs = shared.scan(docs)
    row, times = shared.fresh(docs.columns, "row"), shared.fresh(docs.columns, "copies")
    taken = mix(docs, **options).select(F.col("row").alias(row), F.col("copies").cast("int").alias(times))
    again = docs.withColumn(row, shared.place(docs)).join(taken.where(F.col(times) > 0), row)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return again.select(*columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)).drop(times)
