"""Exact copies of texts: sorted digest runs merged up a tree.

Each input partition is a leaf run: its digests in order, each with its smallest identifier and its count. In every
round, groups of runs meet: runs g*f to g*f+f-1 become run g, merged digest by digest over all tasks of the round, so
that no task holds a whole run. A digest has at most ``FANOUT`` entries to merge in a round however many copies it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm import shared

#: Leaf runs, a power of the fan-out: input partitions beyond this many share a run.
RUNS = 512
FANOUT = 8

#: Runs of this white space count as one blank.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text that copies share; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def digests(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, ``row`` (its place in the files), ``digest``, ``check`` and ``run``.

    ``check`` is a second hash of the same text: it is part of what is compared at every level of the tree, so that two
    texts meet only if both agree.
    """
    docs = shared.scan(docs)
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        shared.place(docs).alias("row"),
        normalised(F.col("text")).alias("text"),
        F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"),
    )
    return text.select(
        "doc_id", "row", F.sha2("text", 256).alias("digest"), F.xxhash64("text").alias("check"), "run"
    )


def merged(rows: DataFrame, runs: int = RUNS, fanout: int = FANOUT) -> DataFrame:
    """For each digest its ``keep`` (the smallest identifier; null last, then the first row) and ``size``."""
    entry = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    level = rows.groupBy("run", "digest", "check").agg(F.min(entry).alias("keep"), F.count(F.lit(1)).alias("size"))
    while runs > 1:
        runs = -(-runs // fanout)
        level = (
            level.withColumn("run", F.expr(f"run div {fanout}"))
            .groupBy("run", "digest", "check")
            .agg(F.min("keep").alias("keep"), F.sum("size").alias("size"))
        )
    return level.drop("run")


def copies(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, ``row``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are after each run of white space became one blank. A null text is empty; empty texts are
    copies of each other. Of equal texts the row with the smallest doc_id stays (null is the largest); of rows that
    share that doc_id too, one whose place is the smallest. An empty table gives no rows. Only doc_id and text are read.
    Texts never leave the task that reads them: digests do. ``row`` is the row's file and number there, so that another
    read of the same files finds it again; what is not a scan of files is written first.
    """
    rows = shared.stored(digests(docs))
    many = merged(rows).where("size > 1")
    joined = rows.join(many, ["digest", "check"], "left")
    return joined.select(
        "doc_id",
        "row",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def rows_kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` (a ``scan``), all columns, whose place is not among the ``row`` values of ``kept``'s rest.

    ``kept`` has ``row`` and ``kept`` for every row of ``docs``; only rows that go are joined, by their place.
    """
    row = shared.fresh(docs.columns, "row")
    gone = kept.where(~F.col("kept")).select(F.col("row").alias(row))
    return docs.withColumn(row, shared.place(docs)).join(gone, row, "left_anti").drop(row)


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of copies, all columns as they were.

    Nulls, empty texts, ties and repeated rows are as ``copies`` says: of repeated rows one stays. An empty table stays
    empty.
    """
    docs = shared.scan(docs)
    return rows_kept(docs, copies(docs))
