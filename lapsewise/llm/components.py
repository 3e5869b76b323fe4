"""Connected components of a graph of links, by rounds of joins that hand on the smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.llm import shared


def components(links: DataFrame) -> DataFrame:
    """For each number in ``links`` (a, b) the smallest number it is linked with, itself included: node, label.

    Each round, every link carries the smaller of its ends' labels to the labels of both ends (hooking), and each label
    is replaced by its own label (jumping), so that the depth of a chain halves. Rounds end when no link joins two
    labels. Each round's result is written to the shared folder, which also cuts the lineage.
    """
    links = shared.stored(links.where("a <> b").select("a", "b").distinct())
    labels = shared.stored(
        links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    )
    live = links
    while True:
        # links between the labels of their ends; those within a label are done
        a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        live = shared.stored(
            live.join(a, "a").join(b, "b").where("la <> lb").select(
                F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")
            ).distinct()
        )
        if live.isEmpty():
            return labels
        hooked = live.groupBy("a").agg(F.min("b").alias("up"))
        up = _roots(hooked)
        labels = shared.stored(
            labels.join(up.select(F.col("a").alias("label"), "root"), "label", "left").select(
                "node", F.coalesce("root", "label").alias("label")
            )
        )


def _roots(hooked: DataFrame) -> DataFrame:
    """The end of each chain a -> up (always downward, so without circles): a, root."""
    chain = shared.stored(hooked.select("a", F.col("up").alias("root")))
    while True:
        step = chain.select(F.col("a").alias("root"), F.col("root").alias("next"))
        further = shared.stored(
            chain.join(step, "root", "left").select(
                "a", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            )
        )
        if further.where("moved").isEmpty():
            return further.select("a", "root")
        chain = further.select("a", "root")
