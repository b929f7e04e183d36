"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import cut_lineage


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node that each node of ``links`` (``a``, ``b``) can reach.

    A round sends every node the smallest label among its neighbours (an aggregate, combined before the
    shuffle), tells the node it named before, and then lets each label jump to the label of the node it
    names, so a chain of n nodes takes about log n rounds. Both sides of the joins are written tables, shuffled for the join alone, so
    adaptive execution splits a label that very many nodes share. Null ends and loops are left out.
    """
    links = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    links = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(max_rounds):
        sent = links.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("to")).agg(F.min("label").alias("sent"))
        hooked = cut_lineage(
            labels.join(sent, F.col("node") == F.col("to"), "left")
            .select("node", F.least("label", F.coalesce("sent", "label")).alias("label"), F.col("label").alias("old"))
        )
        told = hooked.filter("label < old").groupBy(F.col("old").alias("root")).agg(F.min("label").alias("told"))
        merged = cut_lineage(
            hooked.join(told, F.col("node") == F.col("root"), "left")
            .select("node", F.least("label", F.coalesce("told", "label")).alias("label"), "old")
        )
        jump = merged.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = cut_lineage(
            merged.join(jump, F.col("label") == F.col("at"), "left")
            .select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old")
        )
        labels = jumped.select("node", "label")
        if jumped.filter(F.col("label") != F.col("old")).isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")
