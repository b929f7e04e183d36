"""Lists that lie in a table as one edge per node, walked by pointer jumping.

A walk follows edges until a node has none. :func:`double_hops` gives jump tables of 1, 2, 4 ... hops, so that a walk
of a thousand tweets takes ten rounds of joins. Walks that run into a circle never end. Their circles are found in as many
rounds, and each is cut in front of its smallest node; what is left are lists like all others, with jump tables of their own.
A walk into a circle then lies in two lists: up to the cut, and on from there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.operators.spread import lookup
from replyloom.session import cut_and_count, cut_lineage


@dataclass
class Jumps:
    """``levels[i]`` holds (node, jump, dist): where ``2 ** i`` hops lead and how many tweets on.

    ``endless`` holds the nodes whose walk runs into a circle of replies; they are in no level. ``cut`` holds the edge (node, jump, dist)
    that was taken out of each circle, and ``open`` the jump tables of those nodes without it.
    """

    levels: list[DataFrame]
    endless: DataFrame | None = None
    cut: DataFrame | None = None
    open: list[DataFrame] | None = None


def double_hops(edges: DataFrame) -> Jumps:
    """Jump tables over (node, jump, dist) edges, one edge per node.

    Level i holds the nodes with at least ``2 ** i`` hops ahead. As long as a node outside the
    circles is left, some node runs out of hops in every round; so a round that loses no node
    leaves only nodes that never come to an end.
    """
    levels, endless = _levels(edges.select("node", "jump", "dist"))
    if endless is None:
        return Jumps(levels)
    looped = cut_lineage(levels[0].join(endless, "node", "left_semi"))
    cut = break_circles(looped)
    rest, left = _levels(looped.join(cut.select("node"), "node", "left_anti"))
    if left is not None:
        raise RuntimeError("a circle was not cut")
    return Jumps([one.join(endless, "node", "left_anti") for one in levels], endless, cut, rest)


def _levels(edges: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Jump tables, and the nodes whose walk never ends, or None."""
    level, left = cut_and_count(edges)
    levels: list[DataFrame] = []
    while left:
        levels.append(level)
        level, remaining = cut_and_count(hop_on(level, level))
        if remaining == left:
            return levels, level.select("node")
        left = remaining
    return levels, None


def hop_on(first: DataFrame, then: DataFrame) -> DataFrame:
    """The jumps of ``first`` followed by those of ``then``, where there are any."""
    ahead = then.select(F.col("node").alias("mid"), F.col("jump").alias("far"), F.col("dist").alias("more"))
    return lookup(first, ahead, "jump", "mid").select(
        "node", F.col("far").alias("jump"), (F.col("dist") + F.col("more")).alias("dist")
    )


def break_circles(edges: DataFrame) -> DataFrame:
    """The edge that leads to the smallest node of each circle; ``edges`` holds only nodes whose walk never ends.

    Every node keeps the smallest node among those that come next, of twice as many in every round. As soon as there
    are as many as edges, that covers its circle. Where such long jumps end lies on a circle, and every node of a circle is such an end.
    """
    size = edges.count()
    window = edges.select("node", "jump", F.col("jump").alias("least"))
    hops = 1
    while hops < size:
        ahead = window.select(F.col("node").alias("mid"), F.col("jump").alias("far"), F.col("least").alias("other"))
        window = cut_lineage(
            lookup(window, ahead, "jump", "mid").select("node", F.col("far").alias("jump"), F.least("least", "other").alias("least"))
        )
        hops *= 2
    on_circle = window.select(F.col("jump").alias("node")).distinct()
    heads = window.join(on_circle, "node", "left_semi").select(F.col("node").alias("at"), F.col("least").alias("head"))
    closing = lookup(edges, heads, "node", "at").where(F.col("jump") == F.col("head"))
    return cut_lineage(closing.select("node", "jump", "dist"))


def follow(starts: DataFrame, jumps: Jumps) -> DataFrame:
    """(node) to (node, last, dist): the last node of its walk and how many tweets away it is."""
    walk = starts.select("node", F.col("node").alias("last"), F.lit(0).cast("bigint").alias("dist"))
    for level in reversed(jumps.levels):
        step = level.select(
            F.col("node").alias("at"), F.col("jump").alias("to"), F.col("dist").alias("more")
        )
        walk = lookup(walk, step, "last", "at", "left").select(
            "node",
            F.coalesce("to", "last").alias("last"),
            (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"),
        )
    return walk


def list_into_circle(starts: DataFrame, jumps: Jumps) -> DataFrame:
    """As :func:`list_walk` for starts that run into a circle: up to the cut, and on from there once round.

    Nodes between the entry into the circle and the cut come up twice, at their second place as well.
    """
    lists = Jumps(jumps.open)
    first = cut_lineage(list_walk(starts, lists))
    closing = jumps.cut.select(F.col("node").alias("closing"), F.col("jump").alias("to"), F.col("dist").alias("more"))
    again = lookup(first, closing, "node", "closing").select("walk", F.col("to").alias("node"), (F.col("off") + F.col("more")).alias("off"))
    return first.unionByName(list_walk(again, lists))


def list_walk(starts: DataFrame, jumps: Jumps) -> DataFrame:
    """(walk, node, off) to every node of each walk, ``off`` counting tweets from its start.

    Larger jumps first: each round adds to every node listed so far the one 2**i hops on, so each
    node of a walk comes up once.
    """
    listed = starts.select("walk", "node", F.col("off").cast("bigint").alias("off"))
    here = F.struct("node", "off")
    for level in reversed(jumps.levels):
        step = level.select(F.col("node").alias("at"), F.col("jump").alias("to"), "dist")
        there = F.struct(F.col("to").alias("node"), (F.col("off") + F.col("dist")).alias("off"))
        # both rows come out of one join, so the plan grows by a join a level
        listed = lookup(listed, step, "node", "at", "left").select(
            "walk", F.inline(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there)))
        )
    return listed
