"""Group work that stays spread over the cluster when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replyloom.session import cut_lineage

SALTS = 64
# from this n on Spark no longer cuts the rows of a group within the input tasks
SMALL_TOP = 1_000
MAX_BROADCAST_ROWS = 100_000


def hash_order(key: str, seed: str) -> Column:
    """Seeded order of a key that does not depend on partitions or engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that comes first in ``order``.

    An aggregate, so copies are reduced before the shuffle and a key with a billion copies
    reaches its reducer as one row per input task.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*order, *[c for c in rest if c not in order])
    return (
        df.groupBy(*keys)
        .agg(F.min(ranked).alias("_first"))
        .select(*keys, *[F.col("_first")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
                  salt_on: Sequence[str], rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group.

    Rows are ranked within (group, salt) first, so a group with a third of all rows is cut down by
    ``SALTS`` tasks and the last task sees at most ``SALTS * n`` rows of it. For small ``n`` Spark
    also cuts each input task's rows ahead of both shuffles.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(SALTS)))
    part = Window.partitionBy(*group, "_salt").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    out = rank or "_rank"
    kept = (
        salted.withColumn("_rank", F.row_number().over(part))
        .where(F.col("_rank") <= n)
        .drop("_rank")
        .withColumn(out, F.row_number().over(whole).cast("bigint"))
        .where(F.col(out) <= n)
        .drop("_salt")
    )
    return kept if rank else kept.drop(out)


def hash_position(df: DataFrame, key: str, seed: str, group: Sequence[str] = (),
                  out: str = "position", digits: int = 4) -> DataFrame:
    """Number the rows of each group from 1 in hash order without sorting a group in one task.

    The leading hex digits of the hash split every group into ``16 ** digits`` ranges in order;
    rows are numbered within a range and moved up by the rows in the ranges before it.
    """
    ranged = df.withColumn("_hash", hash_order(key, seed)).withColumn(
        "_range", F.substring("_hash", 1, digits)
    )
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(*group, "_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .select(
            F.col("_range").alias("_o_range"), "_before",
            *[F.col(g).alias(f"_o_{i}") for i, g in enumerate(group)],
        )
    )
    inside = Window.partitionBy(*group, "_range").orderBy("_hash", key)
    condition = F.col("_range") == F.col("_o_range")
    for i, g in enumerate(group):
        condition = condition & F.col(g).eqNullSafe(F.col(f"_o_{i}"))
    return (
        ranged.join(offsets, condition)
        .withColumn(out, F.row_number().over(inside).cast("bigint") + F.col("_before"))
        .drop("_hash", "_range", "_before", "_o_range", *[f"_o_{i}" for i in range(len(group))])
    )


def first_by_hash(df: DataFrame, group: Sequence[str], key: str, n: int, seed: str,
                  rank: str | None = None, digits: int = 4,
                  limit_in_tasks: int = SMALL_TOP) -> DataFrame:
    """The first ``n`` rows of each group in hash order.

    A small ``n`` is cut down within the input tasks. For a large one the rows per range of the
    hash are counted first, and only rows of the leading ranges that hold ``n`` rows go on; all
    others are dropped before any shuffle. ``df`` is then read twice.
    """
    order = [hash_order(key, seed), F.col(key)]
    if n < limit_in_tasks:
        return top_per_group(df, group, order, n, [key], rank)
    ranged = df.withColumn("_range", F.substring(hash_order(key, seed), 1, digits))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    last = cut_lineage(
        ranged.groupBy(*group, "_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .where(F.col("_before") < n)
        .groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])
        .agg(F.max("_range").alias("_last"))
    )
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    if last.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        last = F.broadcast(last)
    kept = ranged.join(last, same).where(F.col("_range") <= F.col("_last")).drop(
        "_range", "_last", *[f"_g{i}" for i in range(len(group))]
    )
    return top_per_group(kept, group, order, n, [key], rank)


def place_in_order(df: DataFrame, group: str, position: str, out: str, span: int = 4_096) -> DataFrame:
    """Number the rows of each group from 0 in the order of ``position``, whatever gaps that has.

    Rows are numbered within stretches of ``span`` positions and moved up by the rows of the stretches
    before, so a group of any length is spread over many tasks.
    """
    parted = df.withColumn("_part", F.floor(F.col(position) / span))
    before = Window.partitionBy("_in").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parted.groupBy(F.col(group).alias("_in"), F.col("_part").alias("_at"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_in", "_at", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    same = F.col(group).eqNullSafe(F.col("_in")) & F.col("_part").eqNullSafe(F.col("_at"))
    inside = Window.partitionBy(group, "_part").orderBy(position)
    return (
        parted.join(offsets, same)
        .withColumn(out, F.row_number().over(inside).cast("bigint") - 1 + F.col("_before"))
        .drop("_part", "_in", "_at", "_before")
    )


def with_neighbours(df: DataFrame, group: str, position: str, columns: Sequence[str],
                    after: str | None = "next_", before: str | None = None,
                    span: int = 4_096) -> DataFrame:
    """Add columns of the next row (prefix ``after``) and of the row before (prefix ``before``).

    Rows of a group follow each other in the order of ``position``, which may have gaps. Groups are cut into
    stretches of ``span`` rows that are windowed apart; the one row each stretch needs from the stretch
    beside it is copied over, so a group of any length is spread over many tasks in one shuffle.
    """
    numbered = place_in_order(df, group, position, "_place", span)
    stretch = F.floor(F.col("_place") / span)
    inside = F.pmod(F.col("_place"), F.lit(span))
    places = [stretch]
    if after:
        places.append(F.when(inside == 0, stretch - 1))
    if before:
        places.append(F.when(inside == span - 1, stretch + 1))
    copied = F.filter(F.array(*places), lambda s: s.isNotNull())
    window = Window.partitionBy(group, "_stretch").orderBy("_place")
    found = {}
    for prefix, shift, step in ((after, F.lead, 1), (before, F.lag, -1)):
        if prefix:
            near = shift(F.col("_place"), 1).over(window) == F.col("_place") + step
            found |= {f"{prefix}{c}": F.when(near, shift(F.col(c), 1).over(window)) for c in columns}
    return (
        numbered.withColumn("_stretch", F.explode(copied))
        .withColumns(found)
        .where(F.col("_stretch") == stretch)
        .drop("_stretch", "_place")
    )


def lookup(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Join each left row to the one right row with its key; the key of the right side is dropped.

    A plain join: adaptive execution splits a left key that very many rows hold.
    """
    if right_key in left.columns:
        raise ValueError(f"column {right_key} is on both sides")
    joined = left.join(right, F.col(left_key) == F.col(right_key), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(right_key)
