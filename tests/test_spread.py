"""Operators that split hot groups give the same rows as the plain ones."""

import hashlib

from pyspark.sql import functions as F

from replyloom.operators import sampling
from replyloom.operators.spread import (
    first_by_hash, first_per_key, hash_position, lookup, top_per_group, with_neighbours,
)


def skewed(spark):
    """One group holds most rows."""
    return spark.range(2000).select(
        F.col("id"), F.when(F.col("id") % 10 < 8, "big").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.col("id") * 7919 % 1000).alias("v"),
    )


def md5(key, seed="42"):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def test_lookup(spark):
    left = skewed(spark)
    right = left.select(F.col("g").alias("name")).distinct().where("name <> 'g9'").withColumn(
        "size", F.length("name"))
    for how in ("inner", "left"):
        found = lookup(left, right, "g", "name", how)
        assert found.columns == [*left.columns, "size"]
        assert all(r["size"] == (None if r["g"] in (None, "g9") else len(r["g"])) for r in found.collect())
    known = left.where("g <> 'g9'").count()
    assert lookup(left, right, "g", "name").count() == known
    assert lookup(left, right, "g", "name", "left_semi").count() == known
    assert lookup(left, right, "g", "name", "left_anti").count() == left.count() - known


def test_top_per_group(spark):
    rows = skewed(spark)
    kept = top_per_group(rows, ["g"], [F.desc("v"), F.col("id")], 7, ["id"], rank="r").collect()
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["g"], []).append((-r["v"], r["id"]))
    expected = {(g, i, n + 1) for g, xs in groups.items() for n, (_, i) in enumerate(sorted(xs)[:7])}
    assert {(r["g"], r["id"], r["r"]) for r in kept} == expected


def test_first_by_hash_both_ways(spark):
    rows = skewed(spark).withColumn("g", F.when(F.col("g") != "g9", F.col("g")))
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["g"], []).append(r["id"])
    for n in (1, 9, 30, 3000):
        expected = {(g, i, at + 1) for g, ids in groups.items()
                    for at, i in enumerate(sorted(ids, key=md5)[:n])}
        for way in ({"limit_in_tasks": 10_000}, {"limit_in_tasks": 0, "digits": 2}):
            kept = first_by_hash(rows, ["g"], "id", n, "42", "r", **way).collect()
            assert {(r["g"], r["id"], r["r"]) for r in kept} == expected


def test_hash_position_with_and_without_groups(spark):
    rows = skewed(spark)
    placed = {r["id"]: r["position"] for r in hash_position(rows, "id", "42").collect()}
    assert placed == {i: n + 1 for n, i in enumerate(sorted(range(2000), key=md5))}
    by_group = hash_position(rows, "id", "42", ("g",), "at", digits=1).collect()
    groups = {}
    for r in by_group:
        groups.setdefault(r["g"], []).append((md5(r["id"]), r["at"]))
    for found in groups.values():
        assert [at for _, at in sorted(found)] == list(range(1, len(found) + 1))


def test_neighbours_cross_stretches(spark):
    rows = spark.range(100).select(
        F.when(F.col("id") < 90, "long").otherwise("short").alias("c"),
        F.when(F.col("id") < 90, F.col("id")).otherwise(F.col("id") - 90).alias("p"),
        (F.col("id") * 3).alias("x"),
    ).where("not (c = 'short' and p = 5)")
    known = {(r["c"], r["p"]): r["x"] for r in rows.collect()}
    # what stood around the missing row are neighbours now
    after = known | {("short", 5): known["short", 6]}
    before = known | {("short", 5): known["short", 4]}
    for span in (1, 4, 4096):
        near = with_neighbours(rows, "c", "p", ["x"], "n_", "b_", span).collect()
        assert len(near) == 99
        assert all(r["n_x"] == after.get((r["c"], r["p"] + 1)) for r in near)
        assert all(r["b_x"] == before.get((r["c"], r["p"] - 1)) for r in near)
        assert with_neighbours(rows, "c", "p", ["x"], None, "b_", span).columns == ["c", "p", "x", "b_x"]


def test_first_per_key(spark):
    rows = spark.createDataFrame([("a", 3, None), ("a", 1, "x"), ("b", 2, "y")], "k string, o int, v string")
    assert sorted(first_per_key(rows, ["k"], ["o"]).collect()) == [("a", 1, "x"), ("b", 2, "y")]


def test_samples_do_not_depend_on_partitions(spark):
    rows = skewed(spark)
    for make in (
        lambda df: sampling.sample_rows(df, 30, "id"),
        lambda df: sampling.sample_per_class(df, "g", 5, "id"),
        lambda df: sampling.sample_quotas(df, {"big": 9, "g8": 2}, "g", "id"),
        lambda df: sampling.assign_folds(df, "g", 5, "id"),
        lambda df: sampling.shuffle_positions(df, "id"),
    ):
        assert sorted(make(rows).collect()) == sorted(make(rows.repartition(7)).collect())


def test_quota_shortage_is_an_error(spark):
    import pytest

    with pytest.raises(ValueError, match="g8 needs 1000, has 40"):
        sampling.sample_quotas(skewed(spark), {"big": 1, "g8": 1000}, "g", "id")


def test_folds_are_balanced_per_class(spark):
    folds = sampling.assign_folds(skewed(spark), "g", 5, "id").groupBy("g", "fold").count().collect()
    for g in {r["g"] for r in folds}:
        sizes = [r["count"] for r in folds if r["g"] == g]
        assert max(sizes) - min(sizes) <= 1
