"""Seeded samples in hash order: the same rows whatever the partitions or the engine."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom import fixed_values as fixed
from replyloom.operators.spread import first_by_hash, hash_order, hash_position
from replyloom.session import cut_lineage, literal_rows


def sample_rows(df: DataFrame, n: int = fixed.SAMPLE_SIZE, key: str = "tweet_id",
                seed: str = fixed.SEED) -> DataFrame:
    """``n`` rows at random, or all if there are fewer."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def sample_per_class(df: DataFrame, label: str, n: int = fixed.CANDIDATES_PER_CLASS,
                     key: str = "tweet_id", seed: str = fixed.SEED) -> DataFrame:
    """At most ``n`` rows of each class, small classes whole."""
    return first_by_hash(df, [label], key, n, seed)


def quota_shortage(df: DataFrame, quotas: Mapping[str, int], label: str) -> DataFrame:
    """(class, needed, found) of the classes with fewer rows than their quota."""
    wanted = literal_rows(df.sparkSession, ["class", "needed"], list(quotas.items())).withColumn(
        "needed", F.col("needed").cast("bigint")
    )
    found = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("found"))
    return (
        wanted.join(found, "class", "left")
        .fillna({"found": 0})
        .where(F.col("found") < F.col("needed"))
    )


def sample_quotas(df: DataFrame, quotas: Mapping[str, int], label: str = "candidate_intent",
                  key: str = "tweet_id", seed: str = fixed.SEED, check: bool = True) -> DataFrame:
    """Exactly the quota of each class; an error names the classes that are short."""
    quota = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    ranked = first_by_hash(
        df.where(F.col(label).isin(list(quotas))), [label], key, max(quotas.values()), seed, "_rank"
    )
    if check:
        # a class below its quota is whole in the sample, so the sample tells what it has
        ranked = cut_lineage(ranked)
        short = quota_shortage(ranked, quotas, label).limit(len(quotas)).collect()
        if short:
            raise ValueError(
                "Not enough candidates: "
                + "; ".join(f"{r['class']} needs {r['needed']}, has {r['found']}" for r in short)
            )
    return ranked.where(F.col("_rank") <= quota[F.col(label)]).drop("_rank")


def cap_classes(df: DataFrame, cap: int = fixed.CLASS_CAP, label: str = "intent",
                key: str = "tweet_id", seed: str = fixed.SEED) -> DataFrame:
    """At most ``cap`` rows of each class."""
    return sample_per_class(df, label, cap, key, seed)


def cap_one_class(df: DataFrame, cap: int = fixed.OTHER_CLASS_CAP, name: str = fixed.OTHER_CLASS,
                  label: str = "intent", key: str = "tweet_id", seed: str = fixed.SEED) -> DataFrame:
    """At most ``cap`` rows of one class, all rows of the others; ``df`` is read twice."""
    capped = first_by_hash(df.where(F.col(label) == name), [label], key, cap, seed)
    return df.where(F.col(label) != name).unionByName(capped)


def shuffle_positions(df: DataFrame, key: str = "tweet_id", seed: str = fixed.SEED,
                      out: str = "shuffle_pos") -> DataFrame:
    """Number all rows from 1 in random order."""
    return hash_position(df, key, seed, (), out)


def assign_folds(df: DataFrame, label: str, n_folds: int = fixed.FOLDS, key: str = "tweet_id",
                 seed: str = fixed.SEED, out: str = "fold") -> DataFrame:
    """Deal the rows of each class over the folds in random order; ``df`` is read twice."""
    placed = hash_position(df, key, seed, (label,), "_at")
    return placed.withColumn(out, F.pmod(F.col("_at") - 1, F.lit(n_folds)).cast("bigint")).drop("_at")


def lowest_confidence(df: DataFrame, n: int = 10, key: str = "tweet_id",
                      confidence: str = "confidence") -> DataFrame:
    return df.orderBy(confidence, key).limit(n)


def top_two(df: DataFrame, probabilities: str, classes: list[str]) -> DataFrame:
    """Best and second class, their probabilities and the margin; of equals the later class first."""
    names = F.array(*[F.lit(c) for c in classes])
    ranked = F.sort_array(
        F.transform(F.col(probabilities), lambda p, i: F.struct(p.alias("p"), i.alias("i"))), asc=False
    )
    first, second = F.element_at("_ranked", 1), F.element_at("_ranked", 2)
    return (
        df.withColumn("_ranked", ranked)
        .withColumns(
            {
                "predicted_intent": F.get(names, first["i"]),
                "confidence": first["p"],
                "second_intent": F.get(names, second["i"]),
                "second_confidence": second["p"],
                "confidence_margin": first["p"] - second["p"],
            }
        )
        .drop("_ranked")
    )
