"""Resolution pairs from conversations, without anything the evaluation set has seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from replyloom.functions.text import has_text, strip
from replyloom.operators.spread import lookup, with_neighbours


def _id(column: str, both_numbers: bool) -> Column:
    """The id as a number when both sides have numbers, else as trimmed text."""
    return F.col(column).cast("bigint") if both_numbers else strip(F.col(column).cast("string"))


def _both_numbers(left: DataFrame, right: DataFrame, column: str) -> bool:
    return all(isinstance(d.schema[column].dataType, IntegralType) for d in (left, right))


def holdout_rows(df: DataFrame, golden: DataFrame, key: str = "tweet_id") -> DataFrame:
    """Rows whose id is not in the golden set; ids in text columns are compared trimmed."""
    numbers = _both_numbers(df, golden, key)
    held = golden.select(_id(key, numbers).alias("_held")).distinct()
    return (
        df.withColumn("_id", _id(key, numbers))
        .join(held, F.col("_id") == F.col("_held"), "left_anti")
        .drop("_id")
    )


def golden_conversations(flat: DataFrame, golden: DataFrame) -> DataFrame:
    """Ids of conversations with at least one golden message."""
    numbers = _both_numbers(flat, golden, "tweet_id")
    held = golden.select(_id("tweet_id", numbers).alias("_held")).distinct()
    return (
        flat.select("conversation_id", _id("tweet_id", numbers).alias("_id"))
        .join(held, F.col("_id") == F.col("_held"), "left_semi")
        .select("conversation_id")
        .distinct()
    )


def holdout_conversations(flat: DataFrame, golden: DataFrame) -> DataFrame:
    """Rows of conversations without any golden message."""
    held = golden_conversations(flat, golden).select(F.col("conversation_id").alias("_conv"))
    return lookup(flat, held, "conversation_id", "_conv", "left_anti")


def resolution_pairs(flat: DataFrame) -> DataFrame:
    """A customer message and the brand message right after it, both with text.

    ``flat`` has one row per message with conversation_id and pos, which may have gaps: rows that were
    filtered out before do not part their neighbours.
    """
    pairs = with_neighbours(flat, "conversation_id", "pos", ["inbound", "text", "tweet_id"])
    return pairs.where(F.col("inbound") & ~F.col("next_inbound")).where(
        has_text("text") & has_text("next_text")
    ).select(
        "conversation_id",
        F.col("tweet_id").alias("customer_tweet_id"),
        F.col("next_tweet_id").alias("agent_tweet_id"),
        strip("text").alias("customer_message"),
        strip("next_text").alias("historical_response"),
    )
