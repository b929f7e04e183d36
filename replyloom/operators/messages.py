"""Projections and filters over tweet and message rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom import fixed_values as fixed
from replyloom.functions.text import has_text, strip
from replyloom.schema import require_columns


def inbound_rows(df: DataFrame, inbound: bool = True) -> DataFrame:
    return df.where(F.col("inbound") if inbound else ~F.col("inbound"))


def rows_with_text(df: DataFrame, column: str = "text", ascii_only: bool = False) -> DataFrame:
    return df.where(has_text(column, ascii_only))


def rows_with_min_length(df: DataFrame, column: str = "text", n: int = 10,
                         ascii_only: bool = False) -> DataFrame:
    return df.where(F.length(strip(column, ascii_only)) >= n)


def drop_null_pairs(df: DataFrame, columns: Sequence[str] = ("text", "intent")) -> DataFrame:
    return df.dropna(subset=list(columns))


def flatten_messages(conversations: DataFrame) -> DataFrame:
    """One row per non-blank customer message with its conversation's id and length."""
    return (
        conversations.select(
            "conversation_id",
            "turn_count",
            F.posexplode("messages").alias("pos", "message"),
        )
        .where(F.coalesce(F.col("message.inbound"), F.lit(False)))
        .where(has_text("message.text"))
        .select(
            "conversation_id",
            F.col("message.tweet_id").alias("tweet_id"),
            F.col("message.created_at").alias("created_at"),
            strip("message.text").alias("customer_message"),
            F.coalesce("turn_count", F.lit(1)).alias("turn_count"),
        )
    )


def blind_sheet(golden: DataFrame) -> DataFrame:
    """What a human annotator may see, with empty label columns."""
    seen = ["tweet_id", "customer_message", "turn_count"]
    empty = ["gold_intent", "expected_escalation", "annotation_note"]
    require_columns(golden, seen)
    return golden.select(*seen, *[F.lit("").alias(c) for c in empty])


def review_sheet(examples: DataFrame,
                 dimensions: Sequence[str] = tuple(fixed.SCORE_DIMENSIONS)) -> DataFrame:
    """Replies to be scored by hand, with empty score columns."""
    seen = ["tweet_id", "customer_message", "response"]
    require_columns(examples, seen)
    return examples.select(*seen, *[F.lit("").alias(c) for c in [*dimensions, "human_note"]])


def add_failure_flags(examples: DataFrame) -> DataFrame:
    """Class failure, routing failure and reply length per evaluated example."""
    return examples.withColumns(
        {
            "intent_failure": ~F.col("gold_intent").eqNullSafe(F.col("predicted_intent")),
            "escalation_failure": ~F.col("expected_escalation").eqNullSafe(
                F.col("predicted_escalation")
            ),
            "response_length": F.length("response").cast("bigint"),
        }
    )
