"""Table schemas and the checks that run before a job is started."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TWEETS = T.StructType(
    [
        T.StructField("tweet_id", T.LongType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("inbound", T.BooleanType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("response_tweet_id", T.StringType()),
        T.StructField("in_response_to_tweet_id", T.StringType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("tweet_id", T.LongType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("inbound", T.BooleanType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

CONVERSATIONS = T.StructType(
    [
        T.StructField("conversation_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("turn_count", T.LongType()),
    ]
)

EVIDENCE = (
    "array<struct<conversation_id:string,customer_tweet_id:bigint,agent_tweet_id:bigint,"
    "customer_message:string,historical_response:string,similarity:double>>"
)

EVALUATED = (
    "tweet_id bigint, customer_message string, gold_intent string, predicted_intent string, "
    "confidence double, expected_escalation boolean, predicted_escalation boolean, "
    f"escalation_reason string, response string, evidence {EVIDENCE}"
)

ANNOTATION_COLUMNS = [
    "ai_intent",
    "ai_escalation",
    "ai_confidence",
    "ai_reason",
    "ai_source",
    "ai_disagrees_with_candidate",
    "ai_low_confidence",
    "annotation_status",
    "gold_intent",
    "expected_escalation",
    "annotation_notes",
]


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail while the plan is built, before any job runs, if columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError("Missing required columns: " + ", ".join(missing))
    return df


def require_rows(df: DataFrame, exactly: int | None = None, at_least: int = 1) -> DataFrame:
    """Fail unless the row count is ``exactly`` n, or not below ``at_least``.

    At most one row more than the bound is looked at, so a huge table costs nothing.
    """
    bound = at_least if exactly is None else exactly + 1
    found = df.limit(bound).count()
    if exactly is not None and found != exactly:
        raise ValueError(f"Expected exactly {exactly} rows, found {'more' if found > exactly else found}")
    if exactly is None and found < at_least:
        raise ValueError(f"Expected at least {at_least} rows, found {found}")
    return df


def with_missing_columns(df: DataFrame, columns: Iterable[str], default: str | None = None) -> DataFrame:
    """Add each absent column with a default; present columns stay untouched."""
    return df.withColumns(
        {c: F.lit(default).cast("string") for c in columns if c not in df.columns}
    )
