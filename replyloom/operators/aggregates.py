"""Counts and frequency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom import fixed_values as fixed
from replyloom.functions.columns import settle
from replyloom.functions.text import blank_to_null, ngrams, normalize_for_discovery, tokens
from replyloom.operators.spread import first_per_key, top_per_group


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, data_type, rows, nulls) in one pass over the table."""
    names = list(columns or df.columns)
    types = dict(df.dtypes)
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"),
                F.col(f"n{i}").alias("nulls"),
            )
            for i, c in enumerate(names)
        ]
    )
    return counted.select("rows", F.inline(entries)).select(
        "column_name", "data_type", "rows", "nulls"
    )


def value_counts(df: DataFrame, column: str, unset: str = "unset") -> DataFrame:
    """Rows per value; blank and NULL count as ``unset``."""
    value = F.coalesce(blank_to_null(F.col(column).cast("string")), F.lit(unset))
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("n_classes"))


def dedup_text(df: DataFrame, text: str = "text", order_by: str = "tweet_id") -> DataFrame:
    """One row per text, the first in order."""
    return first_per_key(df, [text], [order_by])


def discovery_tokens(messages: DataFrame, text: str = "text",
                     stopwords: Sequence[str] = tuple(fixed.STOPWORDS),
                     ascii_only: bool = False) -> DataFrame:
    """Add the token array of each message; messages without tokens are dropped."""
    clean = messages.withColumn("_clean", normalize_for_discovery(text, ascii_only))
    listed = settle(clean, {"tokens": tokens(F.col("_clean"), stopwords)})
    return listed.drop("_clean").where(F.size("tokens") > 0)


def top_ngrams(tokenized: DataFrame, sizes: Sequence[int] = (1, 2, 3),
               n: int = fixed.TOP_TERMS) -> DataFrame:
    """(size, term, n): the most frequent runs of each size, ties in term order."""
    def sized(size: int):
        return F.transform(
            ngrams("tokens", size), lambda t: F.struct(F.lit(size).alias("size"), t.alias("term"))
        )

    runs = F.flatten(F.array(*[sized(size) for size in sizes]))
    counted = (
        tokenized.select(F.inline_outer(runs))
        .where(F.col("term").isNotNull())
        .groupBy("size", "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_per_group(counted, ["size"], [F.desc("n"), F.col("term")], n, ["term"])


def discovery_counts(messages: DataFrame, conversation: str = "conversation_id",
                     text: str = "text", ascii_only: bool = False) -> DataFrame:
    """Conversations seen and customer messages that have at least one token."""
    clean = messages.withColumn("_clean", normalize_for_discovery(text, ascii_only))
    return clean.agg(
        F.countDistinct(conversation).alias("conversations"),
        F.count_if(F.size(tokens(F.col("_clean"))) > 0).alias("messages"),
    )
