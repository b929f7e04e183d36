"""Which rows belong to which brand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.functions.text import parse_reply_ids
from replyloom.operators.spread import first_per_key, lookup


def brand_rows(tweets: DataFrame, brands: Sequence[str] | None = None) -> DataFrame:
    """(tweet_id, brand) of outbound rows, once per tweet."""
    out = tweets.where(~F.col("inbound"))
    if brands is not None:
        out = out.where(F.col("author_id").isin(list(brands)))
    return out.groupBy("tweet_id").agg(F.min("author_id").alias("brand"))


def linked_brands(tweets: DataFrame, brands: Sequence[str] | None = None,
                  inbound_only: bool = True) -> DataFrame:
    """(tweet_id, brand), once each: the row answers the brand or lists an answer of the brand."""
    owners = brand_rows(tweets, brands)
    rows = tweets.where("inbound") if inbound_only else tweets
    others = F.array_append(
        parse_reply_ids("response_tweet_id"), F.col("in_response_to_tweet_id").cast("bigint")
    )
    links = rows.select("tweet_id", F.explode_outer(others).alias("other_id")).where(
        F.col("other_id").isNotNull()
    )
    return (
        lookup(links, owners.withColumnRenamed("tweet_id", "owner_id"), "other_id", "owner_id")
        .select("tweet_id", "brand")
        .distinct()
    )


def brand_volume(tweets: DataFrame) -> DataFrame:
    """Inbound, outbound and total rows per brand; brands nobody wrote to are kept with 0."""
    outbound = (
        tweets.where(~F.col("inbound"))
        .groupBy(F.col("author_id").alias("brand"))
        .agg(F.count(F.lit(1)).alias("outbound"))
    )
    inbound = linked_brands(tweets).groupBy("brand").agg(F.count(F.lit(1)).alias("inbound"))
    return (
        outbound.join(inbound, "brand", "left")
        .withColumn("inbound", F.coalesce("inbound", F.lit(0).cast("bigint")))
        .select("brand", "inbound", "outbound", (F.col("inbound") + F.col("outbound")).alias("total"))
    )


def top_brands(volume: DataFrame, n: int = 20) -> DataFrame:
    return volume.orderBy(F.desc("inbound"), F.desc("outbound"), "brand").limit(n)


def connected_rows(tweets: DataFrame, brands: Sequence[str]) -> DataFrame:
    """Rows written by, answering, or answered by each brand, once per (brand, tweet)."""
    own = tweets.where(~F.col("inbound") & F.col("author_id").isin(list(brands))).select(
        "tweet_id", F.col("author_id").alias("brand")
    )
    pairs = own.unionByName(linked_brands(tweets, brands, inbound_only=False)).distinct()
    # only rows that are connected are looked through for copies
    linked = tweets.join(pairs.select("tweet_id").distinct(), "tweet_id", "left_semi")
    unique = first_per_key(linked, ["tweet_id"], ["author_id"])
    return pairs.join(unique, "tweet_id")
