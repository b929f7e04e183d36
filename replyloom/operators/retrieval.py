"""Exact top-k by cosine over unit vectors, and how well the retrieved rows fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replyloom.functions.lexicon import Lexicon, infer_class
from replyloom.functions.text import normalize_text
from replyloom.operators.cells import top_in_cells
from replyloom.operators.spread import lookup


def normalize_vectors(df: DataFrame, column: str) -> DataFrame:
    """Scale the vectors of a column to length one, as doubles; zero vectors stay as they are."""
    wide = F.col(column).cast("array<double>")
    squares = F.aggregate(wide, F.lit(0.0), lambda total, x: total + x * x)
    measured = df.withColumn("_length", F.sqrt(squares))
    # the length is a column of its own, not worked out again for each element
    length = F.col("_length")
    scaled = F.transform(wide, lambda x: F.when(length > 0, x / length).otherwise(x))
    return measured.withColumn(column, scaled).drop("_length")


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, exclude_self: bool = False,
          block_rows: int | None = None, scan_queries: int | None = None) -> DataFrame:
    """(query_id, corpus_id, similarity, rank): the ``k`` largest inner products of each query.

    ``queries`` has query_id and vector, ``corpus`` corpus_id and vector, ids unique, vectors of
    one length and unit norm; zero vectors may be among them, rows without vector are left out. Equal similarities
    (to 9 digits) rank by corpus id.

    The corpus is dealt to cells of near vectors, ``block_rows`` in a part at most (by default, 64 MB), and a query visits the
    parts of cells that can hold one of its best, whatever the sizes (see :mod:`cells`). ``scan_queries`` has no effect.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    queries, corpus = (
        df.select(name, "vector").where(F.col("vector").isNotNull()) for df, name in ((queries, "query_id"), (corpus, "corpus_id"))
    )
    found = top_in_cells(queries, corpus, k, exclude_self, block_rows)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "corpus_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint"))
    )


def attach_pairs(ranked: DataFrame, pairs: DataFrame, key: str = "customer_tweet_id") -> DataFrame:
    """Add the pair behind each retrieved id."""
    return lookup(ranked, pairs.withColumn("_key", F.col(key)), "corpus_id", "_key")


def nest_evidence(ranked: DataFrame) -> DataFrame:
    """(query_id, evidence): the retrieved pairs of each query, best first, at most k of them."""
    pair = F.struct(
        "rank", "conversation_id", "customer_tweet_id", "agent_tweet_id", "customer_message",
        "historical_response", "similarity",
    )
    return ranked.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(pair)), lambda p: p.dropFields("rank"))
        .alias("evidence")
    )


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, unknown: str,
                      ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Recall at each k, mean reciprocal rank, and how many queries met an ``unknown`` row.

    ``ranked`` has query_id, rank and inferred; ``gold`` has query_id and gold. Queries without a
    gold class are left out; a query without a match counts 0.
    """
    asked = gold.select("query_id", F.lower(normalize_text("gold")).alias("gold")).where(
        F.coalesce(F.col("gold"), F.lit("")) != ""
    )
    per_query = (
        asked.join(ranked.select("query_id", "rank", "inferred"), "query_id", "left")
        .groupBy("query_id")
        .agg(
            F.min(F.when(F.col("inferred") == F.col("gold"), F.col("rank"))).alias("hit"),
            F.max((F.coalesce(F.col("inferred") == unknown, F.lit(False))).cast("int")).alias("odd"),
        )
    )
    recalls = [
        F.avg(F.when(F.col("hit") <= n, 1.0).otherwise(0.0)).alias(f"recall_at_{n}") for n in ks
    ]
    return per_query.agg(
        F.count(F.lit(1)).alias("examples"),
        *recalls,
        F.avg(F.coalesce(1.0 / F.col("hit"), F.lit(0.0))).alias("mrr"),
        F.sum("odd").alias("examples_with_unknown"),
    )


def evaluate_retrieval(ranked_pairs: DataFrame, gold: DataFrame, lexicon: Lexicon,
                       unknown: str = "unknown") -> DataFrame:
    """Infer the class of each retrieved customer message, then :func:`retrieval_metrics`."""
    inferred = infer_class(ranked_pairs, "customer_message", lexicon, "inferred", unknown)
    return retrieval_metrics(inferred, gold, unknown)
