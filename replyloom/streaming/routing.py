"""Routing of messages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from replyloom.functions.lexicon import Lexicon, add_candidate
from replyloom.functions.routing import RoutingRules, route


def read_message_stream(spark: SparkSession, path: str, schema: str,
                        files_per_trigger: int = 1_000) -> DataFrame:
    """New parquet files of a folder as a stream of messages."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def route_stream(messages: DataFrame, lexicon: Lexicon, rules: RoutingRules | None = None,
                 message: str = "customer_message", similarity: str = "top_similarity") -> DataFrame:
    """The same candidate class and routing decision as on a batch frame; keeps no state."""
    scored = add_candidate(messages, message, lexicon, "intent", "score")
    return route(scored, message, "intent", "confidence", similarity=similarity, rules=rules)


def start_routing(routed: DataFrame, path: str, checkpoint: str,
                  available_now: bool = True) -> StreamingQuery:
    """Append the decisions to a parquet folder, each input row exactly once."""
    writer = (
        routed.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
