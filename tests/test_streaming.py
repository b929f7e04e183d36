"""Routing of a file stream equals routing of the same rows as a batch."""

from pyspark.sql import functions as F

from replyloom.functions import prompts
from replyloom.functions.lexicon import Lexicon, add_candidate, infer_class, label_weakly, match_lexicon
from replyloom.functions.routing import route
from replyloom.operators.aggregates import discovery_tokens
from replyloom.operators.annotations import validate_annotations, validate_judgements
from replyloom.streaming.routing import read_message_stream, route_stream, start_routing

SCHEMA = "tweet_id int, customer_message string, confidence double, top_similarity double"
ROWS = [(1, "this is fraud", 0.9, 0.9), (2, "late parcel", 0.9, 0.9), (3, "late parcel", 0.2, 0.3),
        (4, "thanks", 0.1, None)]


def test_stream_equals_batch(spark, tmp_path):
    lexicon = Lexicon({"ship": ["late", "parcel"]})
    rows = spark.createDataFrame(ROWS, SCHEMA)
    rows.write.parquet(str(tmp_path / "in"))
    stream = route_stream(read_message_stream(spark, str(tmp_path / "in"), SCHEMA), lexicon)
    assert stream.isStreaming
    start_routing(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    batch = route(add_candidate(rows, "customer_message", lexicon, "intent", "score"), similarity="top_similarity")
    key = ["tweet_id", "intent", "decision"]
    got = spark.read.parquet(str(tmp_path / "out")).select(key).orderBy("tweet_id").collect()
    assert got == batch.select(key).orderBy("tweet_id").collect()
    assert [r["decision"]["rule"] for r in got] == ["high_risk", "auto", "low_both", "other_positive"]


def test_stateless_operators_run_on_streams(spark, tmp_path):
    """Labels, tokens, prompts and record checks of a stream equal those of the batch."""
    lexicon = Lexicon({"ship": ["late", "parcel"], "pay": ["fraud"]})
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "in"))

    def work(df):
        df = match_lexicon(df, "customer_message", lexicon)
        df = label_weakly(df, "customer_message", lexicon, ["thanks"])
        df = infer_class(df, "customer_message", lexicon)
        df = discovery_tokens(df, "customer_message")
        df = df.withColumn("prompt", prompts.label_prompt(
            F.col("customer_message"), F.col("inferred"), {"ship": "x"}))
        df = df.withColumn("raw", F.format_string(
            '{"intent": "%s", "escalation": false, "confidence": 80, "reason": "r"}', "inferred"))
        df = validate_annotations(
            df.withColumnRenamed("intent", "label"), "raw", "inferred", ["ship", "pay"])
        return validate_judgements(df.withColumnRenamed("error", "e").drop("reason"), "raw")

    stream = work(read_message_stream(spark, str(tmp_path / "in"), SCHEMA))
    start_routing(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    batch = work(spark.read.parquet(str(tmp_path / "in")))
    got = spark.read.parquet(str(tmp_path / "out")).select(batch.columns)
    assert sorted(got.collect(), key=str) == sorted(batch.collect(), key=str)
    assert got.where("e is null").count() == 3
