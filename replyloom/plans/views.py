"""Support-shaped views over the test tables; each query reads whole tables through them."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom import fixed_values as fixed
from replyloom.functions.lexicon import Lexicon, add_candidate, infer_class
from replyloom.operators.features import add_terms
from replyloom.operators.sampling import sample_per_class
from replyloom.operators.spread import with_neighbours

LEXICON = Lexicon(
    {
        "c_en": ["the", "and", "that is"],
        "c_de": ["der ", "und ", "eine"],
        "c_fr": ["que ", "les ", "ment"],
        "c_es": ["los ", "cion", "ción", "para"],
    }
)
CLASSES = [*LEXICON.classes, "other"]
OTHER_PHRASES = ["tion", "es"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a tweet table: each turn answers the turn before it."""
    turns = (
        table(spark, sf_dir, "conversations")
        .where(F.col("role") != "system")
        .select(
            "conv_id",
            "turn",
            (F.col("conv_id") * 1000 + F.col("turn")).alias("tweet_id"),
            F.when(F.col("role") == "user", F.concat(F.lit("cust_"), F.col("conv_id")))
            .otherwise(F.lit("brand"))
            .alias("author_id"),
            (F.col("role") == "user").alias("inbound"),
            "text",
        )
    )
    linked = with_neighbours(turns, "conv_id", "turn", ["tweet_id"], "after_", "before_")
    return linked.select(
        "conv_id", "turn", "tweet_id", "author_id", "inbound", "text",
        F.col("before_tweet_id").alias("in_response_to_tweet_id"),
        F.col("after_tweet_id").cast("string").alias("response_tweet_id"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer messages: (tweet_id, conv_id, text)."""
    return (
        table(spark, sf_dir, "conversations")
        .where(F.col("role") == "user")
        .select((F.col("conv_id") * 1000 + F.col("turn")).alias("tweet_id"), "conv_id", "text")
    )


def reply_tree(spark: SparkSession, sf_dir: str, brands: bool = False) -> DataFrame:
    """Events as a reply tree in which event n answers event n // 2."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("event_id") + 1).scalar()
    is_brand = F.col("event_type").isin("view", "click")
    own = F.concat(F.lit("brand_"), F.col("event_type")) if brands else F.lit("brand")
    tweet_id = F.col("event_id") + 1
    children = F.filter(F.array(tweet_id * 2, tweet_id * 2 + 1), lambda c: c <= F.col("last"))
    return events.withColumn("last", last).select(
        tweet_id.alias("tweet_id"),
        F.when(is_brand, own)
        .otherwise(F.concat(F.lit("cust_"), F.col("user_id") % 7))
        .alias("author_id"),
        (~is_brand).alias("inbound"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.concat_ws(" ", "event_type", "props").alias("text"),
        F.when(F.size(children) > 0, F.array_join(children, ",")).alias("response_tweet_id"),
        F.when(tweet_id > 1, F.floor(tweet_id / 2)).alias("in_response_to_tweet_id"),
    )


def reply_tree_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reply tree with two brands."""
    return reply_tree(spark, sf_dir, brands=True)


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as flat rows (conversation_id, pos, ...)."""
    return tweets(spark, sf_dir).withColumns(
        {"conversation_id": F.col("conv_id"), "pos": F.col("turn")}
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer messages with their candidate class."""
    return add_candidate(messages(spark, sf_dir), "text", LEXICON)


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five messages of each candidate class."""
    return sample_per_class(scored(spark, sf_dir), "candidate_intent", 5)


def _pick(k, values: dict, default=None):
    """CASE over a remainder; the values are columns or text."""
    out = None
    for key, value in values.items():
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(k == key, value) if out is None else out.when(k == key, value)
    if default is None:
        return out
    return out.otherwise(F.lit(default) if isinstance(default, str) else default)


def _variant(df: DataFrame) -> DataFrame:
    """Add k, a number that runs through every remainder."""
    return df.withColumn("k", F.floor(F.col("tweet_id") / 1000) * 7 + F.col("tweet_id") % 1000)


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customer messages as an annotation sheet in every state a sheet may be in."""
    k, candidate = F.col("k"), F.col("candidate_intent")
    return _variant(scored(spark, sf_dir)).select(
        "tweet_id",
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.col("text").alias("customer_message"),
        (F.col("tweet_id") % 1000 + 1).alias("turn_count"),
        "candidate_intent",
        "k",
        _pick(k % 5, {0: "", 1: candidate, 2: "c_en", 3: F.concat(F.lit(" "), candidate)}, "other")
        .alias("ai_intent"),
        _pick(k % 6, {0: "", 1: "true", 2: "False", 3: "yes", 4: "0"}).alias("ai_escalation"),
        _pick(k % 11, {0: "n/a", 5: ""}, (k * 37 % 101).cast("string")).alias("ai_confidence"),
        F.concat(F.lit("r"), (k % 3).cast("string")).alias("ai_reason"),
        F.lit("stub").alias("ai_source"),
        _pick(k % 3, {0: "true", 1: "false"}, "").alias("ai_disagrees_with_candidate"),
        _pick(k % 2, {0: "true"}, "False").alias("ai_low_confidence"),
        _pick(F.floor(k / 2) % 4, {0: "", 1: "human_reviewed", 2: "ai_bulk_accepted"}, "ai_suggested")
        .alias("annotation_status"),
        _pick(k % 4, {0: "", 1: candidate, 2: "c_de"}).alias("gold_intent"),
        _pick(k % 7, {0: "true", 1: "false", 2: "", 3: "TRUE ", 4: "no", 5: "1"})
        .alias("expected_escalation"),
        _pick(k % 9, {0: fixed.BULK_NOTE, 1: "checked by hand"}, "").alias("annotation_notes"),
    )


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a labelling model may answer per message, good and bad."""
    k = F.col("k")
    good = F.concat(
        F.lit('{"intent": "'), "candidate_intent", F.lit('", "escalation": false, "confidence": '),
        (k % 101).cast("string"), F.lit(', "reason": "about '), "conversation_id", F.lit('"}'),
    )
    raw = _pick(
        k % 11,
        {
            0: good,
            1: 'Here it is: {"intent": "c_de", "escalation": "yes", "confidence": "65", '
               '"reason": " ok "} done',
            2: '```json\n{"intent": "other", "escalation": true, "confidence": 99.7, "reason": "x"}\n```',
            3: '{"intent": "other", "confidence": 5}',
            4: '{"intent": "nonsense", "escalation": true, "confidence": 50, "reason": "x"}',
            5: '{"intent": "other", "escalation": true, "confidence": 101, "reason": "x"}',
            6: "no answer",
            7: '{"intent": "other", "escalation": "maybe", "confidence": 50, "reason": "x"}',
            8: '{"intent": "other", "escalation": 1, "confidence": "fifty", "reason": "x"}',
            9: '{"intent": "c_en", "escalation": "N", "confidence": "6x", "reason": "x"}',
        },
        '{"intent": "c_fr", "escalation": "0", "confidence": 70, "reason": "  "}',
    )
    return annotated(spark, sf_dir).select(
        "tweet_id", "k", "candidate_intent", "customer_message", raw.alias("raw")
    )


def raw_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scoring model may answer per message, good and bad."""
    k = F.col("k")
    first = F.concat(
        F.lit('{"grounding": '), (1 + k % 5).cast("string"),
        F.lit(', "resolution_correctness": 2, "relevance": 3, "safety": 4, "style": 5, "overall": '),
        (1 + k % 4).cast("string"), F.lit(', "reason": "fine"}'),
    )
    second = F.concat(
        F.lit('```json\n{"grounding": 1, "resolution_correctness": '), (1 + k % 5).cast("string"),
        F.lit(', "relevance": 1, "safety": 1, "style": 1, "overall": 1, "reason": "bad"}\n```'),
    )
    raw = _pick(
        k % 6,
        {
            0: first,
            1: second,
            2: '{"grounding": 1, "resolution_correctness": 2, "relevance": 3, "safety": 4, '
               '"style": 5, "reason": "x"}',
            3: '{"grounding": 1, "resolution_correctness": 2, "relevance": 7, "safety": 4, '
               '"style": 5, "overall": 3, "reason": "x"}',
            4: 'Scores: {"grounding": 4, "resolution_correctness": 4, "relevance": 4, "safety": 4, '
               '"style": 4, "overall": 4, "reason": "ok"} end',
        },
        '{"grounding": 1, "resolution_correctness": 2.5, "relevance": 3, "safety": 4, "style": 5, '
        '"overall": 3, "reason": "x"}',
    )
    return annotated(spark, sf_dir).select("tweet_id", "k", raw.alias("raw"))


def documents_with_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return infer_class(docs, "text", LEXICON)


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as evaluated examples."""
    confidence = F.col("doc_id") * 37 % 101
    labelled = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(
        table(spark, sf_dir, "labels"), "doc_id"
    )
    return (
        infer_class(labelled, "text", LEXICON)
        .select(
            "doc_id",
            F.col("text").alias("customer_message"),
            F.concat(F.lit("c_"), "lang").alias("gold_intent"),
            F.col("inferred").alias("predicted_intent"),
            (confidence / 100).alias("confidence"),
            (confidence / 200).alias("confidence_margin"),
            (F.col("toxic") == 1).alias("expected_escalation"),
            (F.col("quality") == 0).alias("predicted_escalation"),
        )
    )


def human_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        *[(1 + (F.col("doc_id") + d) % 5).alias(n) for d, n in enumerate(fixed.SCORE_DIMENSIONS)],
    )


def judge_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the other rater; every 13th judgement failed."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        *[
            F.when(doc % 13 != 0, 1 + (doc * 7 + F.floor(doc / 3) + d) % 5).alias(n)
            for d, n in enumerate(fixed.SCORE_DIMENSIONS)
        ],
        F.when(doc % 13 == 0, F.lit("no answer")).alias("error"),
    )


def vectors(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias(key), F.col("embedding").alias("vector")
    )


def routing_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _variant(scored(spark, sf_dir)).select(
        "tweet_id",
        F.col("text").alias("customer_message"),
        F.col("candidate_intent").alias("intent"),
        "k",
        (k * 37 % 101 / 100).alias("confidence"),
        F.when(k % 9 != 0, k * 53 % 101 / 100).alias("top_similarity"),
    )


def message_vectors(df: DataFrame, text: str, dims: int = 256) -> DataFrame:
    """Add ``embedding``: hashed word counts of a text, standing in for an encoder's column."""
    hasher = HashingTF(inputCol="_words", outputCol="_hashed", numFeatures=dims)
    hashed = hasher.transform(add_terms(df, text, "_words", (1,)))
    return hashed.withColumn("embedding", vector_to_array("_hashed")).drop("_words", "_hashed")
