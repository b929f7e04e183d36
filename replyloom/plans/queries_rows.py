"""Sources, filters, counts and samples."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from replyloom.functions import text as tx
from replyloom.functions.lexicon import label_weakly
from replyloom.operators import aggregates, messages, sampling
from replyloom.operators.corpus import (
    golden_conversations, holdout_conversations, holdout_rows, resolution_pairs,
)
from replyloom.plans import views
from replyloom.plans.jobs import build_golden_set, build_training_set
from replyloom.plans.oracle import hash_order, strip
from replyloom.plans.registry import query
from replyloom.session import ensure_checkpoint_dir
from replyloom.sources.quoted_csv import read_quoted_csv
from replyloom.sources.tables import scan

QUOTAS = {"c_en": 12, "c_de": 4, "c_fr": 4, "c_es": 2, "other": 1}


@query("scan_project_limit", """
    SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 100""")
def _(spark, d):
    return scan(views.table(spark, d, "conversations"), ["conv_id", "turn", "role"], 100,
                ["conv_id", "turn"])


@query("quoted_csv_scan", """
    SELECT doc_id, replace(text, ' ', ',"' || chr(10)) AS text, CAST(n_chars AS BIGINT) AS n_chars FROM documents""")
def _(spark, d):
    """Documents written as CSV with a quote and a line break in place of each space, and read back."""
    folder = f"{ensure_checkpoint_dir(spark)}/csv-{uuid4().hex}"
    rows = views.table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(" "), F.lit(',"\n')).alias("text"), "n_chars")
    rows.write.options(
        header=True, escape='"', nullValue="", emptyValue='""', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(folder)
    return read_quoted_csv(spark, folder, "doc_id bigint, text string, n_chars bigint")


@query("sample_head", "SELECT tweet_id, author_id, inbound, text FROM tweets ORDER BY tweet_id LIMIT 10")
def _(spark, d):
    return scan(views.tweets(spark, d), ["tweet_id", "author_id", "inbound", "text"], 10, ["tweet_id"])


@query("null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS rows, "
    f"count(*) FILTER ({c} IS NULL) AS nulls FROM tweets"
    for c, t in [("tweet_id", "bigint"), ("author_id", "string"), ("inbound", "boolean"),
                 ("text", "string"), ("in_response_to_tweet_id", "bigint"),
                 ("response_tweet_id", "string")]))
def _(spark, d):
    return aggregates.null_profile(
        views.tweets(spark, d),
        ["tweet_id", "author_id", "inbound", "text", "in_response_to_tweet_id", "response_tweet_id"],
    )


@query("filter_inbound", "SELECT tweet_id, author_id FROM tweets WHERE inbound")
def _(spark, d):
    return messages.inbound_rows(views.tweets(spark, d)).select("tweet_id", "author_id")


@query("filter_outbound", "SELECT tweet_id, author_id FROM tweets WHERE NOT inbound")
def _(spark, d):
    return messages.inbound_rows(views.tweets(spark, d), False).select("tweet_id", "author_id")


@query("filter_nonblank", f"SELECT page_id, length(html) AS n FROM pages WHERE length({strip('html')}) > 0")
def _(spark, d):
    pages = views.table(spark, d, "pages")
    return messages.rows_with_text(pages, "html", True).select(
        "page_id", F.length("html").cast("bigint").alias("n"))


@query("filter_minlen", f"""
    SELECT doc_id, CAST(length({strip('text')}) AS BIGINT) AS n FROM documents
    WHERE length({strip('text')}) >= 40""")
def _(spark, d):
    docs = views.table(spark, d, "documents")
    return messages.rows_with_min_length(docs, "text", 40, True).select(
        "doc_id", F.length(tx.strip("text", True)).cast("bigint").alias("n"))


@query("drop_null_pairs", """
    SELECT tweet_id, intent FROM weak_labels WHERE text IS NOT NULL AND intent IS NOT NULL""")
def _(spark, d):
    labelled = label_weakly(views.messages(spark, d), "text", views.LEXICON, views.OTHER_PHRASES,
                            ascii_only=True)
    return messages.drop_null_pairs(labelled).select("tweet_id", "intent")


@query("blind_project", """
    SELECT tweet_id, customer_message, turn_count, '' AS gold_intent, '' AS expected_escalation,
           '' AS annotation_note FROM annotated""")
def _(spark, d):
    return messages.blind_sheet(views.annotated(spark, d))


@query("review_sheet", """
    SELECT doc_id AS tweet_id, text AS customer_message, lang AS response, '' AS grounding,
           '' AS resolution_correctness, '' AS relevance, '' AS safety, '' AS style, '' AS overall,
           '' AS human_note FROM documents""")
def _(spark, d):
    docs = views.table(spark, d, "documents")
    return messages.review_sheet(docs.select(
        F.col("doc_id").alias("tweet_id"), F.col("text").alias("customer_message"),
        F.col("lang").alias("response")))


# --- holdouts and resolution pairs ------------------------------------------------------------

PAIRS = """
    SELECT conv_id AS conversation_id, tweet_id AS customer_tweet_id, CAST(response_tweet_id AS BIGINT) AS agent_tweet_id,
           {m} AS customer_message, {r} AS historical_response
    FROM tweets WHERE inbound AND NOT after_inbound
      AND length({m}) > 0 AND length({r}) > 0""".format(m=strip("text"), r=strip("after_text"))


@query("resolution_pairs_gaps", PAIRS.replace("FROM tweets", "FROM gappy"))
def _(spark, d):
    return resolution_pairs(views.flat(spark, d).where("turn % 3 <> 0"))


@query("resolution_pairs", PAIRS)
def _(spark, d):
    return resolution_pairs(views.flat(spark, d))


@query("holdout_rows", """
    SELECT tweet_id, conv_id FROM messages WHERE tweet_id NOT IN (SELECT tweet_id FROM golden)""")
def _(spark, d):
    return holdout_rows(views.messages(spark, d), views.golden(spark, d)).select("tweet_id", "conv_id")


@query("holdout_conversations", """
    SELECT conv_id AS conversation_id, tweet_id FROM tweets
    WHERE conv_id NOT IN (SELECT conv_id FROM golden)""")
def _(spark, d):
    return holdout_conversations(views.flat(spark, d), views.golden(spark, d)).select(
        "conversation_id", "tweet_id")


@query("excluded_conversations", "SELECT count(DISTINCT conv_id) AS excluded FROM golden")
def _(spark, d):
    return golden_conversations(views.flat(spark, d), views.golden(spark, d)).agg(
        F.count(F.lit(1)).alias("excluded"))


# --- counts ---------------------------------------------------------------------------------

@query("value_counts", f"""
    SELECT coalesce(nullif({strip('gold_intent')}, ''), 'unset') AS value, count(*) AS n
    FROM annotated GROUP BY 1""")
def _(spark, d):
    return aggregates.value_counts(views.annotated(spark, d), "gold_intent")


@query("distinct_classes", "SELECT count(DISTINCT intent) AS n_classes FROM weak_labels")
def _(spark, d):
    labelled = label_weakly(views.messages(spark, d), "text", views.LEXICON, views.OTHER_PHRASES,
                            ascii_only=True)
    return aggregates.distinct_count(labelled, "intent")


@query("dedup_text", """
    SELECT doc_id, text, source FROM documents
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def _(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", "text", "source")
    return aggregates.dedup_text(docs, "text", "doc_id")


def _ngram_sql(n: int) -> str:
    words = " || ' ' || ".join(f"tokens[i + {j}]" for j in range(n))
    return f"""
        SELECT {n} AS size, unnest(list_transform(range(1, len(tokens) - {n - 2}), lambda i: {words})) AS term
        FROM tokenized"""


def _top_ngrams_sql(sizes, keep_size=True) -> str:
    runs = " UNION ALL ".join(_ngram_sql(n) for n in sizes)
    size = "CAST(size AS BIGINT) AS size, " if keep_size else ""
    return f"""
        SELECT {size}term, n FROM (SELECT size, term, count(*) AS n FROM ({runs}) GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY size ORDER BY n DESC, term) <= 100"""


@query("top_terms", _top_ngrams_sql([1], False))
def _(spark, d):
    tokenized = aggregates.discovery_tokens(views.messages(spark, d), ascii_only=True)
    return aggregates.top_ngrams(tokenized, [1]).select("term", "n")


@query("top_phrases", _top_ngrams_sql([2, 3]))
def _(spark, d):
    tokenized = aggregates.discovery_tokens(views.messages(spark, d), ascii_only=True)
    return aggregates.top_ngrams(tokenized, [2, 3]).withColumn("size", F.col("size").cast("bigint"))


@query("discovery_counts", """
    SELECT count(DISTINCT conv_id) AS conversations, count(*) FILTER (len(tokens) > 0) AS messages
    FROM tokenized""")
def _(spark, d):
    return aggregates.discovery_counts(views.messages(spark, d), "conv_id", "text", True)


# --- samples ----------------------------------------------------------------------------------

@query("sample_n", f"SELECT tweet_id, text FROM messages ORDER BY {hash_order('tweet_id')} LIMIT 500")
def _(spark, d):
    return sampling.sample_rows(views.messages(spark, d)).select("tweet_id", "text")


@query("candidates_per_class", f"""
    SELECT tweet_id, candidate_intent, keyword_score FROM candidates
    QUALIFY row_number() OVER (PARTITION BY candidate_intent ORDER BY {hash_order('tweet_id')}) <= 40""")
def _(spark, d):
    return sampling.sample_per_class(views.scored(spark, d), "candidate_intent").select(
        "tweet_id", "candidate_intent", F.col("keyword_score").cast("bigint").alias("keyword_score"))


@query("quota_sample", f"""
    SELECT tweet_id, candidate_intent FROM candidates
    JOIN (VALUES {', '.join(f"('{c}', {n})" for c, n in QUOTAS.items())}) AS q(class, quota)
      ON class = candidate_intent
    QUALIFY row_number() OVER (PARTITION BY candidate_intent ORDER BY {hash_order('tweet_id')}) <= quota""")
def _(spark, d):
    return sampling.sample_quotas(views.scored(spark, d), QUOTAS, check=False).select(
        "tweet_id", "candidate_intent")


@query("quota_shortage", """
    SELECT class, CAST(needed AS BIGINT) AS needed, coalesce(found, 0) AS found
    FROM (VALUES ('c_en', 1000000), ('c_de', 1), ('missing', 3)) AS q(class, needed)
    LEFT JOIN (SELECT candidate_intent, count(*) AS found FROM candidates GROUP BY 1) ON candidate_intent = class
    WHERE coalesce(found, 0) < needed""")
def _(spark, d):
    return sampling.quota_shortage(
        views.scored(spark, d), {"c_en": 1000000, "c_de": 1, "missing": 3}, "candidate_intent")


@query("class_cap", f"""
    SELECT tweet_id, candidate_intent FROM candidates
    QUALIFY row_number() OVER (PARTITION BY candidate_intent ORDER BY {hash_order('tweet_id')}) <= 5000""")
def _(spark, d):
    return sampling.cap_classes(views.scored(spark, d), label="candidate_intent").select(
        "tweet_id", "candidate_intent")


@query("cap_other", f"""
    SELECT tweet_id, candidate_intent FROM candidates WHERE candidate_intent <> 'c_en'
    UNION ALL
    (SELECT tweet_id, candidate_intent FROM candidates WHERE candidate_intent = 'c_en'
     ORDER BY {hash_order('tweet_id')} LIMIT 20)""")
def _(spark, d):
    return sampling.cap_one_class(
        views.scored(spark, d), 20, "c_en", "candidate_intent").select("tweet_id", "candidate_intent")


@query("shuffle_pos", f"""
    SELECT tweet_id, row_number() OVER (ORDER BY {hash_order('tweet_id')}) AS shuffle_pos FROM messages""")
def _(spark, d):
    return sampling.shuffle_positions(views.messages(spark, d)).select("tweet_id", "shuffle_pos")


@query("stratified_folds", f"""
    SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY {hash_order('doc_id')}) - 1) % 5 AS fold
    FROM documents""")
def _(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", "lang")
    return sampling.assign_folds(docs, "lang", 5, "doc_id")


@query("lowest_confidence", """
    SELECT doc_id, gold_intent, predicted_intent, confidence FROM preds ORDER BY confidence, doc_id LIMIT 10""")
def _(spark, d):
    return sampling.lowest_confidence(views.preds(spark, d), 10, "doc_id").select(
        "doc_id", "gold_intent", "predicted_intent", "confidence")


@query("top2_margin", """
    WITH ranked AS (
        SELECT vec_id, i, round(e * e, 6) AS p,
               row_number() OVER (PARTITION BY vec_id ORDER BY e * e DESC, i DESC) AS r
        FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, unnest(range(len(embedding))) AS i FROM embeddings))
    SELECT a.vec_id, 'd' || a.i AS predicted_intent, a.p AS confidence, 'd' || b.i AS second_intent,
           b.p AS second_confidence
    FROM ranked a JOIN ranked b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2""")
def _(spark, d):
    squared = views.table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("p"))
    two = sampling.top_two(squared, "p", [f"d{i}" for i in range(64)])
    return two.select("vec_id", "predicted_intent", F.round("confidence", 6).alias("confidence"),
                      "second_intent", F.round("second_confidence", 6).alias("second_confidence"))


@query("union_buckets", """
    SELECT 'message' AS bucket, tweet_id AS id, text FROM messages
    UNION ALL SELECT 'document', doc_id, text FROM documents""")
def _(spark, d):
    docs = views.table(spark, d, "documents")
    first = views.messages(spark, d).select(
        F.lit("message").alias("bucket"), F.col("tweet_id").alias("id"), "text")
    return first.unionByName(
        docs.select(F.lit("document").alias("bucket"), F.col("doc_id").alias("id"), "text"))


@query("build_golden_set", f"""
    SELECT row_number() OVER (ORDER BY {hash_order('tweet_id')}) AS shuffle_pos, tweet_id, conversation_id,
           candidate_intent, '' AS gold_intent FROM (
        SELECT tweet_id, conversation_id, candidate_intent, quota FROM annotated
        JOIN (VALUES {', '.join(f"('{c}', {n})" for c, n in QUOTAS.items())}) AS q(class, quota)
          ON class = candidate_intent
        QUALIFY row_number() OVER (PARTITION BY candidate_intent ORDER BY {hash_order('tweet_id')}) <= quota)""")
def _(spark, d):
    candidates = sampling.sample_per_class(views.annotated(spark, d), "candidate_intent")
    golden = build_golden_set(candidates, QUOTAS, check=False)
    return golden.select("shuffle_pos", "tweet_id", "conversation_id", "candidate_intent", "gold_intent")


# --- training set -------------------------------------------------------------------------------

@query("build_training_set", f"""
    SELECT tweet_id, text, intent FROM (
        SELECT * FROM weak_labels WHERE intent IS NOT NULL AND length({strip('text')}) > 0
          AND tweet_id NOT IN (SELECT tweet_id FROM golden)
        QUALIFY intent <> 'other'
             OR row_number() OVER (PARTITION BY intent ORDER BY {hash_order('tweet_id')}) <= 3)
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY tweet_id) = 1""")
def _(spark, d):
    return build_training_set(views.tweets(spark, d), views.golden(spark, d), views.LEXICON,
                              views.OTHER_PHRASES, 3, ascii_only=True)


