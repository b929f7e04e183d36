"""TF-IDF, classifiers, text models and whole evaluation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from replyloom.operators import features as ft
from replyloom.operators import metrics
from replyloom.operators.inference import annotate_with_retry, generate_replies
from replyloom.operators.models import TextClassifier, cross_validate
from replyloom.operators.retrieval import normalize_vectors
from replyloom.operators.sampling import top_two
from replyloom.plans import jobs, views
from replyloom.plans.registry import query

def _tfidf_sql(min_df: int, tf: str, limit: int | None) -> str:
    top = f"ORDER BY total DESC, term LIMIT {limit}" if limit else ""
    return f"""
        WITH tfs AS (SELECT tweet_id, term, count(*) AS tf FROM terms GROUP BY ALL),
        vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tfs GROUP BY term HAVING count(*) >= {min_df} {top}),
        n AS (SELECT count(*)::DOUBLE AS n FROM messages),
        raw AS (SELECT tweet_id, term, {tf} * (ln((1 + n) / (1 + df)) + 1) AS w FROM tfs JOIN vocab USING (term), n)
        SELECT tweet_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY tweet_id)), 6) AS weight FROM raw"""


@query("tfidf_weights", _tfidf_sql(2, "(1 + ln(tf))", 30000))
def _(spark, d):
    rows = ft.add_terms(views.messages(spark, d), "text", ascii_only=True)
    return ft.tfidf_weights(rows, "tweet_id", min_df=2, max_features=30_000, sublinear=True).select(
        "tweet_id", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_weights_plain", _tfidf_sql(1, "tf", 20000))
def _(spark, d):
    rows = ft.add_terms(views.messages(spark, d), "text", ascii_only=True)
    return ft.tfidf_weights(rows, "tweet_id", min_df=1, max_features=20_000).select(
        "tweet_id", "term", F.round("weight", 6).alias("weight"))


@query("class_weights", """
    SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
    FROM (SELECT candidate_intent AS label, count(*) AS n FROM candidates GROUP BY 1)""")
def _(spark, d):
    return ft.class_weights(views.scored(spark, d), "candidate_intent").select(
        "label", "n", F.round("weight", 6).alias("weight"))


def _labelled(spark, d):
    """Messages with their candidate class as the label to learn."""
    return views.scored(spark, d).select(
        "tweet_id", F.col("text").alias("customer_message"), F.col("candidate_intent").alias("gold_intent"),
        F.when(F.length("text") > 150, "yes").otherwise("no").alias("expected_escalation"))


def _classifier(spark, d, **settings):
    return jobs.train_classifier(_labelled(spark, d), "customer_message", "gold_intent", **settings)


@query("lr_fit")
def _(spark, d):
    rows = _labelled(spark, d)
    model = _classifier(spark, d)
    scored = model.predict(rows, "customer_message")
    return scored.select("tweet_id", "gold_intent", "predicted_intent", F.round("confidence", 3).alias("confidence"))


@query("lr_predict")
def _(spark, d):
    model = _classifier(spark, d, settings=ft.BASELINE)
    scored = top_two(model.predict(_labelled(spark, d), "customer_message"), "probabilities", model.classes)
    return scored.select("tweet_id", "predicted_intent", "second_intent",
                         F.round("confidence_margin", 3).alias("confidence_margin"))


@query("hybrid_predict")
def _(spark, d):
    rows = views.message_vectors(_labelled(spark, d), "customer_message", 128)
    model = TextClassifier(ft.HYBRID, "embedding").fit(rows, "customer_message", "gold_intent")
    return model.predict(rows, "customer_message").select("tweet_id", "gold_intent", "predicted_intent")


@query("embedding_predict")
def _(spark, d):
    rows = views.table(spark, d, "embeddings").withColumn("label", F.concat(F.lit("l"), "label"))
    model = TextClassifier(None, "embedding").fit(rows, label="label")
    return model.predict(rows).select("vec_id", "label", "predicted_intent")


@query("cross_validated_tfidf")
def _(spark, d):
    scored = cross_validate(
        _labelled(spark, d), lambda: TextClassifier(ft.BASELINE), "customer_message", "gold_intent")
    return scored.select("tweet_id", "gold_intent", "fold", "predicted_intent")


# --- text models: stand-ins that answer from the prompt ------------------------------------------

def _stand_ins():
    """Two providers and a labeller; as inner functions they need no package on the workers."""

    def first(prompt: str) -> str:
        if len(prompt) % 3 == 0:
            raise RuntimeError("busy")
        return "" if len(prompt) % 3 == 1 else f"Response: first {len(prompt)}"

    def second(prompt: str) -> str:
        if len(prompt) % 5 == 0:
            raise RuntimeError("down")
        return f'"second {len(prompt)}"'

    def label(prompt: str) -> str:
        """Answers at once, after being told of an error, or never, by the message's length."""
        told = "could not be used" in prompt
        message = prompt.split("Message:\n", 1)[1].split("\n\nThe previous answer")[0]
        kind = len(message.strip()) % 4
        if kind == 0 or (kind == 1 and told):
            return 'Sure: {"intent": "c_en", "escalation": "no", "confidence": 60, "reason": "plain"}'
        return "nothing" if kind < 3 else '{"intent": "c_en"}'

    return [("one", "model-1", first), ("two", "model-2", second)], label


PROVIDERS, LABELLER = _stand_ins()


@query("batch_generate", """
    SELECT tweet_id, CASE WHEN n % 3 = 2 THEN 'first ' || n WHEN n % 5 <> 0 THEN 'second ' || n END AS response,
           CASE WHEN n % 3 = 2 THEN 'one' WHEN n % 5 <> 0 THEN 'two' END AS provider,
           CASE WHEN n % 3 = 2 THEN 'model-1' WHEN n % 5 <> 0 THEN 'model-2' END AS model,
           CASE WHEN n % 3 <> 2 AND n % 5 = 0 THEN 'All providers failed: one: '
             || CASE WHEN n % 3 = 0 THEN 'busy' ELSE 'empty answer' END || '; two: down' END AS error
    FROM (SELECT tweet_id, length(text) AS n FROM messages)""")
def _(spark, d):
    return generate_replies(views.messages(spark, d), "text", PROVIDERS).select(
        "tweet_id", "response", "provider", "model", "error")


@query("annotate_retry", r"""
    SELECT tweet_id, CASE WHEN kind < 2 THEN 'c_en' END AS intent, CASE WHEN kind < 2 THEN CAST(60 AS BIGINT) END AS confidence,
           CASE WHEN kind < 2 THEN kind END AS retry_count,
           CASE WHEN kind = 2 THEN 'Could not get valid annotation after 3 retries: No JSON object found.'
                WHEN kind = 3 THEN 'Could not get valid annotation after 3 retries: Missing keys: confidence, escalation, reason'
           END AS error
    FROM (SELECT tweet_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) % 4 AS kind FROM candidates)""")
def _(spark, d):
    rows = views.scored(spark, d).withColumnRenamed("text", "customer_message")
    done = annotate_with_retry(rows, LABELLER, "stub", {c: c for c in views.CLASSES})
    return done.select("tweet_id", "intent", "confidence", F.col("retry_count").cast("bigint").alias("retry_count"),
                       "error")


@query("annotate_golden", r"""
    SELECT tweet_id, CASE WHEN open AND kind < 2 THEN 'c_en' ELSE ai_intent END AS ai_intent,
           CASE WHEN open AND kind < 2 THEN '60' ELSE ai_confidence END AS ai_confidence,
           CASE WHEN NOT open THEN CASE WHEN status <> '' THEN status ELSE 'ai_suggested' END
                WHEN kind > 1 THEN 'ai_failed' WHEN status IN ('human_reviewed', 'ai_bulk_accepted') THEN status
                ELSE 'ai_suggested' END AS annotation_status
    FROM (SELECT *, trim(ai_intent) = '' OR coalesce(trim(ai_escalation), '') = '' OR trim(ai_confidence) = '' AS open,
                 length(regexp_replace(customer_message, '^\s+|\s+$', '', 'g')) % 4 AS kind,
                 CASE WHEN annotation_status <> '' THEN annotation_status
                      WHEN contains(annotation_notes, 'Bulk accepted from AI') THEN 'ai_bulk_accepted'
                      WHEN coalesce(trim(gold_intent), '') <> '' THEN 'human_reviewed'
                      WHEN trim(ai_intent) <> '' THEN 'ai_suggested' ELSE '' END AS status
          FROM annotated)""")
def _(spark, d):
    done, _counts = jobs.annotate_golden(
        views.annotated(spark, d), LABELLER, "stub", {c: c for c in views.CLASSES})
    return done.select("tweet_id", "ai_intent", "ai_confidence", "annotation_status")


@query("annotate_golden_counts", r"""
    SELECT count(*) FILTER (WHERE open AND kind < 2) AS processed, count(*) FILTER (WHERE open AND kind > 1) AS failed,
           count(*) FILTER (WHERE NOT open) AS skipped
    FROM (SELECT trim(ai_intent) = '' OR coalesce(trim(ai_escalation), '') = '' OR trim(ai_confidence) = '' AS open,
                 length(regexp_replace(customer_message, '^\s+|\s+$', '', 'g')) % 4 AS kind
          FROM annotated)""")
def _(spark, d):
    _done, counts = jobs.annotate_golden(
        views.annotated(spark, d), LABELLER, "stub", {c: c for c in views.CLASSES})
    return counts


# --- jobs ---------------------------------------------------------------------------------------

def _corpus(spark, d):
    return jobs.build_corpus(views.flat(spark, d), views.golden(spark, d),
                             lambda df: views.message_vectors(df, "customer_message"))


def _with_vectors(rows):
    return normalize_vectors(views.message_vectors(rows, "customer_message"), "embedding")


@query("handle_messages")
def _(spark, d):
    rows = _with_vectors(_labelled(spark, d).select("tweet_id", "customer_message"))
    handled = jobs.handle_messages(rows, _classifier(spark, d), _corpus(spark, d), PROVIDERS)
    return handled.select("tweet_id", "intent", F.round("confidence", 3).alias("confidence"), "response",
                          F.size("evidence").alias("n_evidence"), "escalate", "escalation_reason")


@query("end_to_end_eval")
def _(spark, d):
    rows = _with_vectors(_labelled(spark, d))
    report = jobs.evaluate_end_to_end(rows, _classifier(spark, d), _corpus(spark, d), PROVIDERS)
    return metrics.tidy_report({k: v for k, v in report.items() if k != "examples"})


@query("classifier_eval")
def _(spark, d):
    report = jobs.evaluate_classifier(
        _labelled(spark, d), _classifier(spark, d), "customer_message", "gold_intent", views.CLASSES)
    return metrics.tidy_report({k: v for k, v in report.items() if k != "predictions"})


@query("end_to_end_examples")
def _(spark, d):
    rows = _with_vectors(_labelled(spark, d))
    report = jobs.evaluate_end_to_end(rows, _classifier(spark, d), _corpus(spark, d), PROVIDERS)
    return report["examples"].withColumn("confidence", F.round("confidence", 3)).withColumn(
        "evidence", F.transform("evidence", lambda e: e["customer_tweet_id"]))


@query("classifier_predictions")
def _(spark, d):
    report = jobs.evaluate_classifier(
        _labelled(spark, d), _classifier(spark, d), "customer_message", "gold_intent", views.CLASSES)
    return report["predictions"].select(
        "tweet_id", "gold_intent", "predicted_intent", "second_intent", F.round("confidence", 3).alias("confidence"),
        F.round("confidence_margin", 3).alias("confidence_margin"))


@query("baseline_eval")
def _(spark, d):
    report = jobs.evaluate_baselines(_labelled(spark, d))
    return metrics.tidy_report(report)
