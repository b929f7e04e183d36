"""Whole jobs put together from the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom import fixed_values as fixed
from replyloom.functions.lexicon import Lexicon, add_candidate, label_weakly
from replyloom.functions.prompts import REPLY_TEMPLATE, SCORE_TEMPLATE, reply_prompt, score_prompt
from replyloom.functions.routing import RoutingRules, route
from replyloom.functions.text import has_text, normalize_bool
from replyloom.operators import metrics
from replyloom.operators.aggregates import dedup_text, value_counts
from replyloom.operators.annotations import (
    ensure_annotation_columns, has_prediction, merge_predictions, pending_rows, validate_judgements,
)
from replyloom.operators.brands import connected_rows, linked_brands
from replyloom.operators.corpus import holdout_conversations, holdout_rows, resolution_pairs
from replyloom.operators.features import BASELINE
from replyloom.operators.inference import Provider, annotate_with_retry, complete, generate_replies
from replyloom.operators.messages import drop_null_pairs, flatten_messages, inbound_rows, rows_with_text
from replyloom.operators.models import TextClassifier, cross_validate
from replyloom.operators.retrieval import attach_pairs, nest_evidence, normalize_vectors, top_k
from replyloom.operators.sampling import (
    assign_folds, cap_classes, cap_one_class, sample_per_class, sample_quotas, shuffle_positions,
    top_two,
)
from replyloom.operators.threads import build_conversations, nest_conversations
from replyloom.schema import require_columns, require_rows
from replyloom.session import cut_lineage
from replyloom.sources.tables import write_report


def build_training_set(tweets: DataFrame, golden: DataFrame, lexicon: Lexicon,
                       other_phrases: Sequence[str] = tuple(fixed.OTHER_PHRASES),
                       other_cap: int = fixed.OTHER_CLASS_CAP, brand: str | None = None,
                       ascii_only: bool = False) -> DataFrame:
    """Weakly labelled customer messages without golden rows: (tweet_id, text, intent)."""
    rows = rows_with_text(inbound_rows(tweets), "text", ascii_only)
    if brand is not None:
        rows = rows.join(linked_brands(tweets, [brand]).select("tweet_id"), "tweet_id", "left_semi")
    # few messages get a label; they are read twice below, the whole table only once
    labelled = cut_lineage(
        label_weakly(
            holdout_rows(rows, golden).select("tweet_id", "text"), "text", lexicon, other_phrases,
            ascii_only=ascii_only,
        ).where(F.col("intent").isNotNull())
    )
    return dedup_text(cap_one_class(labelled, other_cap)).select("tweet_id", "text", "intent")


def build_candidates(nested: DataFrame, lexicon: Lexicon,
                     per_class: int = fixed.CANDIDATES_PER_CLASS) -> DataFrame:
    """Customer messages of nested conversations, scored and sampled per candidate class."""
    scored = add_candidate(flatten_messages(nested), "customer_message", lexicon)
    return sample_per_class(scored, "candidate_intent", per_class)


def build_golden_set(candidates: DataFrame, quotas: Mapping[str, int] | None = None,
                     check: bool = True) -> DataFrame:
    """Quota sample in random order with empty label columns; short classes are an error."""
    kept = ["conversation_id", "tweet_id", "customer_message", "turn_count", "candidate_intent"]
    chosen = sample_quotas(candidates, quotas or fixed.CLASS_QUOTAS, check=check)
    empty = [F.lit("").alias(c) for c in ("gold_intent", "expected_escalation", "annotation_notes")]
    return shuffle_positions(chosen.select(*kept)).select("shuffle_pos", *kept, *empty)


def extract_conversations(tweets: DataFrame, brand: str) -> DataFrame:
    """Rows connected to one brand, rebuilt into nested conversations."""
    connected = connected_rows(tweets, [brand]).drop("brand")
    return nest_conversations(build_conversations(connected, brand))


def build_corpus(flat: DataFrame, golden: DataFrame,
                 embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Resolution pairs with the unit vector of their customer message, as one table.

    ``embed`` adds an array column ``embedding`` computed from customer_message.
    """
    pairs = resolution_pairs(holdout_conversations(flat, golden))
    return cut_lineage(normalize_vectors(embed(pairs), "embedding"))


def annotate_golden(golden: DataFrame, provider: Provider, source: str, taxonomy: Mapping[str, str],
                    limit: int | None = None, force: bool = False,
                    threshold: int = fixed.REVIEW_CONFIDENCE,
                    key: str = "tweet_id") -> tuple[DataFrame, DataFrame]:
    """Label the rows still open and merge the labels: (golden, counts of the run).

    Run again after a stop, it goes on with the rows that have no prediction yet.
    """
    ready = ensure_annotation_columns(golden)
    answers = annotate_with_retry(
        pending_rows(ready, limit, force, key), provider, source, taxonomy, threshold=threshold, key=key
    )
    counts = answers.agg(
        F.count_if(F.col("error").isNull()).alias("processed"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    ).withColumn(
        "skipped",
        F.lit(0).cast("bigint") if force
        else ready.agg(F.count_if(has_prediction()).alias("skipped")).scalar(),
    )
    return merge_predictions(ready, answers, key), counts


def train_classifier(df: DataFrame, text: str = "text", label: str = "intent",
                     cap: int | None = fixed.CLASS_CAP, key: str = "tweet_id",
                     **settings) -> TextClassifier:
    """Check, drop incomplete rows, cap the large classes, fit."""
    require_columns(df, [key, text, label])
    rows = drop_null_pairs(df, [text, label])
    if cap is not None:
        rows = cut_lineage(cap_classes(rows, cap, label, key))
    return TextClassifier(**settings).fit(rows, text, label)


def handle_messages(messages: DataFrame, classifier: TextClassifier, corpus: DataFrame,
                    providers: Sequence[tuple[str, str, Provider]], k: int = 3,
                    message: str = "customer_message", key: str = "tweet_id",
                    rules: RoutingRules | None = None, template: str = REPLY_TEMPLATE) -> DataFrame:
    """Classify, retrieve, draft and route every message with text.

    ``messages`` and ``corpus`` carry unit vectors in ``embedding``; a corpus row with the key of a
    message is never its evidence.
    """
    require_rows(corpus)
    asked = messages.where(has_text(message))
    classified = classifier.predict(asked, message).withColumnRenamed("predicted_intent", "intent")
    ranked = top_k(
        asked.select(F.col(key).alias("query_id"), F.col("embedding").alias("vector")),
        corpus.select(F.col("customer_tweet_id").alias("corpus_id"), F.col("embedding").alias("vector")),
        k, exclude_self=True,
    )
    evidence = nest_evidence(attach_pairs(ranked, corpus.drop("embedding")))
    found = classified.drop("embedding", "probabilities").join(
        evidence, F.col(key) == F.col("query_id"), "left"
    ).drop("query_id")
    prompted = found.withColumn(
        "_prompt", reply_prompt(F.col(message), F.col("intent"), F.col("evidence"), template, k)
    )
    # written out, so that no provider is asked twice for one message
    drafted = cut_lineage(generate_replies(prompted, "_prompt", providers).drop("_prompt"))
    routed = route(drafted, message, "intent", "confidence", evidence="evidence", rules=rules)
    return routed.withColumns(
        {
            "escalate": F.col("decision.escalate"),
            "escalation_reason": F.col("decision.reason"),
        }
    ).drop("decision")


def evaluate_classifier(df: DataFrame, classifier: TextClassifier, text: str, label: str,
                        labels: Sequence[str] | None = None, path: str | None = None) -> dict[str, DataFrame]:
    """All class scores of a labelled set: overall, per class, confusion, confidence.

    With ``path`` they are written there as a report, predictions included.
    """
    labels = list(labels or classifier.classes)
    rows = df.where(has_text(text) & has_text(label))
    scored = cut_lineage(top_two(classifier.predict(rows, text), "probabilities", classifier.classes))
    truth, guess = label, "predicted_intent"
    report = {
        "predictions": scored,
        "overall": metrics.classification_metrics(scored, truth, guess, labels=labels, digits=6),
        "per_class": metrics.per_class_report(scored, truth, guess, labels),
        "confusion": metrics.confusion_matrix(scored, truth, guess, labels),
        "confidence": metrics.confidence_by_correct(scored, truth, guess),
        "buckets": metrics.confidence_buckets(scored, truth, guess),
    }
    if path is not None:
        write_report(df.sparkSession, report, path)
    return report


def evaluate_baselines(golden: DataFrame, text: str = "customer_message", label: str = "gold_intent",
                       escalation: str = "expected_escalation", key: str = "tweet_id",
                       n_folds: int = fixed.FOLDS, max_iter: int = 1000) -> dict[str, DataFrame]:
    """Majority, always-no and cross-validated TF-IDF baselines over the labelled rows."""
    require_columns(golden, [text, label, escalation, key])
    rows = golden.where(has_text(label) & has_text(escalation)).withColumns(
        {
            "truth": F.col(label),
            "needs_person": normalize_bool(escalation, accept_y=True),
        }
    )

    def build() -> TextClassifier:
        return TextClassifier(BASELINE, max_iter=max_iter)

    majority = metrics.cross_validate_majority(assign_folds(rows, "truth", n_folds, key), "truth")
    lexical = cross_validate(rows, build, text, "truth", n_folds, key)
    never = metrics.predict_never(rows)
    routed = cross_validate(
        rows.withColumn("answer", F.col("needs_person").cast("string")), build, text, "answer",
        n_folds, key,
    ).withColumn("predicted_escalation", F.col("predicted_intent") == "true")
    return {
        "intent_distribution": value_counts(rows, "truth"),
        "escalation_distribution": value_counts(rows, "needs_person"),
        "intent_majority": metrics.classification_metrics(majority, "truth", "predicted_intent"),
        "intent_tfidf": metrics.classification_metrics(lexical, "truth", "predicted_intent"),
        "escalation_never": metrics.binary_metrics(never, "needs_person", "predicted_escalation"),
        "escalation_tfidf": metrics.binary_metrics(routed, "needs_person", "predicted_escalation"),
    }


def judge_examples(examples: DataFrame, providers: Sequence[tuple[str, str, Provider]],
                   message: str = "customer_message", response: str = "response", evidence: str = "evidence",
                   template: str = SCORE_TEMPLATE) -> dict[str, DataFrame]:
    """Have a text model score every reply: the judgements, their means and counts.

    An example whose judge failed, or gave no valid scores, stays with an ``error``.
    """
    prompted = examples.withColumn(
        "_prompt", score_prompt(F.col(message), F.col(evidence), F.col(response), template)
    )
    # written out, so that no reply is judged twice
    answered = cut_lineage(
        complete(prompted, "_prompt", providers)
        .drop("_prompt").withColumnsRenamed({"answer": "raw", "error": "failure"})
    )
    judged = validate_judgements(answered).withColumn("error", F.coalesce("failure", "error")).drop("failure")
    return {"judgements": judged, "means": metrics.judge_means(judged), "counts": metrics.judge_counts(judged)}


def evaluate_without_evidence(reviewed: DataFrame, classifier: TextClassifier, message: str = "customer_message",
                              label: str = "gold_intent", escalation: str = "expected_escalation",
                              rules: RoutingRules | None = None) -> dict[str, DataFrame]:
    """Class and routing scores of a reviewed sheet when nothing was retrieved for its messages."""
    rows = reviewed.where(has_text(message) & has_text(label))
    classified = classifier.predict(rows, message)
    routed = route(classified.withColumn("_none", F.lit(None).cast("double")), message, "predicted_intent",
                   "confidence", similarity="_none", rules=rules)
    scored = cut_lineage(routed.withColumns({
        "expected": normalize_bool(escalation, accept_y=True), "predicted": F.col("decision.escalate"),
    }).drop("decision", "_none"))
    return {
        "intent": metrics.classification_metrics(scored, label, "predicted_intent", digits=6),
        "escalation": metrics.binary_metrics(scored, "expected", "predicted", digits=6),
        "predicted_classes": value_counts(scored, "predicted_intent"),
        "actual_classes": value_counts(scored, label),
    }


def evaluate_end_to_end(golden: DataFrame, classifier: TextClassifier, corpus: DataFrame,
                        providers: Sequence[tuple[str, str, Provider]],
                        message: str = "customer_message", label: str = "gold_intent",
                        escalation: str = "expected_escalation", k: int = 3,
                        rules: RoutingRules | None = None, path: str | None = None) -> dict[str, DataFrame]:
    """Handle a labelled set and score classes and routing.

    With ``path`` the scores and all handled examples are written there as a report.
    """
    handled = handle_messages(golden, classifier, corpus, providers, k, message, rules=rules)
    examples = handled.select(
        "tweet_id", F.col(message).alias("customer_message"), F.col(label).alias("gold_intent"),
        F.col("intent").alias("predicted_intent"), "confidence",
        normalize_bool(escalation, accept_y=True).alias("expected_escalation"),
        F.col("escalate").alias("predicted_escalation"), "escalation_reason", "response", "evidence",
    )
    report = {
        "examples": examples,
        "intent": metrics.classification_metrics(examples, "gold_intent", "predicted_intent", digits=6),
        "per_class": metrics.per_class_report(examples, "gold_intent", "predicted_intent"),
        "escalation": metrics.binary_metrics(
            examples, "expected_escalation", "predicted_escalation", digits=6
        ),
    }
    if path is not None:
        write_report(golden.sparkSession, report, path)
    return report
