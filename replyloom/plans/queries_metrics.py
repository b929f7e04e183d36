"""Scores of classes, routing, confidence, raters and retrieval."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from replyloom import fixed_values as fixed
from replyloom.operators import metrics as mt
from replyloom.operators import retrieval as rt
from replyloom.operators.messages import add_failure_flags
from replyloom.operators.sampling import assign_folds
from replyloom.plans import views
from replyloom.plans.oracle import hash_order
from replyloom.plans.registry import query
from replyloom.session import ensure_checkpoint_dir
from replyloom.sources.tables import read_section, write_report

LABELS = ["c_en", "c_de", "c_fr", "c_es", "unknown"]
GIVEN = ", ".join(f"('{x}')" for x in LABELS)

PER_CLASS = """
    SELECT label, tp, support, coalesce(tp / nullif(predicted, 0), 0) AS precision,
           coalesce(tp / nullif(support, 0), 0) AS recall,
           coalesce(2.0 * tp / nullif(predicted + support, 0), 0) AS f1
    FROM (SELECT label, (SELECT count(*) FROM {t} WHERE gold_intent = label AND predicted_intent = label) AS tp,
                 (SELECT count(*) FROM {t} WHERE gold_intent = label) AS support,
                 (SELECT count(*) FROM {t} WHERE predicted_intent = label) AS predicted
          FROM {labels})"""
SEEN = "(SELECT gold_intent AS label FROM {t} UNION SELECT predicted_intent FROM {t})"
GIVEN_LABELS = f"(SELECT * FROM (VALUES {GIVEN}) AS g(label))"


def _overall(table: str, labels: str, digits: int = 4) -> str:
    return f"""
        SELECT (SELECT count(*) FROM {table}) AS examples,
               round((SELECT avg(CASE WHEN gold_intent = predicted_intent THEN 1.0 ELSE 0.0 END) FROM {table}), {digits}) AS accuracy,
               round(avg(f1), {digits}) AS macro_f1, round(sum(f1 * support) / sum(support), {digits}) AS weighted_f1
        FROM ({PER_CLASS.format(t=table, labels=labels)})"""


@query("classification_metrics", _overall("preds", SEEN.format(t="preds")))
def _(spark, d):
    return mt.classification_metrics(views.preds(spark, d), "gold_intent", "predicted_intent")


@query("classification_metrics_taxonomy", _overall("preds", GIVEN_LABELS, 6))
def _(spark, d):
    return mt.classification_metrics(
        views.preds(spark, d), "gold_intent", "predicted_intent", labels=LABELS, digits=6)


@query("per_class_report", f"""
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
    FROM ({PER_CLASS.format(t='preds', labels=GIVEN_LABELS)})""")
def _(spark, d):
    report = mt.per_class_report(views.preds(spark, d), "gold_intent", "predicted_intent", LABELS)
    return report.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("confusion_matrix", f"""
    SELECT a.label AS actual, p.label AS predicted,
           (SELECT count(*) FROM preds WHERE gold_intent = a.label AND predicted_intent = p.label) AS n
    FROM {GIVEN_LABELS} a, {GIVEN_LABELS} p""")
def _(spark, d):
    return mt.confusion_matrix(views.preds(spark, d), "gold_intent", "predicted_intent", LABELS)


@query("confusion_wide", "SELECT gold_intent AS actual, " + ", ".join(
    f"count(*) FILTER (predicted_intent = '{c}') AS {c}" for c in LABELS) + f"""
    FROM preds GROUP BY 1 UNION ALL SELECT label, 0, 0, 0, 0, 0 FROM {GIVEN_LABELS}
    WHERE label NOT IN (SELECT gold_intent FROM preds)""")
def _(spark, d):
    matrix = mt.confusion_matrix(views.preds(spark, d), "gold_intent", "predicted_intent", LABELS)
    return mt.wide_confusion(matrix, LABELS)


@query("label_union", "SELECT gold_intent AS label FROM preds UNION SELECT predicted_intent FROM preds")
def _(spark, d):
    return mt.label_union(views.preds(spark, d), "gold_intent", "predicted_intent")


def _binary(table: str, truth: str, guess: str) -> str:
    return f"""
        SELECT n AS examples, round((tp + tn) / n, 4) AS accuracy,
               round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision,
               round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
               round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1,
               round(fn / n, 4) AS false_auto_handle_rate, round(fp / n, 4) AS false_escalation_rate,
               tp + fp AS predicted_escalations, tp + fn AS actual_escalations
        FROM (SELECT count(*) AS n, count(*) FILTER ({truth} AND {guess}) AS tp,
                     count(*) FILTER (NOT {truth} AND {guess}) AS fp,
                     count(*) FILTER ({truth} AND NOT {guess}) AS fn,
                     count(*) FILTER (NOT {truth} AND NOT {guess}) AS tn FROM {table})"""


@query("binary_metrics", _binary("preds", "expected_escalation", "predicted_escalation"))
def _(spark, d):
    return mt.binary_metrics(views.preds(spark, d), "expected_escalation", "predicted_escalation")


@query("always_no_baseline", _binary("preds", "expected_escalation", "false"))
def _(spark, d):
    never = mt.predict_never(views.preds(spark, d))
    return mt.binary_metrics(never, "expected_escalation", "predicted_escalation")


@query("majority_baseline", """
    SELECT doc_id, gold_intent, (SELECT gold_intent FROM preds GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS majority
    FROM preds""")
def _(spark, d):
    rows = views.preds(spark, d)
    return mt.predict_majority(rows, rows, "gold_intent", "majority").select(
        "doc_id", "gold_intent", "majority")


FOLDED = f"""
    SELECT doc_id, gold_intent, (row_number() OVER (PARTITION BY gold_intent ORDER BY {hash_order('doc_id')}) - 1) % 5 AS fold
    FROM preds"""
CV = f"""
    SELECT f.doc_id, f.gold_intent, f.fold, m.gold_intent AS predicted_intent FROM ({FOLDED}) f JOIN (
        SELECT x.fold, o.gold_intent FROM (SELECT DISTINCT fold FROM ({FOLDED})) x
        JOIN ({FOLDED}) o ON o.fold <> x.fold GROUP BY x.fold, o.gold_intent
        QUALIFY row_number() OVER (PARTITION BY x.fold ORDER BY count(*) DESC, o.gold_intent) = 1) m USING (fold)"""


@query("cv_majority", CV)
def _(spark, d):
    folded = assign_folds(views.preds(spark, d), "gold_intent", 5, "doc_id")
    return mt.cross_validate_majority(folded, "gold_intent").select(
        "doc_id", "gold_intent", "fold", "predicted_intent")


@query("baseline_majority_eval", "WITH cv AS (" + CV + ")" + _overall("cv", SEEN.format(t="cv")))
def _(spark, d):
    folded = assign_folds(views.preds(spark, d), "gold_intent", 5, "doc_id")
    guessed = mt.cross_validate_majority(folded, "gold_intent")
    return mt.classification_metrics(guessed, "gold_intent", "predicted_intent")


@query("confidence_buckets", """
    SELECT CASE WHEN confidence < 0.5 THEN '<0.50' WHEN confidence < 0.7 THEN '0.50-0.70'
                WHEN confidence < 0.85 THEN '0.70-0.85' ELSE '>=0.85' END AS bucket, count(*) AS examples,
           round(avg(CASE WHEN gold_intent = predicted_intent THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
           round(avg(confidence), 6) AS mean_confidence
    FROM preds GROUP BY 1""")
def _(spark, d):
    return mt.confidence_buckets(views.preds(spark, d), "gold_intent", "predicted_intent").select(
        "bucket", "examples", F.round("accuracy", 6).alias("accuracy"),
        F.round("mean_confidence", 6).alias("mean_confidence"))


@query("confidence_by_correct", """
    SELECT gold_intent = predicted_intent AS correct, round(avg(confidence), 6) AS mean_confidence,
           round(avg(confidence_margin), 6) AS mean_margin FROM preds GROUP BY 1""")
def _(spark, d):
    return mt.confidence_by_correct(views.preds(spark, d), "gold_intent", "predicted_intent").select(
        "correct", F.round("mean_confidence", 6).alias("mean_confidence"),
        F.round("mean_margin", 6).alias("mean_margin"))


def _sweep_sql() -> str:
    parts = []
    for t in fixed.FALLBACK_THRESHOLDS:
        table = f"(SELECT gold_intent, CASE WHEN confidence < {t} THEN 'other' ELSE predicted_intent END AS predicted_intent FROM preds)"
        parts.append(f"""
            SELECT CAST({t} AS DOUBLE) AS threshold, accuracy, macro_f1,
                   (SELECT count(*) FROM preds WHERE confidence < {t}) AS fallbacks
            FROM ({_overall(table, SEEN.format(t=table), 6)})""")
    return " UNION ALL ".join(parts)


@query("threshold_sweep", _sweep_sql())
def _(spark, d):
    return mt.threshold_sweep(views.preds(spark, d), "gold_intent", "predicted_intent")


# --- failures -----------------------------------------------------------------------------------

FLAGGED = """
    SELECT *, gold_intent <> predicted_intent AS intent_failure,
           expected_escalation <> predicted_escalation AS escalation_failure,
           CAST(length(customer_message) AS BIGINT) AS response_length FROM preds"""


def _flagged(spark, d):
    return add_failure_flags(views.preds(spark, d).withColumn("response", F.col("customer_message")))


@query("failure_rows", f"SELECT doc_id, intent_failure, escalation_failure, response_length FROM ({FLAGGED})")
def _(spark, d):
    return _flagged(spark, d).select("doc_id", "intent_failure", "escalation_failure", "response_length")


@query("failure_counts", f"""
    SELECT count(*) AS examples, count(*) FILTER (intent_failure) AS intent_failures,
           count(*) FILTER (escalation_failure) AS escalation_failures FROM ({FLAGGED})""")
def _(spark, d):
    return mt.failure_counts(_flagged(spark, d))


@query("failure_slices", f"""
    SELECT 'misclassified' AS slice, doc_id FROM ({FLAGGED}) WHERE intent_failure
    UNION ALL SELECT 'misrouted', doc_id FROM ({FLAGGED}) WHERE escalation_failure
    UNION ALL SELECT 'low_confidence', doc_id FROM ({FLAGGED}) WHERE confidence < 0.6""")
def _(spark, d):
    return mt.failure_slices(_flagged(spark, d)).select("slice", "doc_id")


@query("escalation_cases", """
    SELECT doc_id, expected_escalation, predicted_escalation FROM preds
    WHERE expected_escalation OR predicted_escalation""")
def _(spark, d):
    return mt.escalation_cases(views.preds(spark, d)).select(
        "doc_id", "expected_escalation", "predicted_escalation")


# --- raters -------------------------------------------------------------------------------------

DIMS = fixed.SCORE_DIMENSIONS


def _joined(spark, d):
    return mt.join_raters(views.human_ratings(spark, d), views.judge_ratings(spark, d), DIMS, "doc_id")


@query("rater_join", "SELECT * FROM ratings WHERE overall_judge IS NOT NULL")
def _(spark, d):
    return _joined(spark, d)


LONG = " UNION ALL ".join(
    f"SELECT '{n}' AS dimension, {n}_human AS a, {n}_judge AS b FROM ratings WHERE {n}_judge IS NOT NULL"
    for n in DIMS)


@query("rater_agreement", f"""
    SELECT dimension, count(*) AS examples, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS exact_agreement,
           round(avg(abs(a - b)), 6) AS mean_absolute_difference FROM ({LONG}) GROUP BY 1""")
def _(spark, d):
    return mt.rater_agreement(_joined(spark, d)).select(
        "dimension", "examples", F.round("exact_agreement", 6).alias("exact_agreement"),
        F.round("mean_absolute_difference", 6).alias("mean_absolute_difference"))


@query("weighted_kappa", f"""
    WITH long AS ({LONG}), places AS (
        SELECT dimension, score, row_number() OVER (PARTITION BY dimension ORDER BY score) AS place
        FROM (SELECT dimension, a AS score FROM long UNION SELECT dimension, b FROM long)),
    ranked AS (SELECT l.dimension, i.place::DOUBLE AS i, j.place::DOUBLE AS j FROM long l
        JOIN places i ON i.dimension = l.dimension AND i.score = l.a
        JOIN places j ON j.dimension = l.dimension AND j.score = l.b),
    observed AS (SELECT dimension, i, j, count(*) AS n FROM ranked GROUP BY ALL),
    sums AS (SELECT a.dimension, sum((a.i - b.j) * (a.i - b.j)) AS expected
             FROM ranked a JOIN ranked b ON a.dimension = b.dimension GROUP BY 1)
    SELECT o.dimension, round(1 - sum((i - j) * (i - j) * n) * sum(n) / any_value(expected), 6) AS kappa
    FROM observed o JOIN sums s USING (dimension) GROUP BY 1""")
def _(spark, d):
    return mt.weighted_kappa(_joined(spark, d)).select(
        "dimension", F.round("quadratic_weighted_kappa", 6).alias("kappa"))


# --- retrieval ----------------------------------------------------------------------------------

@query("l2_normalize", """
    SELECT vec_id, i, round(e / sqrt(sum(e * e) OVER (PARTITION BY vec_id)), 6) AS x
    FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE * 3 + 1 AS e FROM embeddings)""")
def _(spark, d):
    shifted = F.transform("embedding", lambda x: x.cast("double") * 3 + 1)
    rows = views.table(spark, d, "embeddings").select("vec_id", shifted.alias("embedding"))
    return rt.normalize_vectors(rows, "embedding").select(
        "vec_id", F.posexplode("embedding").alias("i", "x")
    ).select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


def _top(where: str, k: int = 5) -> str:
    return f"""
        SELECT query_id, corpus_id, similarity, row_number() OVER
               (PARTITION BY query_id ORDER BY similarity DESC, corpus_id) AS rank
        FROM neighbours {where} QUALIFY rank <= {k}"""


@query("topk_similar", f"SELECT query_id, corpus_id, round(similarity, 6) AS similarity, rank FROM ({_top('')})")
def _(spark, d):
    ranked = rt.top_k(views.vectors(spark, d, "query_id"), views.vectors(spark, d, "corpus_id"), 5)
    return ranked.withColumn("similarity", F.round("similarity", 6))


NO_SELF = _top("WHERE query_id <> corpus_id")


@query("topk_no_self", f"SELECT query_id, corpus_id, round(similarity, 6) AS similarity, rank FROM ({NO_SELF})")
def _(spark, d):
    # the way of many queries, also on few
    ranked = rt.top_k(views.vectors(spark, d, "query_id"), views.vectors(spark, d, "corpus_id"), 5, True)
    return ranked.withColumn("similarity", F.round("similarity", 6))


@query("retrieval_metrics", f"""
    SELECT count(*) AS examples, round(avg(CASE WHEN hit <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_at_1,
           round(avg(CASE WHEN hit <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_at_3,
           round(avg(CASE WHEN hit <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_5,
           round(avg(coalesce(1.0 / hit, 0)), 6) AS mrr, CAST(sum(odd) AS BIGINT) AS examples_with_unknown
    FROM (SELECT q.doc_id, min(CASE WHEN r.inferred = 'c_' || q.lang THEN t.rank END) AS hit,
                 max(CASE WHEN r.inferred = 'unknown' THEN 1 ELSE 0 END) AS odd
          FROM (SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) q
          LEFT JOIN (({NO_SELF}) t JOIN doc_classes r ON r.doc_id = t.corpus_id) ON t.query_id = q.doc_id GROUP BY 1)""")
def _(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", F.col("text").alias("customer_message"), "lang")
    ids = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    ranked = rt.top_k(views.vectors(spark, d, "query_id"), views.vectors(spark, d, "corpus_id"), 5, True)
    retrieved = rt.attach_pairs(ranked, docs, "doc_id")
    gold = docs.join(ids, "doc_id", "left_semi").select(
        F.col("doc_id").alias("query_id"), F.concat(F.lit("c_"), "lang").alias("gold"))
    scores = rt.evaluate_retrieval(retrieved, gold, views.LEXICON)
    return scores.select(
        "examples", *[F.round(c, 6).alias(c) for c in ("recall_at_1", "recall_at_3", "recall_at_5", "mrr")],
        F.col("examples_with_unknown").cast("bigint").alias("examples_with_unknown"))


def _report(spark, d) -> str:
    """A report on the evaluated documents whose examples are a table beside its head."""
    path = f"{ensure_checkpoint_dir(spark)}/report-{uuid4().hex}"
    rows = views.preds(spark, d)
    matrix = mt.confusion_matrix(rows, "gold_intent", "predicted_intent", LABELS)
    write_report(spark, {"examples": rows, "confusion": matrix}, path, inline_rows=30)
    return path


@query("report_examples", """
    SELECT doc_id, gold_intent, predicted_intent, expected_escalation, predicted_escalation, confidence FROM preds""")
def _(spark, d):
    return read_section(spark, _report(spark, d), "examples", (
        "doc_id bigint, gold_intent string, predicted_intent string, expected_escalation boolean, "
        "predicted_escalation boolean, confidence double"))


@query("report_section", f"""
    SELECT a.label AS actual, p.label AS predicted,
           (SELECT count(*) FROM preds WHERE gold_intent = a.label AND predicted_intent = p.label) AS n
    FROM {GIVEN_LABELS} a, {GIVEN_LABELS} p""")
def _(spark, d):
    return read_section(spark, _report(spark, d), "confusion", "actual string, predicted string, n bigint")
