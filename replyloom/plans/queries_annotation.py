"""Annotation records, provenance and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from replyloom import fixed_values as fixed
from replyloom.operators import annotations as an
from replyloom.operators.aggregates import value_counts
from replyloom.plans import views
from replyloom.plans.oracle import quoted, strip
from replyloom.plans.registry import query

TAXONOMY = views.CLASSES


@query("validate_annotation", """
    SELECT tweet_id, error, CASE WHEN error IS NULL THEN i END AS intent,
           CASE WHEN error IS NULL THEN e IN ('true', 'yes', 'y', '1') END AS escalation,
           CASE WHEN error IS NULL THEN CAST(trunc(try_cast(c AS DOUBLE)) AS BIGINT) END AS confidence,
           CASE WHEN error IS NULL THEN r END AS reason,
           CASE WHEN error IS NULL THEN i <> candidate_intent END AS disagrees_with_candidate,
           CASE WHEN error IS NULL THEN try_cast(c AS DOUBLE) < 70 END AS low_confidence
    FROM (
        SELECT *, CASE
            WHEN j IS NULL THEN 'No JSON object found.'
            WHEN missing <> '' THEN 'Missing keys: ' || missing
            WHEN i NOT IN ('c_en', 'c_de', 'c_fr', 'c_es', 'other') THEN 'Invalid intent: ' || i
            WHEN json_type(j, '$.escalation') NOT IN ('BOOLEAN', 'VARCHAR')
              OR e NOT IN ('true', 'yes', 'y', '1', 'false', 'no', 'n', '0') THEN 'escalation must be a boolean.'
            WHEN try_cast(c AS DOUBLE) IS NULL THEN 'confidence must be an integer.'
            WHEN try_cast(c AS DOUBLE) > 100 THEN 'confidence must be between 0 and 100.'
            WHEN r = '' THEN 'reason must be non-empty.' END AS error
        FROM (SELECT *, trim(j->>'$.intent') AS i, lower(trim(j->>'$.escalation')) AS e,
                     trim(j->>'$.confidence') AS c, trim(j->>'$.reason') AS r,
                     concat_ws(', ', CASE WHEN NOT list_contains(json_keys(j), 'confidence') THEN 'confidence' END,
                       CASE WHEN NOT list_contains(json_keys(j), 'escalation') THEN 'escalation' END,
                       CASE WHEN NOT list_contains(json_keys(j), 'intent') THEN 'intent' END,
                       CASE WHEN NOT list_contains(json_keys(j), 'reason') THEN 'reason' END) AS missing
              FROM (SELECT *, try_cast(nullif(regexp_extract(raw, '(?s)\\{.*\\}', 0), '') AS JSON) AS j
                    FROM raw_answers)))""")
def _(spark, d):
    checked = an.validate_annotations(views.raw_answers(spark, d), taxonomy=TAXONOMY)
    return checked.select("tweet_id", "error", "intent", "escalation", "confidence", "reason",
                          "disagrees_with_candidate", "low_confidence")


_J = "(regexp_extract(raw, '(?s)\\{.*\\}', 0)::JSON)"


def _judgement_errors() -> str:
    cases = [
        f"WHEN json_extract(j, '$.{n}') IS NULL THEN 'Judge response missing required field: {n}'"
        for n in [*fixed.SCORE_DIMENSIONS, "reason"]
    ] + [
        f"WHEN json_type(j, '$.{n}') NOT IN ('UBIGINT', 'BIGINT') OR CAST(j->>'$.{n}' AS DOUBLE) NOT BETWEEN 1 AND 5 "
        f"THEN 'Judge score ''{n}'' must be an integer from 1 to 5.'"
        for n in fixed.SCORE_DIMENSIONS
    ]
    return "CASE " + " ".join(cases) + " END"


JUDGED = f"""
    SELECT tweet_id, error, {', '.join(
        f"CASE WHEN error IS NULL THEN CAST(j->>'$.{n}' AS BIGINT) END AS {n}" for n in fixed.SCORE_DIMENSIONS)},
        CASE WHEN error IS NULL THEN j->>'$.reason' END AS reason
    FROM (SELECT *, {_judgement_errors()} AS error FROM (SELECT tweet_id, {_J} AS j FROM raw_judgements))"""


@query("validate_judgment", JUDGED)
def _(spark, d):
    return an.validate_judgements(views.raw_judgements(spark, d)).select(
        "tweet_id", "error", *fixed.SCORE_DIMENSIONS, "reason")


@query("judge_means", " UNION ALL ".join(
    f"SELECT '{n}' AS dimension, round(avg({n}), 6) AS mean_score FROM ({JUDGED}) WHERE error IS NULL"
    for n in fixed.SCORE_DIMENSIONS))
def _(spark, d):
    from replyloom.operators.metrics import judge_means

    judged = an.validate_judgements(views.raw_judgements(spark, d))
    return judge_means(judged).select("dimension", F.round("mean_score", 6).alias("mean_score"))


@query("judge_counts", f"""
    SELECT count(*) AS examples, count(*) FILTER (error IS NULL) AS successful,
           count(*) FILTER (error IS NOT NULL) AS failed FROM ({JUDGED})""")
def _(spark, d):
    from replyloom.operators.metrics import judge_counts

    return judge_counts(an.validate_judgements(views.raw_judgements(spark, d)))


STATUS = f"""CASE WHEN length({strip('annotation_status')}) > 0 THEN annotation_status
    WHEN contains(annotation_notes, {quoted(fixed.BULK_NOTE)}) THEN 'ai_bulk_accepted'
    WHEN length({strip("coalesce(gold_intent, '')")}) > 0 THEN 'human_reviewed'
    WHEN length({strip('ai_intent')}) > 0 THEN 'ai_suggested' ELSE '' END"""


@query("annotation_status", f"SELECT tweet_id, {STATUS} AS annotation_status FROM annotated")
def _(spark, d):
    return an.ensure_annotation_columns(views.annotated(spark, d)).select("tweet_id", "annotation_status")


PENDING = """length(trim(ai_intent)) = 0 OR coalesce(length(trim(ai_escalation)), 0) = 0
             OR length(trim(ai_confidence)) = 0"""


@query("pending_rows", f"SELECT tweet_id FROM annotated WHERE {PENDING}")
def _(spark, d):
    return an.pending_rows(views.annotated(spark, d)).select("tweet_id")


@query("pending_rows_limit", f"SELECT tweet_id FROM annotated WHERE {PENDING} ORDER BY tweet_id LIMIT 25")
def _(spark, d):
    return an.pending_rows(views.annotated(spark, d), 25).select("tweet_id")


MERGE_FIELDS = ["ai_intent", "ai_escalation", "ai_confidence", "ai_reason", "ai_source",
                "ai_disagrees_with_candidate", "ai_low_confidence", "annotation_status"]


def _predictions(spark, d):
    """Every open row of the sheet gets a new prediction or an error."""
    k = F.col("k")
    ok = k % 4 != 0
    return an.pending_rows(views.annotated(spark, d)).select(
        "tweet_id",
        F.when(ok, "c_fr").alias("intent"), F.when(ok, k % 2 == 0).alias("escalation"),
        F.when(ok, k % 101).alias("confidence"), F.when(ok, "new").alias("reason"),
        F.when(ok, "stub2").alias("source"),
        F.when(ok, F.col("candidate_intent") != "c_fr").alias("disagrees_with_candidate"),
        F.when(ok, k % 101 < 70).alias("low_confidence"),
        F.when(~ok, "no answer").alias("error"))


@query("merge_predictions", f"""
    SELECT tweet_id,
      CASE WHEN good THEN 'c_fr' ELSE ai_intent END AS ai_intent,
      CASE WHEN good THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END ELSE ai_escalation END AS ai_escalation,
      CASE WHEN good THEN CAST(k % 101 AS VARCHAR) ELSE ai_confidence END AS ai_confidence,
      CASE WHEN bad THEN 'no answer' WHEN good THEN 'new' ELSE ai_reason END AS ai_reason,
      CASE WHEN good THEN 'stub2' ELSE ai_source END AS ai_source,
      CASE WHEN good THEN CASE WHEN candidate_intent <> 'c_fr' THEN 'true' ELSE 'false' END
           ELSE ai_disagrees_with_candidate END AS ai_disagrees_with_candidate,
      CASE WHEN good THEN CASE WHEN k % 101 < 70 THEN 'true' ELSE 'false' END ELSE ai_low_confidence END AS ai_low_confidence,
      CASE WHEN bad THEN 'ai_failed'
           WHEN good AND annotation_status NOT IN ('human_reviewed', 'ai_bulk_accepted') THEN 'ai_suggested'
           ELSE annotation_status END AS annotation_status
    FROM (SELECT *, open AND k % 4 <> 0 AS good, open AND k % 4 = 0 AS bad
          FROM (SELECT *, ({PENDING}) AS open FROM annotated))""")
def _(spark, d):
    return an.merge_predictions(views.annotated(spark, d), _predictions(spark, d)).select(
        "tweet_id", *MERGE_FIELDS)


TAKE = f"length({strip("coalesce(gold_intent, '')")}) = 0 AND length({strip('ai_intent')}) > 0"


@query("accept_ai", f"""
    SELECT tweet_id, {TAKE} AS accepted,
           CASE WHEN {TAKE} THEN ai_intent ELSE gold_intent END AS gold_intent,
           CASE WHEN {TAKE} THEN lower({strip("coalesce(ai_escalation, '')")}) ELSE expected_escalation END AS expected_escalation,
           CASE WHEN {TAKE} AND length(annotation_notes) = 0 THEN {quoted(fixed.BULK_NOTE)} ELSE annotation_notes END AS annotation_notes
    FROM annotated""")
def _(spark, d):
    return an.accept_suggestions(views.annotated(spark, d)).select(
        "tweet_id", "accepted", "gold_intent", "expected_escalation", "annotation_notes")


@query("acceptance_counts", f"""
    SELECT count(*) FILTER (take) AS accepted, count(*) FILTER (NOT take) AS skipped,
           count(*) FILTER (take OR length({strip("coalesce(gold_intent, '')")}) > 0) AS labelled, count(*) AS rows
    FROM (SELECT *, {TAKE} AS take FROM annotated)""")
def _(spark, d):
    return an.acceptance_counts(an.accept_suggestions(views.annotated(spark, d)))


@query("apply_decisions", """
    SELECT tweet_id, CASE WHEN decided THEN 'other' ELSE gold_intent END AS gold_intent,
           CASE WHEN decided THEN CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END ELSE expected_escalation END AS expected_escalation,
           CASE WHEN decided THEN 'seen' ELSE annotation_notes END AS annotation_notes,
           CASE WHEN decided THEN 'human_reviewed' ELSE annotation_status END AS annotation_status
    FROM (SELECT *, annotation_status = 'ai_suggested' AS decided FROM annotated)""")
def _(spark, d):
    golden = views.annotated(spark, d)
    decisions = golden.where(F.col("annotation_status") == an.SUGGESTED).select(
        "tweet_id", F.lit("other").alias("gold_intent"), (F.col("k") % 3 == 0).alias("escalation"),
        F.lit("seen").alias("note"))
    return an.apply_decisions(golden, decisions).select(
        "tweet_id", "gold_intent", "expected_escalation", "annotation_notes", "annotation_status")


def _true(column: str) -> str:
    return f"coalesce(lower({strip(column)}) IN ('true', '1', 'yes'), false)"


QUEUE = f"""
    SELECT * FROM (SELECT tweet_id, customer_message, candidate_intent, gold_intent, expected_escalation, ai_intent,
      ai_escalation, ai_confidence, ai_reason, annotation_status, concat_ws(';',
        CASE WHEN length({strip('ai_intent')}) > 0 AND length({strip('gold_intent')}) > 0
             AND {strip('ai_intent')} <> {strip('gold_intent')} THEN 'ai_gold_intent_disagreement' END,
        CASE WHEN length({strip('ai_escalation')}) > 0 AND length({strip('expected_escalation')}) > 0
             AND {_true('ai_escalation')} <> {_true('expected_escalation')} THEN 'ai_gold_escalation_disagreement' END,
        CASE WHEN try_cast(ai_confidence AS DOUBLE) < 70 THEN 'low_ai_confidence' END,
        CASE WHEN {_true('ai_disagrees_with_candidate')} THEN 'candidate_disagreement' END,
        CASE WHEN annotation_status = 'ai_bulk_accepted' THEN 'bulk_accepted_not_human_reviewed' END) AS review_reason
    FROM annotated) WHERE review_reason <> ''"""


@query("review_queue", QUEUE)
def _(spark, d):
    return an.review_queue(views.annotated(spark, d))


@query("review_reason_counts", f"""
    SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(review_reason, ';')) AS reason FROM ({QUEUE}))
    GROUP BY 1""")
def _(spark, d):
    return an.review_reason_counts(an.review_queue(views.annotated(spark, d)))


@query("next_unreviewed", """
    SELECT tweet_id, annotation_status FROM annotated WHERE lower(trim(annotation_status)) <> 'human_reviewed'
    ORDER BY tweet_id LIMIT 1""")
def _(spark, d):
    return an.next_unreviewed(views.annotated(spark, d)).select("tweet_id", "annotation_status")


@query("annotation_summary", f"""
    SELECT count(*) AS rows, count(*) FILTER (length({strip('ai_intent')}) > 0) AS predicted,
           count(*) FILTER (length({strip("coalesce(gold_intent, '')")}) > 0) AS labelled,
           count(*) FILTER (lower(ai_disagrees_with_candidate) = 'true') AS disagreements,
           count(*) FILTER (lower(ai_low_confidence) = 'true') AS low_confidence,
           round(avg(try_cast(ai_confidence AS DOUBLE)), 6) AS confidence_mean,
           min(try_cast(ai_confidence AS DOUBLE)) AS confidence_min,
           max(try_cast(ai_confidence AS DOUBLE)) AS confidence_max
    FROM annotated""")
def _(spark, d):
    return an.annotation_summary(views.annotated(spark, d)).withColumn(
        "confidence_mean", F.round("confidence_mean", 6))


@query("status_counts", f"""
    SELECT coalesce(nullif({strip('annotation_status')}, ''), 'unset') AS value, count(*) AS n
    FROM annotated GROUP BY 1""")
def _(spark, d):
    return value_counts(views.annotated(spark, d), "annotation_status")


@query("review_progress", f"""
    WITH marked AS (SELECT *, lower(trim(annotation_status)) = 'human_reviewed' AS done FROM annotated)
    SELECT 'rows' AS kind, CASE WHEN done THEN 'reviewed' ELSE 'remaining' END AS value, count(*) AS n
    FROM marked GROUP BY 2
    UNION ALL SELECT 'gold_intent', gold_intent, count(*) FROM marked
    WHERE done AND length({strip('gold_intent')}) > 0 GROUP BY 2
    UNION ALL SELECT 'expected_escalation', expected_escalation, count(*) FROM marked
    WHERE done AND length({strip('expected_escalation')}) > 0 GROUP BY 2""")
def _(spark, d):
    return an.review_progress(views.annotated(spark, d))
