"""Annotation records: validation, provenance, review queue and progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom import fixed_values as fixed
from replyloom.functions.columns import settle
from replyloom.functions.text import (
    blank_to_null, bool_text, extract_json, extract_json_error, has_text, is_blank, normalize_bool,
    null_to_blank, strict_bool, strip, to_number, unfence_json,
)
from replyloom.schema import ANNOTATION_COLUMNS, require_columns, with_missing_columns

HUMAN, BULK, SUGGESTED, FAILED = "human_reviewed", "ai_bulk_accepted", "ai_suggested", "ai_failed"


# --- validation ---------------------------------------------------------------------------------

def _field(variant: Column, name: str) -> Column:
    return F.try_variant_get(variant, f"$.{name}", "string")


def _missing(variant: Column, names: Sequence[str]) -> Column:
    """Names of absent keys, sorted, as one text."""
    absent = [
        F.when(~F.array_contains(variant, F.lit(n)), F.lit(n)) for n in sorted(names)
    ]
    return F.concat_ws(", ", *absent)


def validate_annotations(df: DataFrame, raw: str = "raw", candidate: str = "candidate_intent",
                         taxonomy: Sequence[str] = tuple(fixed.INTENTS),
                         threshold: int = fixed.REVIEW_CONFIDENCE,
                         source: Column | None = None,
                         retry_count: Column | None = None) -> DataFrame:
    """Add the checked fields of a raw answer; ``error`` says what is wrong with a bad one.

    Bad rows stay, with NULL fields. The first failed check names the error: JSON, object, keys,
    class, boolean, integer, range, reason.
    """
    v = F.col("_json")
    required = ["intent", "escalation", "confidence", "reason"]
    absent = _missing(F.col("_keys"), required)
    intent, reason = strip(F.col("_intent")), strip(F.col("_reason"))
    escalation = strict_bool("_escalation")
    # an integer, or a number cut to one; text must be an integer
    number = F.when(
        F.col("_confidence_type") == "string",
        F.regexp_extract(strip(F.col("_confidence")), r"^[+-]?\d+$", 0).try_cast("bigint"),
    ).when(
        F.col("_confidence_type") == "boolean",
        F.when(F.col("_confidence") == "true", F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
    ).otherwise(F.col("_confidence").try_cast("double").try_cast("bigint"))
    bare_bool = F.col("_escalation_type").isin("boolean", "string")
    error = (
        F.when(F.col("_text").isNull(), F.col("_no_json"))
        .when(F.col("_keys").isNull(), F.lit("Response must be a JSON object."))
        .when(absent != "", F.concat(F.lit("Missing keys: "), absent))
        .when(~F.coalesce(intent.isin(list(taxonomy)), F.lit(False)),
              F.concat(F.lit("Invalid intent: "), F.coalesce(intent, F.lit("None"))))
        .when(escalation.isNull() | ~bare_bool, F.lit("escalation must be a boolean."))
        .when(number.isNull(), F.lit("confidence must be an integer."))
        .when((number < 0) | (number > 100), F.lit("confidence must be between 0 and 100."))
        .when(is_blank(F.col("_reason")), F.lit("reason must be non-empty."))
    )
    ok = F.col("error").isNull()
    schema = F.schema_of_variant
    fields = {
        "_text": extract_json(raw),
        "_no_json": extract_json_error(raw),
    }
    parsed = df.withColumns(fields).withColumn("_json", F.try_parse_json("_text"))
    is_object = F.col("_text").rlike(r"(?s)^\s*\{")
    keys = F.coalesce(F.json_object_keys("_text"), F.array().cast("array<string>"))
    parsed = settle(
        parsed,
        {
            "_keys": F.when(is_object, keys),
            "_intent": _field(v, "intent"),
            "_escalation": _field(v, "escalation"),
            "_confidence": _field(v, "confidence"),
            "_reason": _field(v, "reason"),
            "_escalation_type": F.lower(schema(F.try_variant_get(v, "$.escalation", "variant"))),
            "_confidence_type": F.lower(schema(F.try_variant_get(v, "$.confidence", "variant"))),
        },
    )
    checked = parsed.withColumn("error", error)
    out = checked.withColumns(
        {
            "intent": F.when(ok, intent),
            "escalation": F.when(ok, escalation),
            "confidence": F.when(ok, number),
            "reason": F.when(ok, reason),
            "disagrees_with_candidate": F.when(ok, intent != strip(null_to_blank(candidate))),
            "low_confidence": F.when(ok, number < threshold),
        }
    )
    if source is not None:
        out = out.withColumn("source", F.when(ok, source))
    if retry_count is not None:
        out = out.withColumn("retry_count", F.when(ok, retry_count))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def validate_judgements(df: DataFrame, raw: str = "raw",
                        dimensions: Sequence[str] = tuple(fixed.SCORE_DIMENSIONS)) -> DataFrame:
    """Add the scores and reason of a raw judgement, or ``error``; scores are integers 1 to 5."""
    v = F.col("_json")
    parsed = df.withColumn("_text", unfence_json(raw)).withColumn("_json", F.try_parse_json("_text"))
    keys = F.coalesce(F.json_object_keys("_text"), F.array().cast("array<string>"))
    kinds = {
        f"_kind_{d}": F.lower(F.schema_of_variant(F.try_variant_get(v, f"$.{d}", "variant")))
        for d in dimensions
    }
    values = {f"_value_{d}": F.try_variant_get(v, f"$.{d}", "bigint") for d in dimensions}
    parsed = settle(
        parsed,
        {"_bad": v.isNull(), "_keys": keys, "_reason": _field(v, "reason"), **kinds, **values},
    )
    error = F.when(F.col("_bad"), F.lit("Invalid JSON"))
    for name in [*dimensions, "reason"]:
        error = error.when(
            ~F.array_contains("_keys", F.lit(name)),
            F.lit(f"Judge response missing required field: {name}"),
        )
    for d in dimensions:
        whole = F.coalesce(F.col(f"_kind_{d}") == "bigint", F.lit(False))
        within = F.coalesce(F.col(f"_value_{d}").between(1, 5), F.lit(False))
        error = error.when(
            ~(whole & within), F.lit(f"Judge score '{d}' must be an integer from 1 to 5.")
        )
    out = parsed.withColumn("error", error)
    ok = F.col("error").isNull()
    out = out.withColumns(
        {**{d: F.when(ok, F.col(f"_value_{d}")) for d in dimensions},
         "reason": F.when(ok, F.col("_reason"))}
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


# --- lifecycle ------------------------------------------------------------------------------------

def annotation_status(bulk_note: str = fixed.BULK_NOTE) -> Column:
    """Status kept if set, else derived from note, gold label and suggestion, else blank."""
    return (
        F.when(has_text("annotation_status"), F.col("annotation_status"))
        .when(F.contains(null_to_blank("annotation_notes"), F.lit(bulk_note)), F.lit(BULK))
        .when(has_text("gold_intent"), F.lit(HUMAN))
        .when(has_text("ai_intent"), F.lit(SUGGESTED))
        .otherwise(F.lit(""))
    )


def ensure_annotation_columns(golden: DataFrame, bulk_note: str = fixed.BULK_NOTE) -> DataFrame:
    """Add missing annotation columns, blank for NULL, and the derived status."""
    full = with_missing_columns(golden, ANNOTATION_COLUMNS)
    return full.withColumns({c: null_to_blank(c) for c in ANNOTATION_COLUMNS}).withColumn(
        "annotation_status", annotation_status(bulk_note)
    )


def has_prediction() -> Column:
    return has_text("ai_intent") & has_text("ai_escalation") & has_text("ai_confidence")


def pending_rows(golden: DataFrame, limit: int | None = None, force: bool = False,
                 key: str = "tweet_id") -> DataFrame:
    """Rows without a full prediction, or all when forced; at most ``limit`` in key order."""
    rows = golden if force else golden.where(~has_prediction())
    return rows if limit is None else rows.orderBy(key).limit(limit)


def merge_predictions(golden: DataFrame, predictions: DataFrame, key: str = "tweet_id") -> DataFrame:
    """Write predictions or their errors into the golden rows.

    ``predictions`` has the key and intent, escalation, confidence, reason, source,
    disagrees_with_candidate, low_confidence, error. A reviewed or bulk-accepted status outlives a
    new prediction; an error sets status and reason and leaves the other fields.
    """
    p = predictions.select(
        F.col(key).alias("_key"),
        *[F.col(c).alias(f"_p_{c}") for c in (
            "intent", "escalation", "confidence", "reason", "source", "disagrees_with_candidate",
            "low_confidence", "error",
        )],
    )
    joined = golden.join(p, F.col(key) == F.col("_key"), "left")
    good = F.col("_key").isNotNull() & F.col("_p_error").isNull()
    bad = F.col("_p_error").isNotNull()

    def put(column: str, value: Column) -> Column:
        return F.when(good, value).otherwise(F.col(column))

    settled = strip(null_to_blank("annotation_status")).isin(HUMAN, BULK)
    updated = joined.withColumns(
        {
            "annotation_status": F.when(bad, F.lit(FAILED)).when(
                good & ~settled, F.lit(SUGGESTED)
            ).otherwise(F.col("annotation_status")),
            "ai_intent": put("ai_intent", F.col("_p_intent")),
            "ai_escalation": put("ai_escalation", bool_text("_p_escalation")),
            "ai_confidence": put("ai_confidence", F.col("_p_confidence").cast("string")),
            "ai_reason": F.when(bad, F.col("_p_error")).otherwise(put("ai_reason", F.col("_p_reason"))),
            "ai_source": put("ai_source", F.col("_p_source")),
            "ai_disagrees_with_candidate": put(
                "ai_disagrees_with_candidate", bool_text("_p_disagrees_with_candidate")
            ),
            "ai_low_confidence": put("ai_low_confidence", bool_text("_p_low_confidence")),
        }
    )
    return updated.drop(*[c for c in updated.columns if c.startswith("_p_")], "_key")


def accept_suggestions(golden: DataFrame, bulk_note: str = fixed.BULK_NOTE) -> DataFrame:
    """Take over the suggested label where there is no gold label; ``accepted`` marks those rows."""
    require_columns(
        golden,
        ["ai_intent", "ai_escalation", "gold_intent", "expected_escalation", "annotation_notes"],
    )
    take = F.col("accepted")
    return golden.withColumn("accepted", is_blank("gold_intent") & has_text("ai_intent")).withColumns(
        {
            "gold_intent": F.when(take, F.col("ai_intent")).otherwise(F.col("gold_intent")),
            "expected_escalation": F.when(
                take, F.lower(strip(null_to_blank("ai_escalation")))
            ).otherwise(F.col("expected_escalation")),
            "annotation_notes": F.when(
                take & is_blank("annotation_notes"), F.lit(bulk_note)
            ).otherwise(F.col("annotation_notes")),
        }
    )


def acceptance_counts(accepted: DataFrame) -> DataFrame:
    return accepted.agg(
        F.count_if("accepted").alias("accepted"),
        F.count_if(~F.col("accepted")).alias("skipped"),
        F.count_if(has_text("gold_intent")).alias("labelled"),
        F.count(F.lit(1)).alias("rows"),
    )


def apply_decisions(golden: DataFrame, decisions: DataFrame, key: str = "tweet_id") -> DataFrame:
    """Write human decisions (gold_intent, escalation, note) into their golden rows."""
    d = decisions.select(
        F.col(key).alias("_key"), F.col("gold_intent").alias("_gold"),
        F.col("escalation").alias("_escalation"), F.col("note").alias("_note"),
    )
    made = F.col("_key").isNotNull()
    return (
        golden.join(d, F.col(key) == F.col("_key"), "left")
        .withColumns(
            {
                "gold_intent": F.when(made, F.col("_gold")).otherwise(F.col("gold_intent")),
                "expected_escalation": F.when(made, bool_text("_escalation")).otherwise(
                    F.col("expected_escalation")
                ),
                "annotation_notes": F.when(made, null_to_blank("_note")).otherwise(
                    F.col("annotation_notes")
                ),
                "annotation_status": F.when(made, F.lit(HUMAN)).otherwise(F.col("annotation_status")),
            }
        )
        .drop("_key", "_gold", "_escalation", "_note")
    )


# --- review ---------------------------------------------------------------------------------------

REVIEW_COLUMNS = [
    "tweet_id", "customer_message", "candidate_intent", "gold_intent", "expected_escalation",
    "ai_intent", "ai_escalation", "ai_confidence", "ai_reason", "annotation_status",
]


def review_reason(threshold: int = fixed.REVIEW_CONFIDENCE) -> Column:
    """Why a row should be looked at, reasons joined by ``;``, blank if there is none."""
    named = fixed.REVIEW_REASONS
    class_differs = (
        has_text("ai_intent") & has_text("gold_intent")
        & (strip("ai_intent") != strip("gold_intent"))
    )
    escalation_differs = (
        has_text("ai_escalation") & has_text("expected_escalation")
        & (normalize_bool("ai_escalation") != normalize_bool("expected_escalation"))
    )
    checks = [
        class_differs,
        escalation_differs,
        to_number("ai_confidence") < threshold,
        normalize_bool("ai_disagrees_with_candidate"),
        F.col("annotation_status") == BULK,
    ]
    return F.concat_ws(";", *[F.when(c, F.lit(n)) for c, n in zip(checks, named, strict=True)])


def review_queue(golden: DataFrame, threshold: int = fixed.REVIEW_CONFIDENCE) -> DataFrame:
    require_columns(golden, [*REVIEW_COLUMNS, "ai_disagrees_with_candidate"])
    return (
        settle(golden, {"review_reason": review_reason(threshold)})
        .where(F.col("review_reason") != "")
        .select(*REVIEW_COLUMNS, "review_reason")
    )


def review_reason_counts(queue: DataFrame) -> DataFrame:
    return (
        queue.select(F.explode(F.split("review_reason", ";")).alias("reason"))
        .where(F.col("reason") != "")
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "reason")
    )


def next_unreviewed(golden: DataFrame, key: str = "tweet_id") -> DataFrame:
    """The first row in key order that no human has reviewed."""
    status = F.lower(strip(null_to_blank("annotation_status")))
    return golden.where(status != HUMAN).orderBy(key).limit(1)


# --- progress -------------------------------------------------------------------------------------

def annotation_summary(golden: DataFrame) -> DataFrame:
    """Predictions, gold labels, disagreements, low confidence and the spread of confidence."""
    flag = {
        c: F.coalesce(F.lower(F.col(c)) == "true", F.lit(False))
        for c in ("ai_disagrees_with_candidate", "ai_low_confidence")
    }
    confidence = to_number("ai_confidence")
    return golden.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(has_text("ai_intent")).alias("predicted"),
        F.count_if(has_text("gold_intent")).alias("labelled"),
        F.count_if(flag["ai_disagrees_with_candidate"]).alias("disagreements"),
        F.count_if(flag["ai_low_confidence"]).alias("low_confidence"),
        F.avg(confidence).alias("confidence_mean"),
        F.min(confidence).alias("confidence_min"),
        F.max(confidence).alias("confidence_max"),
    )


def review_progress(golden: DataFrame) -> DataFrame:
    """(kind, value, n): reviewed and remaining rows, then labels and routing of reviewed rows."""
    done = F.lower(strip(null_to_blank("annotation_status"))) == HUMAN
    state = F.when(done, F.lit("reviewed")).otherwise(F.lit("remaining"))
    entries = F.filter(
        F.array(
            F.struct(F.lit("rows").alias("kind"), state.alias("value")),
            F.when(done & blank_to_null("gold_intent").isNotNull(),
                   F.struct(F.lit("gold_intent").alias("kind"), F.col("gold_intent").alias("value"))),
            F.when(done & blank_to_null("expected_escalation").isNotNull(),
                   F.struct(F.lit("expected_escalation").alias("kind"),
                            F.col("expected_escalation").alias("value"))),
        ),
        lambda e: e.isNotNull(),
    )
    return (
        golden.select(F.inline(entries)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    )
