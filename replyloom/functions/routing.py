"""Ordered routing rules: answer automatically or hand the message to a person.

Only column expressions, so batch and streaming frames are routed by the same call.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom import fixed_values as fixed
from replyloom.functions.columns import settle
from replyloom.functions.lexicon import contains_any


@dataclass(frozen=True)
class RoutingRules:
    """Phrase lists and thresholds of the cascade, all replaceable."""

    high_risk: Sequence[str] = tuple(fixed.HIGH_RISK_PHRASES)
    prior_support: Sequence[str] = tuple(fixed.PRIOR_SUPPORT_PHRASES)
    repeat_words: Sequence[str] = tuple(fixed.REPEAT_WORDS)
    repeated_attempt: Sequence[str] = tuple(fixed.REPEATED_ATTEMPT_PHRASES)
    cashback: Sequence[str] = tuple(fixed.CASHBACK_PHRASES)
    financial: Sequence[str] = tuple(fixed.FINANCIAL_TERMS)
    unresolved: Sequence[str] = tuple(fixed.UNRESOLVED_TERMS)
    persistence: Sequence[str] = tuple(fixed.PERSISTENCE_TERMS)
    operational: Sequence[str] = tuple(fixed.OPERATIONAL_TERMS)
    private_support: Sequence[str] = tuple(fixed.PRIVATE_SUPPORT_PHRASES)
    positive: Sequence[str] = tuple(fixed.POSITIVE_PHRASES)
    other_class: str = fixed.OTHER_CLASS
    confidence_threshold: float = fixed.CONFIDENCE_THRESHOLD
    similarity_threshold: float = fixed.SIMILARITY_THRESHOLD
    short_phrase: int = fixed.SHORT_PHRASE
    reasons: dict = field(default_factory=lambda: dict(fixed.ROUTING_REASONS))


def phrase_matches(text: Column, phrase: str, short_phrase: int = fixed.SHORT_PHRASE) -> Column:
    """Short phrases match as whole words only, longer ones anywhere."""
    if len(phrase) <= short_phrase:
        return text.rlike(rf"(?U)\b{re.escape(phrase)}\b")
    return F.contains(text, F.lit(phrase))


def first_phrase(text: Column, phrases: Sequence[str],
                 short_phrase: int = fixed.SHORT_PHRASE) -> Column:
    """The first phrase, in list order, that matches; NULL if none does."""
    if not phrases:
        return F.lit(None).cast("string")
    return F.coalesce(
        *[F.when(phrase_matches(text, p, short_phrase), F.lit(p)) for p in phrases]
    )


def has_repeat_signal(text: Column, words: Sequence[str] = tuple(fixed.REPEAT_WORDS)) -> Column:
    """A number followed by one of the words, as in '3 times'."""
    return text.rlike(rf"(?U)\b\d+\s+(?:{'|'.join(words)})\b") if words else F.lit(False)


def co_occurs(text: Column, left: Sequence[str], right: Sequence[str]) -> Column:
    """At least one term of each list is present."""
    return contains_any(text, left) & contains_any(text, right)


def evidence_similarity(evidence: str | None, similarity: str | None) -> Column:
    """Given similarity, else that of the first evidence, else 0.0."""
    parts = []
    if similarity:
        parts.append(F.col(similarity).cast("double"))
    if evidence:
        parts.append(F.try_element_at(F.col(evidence), F.lit(1))["similarity"].cast("double"))
    return F.coalesce(*parts, F.lit(0.0))


def route(df: DataFrame, message: str = "customer_message", intent: str = "intent",
          confidence: str = "confidence", evidence: str | None = None,
          similarity: str | None = None, rules: RoutingRules | None = None,
          out: str = "decision") -> DataFrame:
    """Add ``struct<escalate, rule, reason>``: the first rule that applies, in order.

    1 high-risk phrase, 2 earlier support, 3 counted repetition, 4 repeated attempts,
    5 pending cashback, 6 unresolved payment, 7 persistent problem, 8 private support,
    9 the catch-all class (positive, unmapped, plain), 10 low confidence and weak evidence,
    11 weak evidence, 12 automatic.
    """
    r = rules or RoutingRules()
    text, sim, conf = F.col("_message"), F.col("_similarity"), F.col(confidence).cast("double")
    weak = sim < r.similarity_threshold
    low = conf < r.confidence_threshold
    is_other = F.col(intent) == r.other_class

    def outcome(escalate: bool, rule: str, reason: Column | None = None) -> Column:
        return F.struct(
            F.lit(escalate).alias("escalate"),
            F.lit(rule).alias("rule"),
            (F.lit(r.reasons[rule]) if reason is None else reason).alias("reason"),
        )

    cascade = [
        (F.col("_risk").isNotNull(),
         outcome(True, "high_risk", F.format_string(r.reasons["high_risk"], F.col("_risk")))),
        (contains_any(text, r.prior_support), outcome(True, "prior_support")),
        (has_repeat_signal(text, r.repeat_words), outcome(True, "repeat_signal")),
        (contains_any(text, r.repeated_attempt), outcome(True, "repeated_attempt")),
        (contains_any(text, r.cashback), outcome(True, "cashback")),
        (co_occurs(text, r.financial, r.unresolved), outcome(True, "financial")),
        (co_occurs(text, r.persistence, r.operational), outcome(True, "persistent")),
        (contains_any(text, r.private_support), outcome(True, "private")),
        (is_other & contains_any(text, r.positive), outcome(False, "other_positive")),
        (is_other & low & weak, outcome(True, "other_unmapped")),
        (is_other, outcome(False, "other_plain")),
        (low & weak,
         outcome(True, "low_both", F.format_string(r.reasons["low_both"], conf, sim))),
        (weak,
         outcome(True, "weak_evidence", F.format_string(
             r.reasons["weak_evidence"], sim, F.lit(float(r.similarity_threshold))))),
    ]
    decision = None
    for condition, result in cascade:
        decision = F.when(condition, result) if decision is None else decision.when(condition, result)
    prepared = (
        df.withColumn("_message", F.lower(F.col(message)))
        .withColumn("_similarity", evidence_similarity(evidence, similarity))
        .withColumn("_risk", first_phrase(F.col("_message"), r.high_risk, r.short_phrase))
    )
    return settle(prepared, {out: decision.otherwise(outcome(False, "auto"))}).drop(
        "_message", "_similarity", "_risk"
    )
