"""Prompt texts put together from columns; the wording is a parameter."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from replyloom.functions.text import null_to_blank, strip

REPLY_TEMPLATE = """Reply to a customer of the support desk.

Message:
{message}

Class:
{intent}

How similar messages were answered before:

{evidence}

Rely on these answers. Promise nothing they do not show, claim no action, and keep it short.
Return the reply only."""

SCORE_TEMPLATE = """Score the reply from 1 to 5 on grounding, resolution_correctness, relevance, safety,
style and overall, and give a reason, as one JSON object with these seven fields.

Message:
{message}

Evidence:
{evidence}

Reply:
{response}"""

LABEL_TEMPLATE = """Choose the one class that fits the main problem of the message.

Classes:
{taxonomy}

Return one JSON object with the keys intent, escalation, confidence (0 to 100) and reason.

A first guess, which may be wrong: {candidate}

Message:
{message}
{retry}"""

RETRY_TEMPLATE = """
The previous answer could not be used: {error}
Return corrected JSON only."""


def fill_raw(template: str, values: Mapping[str, Column]) -> Column:
    """Replace each ``{name}`` known in ``values`` by its column; NULL counts as empty."""
    parts = re.split(r"\{(" + "|".join(map(re.escape, values)) + r")\}", template)
    return F.concat(
        *[
            null_to_blank(values[part]) if position % 2 else F.lit(part)
            for position, part in enumerate(parts)
        ]
    )


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """As :func:`fill_raw`, stripped at both ends."""
    return strip(fill_raw(template, values))


def evidence_block(evidence: Column, limit: int = 3) -> Column:
    """The first ``limit`` pairs; a pair with a blank side is left out but keeps its number."""
    numbered = F.transform(
        F.slice(evidence, 1, limit),
        lambda e, i: F.struct(
            (i + 1).alias("n"),
            strip(null_to_blank(e["customer_message"])).alias("q"),
            strip(null_to_blank(e["historical_response"])).alias("a"),
        ),
    )
    used = F.filter(numbered, lambda e: (e["q"] != "") & (e["a"] != ""))
    lines = F.transform(
        used,
        lambda e: F.concat(
            F.lit("Example "), e["n"].cast("string"), F.lit(":\nCustomer: "), e["q"],
            F.lit("\nHistorical support response: "), e["a"],
        ),
    )
    return F.coalesce(F.array_join(lines, "\n\n"), F.lit(""))


def reply_prompt(message: Column, intent: Column, evidence: Column,
                 template: str = REPLY_TEMPLATE, limit: int = 3) -> Column:
    """Prompt for drafting a reply from retrieved pairs."""
    return fill(
        template, {"message": message, "intent": intent, "evidence": evidence_block(evidence, limit)}
    )


def score_prompt(message: Column, evidence: Column, response: Column,
                 template: str = SCORE_TEMPLATE) -> Column:
    """Prompt for scoring a reply; all evidence, similarity with three decimals."""
    items = F.transform(
        evidence,
        lambda e: F.concat(
            F.lit("Historical customer message:\n"), null_to_blank(e["customer_message"]),
            F.lit("\n\nHistorical support response:\n"), null_to_blank(e["historical_response"]),
            F.lit("\n\nSimilarity:\n"),
            F.format_string("%.3f", F.coalesce(e["similarity"].cast("double"), F.lit(0.0))),
        ),
    )
    block = F.coalesce(F.array_join(items, "\n\n---\n\n"), F.lit(""))
    return fill(template, {"message": message, "evidence": block, "response": response})


def label_prompt(message: Column, candidate: Column, taxonomy: Mapping[str, str],
                 previous_error: Column | None = None, template: str = LABEL_TEMPLATE,
                 retry_template: str = RETRY_TEMPLATE) -> Column:
    """Prompt for labelling a message; a former error is told on the next attempt."""
    bullets = "\n".join(f"- {name}: {text}" for name, text in taxonomy.items())
    retry = F.lit("")
    if previous_error is not None:
        retry = F.when(
            previous_error.isNotNull(), fill_raw(retry_template, {"error": previous_error})
        ).otherwise(F.lit(""))
    return fill(
        template,
        {"taxonomy": F.lit(bullets), "candidate": candidate, "message": message, "retry": retry},
    )
