"""Text models of the caller's, applied to frames in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyloom import fixed_values as fixed
from replyloom.functions.prompts import label_prompt
from replyloom.functions.text import clean_response
from replyloom.operators.annotations import validate_annotations
from replyloom.session import cut_lineage

Provider = Callable[[str], str]

#: Rows whose answers are held at once.
ASKED_ROWS = 256


def complete(df: DataFrame, prompt: str, providers: Sequence[tuple[str, str, Provider]]) -> DataFrame:
    """Add answer, provider, model and error by asking (name, model, function) providers in order.

    The first answer that is not blank is taken. If every provider fails, ``error`` lists why and
    the row stays.
    """
    schema = T.StructType(
        [*df.schema.fields, *[T.StructField(c, T.StringType()) for c in ("answer", "provider", "model", "error")]]
    )

    def ask(text: str) -> tuple:
        problems = []
        for name, model, provider in providers:
            try:
                answer = (provider(text) or "").strip()
            except Exception as problem:  # a provider may fail in any way
                problems.append(f"{name}: {problem}")
                continue
            if answer:
                return answer, name, model, None
            problems.append(f"{name}: empty answer")
        return None, None, None, "All providers failed: " + "; ".join(problems)

    place = df.columns.index(prompt)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        # the other columns stay as they came, in Arrow
        for batch in batches:
            for start in range(0, batch.num_rows, ASKED_ROWS):
                some = batch.slice(start, ASKED_ROWS)
                answers = [ask(text) for text in some.column(place).to_pylist()]
                added = [pa.array([a[i] for a in answers], pa.string()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*some.columns, *added], names=schema.names)

    return df.mapInArrow(run, schema)


def generate_replies(df: DataFrame, prompt: str, providers: Sequence[tuple[str, str, Provider]]) -> DataFrame:
    """Add response, provider, model and error."""
    return complete(df, prompt, providers).withColumn("response", clean_response("answer")).drop("answer")


def annotate_with_retry(df: DataFrame, provider: Provider, source: str, taxonomy: Mapping[str, str],
                        message: str = "customer_message", candidate: str = "candidate_intent",
                        max_retries: int = fixed.MAX_RETRIES,
                        threshold: int = fixed.REVIEW_CONFIDENCE,
                        key: str = "tweet_id") -> DataFrame:
    """Ask for a label until it is valid, telling the former error, at most ``max_retries`` times more.

    Each round asks for all open rows at once and is written out, so no row is asked twice for the
    same attempt. Rows that never get a valid answer come back with their last error.
    """
    open_rows = df.select(key, message, candidate).withColumn(
        "previous_error", F.lit(None).cast("string")
    )
    finished = None
    for attempt in range(max_retries + 1):
        asked = open_rows.withColumn(
            "_prompt",
            label_prompt(F.col(message), F.col(candidate), taxonomy, F.col("previous_error")),
        )
        answered = complete(asked, "_prompt", [(source, source, provider)]).withColumnRenamed(
            "error", "call_error"
        )
        checked = validate_annotations(
            answered, "answer", candidate, list(taxonomy), threshold, F.lit(source), F.lit(attempt)
        ).withColumn("error", F.coalesce("call_error", "error"))
        done = cut_lineage(
            checked.select(
                key, message, candidate, "intent", "escalation", "confidence", "reason", "source",
                "disagrees_with_candidate", "low_confidence", "retry_count", "error",
            )
        )
        last = attempt == max_retries
        good = done if last else done.where(F.col("error").isNull())
        if last:
            good = good.withColumn(
                "error",
                F.when(F.col("error").isNotNull(), F.concat(
                    F.lit(f"Could not get valid annotation after {max_retries} retries: "), "error"
                )),
            )
        finished = good if finished is None else finished.unionByName(good)
        open_rows = done.where(F.col("error").isNotNull()).select(
            key, message, candidate, F.col("error").alias("previous_error")
        )
        if not last and open_rows.isEmpty():
            break
    return finished.drop(message, candidate)
