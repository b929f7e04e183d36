"""Phrase lists per class, compiled to column expressions.

A lexicon is a parameter of the plan, like a list of columns. It is bounded: a table of phrases
larger than ``MAX_PHRASES`` rows is refused rather than pulled into the plan; it belongs into a
:class:`~replyloom.operators.phrase_tables.PhraseTable`, which takes lists of any size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom import fixed_values as fixed
from replyloom.functions.columns import settle
from replyloom.functions.text import normalize_text

MAX_PHRASES = 10_000


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    """True when at least one phrase is a substring of ``text``."""
    if not phrases:
        return F.lit(False)
    listed = F.array(*[F.lit(p) for p in phrases])
    return F.exists(listed, lambda p: F.contains(text, p))


def count_present(text: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases are substrings of ``text``, each counted once."""
    if not phrases:
        return F.lit(0)
    listed = F.array(*[F.lit(p) for p in phrases])
    return F.size(F.filter(listed, lambda p: F.contains(text, p)))


class Lexicon:
    """Classes in order, each with its phrases; the order breaks ties."""

    def __init__(self, phrases: Mapping[str, Sequence[str]]):
        self.phrases = {name: list(words) for name, words in phrases.items()}
        if sum(map(len, self.phrases.values())) > MAX_PHRASES:
            raise ValueError(f"a lexicon holds at most {MAX_PHRASES} phrases; a PhraseTable holds any number")

    @classmethod
    def from_frame(cls, rows: DataFrame) -> Lexicon:
        """Read (class, class_ord, phrase, phrase_ord) rows; refuses more than ``MAX_PHRASES``."""
        found = (
            rows.select("class", "class_ord", "phrase", "phrase_ord").limit(MAX_PHRASES + 1).collect()
        )
        if len(found) > MAX_PHRASES:
            raise ValueError(f"a lexicon holds at most {MAX_PHRASES} phrases; a PhraseTable holds any number")
        phrases: dict[str, list[str]] = {}
        for row in sorted(found, key=lambda r: (r["class_ord"], r["phrase_ord"])):
            phrases.setdefault(row["class"], []).append(row["phrase"])
        return cls(phrases)

    @property
    def classes(self) -> list[str]:
        return list(self.phrases)

    def matching_classes(self, normalized: Column) -> Column:
        """Classes with at least one phrase in the text, in lexicon order."""
        hits = [
            F.when(contains_any(normalized, words), F.lit(name))
            for name, words in self.phrases.items()
        ]
        return F.filter(F.array(*hits), lambda c: c.isNotNull())

    def scores(self, text: Column, multi_word_weight: int = 1) -> Column:
        """Array of (score, tie, class); the largest element is the best class."""
        entries = []
        for position, (name, words) in enumerate(self.phrases.items()):
            if multi_word_weight == 1:
                score = count_present(text, words)
            else:
                single = [w for w in words if " " not in w]
                multi = [w for w in words if " " in w]
                score = count_present(text, single) + multi_word_weight * count_present(text, multi)
            entries.append(
                F.struct(
                    score.cast("int").alias("score"),
                    F.lit(-position).alias("tie"),
                    F.lit(name).alias("class"),
                )
            )
        return F.array(*entries)


def match_lexicon(df: DataFrame, text: str, lexicon: Lexicon, out: str = "classes",
                  ascii_only: bool = False) -> DataFrame:
    """Add the array of matching classes."""
    clean = df.withColumn("_norm", normalize_text(text, ascii_only))
    return settle(clean, {out: lexicon.matching_classes(F.col("_norm"))}).drop("_norm")


def label_weakly(df: DataFrame, text: str, lexicon: Lexicon,
                 other_phrases: Sequence[str] = tuple(fixed.OTHER_PHRASES),
                 out: str = "intent", other: str = fixed.OTHER_CLASS,
                 ascii_only: bool = False) -> DataFrame:
    """Add the only matching class; ``other`` if none matches but an other-phrase does; or NULL."""
    hits = F.col("_hits")
    label = F.when(F.size(hits) == 1, F.element_at(hits, 1)).when(
        (F.size(hits) == 0) & contains_any(F.col("_norm"), other_phrases), F.lit(other)
    )
    clean = df.withColumn("_norm", normalize_text(text, ascii_only))
    hit = clean.withColumn("_hits", lexicon.matching_classes(F.col("_norm")))
    return settle(hit, {out: label}).drop("_norm", "_hits")


def add_candidate(df: DataFrame, text: str, lexicon: Lexicon, out: str = "candidate_intent",
                  score_out: str = "keyword_score", default: str = fixed.OTHER_CLASS) -> DataFrame:
    """Add the class with most phrases present and its score; the default class with 0 if none."""
    best = F.col("_best")
    scored = df.withColumn("_lower", F.lower(F.col(text))).withColumn(
        "_best", F.array_max(lexicon.scores(F.col("_lower")))
    )
    return settle(
        scored,
        {
            out: F.when(best["score"] > 0, best["class"]).otherwise(F.lit(default)),
            score_out: F.greatest(best["score"], F.lit(0)),
        },
    ).drop("_lower", "_best")


def rank_candidates(df: DataFrame, text: str, lexicon: Lexicon, out: str = "candidates",
                    default: str = fixed.OTHER_CLASS) -> DataFrame:
    """Add all classes with a phrase present as (class, score), best first."""
    ranked = F.transform(
        F.sort_array(F.filter(F.col("_scores"), lambda s: s["score"] > 0), asc=False),
        lambda s: F.struct(s["class"].alias("class"), s["score"].alias("score")),
    )
    fallback = F.array(F.struct(F.lit(default).alias("class"), F.lit(0).alias("score")))
    return (
        df.withColumn("_lower", F.lower(F.col(text)))
        .withColumn("_scores", lexicon.scores(F.col("_lower")))
        .withColumn(out, F.when(F.size(ranked) > 0, ranked).otherwise(fallback))
        .drop("_lower", "_scores")
    )


def infer_class(df: DataFrame, text: str, lexicon: Lexicon, out: str = "inferred",
                unknown: str = fixed.UNKNOWN_CLASS, multi_word_weight: int = 2) -> DataFrame:
    """Add the class with the largest weighted score, the first of equals; ``unknown`` if none."""
    best = F.col("_best")
    scored = df.withColumn("_lower", F.lower(F.col(text))).withColumn(
        "_best", F.array_max(lexicon.scores(F.col("_lower"), multi_word_weight))
    )
    found = F.when(best["score"] > 0, best["class"]).otherwise(F.lit(unknown))
    return settle(scored, {out: found}).drop("_lower", "_best")


def override_class(text: Column, signals: Sequence[str] = tuple(fixed.OVERRIDE_SIGNALS),
                   subjects: Sequence[str] = tuple(fixed.OVERRIDE_SUBJECTS),
                   phrases: Sequence[str] = tuple(fixed.OVERRIDE_PHRASES),
                   label: str = fixed.OVERRIDE_CLASS) -> Column:
    """The fixed class for a signal together with a subject, or for a phrase; else NULL."""
    both = contains_any(text, signals) & contains_any(text, subjects)
    return F.when(both | contains_any(text, phrases), F.lit(label))
