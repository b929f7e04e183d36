"""Toxicity of texts: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import cut_lineage, fold, free_name, kept, sliced, texts, with_text_struct

#: Pronouns of the second person.
SECOND_PERSON = {
    "en": ["you", "your", "yours", "yourself", "u", "ur"],
    "de": ["du", "dich", "dir", "dein", "deine", "deiner", "euch", "ihr"],
    "fr": ["tu", "te", "toi", "ton", "ta", "tes", "vous", "votre"],
    "es": ["tú", "ti", "te", "tu", "tus", "usted", "vos", "ustedes"],
}
#: Signs that stand for letters.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

WORD = re.compile(r"[^\W\d_]+")
#: Signs and digits in front of a letter, as in words written to slip past a list.
SIGN = re.compile(r"[0134578@$!*.\-_](?=[^\W\d_])")

FEATURES = (
    "log_words", "lexicon_density", "stem_density", "lexicon_hits", "weight_density", "top_weight",
    "near_second_person", "second_person", "capitals", "capital_words", "exclamations", "punctuation",
    "disguised", "disguised_hits", "long_runs", "hits_in_window",
)


@dataclass
class ToxicityModel:
    """``trees`` and ``calibration`` are None where the labels did not hold both values; then every
    score is ``rate``."""

    lexicon: dict[str, float]
    trees: Any
    calibration: Any
    rate: float


def stems(word: str, lengths=(5, 7)) -> list[str]:
    return [word[:n] + "*" for n in lengths if len(word) > n]


def word_counts(sample: DataFrame, parts: int) -> DataFrame:
    """``word, bad, good``: in how many texts of each label, by ``part`` of the sample (two arrays), a word occurs, or
    a stem (ending in ``*``)."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in sliced(batches, "text", 2 << 20):
            counts: Counter = Counter()
            for text, toxic, part in zip(*(batch[c].to_pylist() for c in ("text", "toxic", "part"))):
                words = set(WORD.findall(text.lower()))
                words |= {s for w in words for s in stems(w)}
                counts.update([(w, toxic, part) for w in words if len(w) <= 64])
            words, labels, places = zip(*counts) if counts else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(labels, pa.int32()), pa.array(places, pa.int32()),
                 pa.array(list(counts.values()), pa.int64())], names=["word", "toxic", "part", "n"],
            )

    counted = sample.select("text", "toxic", "part").mapInArrow(run, "word string, toxic int, part int, n long")
    of = lambda label: F.array(*[
        F.sum(F.when((F.col("toxic") == label) & (F.col("part") == p), F.col("n")).otherwise(0)) for p in range(parts)
    ])
    return counted.groupBy("word").agg(of(1).alias("bad"), of(0).alias("good"))


def learn_lexicon(counts: DataFrame, sizes: list[tuple[int, int]], without: int | None, size: int, least: int, odds: float) -> dict[str, float]:
    """The ``size`` words and stems with the highest log odds of a toxic text, from at least ``least`` such texts.

    ``sizes`` are the numbers of toxic and other texts of each part; part ``without`` is left out.
    """
    used = [p for p in range(len(sizes)) if p != without]
    all_bad, all_good = (sum(sizes[p][i] for p in used) for i in (0, 1))
    bad, good = (sum((F.get(c, F.lit(p)) for p in used), F.lit(0)) for c in ("bad", "good"))
    rows = counts.select("word", bad.alias("bad"), good.alias("good")).filter(F.col("bad") >= least)
    weight = F.log((F.col("bad") + 0.5) / (all_bad + 1.0)) - F.log((F.col("good") + 0.5) / (all_good + 1.0))
    # Weights of rare words are drawn to zero.
    rows = rows.withColumn("weight", weight * F.col("bad") / (F.col("bad") + 4.0)).filter(F.col("weight") >= odds)
    return {r["word"]: r["weight"] for r in rows.orderBy(F.desc("weight"), "word").limit(size).collect()}


def disguised_words(text: str) -> list[str]:
    """What stands between blanks and has a sign or digit between letters, or in front of three."""
    found, end = [], -1
    for match in SIGN.finditer(text):
        at = match.start()
        if at < end:
            continue
        if at and text[at - 1].isalpha() or not (at and text[at - 1].isalnum()) and text[at + 1:at + 4].isalpha() and len(text) > at + 3 and text[at] in "013457@$":
            start, end = text.rfind(" ", 0, at) + 1, text.find(" ", at)
            end = len(text) if end < 0 else end
            found.append(text[start:end])
    return found


def letter_kinds():
    """A number for every code point: 0 for no letter, 1 for a letter, 3 for a capital."""
    import sys

    import numpy as np

    signs = map(chr, range(sys.maxunicode + 1))
    return np.fromiter((c.isalpha() + 2 * c.isupper() if c.isalpha() else 0 for c in signs), np.uint8, sys.maxunicode + 1)


def feature_arrays(values: list[str], lexicon: dict[str, float]) -> list:
    """One Arrow array of features for each text. Every feature is counted in every text, in all alphabets."""
    import numpy as np
    import pyarrow as pa

    kinds = kept("letter kinds", (), letter_kinds)
    second = {w for words in SECOND_PERSON.values() for w in words}
    memory = kept("toxic words", tuple(lexicon.items()), lambda: {"seen": set(), "weights": {}})
    seen, weights = memory["seen"], memory["weights"]
    if len(seen) > 200_000:
        seen.clear()

    def look_up(words):
        """Adds to ``weights`` the weight of a word in the lexicon, or of its best stem there."""
        for word in words:
            if len(word) <= 64:
                found = lexicon.get(word)
                stem = max((lexicon.get(s, 0.0) for s in stems(word)), default=0.0) if found is None else 0.0
                if found or stem:
                    weights[word] = (found or stem, bool(found))
        seen.update(words)

    disguise = str.maketrans(DISGUISES | {c: "" for c in "*.-_8"})
    out = np.zeros((len(values), len(FEATURES)))
    all_words, shouted = [], []
    new: set = set()
    for text in values:
        words = WORD.findall(text)
        shouted.append(sum(map(str.isupper, words)))
        all_words.append(list(map(str.lower, words)))
        new.update(all_words[-1])
    look_up(new - seen)
    for row, (text, words, capital_words) in enumerate(zip(values, all_words, shouted)):
        if not words:
            continue
        n = len(words)
        # Code points: one byte each in ASCII texts.
        data = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = kinds[data]
        letters, capitals = np.count_nonzero(kind), np.count_nonzero(kind == 3)
        run = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (kind[2:] > 0)
        present = not weights.keys().isdisjoint(words)
        marks = [(i, weights[w]) for i, w in enumerate(words) if w in weights] if present else []
        second_at = [] if second.isdisjoint(words) else [i for i, w in enumerate(words) if w in second]
        full = sum(1 for _, (_, whole) in marks if whole)
        near = at = 0
        for i, _ in marks:
            while at < len(second_at) and second_at[at] < i - 5:
                at += 1
            near += at < len(second_at) and second_at[at] <= i + 5
        window = start = 0
        for end in range(len(marks)):
            while marks[end][0] - marks[start][0] > 100:
                start += 1
            window = max(window, end - start + 1)
        hidden = [w.lower().translate(disguise).strip(",;:?\"'()") for w in disguised_words(text)]
        look_up(set(hidden) - seen)
        weight = [w for _, (w, _) in marks]
        out[row] = (
            math.log1p(n), 100 * full / n, 100 * (len(marks) - full) / n, math.log1p(len(marks)), 100 * sum(weight) / n,
            max(weight, default=0.0), near / max(1, len(marks)), len(second_at) / n, capitals / max(1, letters),
            capital_words / n, 100 * text.count("!") / len(text), 100 * sum(map(text.count, ".,;:?'\"")) / len(text),
            100 * len(hidden) / n, 100 * sum(w in weights for w in hidden) / n, 100 * int(run.sum()) / n, math.log1p(window),
        )
    flat = pa.array(out.ravel(), pa.float64())
    return [pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES)), pa.int32()), flat)]


def with_features(docs: DataFrame, lexicon: dict[str, float], name: str) -> DataFrame:
    return with_text_struct(docs, name, "features array<double>", lambda values: feature_arrays(values, lexicon))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, sample_rows: int = 20_000,
    trees: int = 20, depth: int = 4, parts: int = 4, lexicon_size: int = 500, least: int = 4, odds: float = 1.5, seed: int = 7,
) -> ToxicityModel:
    """Lexicon, trees and calibration from a bounded sample of labelled documents.

    About ``sample_rows`` labelled documents, chosen by a hash of their id, outside the held fold, in ``parts``
    parts. The features that the trees see of a part come from the lexicon of the other parts, as they will for new
    texts. The last part calibrates what the trees learn from the others. Null labels and ids are left out; of
    several labels of one document the higher counts. Words of more than 64 letters are not learned. Without both labels the model is the rate of label 1, or 0
    without labels.
    """
    marked = (
        labels.select(labels["doc_id"].cast("long").alias("label_id"), labels["toxic"].cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & (fold("label_id", folds) != held_fold))
        .groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    )
    total = marked.count()
    share = min(1.0, sample_rows / max(1, total))
    place = F.pmod(F.xxhash64("label_id"), F.lit(1_000_000))
    chosen = marked.filter(place < share * 1_000_000)
    sample = cut_lineage(
        texts(docs).join(chosen, F.col("doc_id") == F.col("label_id"))
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
        .withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(parts)).cast("int"))
    )
    sizes = [[0, 0] for _ in range(parts)]
    for row in sample.groupBy("part", "toxic").count().collect():
        sizes[row["part"]][1 - row["toxic"]] += row["count"]
    bad, good = (sum(s[i] for s in sizes) for i in (0, 1))
    rate = bad / max(1, bad + good)
    if not bad or not good:
        return ToxicityModel({}, None, None, rate)
    counts = cut_lineage(word_counts(sample, parts).filter(F.aggregate("bad", F.lit(0).cast("long"), lambda a, x: a + x) >= least))
    lexicon, *of_parts = [
        learn_lexicon(counts, sizes, p, lexicon_size, max(2, least if p is None else least * (parts - 1) // parts), odds)
        for p in (None, *range(parts))
    ]
    ready = reduce(DataFrame.unionByName, [
        with_features(sample.filter(F.col("part") == p), of_parts[p], "found").select(
            "part", array_to_vector("found.features").alias("features"), F.col("toxic").cast("double").alias("label")
        ) for p in range(parts)
    ])
    ready = cut_lineage(ready.coalesce(8))
    learned = ready.filter(F.col("part") < parts - 1)
    if learned.select("label").distinct().count() < 2:
        learned = ready
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, maxBins=64).fit(learned)
    judged = model.transform(ready.filter(F.col("part") == parts - 1)).select("label", vector_to_array("probability")[1].alias("raw"))
    if judged.isEmpty():
        return ToxicityModel(lexicon, model, None, rate)
    # Two rows keep the ends apart where few rows calibrate.
    ends = judged.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "label double, raw double")
    # Equal raw scores are one weighted row, so that none brings its rows to one task.
    steps = judged.union(ends).groupBy("raw").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("n"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="n").fit(steps)
    return ToxicityModel(lexicon, model, calibration, rate)


def with_toxicity(docs: DataFrame, model: ToxicityModel, name: str = "toxicity", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` and a struct ``name`` of ``score`` (0 to 1) and ``predicted`` (0 or 1).

    Whole texts are scored; null and empty ones have all features zero. Labels, language, source and id
    have no part in a score. Repeated rows have equal scores.
    """
    def result(score):
        return F.struct(score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted")).alias(name)

    if model.trees is None:
        return docs.select("*", result(F.lit(float(model.rate))))
    found, vector, raw, score = (free_name(docs, n) for n in ("found_features", "vector", "raw", "calibrated"))
    scored = with_features(docs, model.lexicon, found).select(
        *docs.columns, array_to_vector(F.col(found)["features"]).alias(vector)
    )
    trees = model.trees.copy({model.trees.featuresCol: vector, model.trees.rawPredictionCol: "", model.trees.predictionCol: "",
                              model.trees.probabilityCol: raw})
    scored = trees.transform(scored).withColumn(raw, vector_to_array(raw)[1])
    if model.calibration is None:
        return scored.select(*docs.columns, result(F.col(raw)))
    calibration = model.calibration.copy({model.calibration.featuresCol: raw, model.calibration.predictionCol: score})
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    return calibration.transform(scored).select(*docs.columns, result(value))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted``: a row for each row of ``docs``, as above."""
    return with_toxicity(texts(docs), model, "found", threshold).select("doc_id", "found.*")
