"""Scores of predicted classes, routing decisions, confidence and raters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyloom import fixed_values as fixed
from replyloom.session import literal_rows


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_counts(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """(truth, prediction, n): the only pass over the examples; all scores follow from it."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def label_scores(counts: DataFrame, by: Sequence[str] = (),
                 labels: Sequence[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of every label seen, or of the given ones."""
    hit = F.col("truth") == F.col("prediction")
    parts = F.array(
        F.struct(F.col("truth").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"), F.col("n").alias("support")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(~hit, F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("bigint").alias("support")),
    )
    summed = (
        counts.select(*by, F.inline(parts))
        .groupBy(*by, "label")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("support").alias("support"))
    )
    if labels is not None:
        given = literal_rows(summed.sparkSession, ["label"], [(x,) for x in labels])
        summed = given.join(summed, "label", "left").fillna({"tp": 0, "fp": 0, "support": 0})
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("support"))
    return (
        summed.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn(
            "f1", _ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("support"))
        )
        .select(*by, "label", "precision", "recall", "f1", "support", "tp")
    )


def per_class_report(df: DataFrame, truth: str, prediction: str,
                     labels: Sequence[str] | None = None) -> DataFrame:
    return label_scores(class_counts(df, truth, prediction), (), labels).drop("tp")


def tidy_report(sections: dict[str, DataFrame]) -> DataFrame:
    """All sections of a report as one table: section, the text columns of a row as its name, measure, value."""
    out = None
    for section, frame in sections.items():
        numeric = [f.name for f in frame.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
        names = [c for c in frame.columns if c not in numeric]
        values = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in numeric])
        part = frame.select(
            F.lit(section).alias("section"), F.concat_ws("/", *[F.col(c).cast("string") for c in names]).alias("name"),
            F.inline(values),
        )
        out = part if out is None else out.unionByName(part)
    return out


def classification_metrics(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = (),
                           labels: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """Accuracy, macro F1 and weighted F1.

    Macro F1 averages over the labels seen in either column, or over ``labels``; in the latter
    case accuracy still counts every example.
    """
    counts = class_counts(df, truth, prediction, by)
    return metrics_from_counts(counts, by, labels, digits)


def metrics_from_counts(counts: DataFrame, by: Sequence[str] = (),
                        labels: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    scores = label_scores(counts, by)
    f1, support = F.col("f1"), F.col("support")
    listed = F.lit(True) if labels is None else F.col("label").isin(list(labels))
    size = F.count(F.lit(1)) if labels is None else F.lit(len(labels))
    total = F.sum("support")
    return scores.groupBy(*by).agg(
        total.alias("examples"),
        F.round(_ratio(F.sum("tp"), total), digits).alias("accuracy"),
        F.round(
            _ratio(F.coalesce(F.sum(F.when(listed, f1)), F.lit(0.0)), size), digits
        ).alias("macro_f1"),
        F.round(
            _ratio(F.coalesce(F.sum(F.when(listed, f1 * support)), F.lit(0.0)),
                   F.sum(F.when(listed, support))), digits
        ).alias("weighted_f1"),
    )


def confusion_matrix(df: DataFrame, truth: str, prediction: str, labels: Sequence[str]) -> DataFrame:
    """(actual, predicted, n) for every pair of labels, zeros included."""
    cells = literal_rows(
        df.sparkSession, ["actual", "predicted"], [(a, p) for a in labels for p in labels]
    )
    counts = class_counts(df, truth, prediction)
    return cells.join(
        counts, (F.col("actual") == F.col("truth")) & (F.col("predicted") == F.col("prediction")), "left"
    ).select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def wide_confusion(matrix: DataFrame, labels: Sequence[str]) -> DataFrame:
    return matrix.groupBy("actual").pivot("predicted", list(labels)).sum("n")


def label_union(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Every label seen in either column, once."""
    return df.select(F.explode(F.array(truth, prediction)).alias("label")).distinct()


def binary_metrics(df: DataFrame, truth: str, prediction: str, digits: int = 4) -> DataFrame:
    """Scores of a yes/no decision, with missed and needless hand-overs as shares of all rows."""
    t, p = F.col(truth), F.col(prediction)
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"),
    )
    c = F.col
    return counts.select(
        c("n").alias("examples"),
        F.round(_ratio(c("tp") + c("tn"), c("n")), digits).alias("accuracy"),
        F.round(_ratio(c("tp"), c("tp") + c("fp")), digits).alias("precision"),
        F.round(_ratio(c("tp"), c("tp") + c("fn")), digits).alias("recall"),
        F.round(_ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")), digits).alias("f1"),
        F.round(_ratio(c("fn"), c("n")), digits).alias("false_auto_handle_rate"),
        F.round(_ratio(c("fp"), c("n")), digits).alias("false_escalation_rate"),
        (c("tp") + c("fp")).alias("predicted_escalations"),
        (c("tp") + c("fn")).alias("actual_escalations"),
    )


def confidence_buckets(df: DataFrame, truth: str, prediction: str, confidence: str = "confidence",
                       bins: Sequence[float] = tuple(fixed.CONFIDENCE_BINS),
                       names: Sequence[str] = tuple(fixed.CONFIDENCE_BIN_NAMES)) -> DataFrame:
    """Rows, accuracy and mean confidence per half-open bin; empty bins do not appear."""
    c = F.col(confidence)
    bucket = F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(bins, bins[1:], names, strict=False))):
        bucket = F.when((c >= low) & (c < high), F.lit(name)).otherwise(bucket)
    return (
        df.withColumn("bucket", bucket)
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("examples"),
            F.avg((F.col(truth) == F.col(prediction)).cast("double")).alias("accuracy"),
            F.avg(c).alias("mean_confidence"),
        )
    )


def confidence_by_correct(df: DataFrame, truth: str, prediction: str,
                          confidence: str = "confidence",
                          margin: str = "confidence_margin") -> DataFrame:
    return df.groupBy((F.col(truth) == F.col(prediction)).alias("correct")).agg(
        F.avg(confidence).alias("mean_confidence"), F.avg(margin).alias("mean_margin")
    )


def threshold_sweep(df: DataFrame, truth: str, prediction: str, confidence: str = "confidence",
                    thresholds: Sequence[float] = tuple(fixed.FALLBACK_THRESHOLDS),
                    fallback: str = fixed.OTHER_CLASS, digits: int = 6) -> DataFrame:
    """Scores when predictions below each threshold become the fallback class.

    Examples are first counted per (truth, prediction, stretch between thresholds); only those
    counts are repeated per threshold.
    """
    cuts = sorted(thresholds)
    stretch = sum((F.col(confidence) >= t).cast("int") for t in cuts)
    counts = df.groupBy(
        F.col(truth).alias("truth"), F.col(prediction).alias("prediction"), stretch.alias("stretch")
    ).agg(F.count(F.lit(1)).alias("n"))
    steps = F.array(
        *[F.struct(F.lit(float(t)).alias("threshold"), F.lit(i + 1).alias("at")) for i, t in enumerate(cuts)]
    )
    swept = counts.select("*", F.inline(steps)).withColumn("below", F.col("stretch") < F.col("at"))
    moved = (
        swept.withColumn(
            "prediction", F.when(F.col("below"), F.lit(fallback)).otherwise(F.col("prediction"))
        )
        .groupBy("threshold", "truth", "prediction")
        .agg(F.sum("n").alias("n"))
    )
    fallbacks = swept.groupBy("threshold").agg(
        F.sum(F.when(F.col("below"), F.col("n")).otherwise(0)).alias("fallbacks")
    )
    return metrics_from_counts(moved, ("threshold",), None, digits).join(fallbacks, "threshold").select(
        "threshold", "accuracy", "macro_f1", "fallbacks"
    )


def _unpivot(df: DataFrame, dimensions: Sequence[str], left: str, right: str) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.col(f"{d}_{left}").alias("a"),
                     F.col(f"{d}_{right}").alias("b"))
            for d in dimensions
        ]
    )
    return df.select(F.inline(pairs)).where(F.col("a").isNotNull() & F.col("b").isNotNull())


def join_raters(human: DataFrame, judge: DataFrame, dimensions: Sequence[str],
                key: str = "tweet_id") -> DataFrame:
    """Scores of both raters side by side; rows without a usable judgement have no partner."""
    judged = judge.dropna(subset=list(dimensions), how="all")
    return human.select(key, *[F.col(d).alias(f"{d}_human") for d in dimensions]).join(
        judged.select(key, *[F.col(d).alias(f"{d}_judge") for d in dimensions]), key
    )


def rater_agreement(joined: DataFrame,
                    dimensions: Sequence[str] = tuple(fixed.SCORE_DIMENSIONS)) -> DataFrame:
    """Share of equal scores and mean absolute difference per dimension."""
    rated = _unpivot(joined, dimensions, "human", "judge")
    return rated.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("examples"),
        F.avg((F.col("a") == F.col("b")).cast("double")).alias("exact_agreement"),
        F.avg(F.abs(F.col("a") - F.col("b")).cast("double")).alias("mean_absolute_difference"),
    )


def weighted_kappa(joined: DataFrame,
                   dimensions: Sequence[str] = tuple(fixed.SCORE_DIMENSIONS)) -> DataFrame:
    """Quadratically weighted kappa per dimension over the places of the scores observed.

    A score nobody gave takes no place, so distances follow the sorted scores in use. Rows are
    counted per pair of scores first; the ranking sees each score of a dimension once.
    """
    counts = (
        _unpivot(joined, dimensions, "human", "judge")
        .groupBy("dimension", "a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("dimension").orderBy("score")).cast("double")
    places = (
        counts.select("dimension", F.explode(F.array("a", "b")).alias("score"))
        .distinct()
        .withColumn("at", place)
    )
    i = places.select(F.col("dimension"), F.col("score").alias("a"), F.col("at").alias("i"))
    j = places.select(F.col("dimension"), F.col("score").alias("b"), F.col("at").alias("j"))
    n = F.col("n")

    def mean(x: Column) -> Column:
        return F.sum(x * n) / F.sum(n)

    observed = mean((F.col("i") - F.col("j")) * (F.col("i") - F.col("j")))
    expected = mean(F.col("i") * F.col("i")) + mean(F.col("j") * F.col("j")) - 2 * mean(
        F.col("i")
    ) * mean(F.col("j"))
    return (
        counts.join(i, ["dimension", "a"])
        .join(j, ["dimension", "b"])
        .groupBy("dimension")
        .agg((1 - F.try_divide(observed, expected)).alias("quadratic_weighted_kappa"))
    )


def judge_means(judged: DataFrame,
                dimensions: Sequence[str] = tuple(fixed.SCORE_DIMENSIONS)) -> DataFrame:
    """Mean score per dimension over the usable judgements."""
    scores = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score")) for d in dimensions]
    )
    return (
        judged.where(F.col("error").isNull())
        .select(F.inline(scores))
        .groupBy("dimension")
        .agg(F.avg(F.col("score").cast("double")).alias("mean_score"))
    )


def judge_counts(judged: DataFrame) -> DataFrame:
    return judged.agg(
        F.count(F.lit(1)).alias("examples"),
        F.count_if(F.col("error").isNull()).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def failure_counts(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count(F.lit(1)).alias("examples"),
        F.count_if("intent_failure").alias("intent_failures"),
        F.count_if("escalation_failure").alias("escalation_failures"),
    )


def failure_slices(flagged: DataFrame, threshold: float = fixed.FAILURE_CONFIDENCE) -> DataFrame:
    """Each example once per slice it belongs to: wrong class, wrong routing, low confidence."""
    named = F.filter(
        F.array(
            F.when(F.col("intent_failure"), F.lit("misclassified")),
            F.when(F.col("escalation_failure"), F.lit("misrouted")),
            F.when(F.col("confidence") < threshold, F.lit("low_confidence")),
        ),
        lambda s: s.isNotNull(),
    )
    return flagged.withColumn("slice", F.explode(named))


def escalation_cases(examples: DataFrame, truth: str = "expected_escalation",
                     prediction: str = "predicted_escalation") -> DataFrame:
    return examples.where(F.col(truth) | F.col(prediction))


def majority_class(df: DataFrame, label: str) -> DataFrame:
    """The most frequent label, the first in order of equals, as one row."""
    return (
        df.groupBy(F.col(label).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "label")
        .limit(1)
        .select("label")
    )


def predict_majority(train: DataFrame, test: DataFrame, label: str,
                     out: str = "predicted_intent") -> DataFrame:
    return test.withColumn(out, majority_class(train, label).scalar())


def predict_never(df: DataFrame, out: str = "predicted_escalation") -> DataFrame:
    return df.withColumn(out, F.lit(False))


def cross_validate_majority(folded: DataFrame, label: str, fold: str = "fold",
                            out: str = "predicted_intent") -> DataFrame:
    """Per fold, the majority label of the other folds, from one count per (fold, label)."""
    counts = folded.groupBy(fold, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    folds = counts.select(fold).distinct().agg(F.collect_set(fold).alias("folds"))
    grid = totals.withColumn(fold, F.explode(folds.scalar()))
    outside = (
        grid.join(counts, [fold, "label"], "left")
        .withColumn("rest", F.col("total") - F.coalesce("n", F.lit(0)))
        .where(F.col("rest") > 0)
        .groupBy(fold)
        .agg(F.min(F.struct((-F.col("rest")).alias("r"), "label")).alias("best"))
        .agg(F.map_from_entries(F.collect_list(F.struct(fold, "best.label"))).alias("answers"))
    )
    # an entry per fold: a lookup in the row, no join on a key with a handful of values
    return folded.withColumn(out, F.try_element_at(outside.scalar(), F.col(fold)))
