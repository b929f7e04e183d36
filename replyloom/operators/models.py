"""Multinomial logistic regression over text, with a fixed class for explicit phrases."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import astuple

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.functions.lexicon import override_class
from replyloom.functions.text import normalize_text
from replyloom.operators.features import CLASSIFIER, Tfidf, TfidfSettings, assemble, class_weights
from replyloom.operators.sampling import assign_folds
from replyloom.schema import require_columns
from replyloom.session import cut_lineage

MAX_CLASSES = 1_000
KIND = "replyloom.text_classifier"


class TextClassifier:
    """Logistic regression over TF-IDF, an embedding column, or both side by side.

    ``settings=None`` leaves out TF-IDF; the text then only serves the override phrases.
    """

    def __init__(self, settings: TfidfSettings | None = CLASSIFIER, embedding: str | None = None,
                 max_iter: int = 1000, balanced: bool = True):
        if settings is None and embedding is None:
            raise ValueError("a classifier needs TF-IDF settings or an embedding column")
        self.settings, self.embedding = settings, embedding
        self.max_iter, self.balanced = max_iter, balanced
        self.classes: list[str] | None = None
        self.tfidf: Tfidf | None = None
        self.model: LogisticRegressionModel | None = None

    def _features(self, df: DataFrame, text: str) -> DataFrame:
        if self.settings is None:
            return df.withColumn(
                "features", array_to_vector(F.col(self.embedding).cast("array<double>"))
            )
        if self.embedding is None:
            return self.tfidf.transform(df, text, "features")
        return assemble(self.tfidf.transform(df, text, "_tfidf"), self.embedding, "_tfidf").drop("_tfidf")

    def fit(self, df: DataFrame, text: str = "text", label: str = "intent") -> TextClassifier:
        """Fit on the rows that have text and label; at least two classes are needed."""
        read = [self.embedding if self.settings is None else text, label]
        needed = [*read, self.embedding] if self.embedding and self.settings else read
        require_columns(df, needed)
        rows = df.select(needed).dropna(subset=read)
        weights = class_weights(rows, label).limit(MAX_CLASSES + 1).collect()
        if not weights:
            raise ValueError("no row to train on")
        if len(weights) < 2:
            raise ValueError("one class only: nothing to tell apart")
        if len(weights) > MAX_CLASSES:
            raise ValueError(f"at most {MAX_CLASSES} classes")
        total = sum(w["n"] for w in weights)
        self.classes = sorted(w["label"] for w in weights)
        weight = F.create_map(*[F.lit(x) for w in weights for x in (w["label"], w["weight"])])
        if self.settings is not None:
            self.tfidf = Tfidf.fit(rows, text, self.settings)
        names = F.array(*[F.lit(c) for c in self.classes])
        train = self._features(rows, text).select(
            "features",
            (F.array_position(names, F.col(label)) - 1).cast("double").alias("y"),
            (weight[F.col(label)] if self.balanced else F.lit(1.0)).alias("w"),
        )
        # the penalty matches an inverse strength of one per training row
        regression = LogisticRegression(
            labelCol="y", weightCol="w", family="multinomial", maxIter=self.max_iter,
            regParam=1.0 / total, elasticNetParam=0.0, standardization=False,
        )
        train = train.persist()
        try:
            self.model = regression.fit(train)
        finally:
            train.unpersist()
        return self

    def _check(self) -> None:
        if self.model is None:
            raise RuntimeError("fit or load the classifier first")

    def predict(self, df: DataFrame, text: str = "text",
                override: Callable[[Column], Column] | None = override_class) -> DataFrame:
        """Add probabilities, predicted_intent and confidence.

        A message with an explicit override phrase gets that class with probability one.
        """
        self._check()
        names = F.array(*[F.lit(c) for c in self.classes])
        scored = self.model.transform(self._features(df, text)).withColumn(
            "probabilities", vector_to_array("probability")
        ).drop("features", "rawPrediction", "probability", "prediction")
        if override is None or text not in df.columns:
            fixed_class = F.lit(None).cast("string")
        else:
            fixed_class = override(normalize_text(text))
        scored = scored.withColumn("_fixed", fixed_class).withColumn(
            "probabilities",
            F.when(
                F.col("_fixed").isNotNull(),
                F.transform(names, lambda c: F.when(c == F.col("_fixed"), 1.0).otherwise(0.0)),
            ).otherwise(F.col("probabilities")),
        )
        best = F.array_max("probabilities")
        at = F.array_position("probabilities", best)
        return scored.withColumns(
            {
                "predicted_intent": F.coalesce("_fixed", F.element_at(names, at.cast("int"))),
                "confidence": F.when(F.col("_fixed").isNotNull(), 1.0).otherwise(best),
            }
        ).drop("_fixed")

    def save(self, path: str) -> None:
        """Write model, vocabulary and settings under one folder."""
        self._check()
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/regression")
        if self.tfidf is not None:
            self.tfidf.save(spark, f"{path}/vocabulary")
        spark.createDataFrame(
            [(KIND, self.classes, self.embedding, self.settings and astuple(self.settings),
              self.max_iter, self.balanced)],
            "kind string, classes array<string>, embedding string, settings struct<sizes:array<int>, "
            "min_df:int, max_features:int, sublinear:boolean, strip_accents:boolean>, max_iter int, "
            "balanced boolean",
        ).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, path: str) -> TextClassifier:
        spark = SparkSession.active()
        try:
            frame = spark.read.parquet(f"{path}/settings")
        except AnalysisException as error:
            raise FileNotFoundError(f"Classifier model not found: {path}") from error
        if "kind" not in frame.columns or frame.first()["kind"] != KIND:
            raise TypeError(f"{path} holds no text classifier")
        row = frame.first()
        s = row["settings"]
        settings = s and TfidfSettings(
            tuple(s["sizes"]), s["min_df"], s["max_features"], s["sublinear"], s["strip_accents"]
        )
        loaded = cls(settings, row["embedding"], row["max_iter"], row["balanced"])
        loaded.classes = list(row["classes"])
        if settings is not None:
            loaded.tfidf = Tfidf.load(spark, f"{path}/vocabulary", settings)
        loaded.model = LogisticRegressionModel.load(f"{path}/regression")
        return loaded


def cross_validate(df: DataFrame, build: Callable[[], TextClassifier], text: str, label: str,
                   n_folds: int = 5, key: str = "tweet_id") -> DataFrame:
    """Out-of-fold predictions: each fold scored by a model fitted on the others."""
    # read several times per fold, so worked out once
    folded = cut_lineage(assign_folds(df, label, n_folds, key))

    def fitted(fold: int) -> TextClassifier:
        return build().fit(folded.where(F.col("fold") != fold), text, label)

    # a step of a fit is a job of few tasks, so the steps of all folds share the cluster
    with ThreadPoolExecutor(max(1, n_folds)) as pool:
        models = list(pool.map(inheritable_thread_target(df.sparkSession)(fitted), range(n_folds)))
    scored = None
    for fold, model in enumerate(models):
        part = model.predict(folded.where(F.col("fold") == fold), text, override=None)
        scored = part if scored is None else scored.unionByName(part)
    return scored
