"""Evaluation jobs write their reports, rows included."""

from pyspark.sql import functions as F

from replyloom.plans import jobs
from replyloom.sources.tables import read_section


class Lengths:
    """Texts of an even length are ``a``, others ``b``."""

    classes = ["a", "b"]

    def predict(self, df, text):
        even = F.length(text) % 2 == 0
        return df.withColumns({
            "probabilities": F.when(even, F.array(F.lit(0.75), F.lit(0.25))).otherwise(F.array(F.lit(0.25), F.lit(0.75))),
            "predicted_intent": F.when(even, "a").otherwise("b"), "confidence": F.lit(0.75),
        })


def test_classifier_report(spark, tmp_path):
    rows = spark.range(12_000).select(
        "id", F.repeat(F.lit("x"), (F.col("id") % 5 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("gold"))
    report = jobs.evaluate_classifier(rows, Lengths(), "text", "gold", path=str(tmp_path / "r"))
    back = read_section(spark, str(tmp_path / "r"), "predictions", "id bigint, gold string, predicted_intent string")
    assert back.count() == 12_000
    assert back.exceptAll(report["predictions"].select("id", "gold", "predicted_intent")).isEmpty()
    matrix = "actual string, predicted string, n bigint"
    found = read_section(spark, str(tmp_path / "r"), "confusion", matrix)
    assert sorted(found.collect()) == sorted(report["confusion"].select("actual", "predicted", "n").collect())
