"""Probability calibration: pooled blocks of scores, or a logistic curve by Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tocsin.operators.isotonic import IsotonicMap, isotonic_map
from tocsin.plans.metrics import classification_metrics
from tocsin.session import kept

ISOTONIC, SIGMOID = "isotonic", "sigmoid"


@dataclass(frozen=True)
class Calibrator:
    """A fitted map from raw score to probability."""

    method: str
    model: Transformer | IsotonicMap

    def apply(self, df: DataFrame, score: str = "raw_score", out: str = "calibrated_probability") -> DataFrame:
        if self.method == ISOTONIC:
            return self.model.apply(df, score, out)
        prepared = df.withColumn("_score", F.col(score).cast("double"))
        vector = VectorAssembler(inputCols=["_score"], outputCol="_vector").transform(prepared)
        scored = self.model.transform(vector)
        return scored.select(*df.columns, F.get(vector_to_array("_calibrated"), F.lit(1)).alias(out))


def fit_calibrator(df: DataFrame, method: str, score: str = "raw_score", label: str = "label") -> Calibrator:
    """Fit on labeled scores. Equal scores are merged first, with their number of rows as weight."""
    value = F.col(score).cast("double")
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(value))
    if method == ISOTONIC:
        merged = known.groupBy(value.alias("score")).agg(
            F.count("*").alias("rows"), F.count_if(F.col(label) == 1).alias("positives")
        )
        return Calibrator(method, isotonic_map(merged, kept))
    if method == SIGMOID:
        merged = known.groupBy(value.alias("_score"), F.col(label).cast("double").alias("_label")).agg(
            F.count("*").cast("double").alias("_rows")
        )
        rows = known.count()
        vector = VectorAssembler(inputCols=["_score"], outputCol="_vector").transform(merged)
        model = LogisticRegression(
            featuresCol="_vector", labelCol="_label", weightCol="_rows", standardization=False,
            regParam=1.0 / max(rows, 1), maxIter=100, probabilityCol="_calibrated", predictionCol="_class",
            rawPredictionCol="_raw",
        ).fit(vector)
        return Calibrator(method, model)
    raise ValueError(f"Unsupported calibration method: {method}")


def calibrate_model(predictions: DataFrame, model_name: str, method: str = ISOTONIC) -> tuple[Calibrator, DataFrame]:
    """Calibrator of one model from its out-of-fold rows, and those rows with the calibrated column."""
    rows = predictions.where(F.col("model_name") == model_name)
    if rows.isEmpty():
        raise ValueError(f"No out-of-fold predictions of model {model_name}.")
    calibrator = fit_calibrator(rows, method)
    return calibrator, calibrator.apply(rows)


@dataclass(frozen=True)
class CalibrationRun:
    """Calibrator of one model, its calibrated out-of-fold rows, and one row of metrics of them."""

    calibrator: Calibrator
    predictions: DataFrame
    metrics: DataFrame


def calibration_run(
    predictions: DataFrame, model_name: str, method: str = ISOTONIC, threshold: float = 0.5
) -> CalibrationRun:
    """Fit, apply and measure. The calibrated rows are written once, since the metrics read them several times."""
    calibrator, rows = calibrate_model(predictions, model_name, method)
    rows = kept(rows, "calibrated")
    metrics = classification_metrics(rows, "calibrated_probability", threshold=threshold)
    named = metrics.select(F.lit(model_name).alias("model_name"), F.lit(method).alias("calibration_method"), "*")
    return CalibrationRun(calibrator, rows, named)
