"""Walk-forward backtest: calibrated fold predictions, drivers, metrics, alerts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tocsin.functions.scoring import feature_hash
from tocsin.plans.alerts import alert_summary, alert_table, operating_threshold, ranking_metrics
from tocsin.plans.calibrate import ISOTONIC, fit_calibrator
from tocsin.plans.explain import signed_drivers
from tocsin.plans.metrics import ALL, calibration_curve, choose_baseline, grouped_metrics, model_comparison
from tocsin.plans.models import (
    PRIOR_RATE,
    FittedModel,
    ModelSpec,
    class_counts,
    fit_model,
    out_of_fold_predictions,
    standardize_predictions,
)
from tocsin.session import cut_lineage, kept


@dataclass(frozen=True)
class BacktestSpec:
    """What to backtest."""

    models: tuple[ModelSpec, ...]
    features: tuple[str, ...]
    primary_model: str
    target: str
    horizon: int
    min_train: int
    validation: int
    step: int
    max_splits: int | None = None
    calibration: str = ISOTONIC
    baseline_model: str | None = None
    threshold: float = 0.5
    gap_days: int | None = None
    groups: tuple[str, ...] = ()
    seed: int = 7
    entity: str = "entity_id"
    name: str = "entity_name"
    date: str = "as_of_date"


def backtest_predictions(training: DataFrame, spec: BacktestSpec) -> DataFrame:
    """Fold predictions of all models, each calibrated on the training slice of its own fold."""

    def calibrate(model: FittedModel, train: DataFrame, scored: DataFrame) -> DataFrame:
        if model.rate is not None:
            # A constant score is mapped by isotonic and sigmoid calibration alike to its own rate.
            return scored.withColumn("calibrated_probability", F.col("raw_score"))
        return fit_calibrator(model.score(train), spec.calibration).apply(scored)

    folds = out_of_fold_predictions(
        training, spec.models, spec.features, spec.date, min_train=spec.min_train, validation=spec.validation,
        step=spec.step, max_splits=spec.max_splits, seed=spec.seed, calibrated=calibrate,
    )
    hashed = folds.withColumn("feature_snapshot_hash", feature_hash(list(spec.features)))
    return standardize_predictions(
        hashed, spec.entity, spec.name, spec.date, target=spec.target, horizon=spec.horizon
    )


def explain_backtest(training: DataFrame, predictions: DataFrame, spec: BacktestSpec, model_name: str) -> DataFrame:
    """Predictions of one model with the drivers of a model fitted on all labeled rows."""
    chosen = next(model for model in spec.models if model.name == model_name)
    counts = class_counts(training)
    rows = predictions.where(F.col("model_name") == model_name)
    if chosen.kind == PRIOR_RATE or 0 in counts:
        empty = F.array().cast("array<struct<feature:string,contribution:double>>")
        return rows.withColumns({"top_positive_drivers": empty, "top_negative_drivers": empty})
    final = fit_model(training, chosen, spec.features, spec.seed, counts)
    return signed_drivers(rows, [(final, 1.0)])


@dataclass(frozen=True)
class BacktestResult:
    """Tables of one backtest. ``metrics`` are those over all rows of a model, ``group_metrics`` hold its groups too;
    ``explained`` are the predictions of all models with the drivers of a model fitted on all labeled rows."""

    predictions: DataFrame
    explained: DataFrame
    metrics: DataFrame
    group_metrics: DataFrame
    calibration: DataFrame
    comparison: DataFrame
    threshold: DataFrame
    alerts: DataFrame
    summary: DataFrame


def run_backtest(training: DataFrame, spec: BacktestSpec) -> BacktestResult:
    """Predictions, drivers, metrics per model and group, comparison, operating threshold, alerts and their summary.

    Training rows are written once before the folds, and the predictions once before they are evaluated. Metrics of all
    models and groups come from one score table.
    """
    rows = cut_lineage(training)
    predictions = cut_lineage(backtest_predictions(rows, spec))
    group_metrics = kept(
        grouped_metrics(
            predictions, "calibrated_probability", spec.groups, threshold=spec.threshold, within=["model_name"], overall=True
        ),
        "group_metrics",
    )
    metrics = group_metrics.where(F.col("group_column") == ALL).drop("group_column", "group_value")
    produced = [row[0] for row in metrics.select("model_name").collect()]  # one row per model
    if spec.primary_model not in produced:
        raise ValueError(f"Primary model {spec.primary_model} was not produced; available: {sorted(produced)}")
    baseline = choose_baseline(produced, spec.baseline_model)
    explained = [explain_backtest(rows, predictions, spec, name) for name in sorted(produced)]
    calibration = calibration_curve(predictions, "calibrated_probability", groups=["model_name"])
    primary = predictions.where(F.col("model_name") == spec.primary_model)
    gap = spec.horizon if spec.gap_days is None else spec.gap_days
    threshold = operating_threshold(primary, gap)
    limit = threshold.select("alert_threshold").scalar()
    alerts = alert_table(primary, limit, gap)
    ranking = ranking_metrics(primary, limit)
    summary = backtest_summary(alert_summary(alerts), ranking, threshold)
    return BacktestResult(
        predictions, reduce(DataFrame.unionByName, explained), metrics, group_metrics, calibration,
        model_comparison(metrics, baseline), threshold, alerts, summary,
    )


def backtest_summary(alert_metrics: DataFrame, ranking: DataFrame, threshold: DataFrame) -> DataFrame:
    """The one-row tables of alerts, ranking and threshold side by side."""

    def packed(df: DataFrame, columns: Sequence[str]):
        return df.select(F.struct(*columns).alias("s")).scalar()

    limits, ranks = ["publish_threshold", "alert_threshold"], ranking.columns
    return (
        alert_metrics.withColumn("_limits", packed(threshold, limits))
        .withColumn("_ranks", packed(ranking, ranks))
        .select(
            *alert_metrics.columns,
            *[F.col("_limits")[column].alias(column) for column in limits],
            *[F.col("_ranks")[column].alias(column) for column in ranks],
        )
    )
