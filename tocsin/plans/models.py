"""Risk models on Spark ML: estimators by name, out-of-fold predictions, ensembles, batch scoring."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tocsin.functions.scoring import feature_hash
from tocsin.plans.folds import fold_trainability, prior_rate_scores, walk_forward_splits
from tocsin.session import scratch_dir

PRIOR_RATE, LOGISTIC, ELASTIC_NET = "prior_rate", "logistic_regression", "elastic_net"
FOREST, BOOSTED = "random_forest", "gradient_boosting"
FEATURES, WEIGHT = "_features", "_weight"


@dataclass(frozen=True)
class ModelSpec:
    """A model by name and kind; ``params`` override the defaults of the kind."""

    name: str
    kind: str
    params: dict = field(default_factory=dict)


def zero_filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing features as 0, all as doubles."""
    def filled(name: str) -> Column:
        value = F.col(name).cast("double")
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))

    return df.withColumns({name: filled(name) for name in features})


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Zero-filled rows with the feature vector; the input columns stay untouched."""
    filled = zero_filled(df.select("*", *[F.col(name).alias(f"_x_{name}") for name in features]),
                         [f"_x_{name}" for name in features])
    vector = VectorAssembler(inputCols=[f"_x_{name}" for name in features], outputCol=FEATURES)
    return vector.transform(filled).drop(*[f"_x_{name}" for name in features])


def balanced(df: DataFrame, counts: tuple[int, int]) -> DataFrame:
    """Row weights that give both classes the same total: n / (2 * n_class)."""
    positives, negatives = counts
    total = positives + negatives
    weight = F.when(F.col("label") == 1, total / (2.0 * max(positives, 1))).otherwise(total / (2.0 * max(negatives, 1)))
    return df.withColumn(WEIGHT, weight)


def _estimator(spec: ModelSpec, rows: int, seed: int):
    """Estimator of a kind. ``C`` of the linear kinds is the inverse penalty per summed loss."""
    params = dict(spec.params)
    common = {"featuresCol": FEATURES, "labelCol": "label", "weightCol": WEIGHT}
    if spec.kind in (LOGISTIC, ELASTIC_NET):
        inverse_penalty = params.pop("C", 1.0)
        defaults = {"maxIter": 500, "elasticNetParam": 0.0}
        if spec.kind == ELASTIC_NET:
            defaults = {"maxIter": 1000, "elasticNetParam": params.pop("l1_ratio", 0.5)}
        settings = {**defaults, "regParam": 1.0 / (inverse_penalty * max(rows, 1)), "standardization": False, **params}
        return LogisticRegression(**common, **settings)
    if spec.kind == FOREST:
        return RandomForestClassifier(**common, seed=seed, **{"numTrees": 100, "maxDepth": 30, **params})
    if spec.kind == BOOSTED:
        defaults = {"maxIter": 80, "stepSize": 0.05, "maxDepth": 4}
        return GBTClassifier(featuresCol=FEATURES, labelCol="label", seed=seed, **{**defaults, **params})
    raise ValueError(f"Unsupported model kind: {spec.kind}")


@dataclass(frozen=True)
class FittedModel:
    """A fitted model with its features; ``rate`` is set for the prior-rate kind only."""

    spec: ModelSpec
    features: tuple[str, ...]
    model: Transformer | None = None
    rate: float | None = None

    def score(self, df: DataFrame, column: str = "raw_score") -> DataFrame:
        """Add the probability of the positive class."""
        if self.rate is not None:
            return df.withColumn(column, F.lit(self.rate))
        scored = self.model.transform(assembled(df, self.features))
        return scored.select(*df.columns, F.get(vector_to_array("probability"), F.lit(1)).alias(column))


def class_counts(df: DataFrame) -> tuple[int, int]:
    """Positives and negatives (two scalars)."""
    row = df.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    return int(row["p"]), int(row["n"])


def fit_model(
    df: DataFrame, spec: ModelSpec, features: Sequence[str], seed: int = 7, counts: tuple[int, int] | None = None
) -> FittedModel:
    """Fit one model on labeled rows. Fitting is distributed; only the model itself reaches the driver."""
    positives, negatives = counts or class_counts(df)
    if spec.kind == PRIOR_RATE:
        return FittedModel(spec, tuple(features), rate=positives / max(positives + negatives, 1))
    slim = df.select(*dict.fromkeys(features), F.col("label").cast("double").alias("label"))
    prepared = balanced(assembled(slim, features).select(FEATURES, "label"), (positives, negatives))
    model = _estimator(spec, positives + negatives, seed).fit(prepared)
    return FittedModel(spec, tuple(features), model=model)


@dataclass(frozen=True)
class Fold:
    """One trainable split with its class counts."""

    split_id: str
    train: Column
    validation: Column
    counts: tuple[int, int]


def trainable_folds(
    df: DataFrame, date: str, min_train: int, validation: int, step: int, max_splits: int | None,
    prior_only: bool = False,
) -> Iterator[Fold]:
    """Splits that can be trained. The split list is calendar-sized, so it is read on the driver."""
    splits = walk_forward_splits(df, date, min_train, validation, step, max_splits)
    checked = splits.join(fold_trainability(df, splits, date, prior_only), "split_id").orderBy("split_id")
    for row in checked.collect():
        if row["skip_reason"] is None:
            yield Fold(
                row["split_id"],
                F.col(date).between(F.lit(row["train_start"]), F.lit(row["train_end"])),
                F.col(date).between(F.lit(row["validation_start"]), F.lit(row["validation_end"])),
                (int(row["train_positive_count"]), int(row["train_negative_count"])),
            )


FITS_AT_ONCE = 4  # each fit is a distributed job of its own


def out_of_fold_predictions(
    df: DataFrame, specs: Sequence[ModelSpec], features: Sequence[str], date: str, *, min_train: int, validation: int,
    step: int, max_splits: int | None = None, seed: int = 7,
    calibrated: Callable[[FittedModel, DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Validation rows of every trainable fold scored by a model fitted on the rows before them, in long form.

    ``calibrated`` may turn (model, train rows, scored validation rows) into rows with a calibrated column.
    Models without a trainable fold contribute no rows. The splits are counted once for all models. Fits of different
    folds do not depend on each other: a few run side by side (``FITS_AT_ONCE``), each writes its scores to the shared
    folder, and all scores are read back as one table, so the plan does not grow with models and folds.
    """
    home = f"{scratch_dir(df.sparkSession)}/folds-{uuid.uuid4().hex}"
    parts: list[DataFrame] = []
    work: list[tuple[ModelSpec, Fold]] = []
    folds: list[Fold] = []

    def written_scores(spec: ModelSpec, fold: Fold) -> str:
        train = df.where(fold.train)
        model = fit_model(train, spec, features, seed, fold.counts)
        scored = model.score(df.where(fold.validation))
        if calibrated is not None:
            scored = calibrated(model, train, scored)
        path = f"{home}/{specs.index(spec)}-{fold.split_id}"
        scored.withColumns({"split_id": F.lit(fold.split_id), "model_name": F.lit(spec.name)}).write.parquet(path)
        return path

    for spec in specs:
        if spec.kind == PRIOR_RATE and calibrated is None:
            splits = walk_forward_splits(df, date, min_train, validation, step, max_splits)
            parts.append(prior_rate_scores(df, splits, date).withColumn("model_name", F.lit(spec.name)))
            continue
        folds = folds or list(trainable_folds(df, date, min_train, validation, step, max_splits, prior_only=True))
        work += [(spec, fold) for fold in folds if spec.kind == PRIOR_RATE or 0 not in fold.counts]
    if work:
        with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
            paths = list(pool.map(lambda item: written_scores(*item), work))
        parts.append(df.sparkSession.read.parquet(*paths))
    if not parts:
        raise ValueError("No fold can be trained for any model.")
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part)
    return combined


def ensemble_scores(
    predictions: DataFrame, weights: dict[str, float], keys: Sequence[str], name: str = "weighted_ensemble"
) -> DataFrame:
    """Weighted mean of the available members' scores where all of them scored the row.

    Members without any prediction are left out and the other weights are scaled up.
    """
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("model_name"))
    members = predictions.where(F.col("model_name").isin(list(weights))).withColumn("_weight", weight)
    present = members.groupBy("model_name").agg(F.max("_weight").alias("_weight"))
    available = present.agg(
        F.struct(F.count("*").alias("members"), F.sum("_weight").alias("weight")).alias("available")
    ).scalar()
    return (
        members.groupBy(*keys)
        .agg(F.count("*").alias("_members"), F.sum(F.col("raw_score") * F.col("_weight")).alias("_total"))
        .where(F.col("_members") == available.getField("members"))
        .select(*keys, (F.col("_total") / available.getField("weight")).alias("raw_score"), F.lit(name).alias("model_name"))
    )


def standardize_predictions(
    df: DataFrame, entity: str, name: str, date: str, *, target: str, horizon: int, model: str | None = None
) -> DataFrame:
    """Unified identity columns and constants of a prediction table; ``model`` None keeps its own model_name."""
    columns = {
        "entity_id": F.col(entity),
        "entity_name": F.col(name),
        "forecast_date": F.col(date).cast("date"),
        "target_name": F.lit(target),
        "horizon_days": F.lit(horizon).cast("long"),
    }
    if model is not None:
        columns["model_name"] = F.lit(model)
    return df.withColumns(columns)


def weighted_score(models: Sequence[tuple[FittedModel, float]], df: DataFrame, column: str = "raw_score") -> DataFrame:
    """Weighted mean of several models' scores on the same rows."""
    if not models:
        raise ValueError("No model to score with.")
    total = sum(weight for _, weight in models) or 1.0
    scored = df
    for position, (model, _) in enumerate(models):
        scored = model.score(scored, f"_score_{position}")
    mean = sum((F.col(f"_score_{i}") * (weight / total) for i, (_, weight) in enumerate(models)), F.lit(0.0))
    return scored.select(*df.columns, mean.alias(column))


def predict(
    df: DataFrame, models: Sequence[tuple[FittedModel, float]], calibrator, *, entity: str, name: str, date: str,
    target: str, horizon: int, model_name: str, model_version: str, calibration_method: str, top_n: int = 5,
) -> DataFrame:
    """Batch scoring: raw score, calibrated probability, identity, drivers and feature digest."""
    from tocsin.plans.explain import signed_drivers

    features = list(models[0][0].features)
    scored = calibrator.apply(weighted_score(models, df), "raw_score", "calibrated_probability")
    named = standardize_predictions(scored, entity, name, date, target=target, horizon=horizon, model=model_name)
    explained = signed_drivers(named, models, top_n)
    return explained.withColumns(
        {
            "model_version": F.lit(model_version),
            "calibration_method": F.lit(calibration_method),
            "feature_snapshot_hash": feature_hash(features),
        }
    )


def save_model(fitted: FittedModel, path: str) -> None:
    """Persist the Spark ML model."""
    PipelineModel(stages=[fitted.model]).write().overwrite().save(path)
