"""Labels, folds, models, calibration and explanation."""

from __future__ import annotations

import datetime
import math
import random

import pytest
from frames import day
from pyspark.sql import functions as F

from tocsin.plans import backtest, calibrate, explain, folds, labels, models


def series(spark, values, start="2024-01-01"):
    first = day(start)
    data = [("A", first + datetime.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "entity_id string, as_of_date date, organized_violence_events long")


def by_day(df):
    return {r["as_of_date"].day: r for r in df.collect()}


def test_onset_label_needs_quiet_before_and_events_after(spark):
    definition = labels.LabelDefinition(
        "t", labels.ONSET, "organized_violence_events", lookback_rows=2, forecast_threshold=2.0, quiet_threshold=0.0
    )
    found = by_day(labels.build_labels(series(spark, [0, 0, 0, 0, 2, 0, 0, 0]), definition, 3))
    assert found[3]["label"] == 1 and found[3]["next_event_date"] == day("2024-01-05")
    assert found[5]["label"] == 0
    assert found[6]["label"] is None and found[6]["future_sum"] is None and found[6]["lookback_sum"] is None


def test_escalation_label_compares_with_the_past(spark):
    definition = labels.LabelDefinition(
        "t", labels.ESCALATION, "organized_violence_events", lookback_rows=1, forecast_threshold=2.0, growth_multiplier=1.5
    )
    found = by_day(labels.build_labels(series(spark, [2, 0, 3, 0, 0, 0]), definition, 2))
    assert found[2]["label"] == 1 and found[2]["next_event_date"] == day("2024-01-03")
    assert found[4]["label"] == 0


def test_ready_made_targets_and_unknown_kind(spark):
    assert labels.TARGETS["humanitarian_deterioration_risk"].forecast_threshold == 150.0
    with pytest.raises(ValueError):
        labels.build_labels(series(spark, [1]), labels.LabelDefinition("t", "other", "organized_violence_events"), 1)
    with pytest.raises(ValueError, match="missing columns"):
        labels.build_labels(series(spark, [1]), labels.LabelDefinition("t", labels.ONSET, "absent"), 1)


def test_precomputed_labels_and_prior(spark):
    df = spark.createDataFrame(
        [("A", day("2024-01-01"), 1), ("A", day("2024-01-08"), None), ("B", day("2024-01-01"), 0)],
        "entity_id string, week date, ready int",
    )
    assert labels.precomputed_labels(df, "ready").count() == 2
    scores = spark.createDataFrame(
        [("A", day("2024-01-01"), 0.4)], "entity_id string, forecast_date date, calibrated_probability double"
    )
    joined = labels.attach_prior(df, scores, "entity_id", "week")
    assert sorted((r["structural_prior_score"] or -1) for r in joined.collect()) == [-1, -1, 0.4]
    with pytest.raises(ValueError, match="not unique"):
        labels.attach_prior(df, scores.unionByName(scores), "entity_id", "week")


def test_walk_forward_splits_count_dates(spark):
    df = spark.range(40).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 7).cast("int")).alias("d"))
    found = folds.walk_forward_splits(df, "d", 12, 4, 4, max_splits=3).orderBy("split_id").collect()
    assert [r["split_id"] for r in found] == ["split_00", "split_01", "split_02"]
    first = found[0]
    assert first["train_start"] == day("2024-01-01")
    assert (first["train_end"] - first["train_start"]).days == 7 * 11
    assert (first["validation_start"] - first["train_end"]).days == 7
    assert (first["validation_end"] - first["validation_start"]).days == 7 * 3


def test_folds_without_both_classes_are_named(spark):
    data = [("A", day("2024-01-01") + datetime.timedelta(days=i), int(i > 6)) for i in range(12)]
    df = spark.createDataFrame(data, "entity_id string, d date, label long")
    splits = folds.walk_forward_splits(df, "d", 4, 2, 2)
    found = {r["split_id"]: r["skip_reason"] for r in folds.fold_trainability(df, splits, "d").collect()}
    assert found == {"split_00": "train_fold_missing_classes", "split_01": "train_fold_missing_classes",
                     "split_02": None, "split_03": None}
    assert all(r["skip_reason"] is None for r in folds.fold_trainability(df, splits, "d", prior_only=True).collect())


@pytest.fixture(scope="module")
def training(spark):
    rng = random.Random(11)
    data = []
    for entity in range(8):
        for week in range(60):
            x, noise = rng.random(), rng.random()
            data.append((f"E{entity}", f"N{entity}", day("2022-01-03") + datetime.timedelta(days=7 * week), x, noise,
                         int(rng.random() < x)))
    return spark.createDataFrame(
        data, "entity_id string, entity_name string, as_of_date date, x double, noise double, label long"
    ).withColumn("next_event_date", F.lit(None).cast("date"))


SPLIT = {"min_train": 30, "validation": 10, "step": 10}


@pytest.mark.parametrize(
    "spec",
    [
        models.ModelSpec("logit", models.LOGISTIC),
        models.ModelSpec("elastic", models.ELASTIC_NET),
        models.ModelSpec("forest", models.FOREST, {"numTrees": 10, "maxDepth": 4}),
        models.ModelSpec("boosted", models.BOOSTED, {"maxIter": 5}),
    ],
)
def test_models_find_the_signal(training, spec):
    from tocsin.plans.metrics import ranking_curve_metrics

    scored = models.out_of_fold_predictions(training, [spec], ["x", "noise"], "as_of_date", **SPLIT).cache()
    assert scored.count() == 8 * 30
    assert scored.where("raw_score < 0 or raw_score > 1 or raw_score is null").isEmpty()
    assert ranking_curve_metrics(scored, "raw_score").first()["roc_auc"] > 0.6


def test_prior_rate_is_the_training_share(training):
    spec = models.ModelSpec("prior_rate", models.PRIOR_RATE)
    scored = models.out_of_fold_predictions(training, [spec], ["x"], "as_of_date", **SPLIT, max_splits=1)
    rate = training.where("as_of_date < date'2022-08-01'").agg(F.avg("label")).first()[0]
    assert {round(r[0], 9) for r in scored.select("raw_score").distinct().collect()} == {round(rate, 9)}


@pytest.mark.parametrize("method", [calibrate.ISOTONIC, calibrate.SIGMOID])
def test_calibration_is_monotone(training, method):
    scored = training.withColumn("raw_score", F.col("x")).withColumn("model_name", F.lit("m"))
    _, calibrated = calibrate.calibrate_model(scored, "m", method)
    values = [r["calibrated_probability"] for r in calibrated.orderBy("raw_score").collect()]
    assert all(0 <= v <= 1 for v in values) and values == sorted(values)
    with pytest.raises(ValueError):
        calibrate.calibrate_model(scored, "absent", method)


def test_drivers_are_signed_and_combined(training):
    counts = models.class_counts(training)
    logit = models.fit_model(training, models.ModelSpec("logit", models.LOGISTIC), ["x", "noise"], counts=counts)
    forest = models.fit_model(
        training, models.ModelSpec("f", models.FOREST, {"numTrees": 5, "maxDepth": 3}), ["x", "noise"], counts=counts
    )
    row = explain.signed_drivers(training, [(logit, 1.0), (forest, 1.0)], 1).first()
    assert row["top_positive_drivers"][0]["feature"] == "x" and row["top_positive_drivers"][0]["contribution"] > 0
    top = explain.global_importance(training, [(logit, 1.0)], 1).collect()
    assert [r["feature"] for r in top] == ["x"]
    coefficient = logit.model.coefficients[0]
    mean_x = training.agg(F.avg("x")).first()[0]
    assert top[0]["mean_absolute_contribution"] == pytest.approx(abs(coefficient) * mean_x)


def test_tree_contributions_follow_the_paths(training):
    """Of boosted trees: they add up to the logarithm of the odds, and a feature that is noise adds little."""
    spec = models.ModelSpec("boosted", models.BOOSTED, {"maxIter": 6, "maxDepth": 3})
    fitted = models.fit_model(training, spec, ["x", "noise"])
    rows = explain.explained_rows(fitted.score(training), [(fitted, 1.0)]).collect()
    base, sizes = explain.base_value(fitted), {"x": 0.0, "noise": 0.0}
    for row in rows:
        found = {item["feature"]: item["contribution"] for item in row[explain.ITEMS]}
        assert base + sum(found.values()) == pytest.approx(math.log(row["raw_score"] / (1 - row["raw_score"])))
        for name, value in found.items():
            sizes[name] += abs(value)
    assert sizes["x"] > 2 * sizes["noise"]
    low, high = (next(r for r in sorted(rows, key=lambda r: sign * r["x"])) for sign in (1, -1))
    assert {i["feature"]: i["contribution"] for i in low[explain.ITEMS]}["x"] < 0 < {
        i["feature"]: i["contribution"] for i in high[explain.ITEMS]}["x"]


def test_backtest_tables_agree(training):
    spec = backtest.BacktestSpec(
        models=(models.ModelSpec("logit", models.LOGISTIC), models.ModelSpec("prior_rate", models.PRIOR_RATE)),
        features=("x", "noise"), primary_model="logit", target="t", horizon=30, max_splits=2,
        groups=("entity_name",), **SPLIT,
    )
    result = backtest.run_backtest(training, spec)
    assert result.predictions.groupBy("model_name").count().collect()[0]["count"] == 8 * 20
    summary = result.summary.first()
    assert summary["alert_threshold"] == result.threshold.first()["alert_threshold"]
    assert summary["new_alert_count"] == summary["true_alert_count"] + summary["false_alert_count"]
    comparison = {r["model_name"]: r for r in result.comparison.collect()}
    assert comparison["logit"]["is_top_model"] == 1 and comparison["logit"]["delta_roc_auc"] > 0
    assert comparison["prior_rate"]["delta_roc_auc"] is None
    explained = {r["model_name"]: r for r in result.explained.collect()}
    assert result.explained.count() == 2 * 8 * 20 and explained["prior_rate"]["top_positive_drivers"] == []
    assert explained["logit"]["top_positive_drivers"] or explained["logit"]["top_negative_drivers"]
    groups = {(r["model_name"], r["group_column"], r["group_value"]): r for r in result.group_metrics.collect()}
    assert len(groups) == 2 * (1 + 8) and groups["logit", "entity_name", "N3"]["row_count"] == 20
    overall = {r["model_name"]: r for r in result.metrics.collect()}
    assert overall["logit"]["roc_auc"] == groups["logit", "all", "all"]["roc_auc"] and overall["logit"]["row_count"] == 160
    assert {r["model_name"] for r in result.calibration.collect()} == {"logit", "prior_rate"}


def test_ensemble_scales_up_the_available_members(spark):
    df = spark.createDataFrame(
        [("A", "m1", 0.2), ("A", "m2", 0.6), ("B", "m1", 0.9)], "k string, model_name string, raw_score double"
    )
    found = models.ensemble_scores(df, {"m1": 1.0, "m2": 3.0, "gone": 5.0}, ["k"]).collect()
    assert [(r["k"], round(r["raw_score"], 9)) for r in found] == [("A", 0.5)]
