"""Metrics, episodes and the threshold sweep against plain loops."""

from __future__ import annotations

import datetime
import random

import pytest
from frames import day
from pyspark.sql import functions as F

from tocsin.operators.running import ranked, running_totals
from tocsin.plans import alerts, metrics


def naive_metrics(pairs):
    """Average precision and ROC AUC from (score, label) pairs."""
    positives = sum(label for _, label in pairs)
    negatives = len(pairs) - positives
    found, precision_sum = 0, 0.0
    for score in sorted({s for s, _ in pairs}, reverse=True):
        block = [label for s, label in pairs if s == score]
        above = [label for s, label in pairs if s >= score]
        precision_sum += sum(block) / positives * (sum(above) / len(above))
        found += sum(block)
    won = sum(
        1.0 if a > b else 0.5 if a == b else 0.0
        for a, x in pairs if x == 1 for b, y in pairs if y == 0
    )
    return precision_sum, won / (positives * negatives)


@pytest.mark.parametrize("levels", [3, 40, 1000])
def test_curve_metrics_equal_a_loop(spark, levels):
    rng = random.Random(levels)
    pairs = [(rng.randrange(levels) / levels, int(rng.random() < 0.3)) for _ in range(300)]
    pairs += [(0.25, 1), (0.25, 0)] * 40  # one score holds a good part of the rows
    df = spark.createDataFrame(pairs, "p double, label int")
    row = metrics.ranking_curve_metrics(df, "p", ranges=8).first()
    average_precision, auc = naive_metrics(pairs)
    assert row["pr_auc"] == pytest.approx(average_precision)
    assert row["roc_auc"] == pytest.approx(auc)


def test_single_class_rules(spark):
    df = spark.createDataFrame([(0.2, 0), (0.9, 0)], "p double, label int")
    row = metrics.classification_metrics(df, "p").first()
    assert (row["pr_auc"], row["roc_auc"], row["precision"], row["recall"], row["f1"]) == (None, None, 0.0, 0.0, 0.0)
    assert row["false_positives_per_true_positive"] is None
    curve = metrics.calibration_curve(df, "p").collect()
    assert len(curve) == 1 and curve[0]["predicted_bin_probability"] == pytest.approx(0.55)


def test_calibration_bins_follow_exact_quantiles(spark):
    import numpy as np

    rng = random.Random(3)
    pairs = [(rng.random() ** 3, int(rng.random() < 0.4)) for _ in range(257)]
    df = spark.createDataFrame(pairs, "p double, label int")
    found = {r["bin"]: r["predicted_bin_probability"] for r in metrics.calibration_curve(df, "p", ranges=8).collect()}
    scores = np.array([p for p, _ in pairs])
    edges = np.percentile(scores, [20, 40, 60, 80])
    bins = np.searchsorted(edges, scores, side="left")
    for b in set(bins):
        assert found[b] == pytest.approx(scores[bins == b].mean())


def test_running_totals_do_not_depend_on_the_cuts(spark):
    rng = random.Random(1)
    data = [(g, s / 100, rng.randrange(5)) for g in ("a", "b", None) for s in range(100)]
    df = spark.createDataFrame(data, "g string, s double, v long")
    few = running_totals(df, "s", ["v"], ["g"], ranges=2).collect()
    many = running_totals(df, "s", ["v"], ["g"], ranges=30).collect()
    key = lambda r: (str(r["g"]), r["s"])
    assert sorted(few, key=key) == sorted(many, key=key)
    for row in many:
        assert row["cum_v"] == sum(v for g, s, v in data if g == row["g"] and s >= row["s"])


def test_ranked_orders_ties(spark):
    df = spark.createDataFrame([(0.5, "b"), (0.5, "a"), (0.9, "z"), (0.1, "c")], "s double, n string")
    found = {r["n"]: r["rank"] for r in ranked(df, "s", [F.col("n").asc()]).collect()}
    assert found == {"z": 1, "a": 2, "b": 3, "c": 4}


def loop_alerts(rows, threshold, gap):
    """Alert summary of [(entity, date, score, label)] by a plain loop."""
    by_entity = {}
    for row in sorted(rows):
        by_entity.setdefault(row[0], []).append(row)
    true = false = recalled = episodes = 0
    for series in by_entity.values():
        last_alert = last_label = None
        alerted = False
        for _, date, score, label in series:
            if score >= threshold:
                if last_alert is None or (date - last_alert).days > gap:
                    if any(d >= date and y == 1 for _, d, _, y in series):
                        true += 1
                    else:
                        false += 1
                last_alert, alerted = date, True
            if label == 1:
                if last_label is None or (date - last_label).days > gap:
                    episodes += 1
                    recalled += alerted
                last_label = date
    return true, false, recalled / episodes if episodes else None


@pytest.mark.parametrize("gap", [0, 7, 20, 60])
def test_sweep_equals_trying_every_threshold(spark, gap):
    rng = random.Random(gap)
    start = day("2024-01-01")
    data = []
    for entity in "ABCDE":
        for week in range(40):
            if rng.random() < 0.8:
                data.append((entity, start + datetime.timedelta(days=7 * week), rng.randrange(12) / 12, int(rng.random() < 0.15)))
    df = spark.createDataFrame(data, "entity_id string, forecast_date date, calibrated_probability double, label int")
    found = {r["threshold"]: (r["true_alert_count"], r["false_alert_count"], r["episode_recall"])
             for r in alerts.threshold_sweep(df, gap, ranges=5).collect()}
    assert set(found) == {score for _, _, score, _ in data}
    for threshold, values in found.items():
        assert values == pytest.approx(loop_alerts(data, threshold, gap))
    summary = alerts.alert_summary(alerts.alert_table(df, 0.5, gap)).first()
    expected = loop_alerts(data, 0.5, gap)
    assert (summary["true_alert_count"], summary["false_alert_count"], summary["episode_recall"]) == pytest.approx(expected)


def test_operating_threshold_and_ranking_on_a_small_table(spark):
    df = spark.createDataFrame(
        [
            ("A", day("2024-01-01"), 0.90, 1), ("B", day("2024-01-01"), 0.20, 0),
            ("A", day("2024-01-08"), 0.40, 0), ("B", day("2024-01-08"), 0.39, 0),
        ],
        "entity_id string, forecast_date date, calibrated_probability double, label int",
    )
    best = alerts.operating_threshold(df, 30).first()
    assert (best["alert_threshold"], best["episode_recall"], best["false_alert_count"]) == (0.9, 1.0, 0)
    ranking = alerts.ranking_metrics(df, 0.9).first()
    assert (ranking["recall_at_5"], ranking["no_clear_leader_rate"]) == (1.0, 0.5)


def test_alert_table_ids_and_outcomes(spark):
    df = spark.createDataFrame(
        [
            ("E", day("2024-01-01"), 0.9, 0), ("E", day("2024-01-05"), 0.8, 1), ("E", day("2024-03-01"), 0.9, 0),
            ("F", day("2024-01-01"), 0.1, 0),
        ],
        "entity_id string, forecast_date date, calibrated_probability double, label int",
    )
    found = alerts.alert_table(df, 0.5, 10).orderBy("entity_id", "forecast_date").collect()
    assert [r["alert_episode_id"] for r in found] == ["E-alert-001", "E-alert-001", "E-alert-002", None]
    assert [r["alert_outcome"] for r in found] == ["true_alert", "true_alert", "false_alert", None]
    assert [r["lead_days_to_positive_label"] for r in found] == [4, 0, None, None]
    assert [r["label_episode_id"] for r in found] == [None, "E-label-001", None, None]


def test_operating_threshold_without_rows(spark):
    df = spark.createDataFrame([], "entity_id string, forecast_date date, calibrated_probability double, label int")
    best = alerts.operating_threshold(df, 30).first()
    assert (best["alert_threshold"], best["true_alert_count"], best["episode_recall"]) == (0.5, 0, None)


def test_grouped_metrics_per_column(spark):
    df = spark.createDataFrame(
        [("x", "r1", 0.9, 1), ("x", "r1", 0.1, 0), ("y", "r1", 0.8, 0), ("y", None, 0.2, 1)],
        "e string, region string, p double, label int",
    )
    found = {(r["group_column"], r["group_value"]): r for r in metrics.grouped_metrics(df, "p", ["e", "region", "absent"]).collect()}
    assert set(found) == {("e", "x"), ("e", "y"), ("region", "r1")}
    assert found["e", "x"]["roc_auc"] == 1.0 and found["e", "y"]["roc_auc"] == 0.0


def test_model_comparison_prefers_the_first_differing_metric(spark):
    df = spark.createDataFrame(
        [("a", 0.5, 0.7, 0.2, 0.1), ("b", 0.5, 0.8, 0.1, 0.3), ("c", None, 0.9, 0.9, 0.0)],
        "model_name string, pr_auc double, roc_auc double, f1 double, brier_score double",
    )
    found = {r["model_name"]: r for r in metrics.model_comparison(df, "a").collect()}
    assert [n for n, r in found.items() if r["is_top_model"] == 1] == ["b"]
    assert found["a"]["delta_pr_auc"] is None and found["c"]["delta_pr_auc"] is None
    assert found["b"]["delta_roc_auc"] == pytest.approx(0.1)
    assert metrics.choose_baseline(["prior_rate", "x"]) == "prior_rate"
    with pytest.raises(ValueError):
        metrics.choose_baseline(["x"], "y")
