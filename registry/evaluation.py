"""Queries over predictions: metrics, alerts, thresholds, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from registry import query
from registry.standins import (
    CUSTOMER_PREDICTIONS, customer_predictions, model_predictions, prediction_panel, rounded, sql,
)
from tocsin.plans import alerts, metrics

GAP, THRESHOLD = 30, 0.7


@query(
    "confusion_brier",
    sql("""
    SELECT count(*) AS row_count, CAST(sum(label) AS BIGINT) AS positive_count,
           round(tp / (tp + fp), 6) AS precision, round(tp / sum(label), 6) AS recall,
           round(2.0 * tp / (tp + fp + sum(label)), 6) AS f1, round(avg((p - label) * (p - label)), 6) AS brier_score,
           round(fp / tp, 6) AS false_positives_per_true_positive
    FROM (SELECT *, calibrated_probability AS p, count(*) FILTER (calibrated_probability >= 0.5 AND label = 1) OVER () AS tp,
                 count(*) FILTER (calibrated_probability >= 0.5 AND label = 0) OVER () AS fp FROM pred)
    GROUP BY tp, fp"""),
)
def confusion_brier(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.threshold_metrics(prediction_panel(spark, sf), "calibrated_probability")
    doubles = [c for c, t in found.dtypes if t == "double"]
    return found.withColumns({c: rounded(c, 6) for c in doubles})


@query(
    "lead_time",
    sql("""
    SELECT round(avg(lead), 6) AS mean_lead_days, median(lead) AS median_lead_days
    FROM (SELECT next_event_date - forecast_date AS lead FROM pred
          WHERE calibrated_probability >= 0.5 AND next_event_date IS NOT NULL)"""),
)
def lead_time(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.threshold_metrics(
        prediction_panel(spark, sf), "calibrated_probability", next_event="next_event_date", date="forecast_date"
    )
    return found.select(rounded("mean_lead_days", 6).alias("mean_lead_days"), "median_lead_days")


SCORES = """
    SELECT calibrated_probability AS score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
    FROM pred GROUP BY 1"""
CURVE = """
    SELECT *, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
           CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp,
           CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n FROM scores"""


CURVE_METRICS = """
    SELECT round(sum(pos * (tp / (tp + fp))) / max(p), 6) AS pr_auc,
           round(sum(pos * (n - fp + neg / 2.0)) / (max(p) * max(n)), 6) AS roc_auc,
           round(sum(greatest(least(p - (tp + fp - pos - neg), pos + neg), 0) * pos / (pos + neg)) / max(p), 6)
           AS top_k_risk_hit_rate
    FROM curve"""


@query("customer_curve", sql(CURVE_METRICS, scores=SCORES, curve=CURVE, pred=CUSTOMER_PREDICTIONS))
def customer_curve(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.ranking_curve_metrics(customer_predictions(spark, sf), "calibrated_probability")
    return found.select(*[rounded(c, 6).alias(c) for c in found.columns])


@query("pr_auc_roc_auc", sql(CURVE_METRICS, scores=SCORES, curve=CURVE))
def pr_auc_roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.ranking_curve_metrics(prediction_panel(spark, sf), "calibrated_probability")
    return found.select(*[rounded(c, 6).alias(c) for c in found.columns])


@query(
    "pr_curve",
    sql("""SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM curve""",
        scores=SCORES, curve=CURVE),
)
def pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.precision_recall_curve(prediction_panel(spark, sf), "calibrated_probability")
    return found.select("threshold", rounded("precision", 6).alias("precision"), rounded("recall", 6).alias("recall"))


@query(
    "calibration_curve",
    sql("""
    SELECT bin, round(avg(p), 6) AS predicted_bin_probability, round(avg(label), 6) AS observed_rate,
           count(*) AS row_count
    FROM (SELECT calibrated_probability AS p, label,
                 CAST((calibrated_probability > q[1])::INT + (calibrated_probability > q[2])::INT
                      + (calibrated_probability > q[3])::INT + (calibrated_probability > q[4])::INT AS INT) AS bin
          FROM pred, (SELECT quantile_cont(calibrated_probability, [0.2, 0.4, 0.6, 0.8]) AS q FROM pred))
    GROUP BY 1"""),
)
def calibration_curve(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.calibration_curve(prediction_panel(spark, sf), "calibrated_probability")
    return found.select(
        "bin", rounded("predicted_bin_probability", 6).alias("predicted_bin_probability"),
        rounded("observed_rate", 6).alias("observed_rate"), "row_count",
    )


GROUPED = """
    SELECT 'entity_id' AS group_column, entity_id AS group_value, label, calibrated_probability AS p FROM pred
    UNION ALL SELECT 'region_name', region_name, label, calibrated_probability FROM pred"""


@query(
    "grouped_metrics",
    sql("""
    SELECT group_column, group_value, count(*) AS row_count, CAST(sum(label) AS BIGINT) AS positive_count,
           round(coalesce(count(*) FILTER (p >= 0.5 AND label = 1) / nullif(count(*) FILTER (p >= 0.5), 0), 0), 6)
           AS precision,
           round(coalesce(count(*) FILTER (p >= 0.5 AND label = 1) / nullif(sum(label), 0), 0), 6) AS recall,
           round(avg((p - label) * (p - label)), 6) AS brier_score, round(max(a.pr_auc), 6) AS pr_auc,
           round(max(a.roc_auc), 6) AS roc_auc
    FROM grouped LEFT JOIN (
        SELECT group_column, group_value,
               CASE WHEN max(tp_all) > 0 THEN sum(pos * (tp / (tp + fp))) / max(tp_all) END AS pr_auc,
               CASE WHEN max(tp_all) > 0 AND max(fp_all) > 0
                    THEN sum(pos * (fp_all - fp + neg / 2.0)) / (max(tp_all) * max(fp_all)) END AS roc_auc
        FROM (SELECT group_column, group_value, pos, neg,
                     sum(pos) OVER (PARTITION BY group_column, group_value ORDER BY p DESC) AS tp,
                     sum(neg) OVER (PARTITION BY group_column, group_value ORDER BY p DESC) AS fp,
                     sum(pos) OVER (PARTITION BY group_column, group_value) AS tp_all,
                     sum(neg) OVER (PARTITION BY group_column, group_value) AS fp_all
              FROM (SELECT group_column, group_value, p, count(*) FILTER (label = 1) AS pos,
                           count(*) FILTER (label = 0) AS neg FROM grouped GROUP BY 1, 2, 3))
        GROUP BY 1, 2) a USING (group_column, group_value)
    GROUP BY 1, 2""", grouped=GROUPED),
)
def grouped_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.grouped_metrics(prediction_panel(spark, sf), "calibrated_probability", ["entity_id", "region_name"])
    return found.select(
        "group_column", "group_value", "row_count", "positive_count",
        *[rounded(c, 6).alias(c) for c in ("precision", "recall", "brier_score", "pr_auc", "roc_auc")],
    )


@query(
    "probability_histogram",
    sql("""SELECT CAST(least(floor(calibrated_probability * 10), 9) AS INT) AS bin, count(*) AS row_count
           FROM pred GROUP BY 1"""),
)
def probability_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.probability_histogram(prediction_panel(spark, sf), "calibrated_probability")


# The alert table in plain SQL, for any column "t" with the threshold of a row.
ALERTS_AT = """
    SELECT *, CASE WHEN is_alert = 1 THEN CASE WHEN next_positive IS NOT NULL THEN 'true_alert' ELSE 'false_alert' END END
              AS alert_outcome,
           CASE WHEN is_alert = 1 THEN next_positive - forecast_date END AS lead_days_to_positive_label,
           CAST(is_alert = 1 AND (last_alert IS NULL OR forecast_date - last_alert > {gap}) AS INT) AS is_new_alert,
           CAST(label = 1 AND (last_label IS NULL OR forecast_date - last_label > {gap}) AS INT) AS is_new_label_episode
    FROM (SELECT *,
                 max(CASE WHEN is_alert = 1 THEN forecast_date END) OVER past AS last_alert,
                 max(CASE WHEN label = 1 THEN forecast_date END) OVER past AS last_label,
                 min(CASE WHEN label = 1 THEN forecast_date END) OVER ahead AS next_positive,
                 max(is_alert) OVER so_far AS alerted
          FROM (SELECT *, CAST(calibrated_probability >= t AS INT) AS is_alert FROM {source})
          WINDOW past AS (PARTITION BY t, entity_id ORDER BY forecast_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                 ahead AS (PARTITION BY t, entity_id ORDER BY forecast_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                 so_far AS (PARTITION BY t, entity_id ORDER BY forecast_date))"""
FIXED = "SELECT *, 0.7 AS t FROM pred"
FIXED_ALERTS = ALERTS_AT.format(gap=GAP, source="fixed")


@query(
    "alert_episodes",
    sql("""
    SELECT entity_id, forecast_date, is_alert, is_new_alert, is_new_label_episode, alert_outcome,
           lead_days_to_positive_label,
           CASE WHEN is_alert = 1 THEN entity_id || '-alert-' || lpad(CAST(CAST(sum(is_new_alert) OVER e AS BIGINT) AS VARCHAR), 3, '0') END
           AS alert_episode_id,
           CASE WHEN label = 1 THEN entity_id || '-label-' || lpad(CAST(CAST(sum(is_new_label_episode) OVER e AS BIGINT) AS VARCHAR), 3, '0') END
           AS label_episode_id
    FROM alerted_rows WINDOW e AS (PARTITION BY entity_id ORDER BY forecast_date)""",
        fixed=FIXED, alerted_rows=FIXED_ALERTS),
)
def alert_episodes(spark: SparkSession, sf: str) -> DataFrame:
    table = alerts.alert_table(prediction_panel(spark, sf), THRESHOLD, GAP)
    return table.select(
        "entity_id", "forecast_date", "is_alert", "is_new_alert", "is_new_label_episode", "alert_outcome",
        "lead_days_to_positive_label", "alert_episode_id", "label_episode_id",
    )


SUMMARY = """
    SELECT CAST(sum(is_new_alert) AS BIGINT) AS new_alert_count,
           CAST(sum(is_new_label_episode) AS BIGINT) AS new_label_episode_count,
           count(*) FILTER (is_new_alert = 1 AND alert_outcome = 'true_alert') AS true_alert_count,
           count(*) FILTER (is_new_alert = 1 AND alert_outcome = 'false_alert') AS false_alert_count,
           round(sum(CASE WHEN is_new_label_episode = 1 THEN alerted END) / sum(is_new_label_episode), 6) AS episode_recall,
           round(avg(CASE WHEN is_new_alert = 1 THEN lead_days_to_positive_label END), 6) AS first_alert_lead_days_mean,
           median(CASE WHEN is_new_alert = 1 THEN lead_days_to_positive_label END) AS first_alert_lead_days_median,
           count(*) FILTER (is_new_alert = 1 AND alert_outcome = 'false_alert') AS false_alert_burden,
           round(count(*) FILTER (is_new_alert = 1 AND alert_outcome = 'false_alert')
                 / count(*) FILTER (is_new_alert = 1 AND alert_outcome = 'true_alert'), 6) AS false_alerts_per_true_alert
    FROM alerted_rows"""


@query("alert_summary", sql(SUMMARY, fixed=FIXED, alerted_rows=FIXED_ALERTS))
def alert_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = alerts.alert_summary(alerts.alert_table(prediction_panel(spark, sf), THRESHOLD, GAP))
    doubles = ["episode_recall", "first_alert_lead_days_mean", "false_alerts_per_true_alert"]
    return found.withColumns({c: rounded(c, 6) for c in doubles})


@query("customer_alerts", sql(SUMMARY, fixed=FIXED, alerted_rows=FIXED_ALERTS, pred=CUSTOMER_PREDICTIONS))
def customer_alerts(spark: SparkSession, sf: str) -> DataFrame:
    found = alerts.alert_summary(alerts.alert_table(customer_predictions(spark, sf), THRESHOLD, GAP))
    doubles = ["episode_recall", "first_alert_lead_days_mean", "false_alerts_per_true_alert"]
    return found.withColumns({c: rounded(c, 6) for c in doubles})


@query(
    "recalled_episodes",
    sql("""SELECT entity_id, forecast_date FROM alerted_rows WHERE is_new_label_episode = 1 AND alerted = 1""",
        fixed=FIXED, alerted_rows=FIXED_ALERTS),
)
def recalled_episodes(spark: SparkSession, sf: str) -> DataFrame:
    table = alerts.alert_table(prediction_panel(spark, sf), THRESHOLD, GAP)
    starts = table.where(F.col("is_new_label_episode") == 1).select("entity_id", "forecast_date")
    return alerts.recalled_episodes(starts, table)


@query(
    "recall_at_k",
    sql("""
    SELECT round(avg(CAST(first < 0.7 OR coalesce(first - second < 0.02, FALSE) AS DOUBLE)), 6) AS no_clear_leader_rate,
           round(sum(h5) / max(total), 6) AS recall_at_5, round(sum(h10) / max(total), 6) AS recall_at_10
    FROM (SELECT forecast_date, max(CASE WHEN k = 1 THEN calibrated_probability END) AS first,
                 max(CASE WHEN k = 2 THEN calibrated_probability END) AS second,
                 sum(CASE WHEN k <= 5 THEN label ELSE 0 END) AS h5, sum(CASE WHEN k <= 10 THEN label ELSE 0 END) AS h10,
                 (SELECT sum(label) FROM pred) AS total
          FROM (SELECT *, row_number() OVER (PARTITION BY forecast_date
                                             ORDER BY calibrated_probability DESC, entity_id) AS k FROM pred)
          GROUP BY 1)"""),
)
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    found = alerts.ranking_metrics(prediction_panel(spark, sf), THRESHOLD)
    return found.select(*[rounded(c, 6).alias(c) for c in found.columns])


SWEPT = "SELECT pred.*, t FROM pred CROSS JOIN (SELECT DISTINCT calibrated_probability AS t FROM pred)"
SWEEP_ALERTS = ALERTS_AT.format(gap=GAP, source="swept")
SWEEP = """
    SELECT t AS threshold,
           round(sum(CASE WHEN is_new_label_episode = 1 THEN alerted END) / sum(is_new_label_episode), 6) AS episode_recall,
           count(*) FILTER (is_new_alert = 1 AND alert_outcome = 'true_alert') AS true_alert_count,
           count(*) FILTER (is_new_alert = 1 AND alert_outcome = 'false_alert') AS false_alert_count
    FROM alerted_rows GROUP BY t"""


@query("threshold_sweep", sql(SWEEP, swept=SWEPT, alerted_rows=SWEEP_ALERTS))
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    found = alerts.threshold_sweep(prediction_panel(spark, sf), GAP)
    return found.withColumn("episode_recall", rounded("episode_recall", 6))


@query(
    "operating_threshold",
    sql("""
    SELECT threshold AS publish_threshold, threshold AS alert_threshold, episode_recall, true_alert_count, false_alert_count
    FROM sweep ORDER BY episode_recall DESC, true_alert_count DESC, false_alert_count, threshold DESC LIMIT 1""",
        swept=SWEPT, alerted_rows=SWEEP_ALERTS, sweep=SWEEP),
)
def operating_threshold(spark: SparkSession, sf: str) -> DataFrame:
    found = alerts.operating_threshold(prediction_panel(spark, sf), GAP)
    return found.withColumn("episode_recall", rounded("episode_recall", 6))


MODEL_METRICS = """
    SELECT model_name,
           max(f1) AS f1, max(brier_score) AS brier_score,
           sum(pos * (tp / (tp + fp))) / max(p) AS pr_auc,
           sum(pos * (n - fp + neg / 2.0)) / (max(p) * max(n)) AS roc_auc
    FROM (SELECT model_name, raw_score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg,
                 sum(count(*) FILTER (label = 1)) OVER w AS tp, sum(count(*) FILTER (label = 0)) OVER w AS fp,
                 sum(count(*) FILTER (label = 1)) OVER (PARTITION BY model_name) AS p,
                 sum(count(*) FILTER (label = 0)) OVER (PARTITION BY model_name) AS n
          FROM models GROUP BY 1, 2 WINDOW w AS (PARTITION BY model_name ORDER BY raw_score DESC))
    JOIN (SELECT model_name, 2.0 * count(*) FILTER (raw_score >= 0.5 AND label = 1)
                 / (count(*) FILTER (raw_score >= 0.5) + sum(label)) AS f1,
                 avg((raw_score - label) * (raw_score - label)) AS brier_score FROM models GROUP BY 1) USING (model_name)
    GROUP BY 1"""


@query(
    "model_comparison",
    sql("""
    SELECT m.model_name,
           CASE WHEN m.model_name <> 'beta' THEN round(m.pr_auc - b.pr_auc, 6) END AS delta_pr_auc,
           CASE WHEN m.model_name <> 'beta' THEN round(m.roc_auc - b.roc_auc, 6) END AS delta_roc_auc,
           CASE WHEN m.model_name <> 'beta' THEN round(m.f1 - b.f1, 6) END AS delta_f1,
           CASE WHEN m.model_name <> 'beta' THEN round(m.brier_score - b.brier_score, 6) END AS delta_brier_score,
           CAST(m.model_name = (SELECT model_name FROM measured ORDER BY pr_auc DESC, roc_auc DESC, f1 DESC, brier_score
                                LIMIT 1) AS INT) AS is_top_model
    FROM measured m, (SELECT * FROM measured WHERE model_name = 'beta') b""", measured=MODEL_METRICS),
)
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    measured = metrics.classification_metrics(model_predictions(spark, sf), "raw_score", groups=["model_name"])
    found = metrics.model_comparison(measured, "beta")
    return found.select("model_name", "is_top_model",
                        *[rounded(c, 6).alias(c) for c in found.columns if c.startswith("delta_")])


@query(
    "replay_entity",
    sql("""
    SELECT entity_id, forecast_date, round(calibrated_probability, 6) AS calibrated_probability, is_alert, alert_outcome
    FROM alerted_rows WHERE entity_id = 'NAC' ORDER BY forecast_date DESC LIMIT 20""",
        fixed=FIXED, alerted_rows=FIXED_ALERTS),
)
def replay_entity(spark: SparkSession, sf: str) -> DataFrame:
    predictions = prediction_panel(spark, sf).withColumn("model_name", F.lit("alpha"))
    table = alerts.alert_table(predictions, THRESHOLD, GAP)
    found = alerts.replay(predictions, table, "NAC", "alpha", 20)
    return found.select(
        "entity_id", "forecast_date", rounded("calibrated_probability", 6).alias("calibrated_probability"), "is_alert",
        "alert_outcome",
    )
