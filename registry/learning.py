"""Queries over labels, folds, trained models, calibration and explanation."""

from __future__ import annotations

import uuid
from functools import reduce
from types import SimpleNamespace

from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from registry import query
from registry.standins import (
    CUSTOMER_PREDICTIONS, customer_predictions, daily_users, model_predictions, prediction_panel, rounded, sql,
)
from tocsin.operators import entity_windows as ew
from tocsin.plans import backtest, calibrate, explain, folds, labels, models
from tocsin.session import cut_lineage, scratch_dir
from tocsin.sources import sinks

HORIZON, LOOKBACK = 7, 5
ONSET = labels.LabelDefinition("t", labels.ONSET, "error_count", LOOKBACK, forecast_threshold=4.0, quiet_threshold=2.0)
ESCALATION = labels.LabelDefinition(
    "t", labels.ESCALATION, "event_count", LOOKBACK, forecast_threshold=5.0, growth_multiplier=1.5, minimum_baseline=2.0
)
LEVEL = labels.LabelDefinition("t", labels.THRESHOLD, "value_sum", LOOKBACK, forecast_threshold=100.0)

FRAMED = """
    SELECT entity_id, as_of_date, next_event_date,
           CASE WHEN ahead = {h} THEN back END AS lookback_sum, CASE WHEN ahead = {h} THEN total END AS future_sum
    FROM (SELECT entity_id, as_of_date, count(*) OVER nxt AS ahead, sum(CAST({v} AS DOUBLE)) OVER nxt AS total,
                 coalesce(sum(CAST({v} AS DOUBLE)) OVER prev, 0) AS back,
                 CASE WHEN count(*) OVER nxt = {h} THEN min(CASE WHEN {v} > 0 THEN as_of_date END) OVER nxt END
                 AS next_event_date
          FROM users
          WINDOW nxt AS (PARTITION BY entity_id ORDER BY as_of_date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING),
                 prev AS (PARTITION BY entity_id ORDER BY as_of_date ROWS BETWEEN {b} PRECEDING AND 1 PRECEDING))"""


def framed(value: str) -> str:
    return FRAMED.format(h=HORIZON, b=LOOKBACK, v=value)


def labeled_sql(value: str, hit: str) -> str:
    return f"""SELECT entity_id, as_of_date, CASE WHEN future_sum IS NOT NULL THEN CAST({hit} AS BIGINT) END AS label,
                      next_event_date, lookback_sum, future_sum FROM ({framed(value)})"""


ONSET_SQL = labeled_sql("error_count", "lookback_sum <= 2 AND future_sum >= 4")
LABEL_COLUMNS = ["entity_id", "as_of_date", "label", "next_event_date", "lookback_sum", "future_sum"]


@query("row_labels_onset", sql(ONSET_SQL))
def row_labels_onset(spark: SparkSession, sf: str) -> DataFrame:
    return labels.build_labels(daily_users(spark, sf), ONSET, HORIZON).select(*LABEL_COLUMNS)


@query(
    "row_labels_escalation",
    sql(labeled_sql("event_count", "future_sum >= greatest(5.0::DOUBLE, greatest(lookback_sum, 2.0::DOUBLE) * 1.5)")),
)
def row_labels_escalation(spark: SparkSession, sf: str) -> DataFrame:
    return labels.build_labels(daily_users(spark, sf), ESCALATION, HORIZON).select(*LABEL_COLUMNS)


@query("clustered_labels", sql(ONSET_SQL))
def clustered_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels over a written table in buckets of the entity, which the windows read without a shuffle."""
    root = f"{scratch_dir(spark)}/clustered-{uuid.uuid4().hex}"
    users = sinks.write_clustered(
        daily_users(spark, sf), root, "gold", "users", "days", entity="entity_id", day="as_of_date", buckets=8
    )
    return labels.build_labels(users, ONSET, HORIZON).select(*LABEL_COLUMNS)


@query("row_labels_threshold", sql(labeled_sql("value_sum", "future_sum >= 100")))
def row_labels_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return labels.build_labels(daily_users(spark, sf), LEVEL, HORIZON).select(*LABEL_COLUMNS)


@query(
    "lag_roll_features",
    sql("""
    SELECT entity_id, as_of_date, coalesce(lag(v, 1) OVER o, 0) AS lag_1, coalesce(lag(v, 7) OVER o, 0) AS lag_7,
           round(coalesce(avg(v) OVER p14, 0), 6) AS mean_14,
           round(coalesce(CASE WHEN count(v) OVER p14 >= 2 THEN stddev_samp(v) OVER p14 END, 0), 6) AS std_14,
           round(coalesce(CASE WHEN count(v) OVER p14 >= 5 THEN v - avg(v) OVER p14 END, 0), 6) AS deviation_14
    FROM (SELECT entity_id, as_of_date, CAST(event_count AS DOUBLE) AS v FROM users)
    WINDOW o AS (PARTITION BY entity_id ORDER BY as_of_date),
           p14 AS (PARTITION BY entity_id ORDER BY as_of_date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)"""),
)
def lag_roll_features(spark: SparkSession, sf: str) -> DataFrame:
    spec, value = ew.ordered("entity_id", "as_of_date"), F.col("event_count").cast("double")
    return daily_users(spark, sf).select(
        "entity_id", "as_of_date", ew.lagged(value, 1, spec).alias("lag_1"), ew.lagged(value, 7, spec).alias("lag_7"),
        rounded(ew.rolling_mean(value, 14, spec), 6).alias("mean_14"),
        rounded(ew.rolling_std(value, 14, spec), 6).alias("std_14"),
        rounded(ew.deviation_from_mean(value, 14, spec), 6).alias("deviation_14"),
    )


SPLITS = """
    SELECT 'split_' || lpad(CAST(CAST((k - 10) // 4 AS INT) AS VARCHAR), 2, '0') AS split_id, train_start, train_end,
           validation_start, validation_end
    FROM (SELECT row_number() OVER (ORDER BY d) AS k, min(d) OVER () AS train_start, d AS train_end,
                 lead(d, 1) OVER (ORDER BY d) AS validation_start, lead(d, 5) OVER (ORDER BY d) AS validation_end
          FROM (SELECT DISTINCT as_of_date AS d FROM users))
    WHERE k >= 10 AND (k - 10) % 4 = 0 AND validation_end IS NOT NULL"""


def user_splits(spark: SparkSession, sf: str) -> DataFrame:
    return folds.walk_forward_splits(daily_users(spark, sf), "as_of_date", 10, 5, 4)


def labeled_users(spark: SparkSession, sf: str) -> DataFrame:
    return labels.labeled_rows(labels.build_labels(daily_users(spark, sf), ONSET, HORIZON))


LABELED = {"splits": SPLITS, "labeled": f"SELECT * FROM ({ONSET_SQL}) WHERE label IS NOT NULL"}


@query("walk_forward_splits", sql(SPLITS))
def walk_forward_splits(spark: SparkSession, sf: str) -> DataFrame:
    return user_splits(spark, sf)


@query(
    "fold_rows",
    sql("""
    SELECT split_id, CASE WHEN as_of_date <= train_end THEN 'train' ELSE 'validation' END AS role, count(*) AS row_count,
           CAST(sum(event_count) AS BIGINT) AS events
    FROM users JOIN splits ON as_of_date BETWEEN train_start AND validation_end GROUP BY 1, 2""", splits=SPLITS),
)
def fold_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = folds.fold_rows(daily_users(spark, sf), user_splits(spark, sf), "as_of_date")
    return rows.groupBy("split_id", "role").agg(F.count("*").alias("row_count"), F.sum("event_count").alias("events"))


@query(
    "fold_trainability",
    sql("""
    SELECT *, CASE WHEN validation_row_count = 0 THEN 'validation_fold_empty' WHEN train_row_count = 0 THEN 'train_fold_empty'
                   WHEN train_positive_count = 0 OR train_negative_count = 0 THEN 'train_fold_missing_classes' END
              AS skip_reason
    FROM (SELECT split_id, count(*) FILTER (t AND label = 1) AS train_positive_count,
                 count(*) FILTER (t AND label = 0) AS train_negative_count, count(*) FILTER (t) AS train_row_count,
                 count(*) FILTER (v AND label = 1) AS validation_positive_count,
                 count(*) FILTER (v AND label = 0) AS validation_negative_count, count(*) FILTER (v) AS validation_row_count
          FROM (SELECT split_id, label, as_of_date BETWEEN train_start AND train_end AS t,
                       as_of_date BETWEEN validation_start AND validation_end AS v FROM splits, labeled)
          GROUP BY 1)""", **LABELED),
)
def fold_trainability(spark: SparkSession, sf: str) -> DataFrame:
    return folds.fold_trainability(labeled_users(spark, sf), user_splits(spark, sf), "as_of_date")


@query(
    "prior_rate_scores",
    sql("""
    SELECT entity_id, as_of_date, split_id, label, round(rate, 6) AS raw_score
    FROM labeled JOIN (SELECT s.*, (SELECT avg(label) FROM labeled WHERE as_of_date BETWEEN train_start AND train_end) AS rate
                       FROM splits s) ON as_of_date BETWEEN validation_start AND validation_end""", **LABELED),
)
def prior_rate_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = folds.prior_rate_scores(labeled_users(spark, sf), user_splits(spark, sf), "as_of_date")
    return scored.select("entity_id", "as_of_date", "split_id", "label", rounded("raw_score", 6).alias("raw_score"))


@query(
    "ensemble_scores",
    sql("""
    SELECT entity_id, forecast_date, round((3 * calibrated_probability + second_probability) / 4, 6) AS raw_score,
           'weighted_ensemble' AS model_name FROM pred"""),
)
def ensemble_scores(spark: SparkSession, sf: str) -> DataFrame:
    found = models.ensemble_scores(
        model_predictions(spark, sf), {"alpha": 3.0, "beta": 1.0, "absent": 2.0}, ["entity_id", "forecast_date"]
    )
    return found.withColumn("raw_score", rounded("raw_score", 6))


@query(
    "label_distribution",
    sql("""SELECT count(*) AS row_count, count(*) FILTER (label = 1) AS positive_count,
           count(*) FILTER (label = 0) AS negative_count, count(DISTINCT label) AS class_count FROM labeled""", **LABELED),
)
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_distribution(labels.build_labels(daily_users(spark, sf), ONSET, HORIZON))


@query(
    "attach_labels",
    sql("""SELECT entity_id, as_of_date, event_count, label FROM users JOIN labeled USING (entity_id, as_of_date)""",
        **LABELED),
)
def attach_labels(spark: SparkSession, sf: str) -> DataFrame:
    users = daily_users(spark, sf)
    truth = labels.build_labels(users, ONSET, HORIZON).select("entity_id", "as_of_date", "label")
    return labels.attach_labels(users.select("entity_id", "as_of_date", "event_count"), truth, "entity_id", "as_of_date")


@query(
    "precomputed_labels",
    sql("""SELECT entity_id, forecast_date, label, next_event_date
           FROM (SELECT entity_id, forecast_date, next_event_date, CASE WHEN n7 > 0 THEN label END AS label FROM pred)
           WHERE label IS NOT NULL"""),
)
def precomputed_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = prediction_panel(spark, sf).select(
        "entity_id", "forecast_date", F.col("next_event_date").alias("next_day"),
        F.when(F.col("n7") > 0, F.col("label")).alias("ready_label"),
    )
    found = labels.precomputed_labels(rows, "ready_label", "next_day")
    return found.select("entity_id", "forecast_date", "label", "next_event_date")


@query(
    "prior_join",
    sql("""SELECT entity_id, forecast_date, n28, round(slow, 6) AS structural_prior_score
           FROM pred LEFT JOIN (SELECT entity_id, forecast_date, calibrated_probability AS slow
                                FROM pred WHERE n28 % 3 = 0) USING (entity_id, forecast_date)"""),
)
def prior_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = prediction_panel(spark, sf)
    slow = rows.where(F.col("n28") % 3 == 0).select("entity_id", "forecast_date", "calibrated_probability")
    fast = rows.select("entity_id", "forecast_date", "n28")
    found = labels.attach_prior(fast, slow, "entity_id", "forecast_date")
    return found.withColumn("structural_prior_score", rounded("structural_prior_score", 6))


@query(
    "standardize_predictions",
    sql("""SELECT entity_id, entity_name, forecast_date, 'label_escalation_30d' AS target_name,
           CAST(30 AS BIGINT) AS horizon_days, 'alpha' AS model_name FROM pred"""),
)
def standardize_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = prediction_panel(spark, sf).select(
        F.col("entity_id").alias("code"), F.col("entity_name").alias("title"), F.col("forecast_date").alias("week")
    )
    found = models.standardize_predictions(
        rows, "code", "title", "week", target="label_escalation_30d", horizon=30, model="alpha"
    )
    return found.select("entity_id", "entity_name", "forecast_date", "target_name", "horizon_days", "model_name")


# --- trained models ----------------------------------------------------------------------------------------------
# Learned values have no SQL. These queries return every row with what SQL does know, and true or false for what must
# hold of the learned part: scores in range, the gradient at the optimum, sums that must agree.

FEATURES = ("n7", "n28", "second_probability")
SPLIT = {"min_train": 156, "validation": 52, "step": 52, "max_splits": None}

# Splits of the panel weeks whose training slice has both classes, and the rows that they validate.
FOLDS = {
    "cuts": """
    SELECT 'split_' || lpad(CAST(CAST((k - 156) // 52 AS INT) AS VARCHAR), 2, '0') AS split_id, train_start, train_end,
           validation_start, validation_end
    FROM (SELECT row_number() OVER (ORDER BY d) AS k, min(d) OVER () AS train_start, d AS train_end,
                 lead(d, 1) OVER (ORDER BY d) AS validation_start, lead(d, 52) OVER (ORDER BY d) AS validation_end
          FROM (SELECT DISTINCT forecast_date AS d FROM pred))
    WHERE k >= 156 AND (k - 156) % 52 = 0 AND validation_end IS NOT NULL""",
    "trainable": """
    SELECT cuts.*, (SELECT avg(label) FROM pred WHERE forecast_date BETWEEN train_start AND train_end) AS rate FROM cuts""",
    "folds": """
    SELECT entity_id, entity_name, region_name, forecast_date, label, split_id, rate
    FROM pred JOIN trainable ON forecast_date BETWEEN validation_start AND validation_end""",
}


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Nation-weeks with features and label, written once for all fits."""
    rows = prediction_panel(spark, sf).select(
        "entity_id", "entity_name", "region_name", F.col("forecast_date").alias("as_of_date"), *FEATURES, "label",
        "next_event_date",
    )
    return cut_lineage(rows)


def out_of_fold(spark: SparkSession, sf: str, spec: models.ModelSpec) -> DataFrame:
    return models.out_of_fold_predictions(training_rows(spark, sf), [spec], FEATURES, "as_of_date", **SPLIT).select(
        "entity_id", "as_of_date", "label", "split_id", "model_name", "raw_score"
    )


def is_share(column: str) -> Column:
    return F.coalesce(F.col(column).between(0.0, 1.0), F.lit(False))


def checked_scores(spark: SparkSession, sf: str, spec: models.ModelSpec) -> DataFrame:
    """Every validation row of every trainable fold once, and whether its score is a share."""
    scored = out_of_fold(spark, sf, spec)
    return scored.withColumn("is_share", is_share("raw_score")).drop("raw_score")


def scores_sql(model: str) -> str:
    return sql(f"""SELECT entity_id, forecast_date AS as_of_date, label, split_id, '{model}' AS model_name, TRUE AS is_share
                   FROM folds WHERE rate > 0 AND rate < 1""", **FOLDS)


@query("logit_scores", scores_sql("logit"))
def logit_scores(spark: SparkSession, sf: str) -> DataFrame:
    return checked_scores(spark, sf, models.ModelSpec("logit", models.LOGISTIC))


@query("elastic_net_scores", scores_sql("elastic"))
def elastic_net_scores(spark: SparkSession, sf: str) -> DataFrame:
    return checked_scores(spark, sf, models.ModelSpec("elastic", models.ELASTIC_NET))


@query("forest_scores", scores_sql("forest"))
def forest_scores(spark: SparkSession, sf: str) -> DataFrame:
    return checked_scores(spark, sf, models.ModelSpec("forest", models.FOREST))


@query("gbt_scores", scores_sql("boosted"))
def gbt_scores(spark: SparkSession, sf: str) -> DataFrame:
    return checked_scores(spark, sf, models.ModelSpec("boosted", models.BOOSTED))


@query(
    "zero_filled",
    sql("""SELECT entity_id, forecast_date, CAST(CASE WHEN n7 % 3 = 0 THEN 0 ELSE n7 END AS DOUBLE) AS n7,
                  CASE WHEN n28 % 5 = 0 THEN 0.0::DOUBLE ELSE second_probability END AS second_probability FROM pred"""),
)
def zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Missing features and features that are no number become zero."""
    rows = prediction_panel(spark, sf).select(
        "entity_id", "forecast_date", F.when(F.col("n7") % 3 != 0, F.col("n7")).alias("n7"),
        F.when(F.col("n28") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("second_probability")).alias("second_probability"),
    )
    return models.zero_filled(rows, ["n7", "second_probability"])


def optimum_checks(rows: DataFrame, fitted: models.FittedModel, counts: tuple[int, int], penalty: float, l1: float) -> DataFrame:
    """For each coefficient whether the weighted mean loss with its penalty has no descent there, one aggregate."""
    scored = models.balanced(fitted.score(models.zero_filled(rows, FEATURES)), counts)
    gap = F.col(models.WEIGHT) * (F.col("raw_score") - F.col("label"))
    total = F.sum(models.WEIGHT)
    means = scored.agg(
        *[(F.sum(gap * F.col(name)) / total).alias(name) for name in FEATURES], (F.sum(gap) / total).alias("intercept"),
        *[F.avg(F.abs(name)).alias(f"size_{name}") for name in FEATURES],
    )
    checks = [F.struct(F.lit("intercept").alias("coefficient"), (F.abs("intercept") < 1e-3).alias("at_optimum"))]
    for name, value in zip(FEATURES, fitted.model.coefficients.toArray()):
        slope = F.col(name) + float(penalty * (1 - l1) * value)
        pull = float(penalty * l1)
        descent = F.abs(slope + (pull if value > 0 else -pull)) if value else F.greatest(F.abs(slope) - pull, F.lit(0.0))
        checks.append(
            F.struct(F.lit(name).alias("coefficient"), (descent < 1e-3 * (1 + F.col(f"size_{name}"))).alias("at_optimum"))
        )
    return means.select(F.inline(F.array(*checks)))


OPTIMUM_SQL = "SELECT unnest(['intercept', 'n7', 'n28', 'second_probability']) AS coefficient, TRUE AS at_optimum"


@query("logit_optimum", OPTIMUM_SQL)
def logit_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted logistic regression lies where its gradient vanishes."""
    rows = training_rows(spark, sf)
    counts = models.class_counts(rows)
    fitted = models.fit_model(rows, models.ModelSpec("logit", models.LOGISTIC), FEATURES, counts=counts)
    return optimum_checks(rows, fitted, counts, 1.0 / sum(counts), 0.0)


@query("elastic_net_optimum", OPTIMUM_SQL)
def elastic_net_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted elastic net lies where no step descends, at kinks too."""
    rows = training_rows(spark, sf)
    counts = models.class_counts(rows)
    fitted = models.fit_model(rows, models.ModelSpec("elastic", models.ELASTIC_NET), FEATURES, counts=counts)
    return optimum_checks(rows, fitted, counts, 1.0 / sum(counts), 0.5)


@query(
    "structural_prior_scores",
    sql("""SELECT entity_id, forecast_date AS as_of_date, split_id IS NOT NULL AS has_prior, TRUE AS is_share
           FROM pred LEFT JOIN (SELECT entity_id, forecast_date, split_id FROM folds WHERE rate > 0 AND rate < 1)
                USING (entity_id, forecast_date)""", **FOLDS),
)
def structural_prior_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold scores of a slow model become a feature of a faster one; rows without such a score count as zero."""
    rows = training_rows(spark, sf)
    slow = out_of_fold(spark, sf, models.ModelSpec("slow", models.LOGISTIC))
    features = [*FEATURES, "structural_prior_score"]
    fast = labels.attach_prior(
        rows, cut_lineage(slow), "entity_id", "as_of_date", score_date="as_of_date", score="raw_score"
    )
    model = models.fit_model(fast, models.ModelSpec("fast", models.LOGISTIC), features)
    return model.score(fast).select(
        "entity_id", "as_of_date", F.col("structural_prior_score").isNotNull().alias("has_prior"),
        is_share("raw_score").alias("is_share"),
    )


# Pooled shares as largest mean from here back of smallest mean from here on; scores in thousandths keep that short.
ISOTONIC = {
    "customers": CUSTOMER_PREDICTIONS,
    "scored": """SELECT entity_id, forecast_date, label, floor(calibrated_probability * 1000) / 1000 AS raw_score
                 FROM customers""",
    "points": """SELECT raw_score, row_number() OVER (ORDER BY raw_score) AS i, sum(count(*)) OVER o AS n,
                        sum(sum(label)) OVER o AS p, sum(count(*)) OVER o - count(*) AS n0,
                        sum(sum(label)) OVER o - sum(label) AS p0
                 FROM scored GROUP BY raw_score WINDOW o AS (ORDER BY raw_score)""",
    "runs": """SELECT a.i AS a, b.i AS b, (b.p - a.p0) / (b.n - a.n0) AS mean FROM points a JOIN points b ON a.i <= b.i""",
    "lowest": """SELECT b AS i, min(mean) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                        AS low FROM runs""",
    "calibrated": """SELECT entity_id, forecast_date, label, raw_score, y AS calibrated_probability
                     FROM scored JOIN points USING (raw_score) JOIN (SELECT i, max(low) AS y FROM lowest GROUP BY i) USING (i)""",
}


def customer_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of customers in thousandths as those of one model."""
    thousandths = F.floor(F.col("calibrated_probability") * 1000) / 1000
    return customer_predictions(spark, sf).select(
        "entity_id", "forecast_date", "label", F.lit("customers").alias("model_name"), thousandths.alias("raw_score")
    )


@query(
    "isotonic_calibrated",
    sql("""SELECT entity_id, forecast_date, label, raw_score, round(calibrated_probability, 9) AS calibrated_probability
           FROM calibrated""", **ISOTONIC),
)
def isotonic_calibrated(spark: SparkSession, sf: str) -> DataFrame:
    found = calibrate.calibrate_model(customer_scores(spark, sf), "customers", calibrate.ISOTONIC)[1]
    return found.select(
        "entity_id", "forecast_date", "label", "raw_score",
        rounded("calibrated_probability", 9).alias("calibrated_probability"),
    )


@query(
    "calibration_metrics",
    sql("""
    SELECT 'customers' AS model_name, 'isotonic' AS calibration_method, count(*) AS row_count,
           CAST(sum(label) AS BIGINT) AS positive_count,
           round(coalesce(count(*) FILTER (p >= 0.25 AND label = 1) / nullif(count(*) FILTER (p >= 0.25), 0), 0), 6)
           AS precision,
           round(count(*) FILTER (p >= 0.25 AND label = 1) / sum(label), 6) AS recall,
           round(avg((p - label) * (p - label)), 6) AS brier_score,
           (SELECT round(sum(pos * (tp / (tp + fp))) / max(tp_all), 6) FROM curve) AS pr_auc,
           (SELECT round(sum(pos * (fp_all - fp + neg / 2.0)) / (max(tp_all) * max(fp_all)), 6) FROM curve) AS roc_auc
    FROM (SELECT calibrated_probability AS p, label FROM calibrated)""",
        **ISOTONIC,
        curve="""
    SELECT pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS tp_all,
           sum(neg) OVER () AS fp_all
    FROM (SELECT calibrated_probability AS p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
          FROM calibrated GROUP BY 1)"""),
)
def calibration_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the calibrated scores of one model."""
    found = calibrate.calibration_run(customer_scores(spark, sf), "customers", threshold=0.25).metrics
    numbers = ("precision", "recall", "brier_score", "pr_auc", "roc_auc")
    return found.select(
        "model_name", "calibration_method", "row_count", "positive_count", *[rounded(c, 6).alias(c) for c in numbers]
    )


@query(
    "sigmoid_calibrated",
    sql("""SELECT entity_id, forecast_date, label, raw_score, TRUE AS is_share, TRUE AS rises, TRUE AS keeps_total
           FROM scored""", **ISOTONIC),
)
def sigmoid_calibrated(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrated by a logistic curve that rises with the score; at its optimum the probabilities sum to the positives."""
    found = cut_lineage(calibrate.calibrate_model(customer_scores(spark, sf), "customers", calibrate.SIGMOID)[1])
    whole = found.agg(
        F.struct(
            F.corr("raw_score", "calibrated_probability").alias("direction"),
            F.avg(F.col("calibrated_probability") - F.col("label")).alias("gap"),
            F.covar_pop("raw_score", F.col("label")).alias("trend"),
        ).alias("s")
    ).scalar()
    return found.select(
        "entity_id", "forecast_date", "label", "raw_score", is_share("calibrated_probability").alias("is_share"),
        (whole.getField("direction") * F.signum(whole.getField("trend")) > 0).alias("rises"),
        (F.abs(whole.getField("gap")) < 1e-4).alias("keeps_total"),
    )


# --- explanation ---------------------------------------------------------------------------------------------------

#: Coefficients of a linear model that nobody fitted, so that SQL knows its contributions.
GIVEN = dict(zip(FEATURES, (0.25, -0.5, 3.0)))
GIVEN_SQL = {
    "parts": "SELECT entity_id, forecast_date, unnest(['n7', 'n28', 'second_probability']) AS feature, "
    "unnest([n7 * 0.25, n28 * -0.5, second_probability * 3.0]) AS contribution FROM pred",
}


def given_model() -> models.FittedModel:
    return models.FittedModel(
        models.ModelSpec("given", models.LOGISTIC), FEATURES, model=SimpleNamespace(coefficients=Vectors.dense(*GIVEN.values()))
    )


@query(
    "linear_contributions",
    sql("""SELECT entity_id, forecast_date, feature, round(contribution, 6) AS contribution FROM parts""", **GIVEN_SQL),
)
def linear_contributions(spark: SparkSession, sf: str) -> DataFrame:
    found = explain.long_contributions(prediction_panel(spark, sf), [(given_model(), 2.0)], ["entity_id", "forecast_date"])
    return found.withColumn("contribution", rounded("contribution", 6))


@query(
    "linear_drivers",
    sql("""
    SELECT entity_id, forecast_date,
           coalesce(string_agg(feature || ' ' || k, ',' ORDER BY k) FILTER (contribution > 0 AND k <= 2), '') AS top_positive,
           coalesce(string_agg(feature || ' ' || l, ',' ORDER BY l) FILTER (contribution < 0 AND l <= 2), '') AS top_negative
    FROM (SELECT *, row_number() OVER (w ORDER BY contribution DESC, feature) AS k,
                 row_number() OVER (w ORDER BY contribution, feature) AS l
          FROM parts WINDOW w AS (PARTITION BY entity_id, forecast_date))
    GROUP BY 1, 2""", **GIVEN_SQL),
)
def linear_drivers(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the two largest contributions of each sign, with their rank."""
    found = explain.signed_drivers(prediction_panel(spark, sf), [(given_model(), 1.0)], 2)

    def named(column: str) -> Column:
        return F.array_join(F.transform(column, lambda x, i: F.concat_ws(" ", x["feature"], (i + 1).cast("string"))), ",")

    return found.select(
        "entity_id", "forecast_date", named("top_positive_drivers").alias("top_positive"),
        named("top_negative_drivers").alias("top_negative"),
    )


@query(
    "linear_importance",
    sql("""SELECT feature, round(avg(abs(contribution)), 6) AS mean_absolute_contribution FROM parts GROUP BY 1
           ORDER BY 2 DESC, 1 LIMIT 2""", **GIVEN_SQL),
)
def linear_importance(spark: SparkSession, sf: str) -> DataFrame:
    found = explain.global_importance(prediction_panel(spark, sf), [(given_model(), 1.0)], 2)
    return found.withColumn("mean_absolute_contribution", rounded("mean_absolute_contribution", 6))


def fitted_members(spark: SparkSession, sf: str) -> list[tuple[models.FittedModel, float]]:
    rows = training_rows(spark, sf)
    counts = models.class_counts(rows)
    logit = models.fit_model(rows, models.ModelSpec("logit", models.LOGISTIC), FEATURES, counts=counts)
    forest = models.fit_model(
        rows, models.ModelSpec("forest", models.FOREST), FEATURES, counts=counts
    )
    return [(logit, 2.0), (forest, 1.0)]


def in_order(column: str, sign: int) -> Column:
    """At most n contributions, all of one sign, largest first."""
    values = F.transform(column, lambda x: x["contribution"] * sign)
    return F.forall(values, lambda v: v > 0) & (values == F.reverse(F.array_sort(values)))


@query(
    "signed_drivers",
    sql("""SELECT entity_id, forecast_date AS as_of_date, TRUE AS positive_in_order, TRUE AS negative_in_order,
                  TRUE AS at_most_two FROM pred"""),
)
def signed_drivers(spark: SparkSession, sf: str) -> DataFrame:
    found = explain.signed_drivers(training_rows(spark, sf), fitted_members(spark, sf), 2)
    return found.select(
        "entity_id", "as_of_date", in_order("top_positive_drivers", 1).alias("positive_in_order"),
        in_order("top_negative_drivers", -1).alias("negative_in_order"),
        (F.greatest(F.size("top_positive_drivers"), F.size("top_negative_drivers")) <= 2).alias("at_most_two"),
    )


@query(
    "tree_contributions",
    sql("""SELECT entity_id, forecast_date AS as_of_date, TRUE AS adds_up FROM pred"""),
)
def tree_contributions(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees: base and contributions of each row add up to the logarithm of its odds."""
    rows = training_rows(spark, sf)
    fitted = models.fit_model(rows, models.ModelSpec("boosted", models.BOOSTED), FEATURES)
    explained = explain.explained_rows(fitted.score(rows), [(fitted, 1.0)])
    total = F.aggregate(explain.ITEMS, F.lit(0.0), lambda sum_, x: sum_ + x["contribution"]) + explain.base_value(fitted)
    odds = F.log(F.col("raw_score") / (1 - F.col("raw_score")))
    return explained.select("entity_id", "as_of_date", (F.abs(total - odds) < 1e-6 * (1 + F.abs(odds))).alias("adds_up"))


@query("global_importance", "SELECT unnest(['n7', 'n28', 'second_probability']) AS feature, TRUE AS is_mean")
def global_importance(spark: SparkSession, sf: str) -> DataFrame:
    """The means over rows are those of the contributions in long form."""
    rows, members = training_rows(spark, sf), fitted_members(spark, sf)
    long = explain.long_contributions(rows, members, ["entity_id", "as_of_date"])
    means = long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean"))
    found = explain.global_importance(rows, members, 5).join(means, "feature")
    return found.select("feature", (F.abs(F.col("mean_absolute_contribution") - F.col("mean")) < 1e-9).alias("is_mean"))


@query(
    "long_contributions",
    sql("""SELECT entity_id, forecast_date AS as_of_date, unnest(['n7', 'n28', 'second_probability']) AS feature,
                  TRUE AS is_number FROM pred"""),
)
def long_contributions(spark: SparkSession, sf: str) -> DataFrame:
    found = explain.long_contributions(
        training_rows(spark, sf), fitted_members(spark, sf), ["entity_id", "as_of_date"]
    )
    number = F.col("contribution").isNotNull() & ~F.isnan("contribution")
    return found.select("entity_id", "as_of_date", "feature", number.alias("is_number"))


@query(
    "batch_predictions",
    sql("""SELECT entity_id, entity_name, forecast_date, 'label_escalation_30d' AS target_name,
                  CAST(30 AS BIGINT) AS horizon_days, 'ensemble' AS model_name, 'v1' AS model_version,
                  'isotonic' AS calibration_method, TRUE AS is_share, TRUE AS has_hash FROM pred"""),
)
def batch_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = training_rows(spark, sf)
    members = fitted_members(spark, sf)
    calibrator = calibrate.fit_calibrator(models.weighted_score(members, rows), calibrate.ISOTONIC)
    found = models.predict(
        rows, members, calibrator, entity="entity_id", name="entity_name", date="as_of_date", target="label_escalation_30d",
        horizon=30, model_name="ensemble", model_version="v1", calibration_method=calibrate.ISOTONIC,
    )
    return found.select(
        "entity_id", "entity_name", "forecast_date", "target_name", "horizon_days", "model_name", "model_version",
        "calibration_method", (is_share("raw_score") & is_share("calibrated_probability")).alias("is_share"),
        (F.length("feature_snapshot_hash") == 64).alias("has_hash"),
    )


BACKTEST = backtest.BacktestSpec(
    models=(models.ModelSpec("logit", models.LOGISTIC), models.ModelSpec("prior_rate", models.PRIOR_RATE)),
    features=FEATURES, primary_model="logit", target="label_escalation_30d", horizon=30, groups=("region_name",), **SPLIT,
)


@query(
    "backtest_predictions",
    sql("""SELECT entity_id, forecast_date, model_name, split_id, label,
                  CASE WHEN model_name = 'prior_rate' THEN round(rate, 9) END AS prior_score, TRUE AS is_share
           FROM folds, (SELECT unnest(['logit', 'prior_rate']) AS model_name)
           WHERE model_name = 'prior_rate' OR (rate > 0 AND rate < 1)""", **FOLDS),
)
def backtest_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of both models; the score of the prior rate is known to SQL, raw and calibrated."""
    prior = F.col("model_name") == "prior_rate"
    both = F.when(F.col("raw_score") == F.col("calibrated_probability"), rounded("raw_score", 9))
    return backtest.backtest_predictions(training_rows(spark, sf), BACKTEST).select(
        "entity_id", "forecast_date", "model_name", "split_id", "label", F.when(prior, both).alias("prior_score"),
        (is_share("raw_score") & is_share("calibrated_probability") & (F.length("feature_snapshot_hash") == 64))
        .alias("is_share"),
    )


@query(
    "backtest_explained",
    sql("""SELECT entity_id, forecast_date, model_name, TRUE AS in_order
           FROM folds, (SELECT unnest(['logit', 'prior_rate']) AS model_name)
           WHERE model_name = 'prior_rate' OR (rate > 0 AND rate < 1)""", **FOLDS),
)
def backtest_explained(spark: SparkSession, sf: str) -> DataFrame:
    """Drivers of every model, from a model fitted on all labeled rows; a row whose features are all zero has none."""
    found = backtest.run_backtest(training_rows(spark, sf), BACKTEST).explained
    ordered = in_order("top_positive_drivers", 1) & in_order("top_negative_drivers", -1)
    empty = (F.size("top_positive_drivers") + F.size("top_negative_drivers")) == 0
    has_values = reduce(lambda a, b: a | b, [F.coalesce(F.col(name) != 0, F.lit(False)) for name in FEATURES])
    fits = F.when(F.col("model_name") == "prior_rate", empty).otherwise(ordered & (has_values != empty))
    return found.select("entity_id", "forecast_date", "model_name", fits.alias("in_order"))


@query("backtest_summary", "SELECT TRUE AS counts_agree, TRUE AS limit_is_share, TRUE AS rates_are_shares")
def backtest_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = backtest.run_backtest(training_rows(spark, sf), BACKTEST).summary
    adds_up = F.col("new_alert_count") == F.col("true_alert_count") + F.col("false_alert_count")
    return found.select(
        adds_up.alias("counts_agree"), is_share("alert_threshold").alias("limit_is_share"),
        F.coalesce(F.col("episode_recall").between(0.0, 1.0), F.lit(True)).alias("rates_are_shares"),
    )


@query(
    "backtest_groups",
    sql("""SELECT model_name, group_column, group_value, count(*) AS row_count, CAST(sum(label) AS BIGINT) AS positive_count,
                  TRUE AS are_shares
           FROM (SELECT model_name, label, unnest(['all', 'region_name']) AS group_column,
                        unnest(['all', region_name]) AS group_value
                 FROM folds, (SELECT unnest(['logit', 'prior_rate']) AS model_name)
                 WHERE model_name = 'prior_rate' OR (rate > 0 AND rate < 1))
           GROUP BY 1, 2, 3""", **FOLDS),
)
def backtest_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of every model over all rows and for each value of the group columns."""
    found = backtest.run_backtest(training_rows(spark, sf), BACKTEST).group_metrics
    shares = [
        F.coalesce(F.col(c).between(0.0, 1.0), F.lit(True)) for c in ("precision", "recall", "brier_score", "roc_auc", "pr_auc")
    ]
    return found.select(
        "model_name", "group_column", "group_value", "row_count", "positive_count",
        reduce(lambda a, b: a & b, shares).alias("are_shares"),
    )


@query(
    "backtest_calibration",
    sql("""SELECT model_name, CAST(count(*) AS BIGINT) AS row_count, TRUE AS are_shares
           FROM folds, (SELECT unnest(['logit', 'prior_rate']) AS model_name)
           WHERE model_name = 'prior_rate' OR (rate > 0 AND rate < 1) GROUP BY 1""", **FOLDS),
)
def backtest_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """The calibration curve of every model covers its rows."""
    found = backtest.run_backtest(training_rows(spark, sf), BACKTEST).calibration
    fits = is_share("predicted_bin_probability") & is_share("observed_rate")
    return found.groupBy("model_name").agg(F.sum("row_count").alias("row_count"), F.every(fits).alias("are_shares"))
