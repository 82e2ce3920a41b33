"""Published tables: ranked snapshot, publication state, lead conflict, country detail, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tocsin.functions.scoring import (
    CLEAR_LEAD_MARGIN,
    alert_band,
    driver_labels,
    freshness_by_hours,
    target_family,
)
from tocsin.operators.entity_windows import latest_and_previous, latest_per_key
from tocsin.operators.quality import require_columns
from tocsin.operators.running import ranked
from tocsin.session import cut_lineage

PREDICTION_COLUMNS = [
    "country_iso3", "country_name", "forecast_date", "calibrated_probability", "model_name", "model_version",
    "target_name", "horizon_days",
]
MENTION_DEPTH = 10
COUNTRY = "array<struct<iso3:string,country_name:string>>"


def snapshot_time(predictions: DataFrame) -> Column:
    """Newest snapshot time, else the newest forecast date."""
    newest_date = F.max("forecast_date").cast("timestamp")
    if "snapshot_ts_utc" in predictions.columns:
        return predictions.agg(F.coalesce(F.max("snapshot_ts_utc"), newest_date)).scalar()
    return predictions.agg(newest_date).scalar()


def ranked_snapshot(
    predictions: DataFrame, published_at: Column | None = None, fresh_days: int = 10, stale_days: int = 21
) -> DataFrame:
    """Newest score of every country with its change, rank and freshness tier."""
    require_columns(predictions, PREDICTION_COLUMNS, "predictions")
    secondary = F.col("raw_score") if "raw_score" in predictions.columns else F.col("calibrated_probability")
    region = F.col("region_name") if "region_name" in predictions.columns else F.lit(None).cast("string")
    slim = predictions.select(
        "country_iso3", "country_name", region.alias("region_name"), "forecast_date", "calibrated_probability",
        secondary.alias("_secondary"), *[name for name in ("snapshot_ts_utc",) if name in predictions.columns],
    )
    # One row per country, written once: ranking reads it several times, the predictions only here.
    newest = cut_lineage(latest_and_previous(slim, "country_iso3", "forecast_date", ["calibrated_probability"]))
    order = [
        F.coalesce("_secondary", F.lit(float("-inf"))).desc(),
        F.coalesce("country_name", F.lit("")).asc(),
        F.coalesce("country_iso3", F.lit("")).asc(),
    ]
    score = F.col("calibrated_probability")
    taken = snapshot_time(newest)
    reference = taken if published_at is None else published_at
    return ranked(newest, "calibrated_probability", order).select(
        "rank",
        F.col("country_iso3").alias("iso3"),
        "country_name",
        "region_name",
        F.bround(score, 4).alias("score"),
        F.bround(score - F.coalesce("previous_calibrated_probability", score), 4).alias("delta"),
        newest.agg(F.max("forecast_date").cast("date")).scalar().alias("forecast_as_of"),
        freshness_by_hours(reference, taken, fresh_days, stale_days).alias("freshness_tier"),
        score.alias("calibrated_probability"),
    )


def publication_state(
    snapshot: DataFrame, target_name: str, *, baseline_used: bool, primary_model: str | None, top_model: str | None,
    publish_threshold: float | None, margin: float = CLEAR_LEAD_MARGIN,
) -> DataFrame:
    """One row: lead, ties, whether there is a clear leader, model status and the kind of watch."""
    lead = F.struct("iso3", "country_name", "score", "calibrated_probability")
    top = snapshot.agg(F.max("calibrated_probability")).scalar()
    one = snapshot.agg(
        F.count("*").alias("coverage_count"),
        F.max("forecast_as_of").alias("forecast_as_of"),
        F.max("freshness_tier").alias("freshness_tier"),
        F.max(F.when(F.col("rank") == 1, lead)).alias("lead"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second_score"),
        F.count_if(F.col("calibrated_probability") == top).alias("lead_tie_count"),
    )
    score = F.col("lead.score")
    unclear = (
        (score < F.lit(publish_threshold) if publish_threshold is not None else F.lit(False))
        | (F.col("lead_tie_count") > 1)
        | F.coalesce((score - F.col("second_score")) < margin, F.lit(False))
    )
    promoted = not baseline_used and primary_model is not None and primary_model == top_model
    family = target_family(F.lit(target_name))
    watch = (
        F.when(F.col("no_clear_leader"), "No Clear Leader")
        .when(F.lit(not promoted), "Monitoring Only")
        .when(F.col("primary_target") == "onset", "Onset Watch")
        .when(F.col("primary_target") == "escalation", "Escalation Watch")
        .otherwise("Monitoring Only")
    )
    return (
        one.withColumns({"no_clear_leader": unclear, "primary_target": family})
        .withColumn("alert_type", watch)
        .select(
            F.col("lead.iso3").alias("lead_country_iso3"),
            F.col("lead.country_name").alias("lead_country_name"),
            score.alias("lead_score"),
            "second_score",
            "lead_tie_count",
            "coverage_count",
            "forecast_as_of",
            "freshness_tier",
            "primary_target",
            "alert_type",
            F.when(F.col("alert_type").isin("Monitoring Only", "No Clear Leader"), "monitoring_only")
            .otherwise("promoted")
            .alias("model_status"),
            F.col("no_clear_leader").cast("int").alias("no_clear_leader"),
        )
    )


def mentioned_countries(lead_text: DataFrame, snapshot: DataFrame, depth: int = MENTION_DEPTH) -> DataFrame:
    """Which of the ``depth`` top-ranked names occur in the one-row lead text (column ``text``)."""
    text = lead_text.select(F.lower("text")).scalar()
    return snapshot.where(F.col("rank") <= depth).where(F.contains(text, F.lower("country_name"))).select(
        "rank", "iso3", "country_name"
    )


def conflict_countries(raw: Column) -> Column:
    """JSON list of ``{iso3, country_name|name}`` objects or of plain names to an array of structs."""
    items = F.when(F.substring(F.trim(raw), 1, 1) == "[", F.from_json(raw, "array<string>"))
    built = F.transform(
        items,
        lambda item: F.when(
            F.substring(F.ltrim(item), 1, 1) == "{",
            F.struct(
                F.get_json_object(item, "$.iso3").alias("iso3"),
                F.coalesce(F.get_json_object(item, "$.country_name"), F.get_json_object(item, "$.name")).alias(
                    "country_name"
                ),
            ),
        ).otherwise(F.struct(F.lit(None).cast("string").alias("iso3"), item.alias("country_name"))),
    )
    return F.coalesce(F.filter(built, lambda c: c["country_name"].isNotNull()), F.array().cast(COUNTRY))


def newest_report(reports: DataFrame) -> DataFrame:
    """One report per country: the newest, and of equal or undated ones the largest slug."""
    if "report_date" in reports.columns:
        reports = latest_per_key(reports, "country_iso3", "report_date")
    others = [column for column in reports.columns if column != "country_iso3"]
    best = F.max_by(F.struct(*others), F.coalesce("report_slug", F.lit(""))).alias("_report")
    return reports.groupBy("country_iso3").agg(best).select("country_iso3", "_report.*")


def predicted_conflict(snapshot: DataFrame, reports: DataFrame, target_name: str, horizon: int) -> DataFrame:
    """One row: countries of the lead conflict. Explicit list of the lead's report, else names its text mentions,
    else the lead itself.
    """
    lead = snapshot.where(F.col("rank") == 1).select(
        F.col("iso3").alias("country_iso3"), F.col("country_name").alias("lead_name")
    )
    row = lead.join(
        newest_report(reports).select(
            "country_iso3",
            F.lit(True).alias("_has_report"),
            F.nullif(F.trim("predicted_conflict_label"), F.lit("")).alias("_label"),
            F.trim("reason_source").alias("_reason"),
            "summary",
            "report_slug",
            conflict_countries(F.col("predicted_conflict_countries")).alias("_explicit"),
            F.concat_ws(" ", "report_title", "summary", F.array_join(driver_labels("chronology"), " ")).alias("text"),
        ),
        "country_iso3",
        "left",
    )
    mentions = mentioned_countries(row, snapshot).agg(
        F.array_sort(F.collect_list(F.struct("rank", "iso3", "country_name"))).alias("m")
    )
    own = F.struct(F.col("country_iso3").alias("iso3"), F.col("lead_name").alias("country_name"))
    found = F.transform(F.col("_mentions"), lambda c: F.struct(c["iso3"].alias("iso3"), c["country_name"].alias("country_name")))
    detected = F.when(
        F.exists("_found", lambda c: c["country_name"] == F.col("lead_name")), F.col("_found")
    ).otherwise(F.concat(F.array(own), F.col("_found")))
    countries = F.when(F.col("_has_report").isNull(), F.array(own)).when(
        F.size("_explicit") > 0, F.col("_explicit")
    ).otherwise(detected)
    return (
        row.withColumn("_mentions", mentions.scalar())
        .withColumn("_found", found)
        .withColumn("countries", countries)
        .select(
            F.when(F.col("_has_report").isNull(), F.col("lead_name"))
            .otherwise(F.coalesce("_label", F.array_join(F.transform("countries", lambda c: c["country_name"]), " / ")))
            .alias("label"),
            "countries",
            "summary",
            "report_slug",
            F.when(F.col("_has_report").isNull(), "lead_country")
            .when(F.col("_reason").isin("report_inputs", "lead_country", "fallback"), F.col("_reason"))
            .otherwise("report_inputs")
            .alias("reason_source"),
            F.lit(target_name).alias("target_name"),
            F.lit(horizon).cast("long").alias("horizon_days"),
        )
    )


def country_detail(snapshot: DataFrame, predictions: DataFrame, reports: DataFrame) -> DataFrame:
    """Ranked rows with text, drivers and digest: the report first, the newest prediction otherwise."""
    newest = latest_per_key(predictions, "country_iso3", "forecast_date")

    def optional(df: DataFrame, column: str) -> Column:
        return F.col(column).cast("string") if column in df.columns else F.lit(None).cast("string")

    drivers = F.lit(None).cast("string")
    if "top_positive_drivers" in newest.columns:
        is_text = dict(newest.dtypes)["top_positive_drivers"] == "string"
        drivers = F.col("top_positive_drivers") if is_text else F.to_json("top_positive_drivers")
    predicted = newest.select(
        F.col("country_iso3").alias("iso3"), "model_name", "model_version", "target_name", "horizon_days",
        drivers.alias("_model_drivers"), optional(newest, "feature_snapshot_hash").alias("_model_hash"),
    )
    reported = newest_report(reports).select(
        F.col("country_iso3").alias("iso3"), "report_slug", "summary",
        driver_labels("chronology").alias("chronology"),
        driver_labels(
            F.coalesce(F.nullif(optional(reports, "top_drivers_json"), F.lit("")), optional(reports, "top_drivers"))
        ).alias(
            "_report_drivers"
        ),
        optional(reports, "source_snapshot_hash").alias("_report_hash"),
    )
    joined = snapshot.join(predicted, "iso3", "left").join(reported, "iso3", "left")
    return joined.select(
        *snapshot.columns,
        "report_slug",
        "summary",
        F.coalesce("chronology", F.array().cast("array<string>")).alias("chronology"),
        F.when(F.size("_report_drivers") > 0, F.col("_report_drivers"))
        .otherwise(driver_labels("_model_drivers"))
        .alias("top_drivers"),
        "model_name",
        "model_version",
        "target_name",
        "horizon_days",
        F.coalesce("_report_hash", "_model_hash").alias("source_snapshot_hash"),
        alert_band("calibrated_probability").alias("alert_band"),
    )


def status_row(state: DataFrame, *, published_at: str, baseline_used: bool, publish_threshold: float | None) -> DataFrame:
    """One status row of a publication."""
    return state.select(
        F.lit("baseline_fallback" if baseline_used else "ok").alias("status"),
        "freshness_tier",
        F.lit(published_at).alias("published_at"),
        "forecast_as_of",
        F.lit(int(baseline_used)).alias("baseline_used"),
        "coverage_count",
        "primary_target",
        "alert_type",
        "model_status",
        "no_clear_leader",
        F.lit(publish_threshold).cast("double").alias("publish_threshold"),
        "lead_country_iso3",
        "lead_country_name",
        "lead_tie_count",
    )


def published_backtest(
    summary: DataFrame, comparison: DataFrame, state: DataFrame, *, primary_model: str, baseline_model: str | None,
    calibration: str,
) -> DataFrame:
    """One row that sums up a backtest for publication."""
    top = comparison.where(F.col("is_top_model") == 1).agg(F.min("model_name")).scalar()
    deltas = comparison.where(F.col("delta_pr_auc").isNotNull()).agg(
        F.array_sort(
            F.collect_list(F.struct("model_name", "delta_pr_auc", "delta_roc_auc", "delta_f1", "delta_brier_score"))
        )
    )
    watch = state.select(F.struct("primary_target", "alert_type", "model_status", "no_clear_leader").alias("s")).scalar()
    return summary.withColumn("_watch", watch).select(
        F.lit(primary_model).alias("primary_model"),
        F.lit(baseline_model).alias("baseline_model"),
        top.alias("top_model_name"),
        "_watch.*",
        *summary.columns,
        F.lit(calibration).alias("calibration_method"),
        deltas.scalar().alias("baseline_deltas"),
    )
