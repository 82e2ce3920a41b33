"""Queries over the serving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from registry import query
from registry.panel import FULL_PARTS, FULL_TEXT, full_panel
from registry.standins import articles, conflict, news, rounded, sql
from tocsin.operators.entity_windows import latest_per_key
from tocsin.plans import serving

GOLD = {**FULL_PARTS, "gold": FULL_TEXT}
SNAPSHOT_TEXT = "2001-06-15 00:00:00+00:00"


@query(
    "entity_day_features",
    sql(f"""
    SELECT country_iso3 AS entity_id, country_name AS entity_name, 'country' AS entity_type, feature_date,
           week_start_date AS source_week_start_date, acled_event_count_7d, acled_event_count_28d, gdelt_event_count_7d,
           food_price_index, macro_cpi_yoy,
           sha256('{{"country_iso3": "' || country_iso3 || '", "feature_date": "' || CAST(feature_date AS VARCHAR)
                  || '", "snapshot_ts_utc": "{SNAPSHOT_TEXT}", "week_start_date": "' || CAST(week_start_date AS VARCHAR)
                  || ' 00:00:00"}}') AS feature_snapshot_hash
    FROM (SELECT *, CAST(week_start_date + CAST(unnest(range(7)) AS INTEGER) AS DATE) AS feature_date FROM gold)""", **GOLD),
)
def entity_day_features(spark: SparkSession, sf: str) -> DataFrame:
    days = serving.entity_day_features(full_panel(spark, sf))
    return days.select(
        "entity_id", "entity_name", "entity_type", "feature_date", "source_week_start_date", "acled_event_count_7d",
        "acled_event_count_28d", "gdelt_event_count_7d", rounded("food_price_index").alias("food_price_index"),
        "macro_cpi_yoy", "feature_snapshot_hash",
    )


@query(
    "entity_day_labels",
    sql("""
    SELECT country_iso3 AS entity_id, label_date, horizon_days,
           CASE WHEN horizon_days = 7 THEN label_escalation_7d END AS label_escalation_7d,
           CASE WHEN horizon_days = 30 THEN label_escalation_30d END AS label_escalation_30d,
           CASE WHEN horizon_days = 30 THEN label_onset_30d END AS label_onset_30d,
           CASE WHEN horizon_days = 90 THEN label_onset_90d END AS label_onset_90d,
           CASE WHEN horizon_days = 30 THEN label_interstate_30d END AS label_interstate_30d,
           CASE WHEN horizon_days = 90 THEN label_interstate_onset_90d END AS label_interstate_onset_90d
    FROM (SELECT *, CAST(week_start_date + CAST(unnest(range(7)) AS INTEGER) AS DATE) AS label_date FROM gold),
         (SELECT unnest([7, 30, 90])::BIGINT AS horizon_days)""", **GOLD),
)
def entity_day_labels(spark: SparkSession, sf: str) -> DataFrame:
    return serving.entity_day_labels(full_panel(spark, sf)).select(
        "entity_id", "label_date", "horizon_days", "label_escalation_7d", "label_escalation_30d", "label_onset_30d",
        "label_onset_90d", "label_interstate_30d", "label_interstate_onset_90d",
    )


LIVE = """
    SELECT k.country_id, e.n AS current_event_count, e.g AS current_avg_goldstein, e.t AS current_avg_event_tone,
           e7.n AS trailing_7d_event_count, e7.g AS trailing_7d_avg_goldstein, d.n AS current_document_count,
           d.t AS current_avg_document_tone, d7.n AS trailing_7d_document_count, d7.t AS trailing_7d_avg_document_tone,
           p.idps
    FROM (SELECT country_id FROM newsev UNION SELECT document_country_id FROM arts) k
    LEFT JOIN (SELECT country_id, count(*) AS n, avg(goldstein_scale) AS g, avg(avg_tone) AS t FROM newsev
               WHERE event_date = (SELECT max(event_date) FROM newsev) GROUP BY 1) e USING (country_id)
    LEFT JOIN (SELECT country_id, count(*) AS n, avg(goldstein_scale) AS g FROM newsev
               WHERE event_date >= (SELECT max(event_date) FROM newsev) - 6 GROUP BY 1) e7 USING (country_id)
    LEFT JOIN (SELECT document_country_id AS country_id, count(*) AS n, avg(tone_score) AS t FROM arts
               WHERE document_date = (SELECT max(document_date) FROM arts) GROUP BY 1) d USING (country_id)
    LEFT JOIN (SELECT document_country_id AS country_id, count(*) AS n, avg(tone_score) AS t FROM arts
               WHERE document_date >= (SELECT max(document_date) FROM arts) - 6 GROUP BY 1) d7 USING (country_id)
    LEFT JOIN (SELECT country_iso3 AS country_id, CAST(count(*) AS DOUBLE) AS idps FROM conf GROUP BY 1) p
         USING (country_id)
    WHERE e7.n IS NOT NULL OR d7.n IS NOT NULL"""


@query(
    "live_signals",
    sql("""
    SELECT country_id, current_event_count, round(current_avg_goldstein, 6) AS current_avg_goldstein,
           trailing_7d_event_count, current_document_count,
           round(current_avg_document_tone, 6) AS current_avg_document_tone, trailing_7d_document_count,
           round(trailing_7d_avg_document_tone, 6) AS trailing_7d_avg_document_tone,
           greatest((SELECT max(event_date) FROM newsev), (SELECT max(document_date) FROM arts)) AS as_of_date,
           round(coalesce((c - avg(c) OVER ()) / nullif(stddev_pop(c) OVER (), 0), 0)
                 + coalesce((t - avg(t) OVER ()) / nullif(stddev_pop(t) OVER (), 0), 0)
                 + coalesce((i - avg(i) OVER ()) / nullif(stddev_pop(i) OVER (), 0), 0), 6) AS live_signal_score
    FROM (SELECT *, CAST(coalesce(current_event_count, 0) AS DOUBLE) AS c, -coalesce(current_avg_document_tone, 0.0) AS t,
                 coalesce(idps, 0.0) AS i FROM live)""", live=LIVE),
)
def live_signals(spark: SparkSession, sf: str) -> DataFrame:
    displaced = conflict(spark, sf).groupBy(F.col("country_iso3").alias("country_id")).agg(
        F.count("*").cast("double").alias("idps")
    )
    found = serving.live_signals(news(spark, sf), articles(spark, sf), displaced)
    return found.select(
        "country_id", "current_event_count", rounded("current_avg_goldstein", 6).alias("current_avg_goldstein"),
        "trailing_7d_event_count", "current_document_count",
        rounded("current_avg_document_tone", 6).alias("current_avg_document_tone"), "trailing_7d_document_count",
        rounded("trailing_7d_avg_document_tone", 6).alias("trailing_7d_avg_document_tone"), "as_of_date",
        rounded("live_signal_score", 6).alias("live_signal_score"),
    )


# Newest weeks with known labels: the panel up to six weeks before the snapshot.
SCORED = """
    SELECT *, row_number() OVER (PARTITION BY country_iso3 ORDER BY week_start_date DESC) AS k,
           CASE WHEN label_escalation_7d IS NOT NULL AND label_escalation_30d IS NOT NULL AND label_onset_30d IS NOT NULL
                THEN round_even(least(label_escalation_30d * 0.1::DOUBLE + label_escalation_7d * 0.1::DOUBLE + label_onset_30d * 0.05::DOUBLE
                           + least(acled_event_count_28d, 10) / 50.0 + least(gdelt_event_count_7d, 20) / 200.0
                           + least(food_price_index, 200.0::DOUBLE) / 1000.0, 1.0::DOUBLE), 2) END AS risk_score
    FROM gold"""
NEWEST = """
    SELECT a.*, b.risk_score AS previous_risk_score,
           CASE WHEN a.risk_score >= 0.6 THEN 'high' WHEN a.risk_score >= 0.3 THEN 'medium'
                WHEN a.risk_score IS NOT NULL THEN 'low' END AS risk_level,
           CASE WHEN b.risk_score >= 0.6 THEN 'high' WHEN b.risk_score >= 0.3 THEN 'medium'
                WHEN b.risk_score IS NOT NULL THEN 'low' END AS previous_level,
           a.acled_event_count_28d || ' ACLED event' || CASE WHEN a.acled_event_count_28d = 1 THEN '' ELSE 's' END AS c28,
           a.gdelt_event_count_7d || ' GDELT event' || CASE WHEN a.gdelt_event_count_7d = 1 THEN '' ELSE 's' END AS n7,
           CAST(round_even(a.food_price_index, 1) AS VARCHAR) AS food, lower(a.country_iso3) || '-latest' AS slug,
           sha256('{"country_iso3": "' || a.country_iso3 || '", "snapshot_ts_utc": "2001-06-15 00:00:00+00:00", '
                  || '"week_start_date": "' || CAST(a.week_start_date AS VARCHAR) || ' 00:00:00"}') AS digest
    FROM scored a JOIN scored b ON a.country_iso3 = b.country_iso3 AND a.k = 1 AND b.k = 2"""
SERVED = {**GOLD, "scored": SCORED, "newest": NEWEST}
DRIVERS = """'["ACLED events (28d): ' || acled_event_count_28d || '", "GDELT events (7d): ' || gdelt_event_count_7d
    || '", "Food price index: ' || food || '"]'"""


@query(
    "report_inputs",
    sql(f"""
    SELECT 'report-' || slug AS report_id, slug AS report_slug, country_name || ' Weekly Risk Brief' AS report_title,
           country_iso3, country_name, region_name, CAST(week_start_date + 6 AS DATE) AS report_date,
           risk_score AS forecast_probability, risk_level,
           CASE WHEN risk_level IS NULL
                THEN country_name || ' remains on the current monitoring board because the latest weekly signals show '
                     || c28 || ' over 28 days, ' || n7 || ' over 7 days, and a food price index of ' || food || '.'
                ELSE country_name || ' is in the ' || risk_level || ' monitoring band after ' || c28 || ' over 28 days, '
                     || n7 || ' over 7 days, and a food price index of ' || food || '.' END AS summary,
           country_name AS predicted_conflict_label,
           '[{{"iso3": "' || country_iso3 || '", "country_name": "' || country_name || '"}}]' AS predicted_conflict_countries,
           'report_inputs' AS reason_source,
           '["Week of ' || CAST(week_start_date AS VARCHAR) || ': ' || acled_event_count_7d
           || ' ACLED events in the trailing 7 days.", "Trailing 28-day ACLED events: ' || acled_event_count_28d
           || '.", "GDELT event count in the trailing 7 days: ' || gdelt_event_count_7d || '."]' AS chronology,
           {DRIVERS} AS top_drivers, digest AS source_snapshot_hash
    FROM newest""", **SERVED),
)
def report_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return serving.report_inputs(full_panel(spark, sf)).select(
        "report_id", "report_slug", "report_title", "country_iso3", "country_name", "region_name", "report_date",
        "forecast_probability", "risk_level", "summary", "predicted_conflict_label", "predicted_conflict_countries",
        "reason_source", "chronology", "top_drivers", "source_snapshot_hash",
    )


SOCIAL = f"""
    SELECT *, 'post-' || slug AS post_id, CAST(week_start_date + 6 AS DATE) AS publish_date,
           CASE WHEN risk_level IS NULL
                THEN country_name || ' remains on the current monitoring board. Latest signals show ' || c28
                     || ' over 28 days and ' || n7 || ' over 7 days.'
                ELSE country_name || CASE WHEN previous_level IS NULL THEN ' enters the ' WHEN previous_level = risk_level
                                THEN ' remains in the ' ELSE ' moved into the ' END
           || risk_level || ' monitoring band after ' || c28 || ' over 28 days and ' || n7 || ' over 7 days.' END AS summary_line,
           country_name || ' monitoring update: ' || coalesce(risk_level, 'signal watch') AS headline,
           {DRIVERS} AS top_drivers,
           'ACLED events (28d): ' || acled_event_count_28d || ', GDELT events (7d): ' || gdelt_event_count_7d
           || ', Food price index: ' || food AS driver_text
    FROM newest"""


@query(
    "social_inputs",
    sql("""
    SELECT post_id, country_iso3, publish_date, risk_score AS forecast_probability,
           round_even(risk_score - previous_risk_score, 1) AS score_delta, summary_line, top_drivers,
           slug AS report_slug, headline, summary_line || ' Drivers: ' || driver_text || '.' AS body,
           '/countries/' || slug AS destination_url, digest AS source_snapshot_hash
    FROM social""", **SERVED, social=SOCIAL),
)
def social_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return serving.social_inputs(full_panel(spark, sf)).select(
        "post_id", "country_iso3", "publish_date", "forecast_probability", "score_delta", "summary_line", "top_drivers",
        "report_slug", "headline", "body", "destination_url", "source_snapshot_hash",
    )


@query(
    "review_queue",
    sql("""
    SELECT post_id, country_iso3, publish_date, 'pending_review' AS review_status, formatted_post,
           CAST(length(formatted_post) AS BIGINT) AS character_count
    FROM (SELECT *, headline || chr(10) || chr(10) || summary_line || ' Drivers: ' || driver_text || '.' || chr(10) || chr(10)
                 || 'Review the latest country monitoring brief. /countries/' || slug AS formatted_post FROM social)""",
        **SERVED, social=SOCIAL),
)
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return serving.review_queue(serving.social_inputs(full_panel(spark, sf))).select(
        "post_id", "country_iso3", "publish_date", "review_status", "formatted_post", "character_count"
    )


@query(
    "narrative_candidates",
    sql("""
    SELECT country_iso3 FROM (SELECT country_iso3 FROM newest ORDER BY coalesce(risk_score, -1) DESC, country_iso3 LIMIT 6)
    UNION SELECT unnest(['CHN', 'IRN', 'ISR', 'LBN', 'RUS', 'TWN', 'UKR'])""", **SERVED),
)
def narrative_candidates(spark: SparkSession, sf: str) -> DataFrame:
    latest = latest_per_key(full_panel(spark, sf), "country_iso3", "week_start_date")
    return serving.narrative_candidates(serving.scored_panel(latest))
