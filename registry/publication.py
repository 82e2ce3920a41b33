"""Queries over the published tables, quality checks and the event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from registry import query
from registry.learning import BACKTEST, training_rows
from registry.panel import FULL_PARTS, full_panel, panel_sources
from registry.standins import (
    SNAPSHOT, conflict, model_predictions, prediction_panel, read, rounded, sql, week_panel,
)
from tocsin.functions.scoring import alert_band, freshness_by_days, freshness_by_hours, target_family
from tocsin.operators import quality
from tocsin.operators.entity_windows import latest_and_previous, latest_per_key
from tocsin.plans import alerts, backtest, layers, metrics, panel, publish, serving
from tocsin.plans.contracts import CONTRACTS, checked
from tocsin.session import scratch_dir
from tocsin.streaming.ingest import ingest_daily_counts

TARGET = "label_onset_30d"
PUBLISHED = "2001-08-10 00:00:00"


def published_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return prediction_panel(spark, sf).select(
        F.col("entity_id").alias("country_iso3"), F.col("entity_name").alias("country_name"), "region_name",
        "forecast_date", "calibrated_probability", F.col("second_probability").alias("raw_score"),
        F.lit("alpha").alias("model_name"), F.lit("v1").alias("model_version"), F.lit(TARGET).alias("target_name"),
        F.lit(30).cast("long").alias("horizon_days"),
        F.to_json(F.array(F.struct(F.concat(F.lit("n28 of "), "entity_name").alias("feature"), F.lit(1.0).alias("contribution"))))
        .alias("top_positive_drivers"),
        F.sha2(F.concat("entity_id", F.col("forecast_date").cast("string")), 256).alias("feature_snapshot_hash"),
    )


RECENT = """
    SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY forecast_date DESC) AS k FROM pred"""
RANKED = """
    SELECT row_number() OVER (ORDER BY a.calibrated_probability DESC, a.second_probability DESC, a.entity_name, a.entity_id)
           AS rank, a.entity_id AS iso3, a.entity_name AS country_name, a.region_name,
           round_even(a.calibrated_probability, 4) AS score,
           round_even(a.calibrated_probability - b.calibrated_probability, 4) AS delta,
           (SELECT max(forecast_date) FROM pred) AS forecast_as_of,
           CASE WHEN DATE '2001-08-10' - (SELECT max(forecast_date) FROM pred) <= 10 THEN 'fresh'
                WHEN DATE '2001-08-10' - (SELECT max(forecast_date) FROM pred) <= 21 THEN 'aging' ELSE 'stale' END
           AS freshness_tier, a.calibrated_probability
    FROM recent a LEFT JOIN recent b ON a.entity_id = b.entity_id AND b.k = 2 WHERE a.k = 1"""
PARTS = {"recent": RECENT, "ranking": RANKED}


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return publish.ranked_snapshot(published_predictions(spark, sf), F.lit(PUBLISHED).cast("timestamp"))


@query(
    "ranked_snapshot",
    sql("SELECT rank, iso3, country_name, region_name, score, delta, forecast_as_of, freshness_tier FROM ranking", **PARTS),
)
def ranked_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot(spark, sf).drop("calibrated_probability")


@query(
    "score_delta",
    sql("""SELECT a.entity_id, a.forecast_date, round(a.calibrated_probability - b.calibrated_probability, 6) AS delta
           FROM recent a JOIN recent b ON a.entity_id = b.entity_id AND a.k = 1 AND b.k = 2""", **PARTS),
)
def score_delta(spark: SparkSession, sf: str) -> DataFrame:
    rows = prediction_panel(spark, sf).select("entity_id", "forecast_date", "calibrated_probability")
    pair = latest_and_previous(rows, "entity_id", "forecast_date", ["calibrated_probability"])
    change = F.col("calibrated_probability") - F.col("previous_calibrated_probability")
    return pair.select("entity_id", "forecast_date", rounded(change, 6).alias("delta"))


@query(
    "latest_per_key",
    sql("SELECT entity_id, forecast_date, n28 FROM recent WHERE k = 1", **PARTS),
)
def latest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return latest_per_key(prediction_panel(spark, sf), "entity_id", "forecast_date").select(
        "entity_id", "forecast_date", "n28"
    )


@query(
    "lead_ties",
    sql("""SELECT round(max(calibrated_probability), 6) AS lead_score,
                  count(*) FILTER (calibrated_probability = (SELECT max(calibrated_probability) FROM ranking)) AS lead_tie_count
           FROM ranking""", **PARTS),
)
def lead_ties(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.lead_ties(snapshot(spark, sf), "calibrated_probability").withColumn(
        "lead_score", rounded("lead_score", 6)
    )


STATE = """
    SELECT a.iso3 AS lead_country_iso3, a.country_name AS lead_country_name, a.score AS lead_score, b.score AS second_score,
           (SELECT count(*) FROM ranking WHERE calibrated_probability = a.calibrated_probability) AS lead_tie_count,
           (SELECT count(*) FROM ranking) AS coverage_count, a.forecast_as_of, a.freshness_tier, 'onset' AS primary_target,
           CAST(a.score < 0.4 OR a.score - b.score < 0.02
                OR (SELECT count(*) FROM ranking WHERE calibrated_probability = a.calibrated_probability) > 1 AS INT)
           AS no_clear_leader
    FROM ranking a, ranking b WHERE a.rank = 1 AND b.rank = 2"""


def state(spark: SparkSession, sf: str) -> DataFrame:
    return publish.publication_state(
        snapshot(spark, sf), TARGET, baseline_used=False, primary_model="alpha", top_model="alpha", publish_threshold=0.4
    )


@query(
    "publication_state",
    sql("""SELECT *, CASE WHEN no_clear_leader = 1 THEN 'No Clear Leader' ELSE 'Onset Watch' END AS alert_type,
                  CASE WHEN no_clear_leader = 1 THEN 'monitoring_only' ELSE 'promoted' END AS model_status FROM state""",
        **PARTS, state=STATE),
)
def publication_state(spark: SparkSession, sf: str) -> DataFrame:
    return state(spark, sf)


@query(
    "status_row",
    sql("""SELECT 'ok' AS status, freshness_tier, '2001-08-10 00:00:00' AS published_at, forecast_as_of,
                  CAST(0 AS INT) AS baseline_used, coverage_count, lead_tie_count, lead_country_iso3, no_clear_leader,
                  0.4::DOUBLE AS publish_threshold FROM state""", **PARTS, state=STATE),
)
def status_row(spark: SparkSession, sf: str) -> DataFrame:
    row = publish.status_row(state(spark, sf), published_at=PUBLISHED, baseline_used=False, publish_threshold=0.4)
    return row.select(
        "status", "freshness_tier", "published_at", "forecast_as_of", "baseline_used", "coverage_count", "lead_tie_count",
        "lead_country_iso3", "no_clear_leader", "publish_threshold",
    )


def reports(spark: SparkSession, sf: str, explicit: bool) -> DataFrame:
    """Briefs whose text names two other nations of the prediction table."""
    latest = latest_per_key(published_predictions(spark, sf), "country_iso3", "forecast_date")
    name = F.col("country_name")
    # Numbers inside the text and not quoted names, so that the mention search has something to find.
    text = F.concat(F.lit("Tension of "), name, F.lit(" with nation_1"), F.right(name, F.lit(1)), F.lit(" and nation_2."))
    countries = F.concat(F.lit('[{"iso3": "XXA", "country_name": "First"}, {"name": "'), name, F.lit('"}, "Third"]'))
    return latest.select(
        "country_iso3",
        F.concat(F.lower("country_iso3"), F.lit("-latest")).alias("report_slug"),
        F.concat(name, F.lit(" Weekly Risk Brief")).alias("report_title"),
        text.alias("summary"),
        F.lit('["first line", "second line"]').alias("chronology"),
        F.when(F.col("country_iso3") > "NAH", F.concat(F.lit('["driver of '), name, F.lit('"]'))).alias("top_drivers_json"),
        (countries if explicit else F.lit(None).cast("string")).alias("predicted_conflict_countries"),
        F.lit(" ").alias("predicted_conflict_label"),
        F.lit("unknown").alias("reason_source"),
        F.when(F.col("country_iso3") < "NAP", F.sha2("country_iso3", 256)).alias("source_snapshot_hash"),
    )


MENTIONS = """
    SELECT r.rank, r.iso3, r.country_name FROM ranking r, (SELECT * FROM ranking WHERE rank = 1) l
    WHERE r.rank <= 10 AND contains(lower(l.country_name || ' weekly risk brief tension of ' || l.country_name || ' with nation_1'
          || right(l.country_name, 1) || ' and nation_2. first line second line'), lower(r.country_name))"""


@query(
    "predicted_conflict",
    sql("""
    SELECT string_agg(m.country_name, ' / ' ORDER BY m.rank) AS label, string_agg(m.iso3, ' / ' ORDER BY m.rank) AS codes,
           'report_inputs' AS reason_source, lower(min(l.iso3)) || '-latest' AS report_slug
    FROM mentions m, (SELECT * FROM ranking WHERE rank = 1) l""", **PARTS, mentions=MENTIONS),
)
def predicted_conflict(spark: SparkSession, sf: str) -> DataFrame:
    row = publish.predicted_conflict(snapshot(spark, sf), reports(spark, sf, explicit=False), TARGET, 30)
    return row.select(
        "label", F.array_join(F.transform("countries", lambda c: c["iso3"]), " / ").alias("codes"), "reason_source",
        "report_slug",
    )


@query(
    "predicted_conflict_listed",
    sql("""SELECT 'First / ' || country_name || ' / Third' AS label, 'XXA' AS codes, 'report_inputs' AS reason_source,
                  lower(iso3) || '-latest' AS report_slug FROM ranking WHERE rank = 1""", **PARTS),
)
def predicted_conflict_listed(spark: SparkSession, sf: str) -> DataFrame:
    row = publish.predicted_conflict(snapshot(spark, sf), reports(spark, sf, explicit=True), TARGET, 30)
    return row.select(
        "label", F.array_join(F.transform("countries", lambda c: c["iso3"]), " / ").alias("codes"), "reason_source",
        "report_slug",
    )


@query(
    "mentioned_countries",
    sql("SELECT * FROM mentions", **PARTS, mentions=MENTIONS),
)
def mentioned_countries(spark: SparkSession, sf: str) -> DataFrame:
    ranks = snapshot(spark, sf)
    text = ranks.where(F.col("rank") == 1).join(
        reports(spark, sf, explicit=False).withColumnRenamed("country_iso3", "iso3"), "iso3"
    ).select(F.concat_ws(" ", "report_title", "summary", F.lit("first line second line")).alias("text"))
    return publish.mentioned_countries(text, ranks)


@query(
    "country_detail",
    sql("""
    SELECT rank, iso3, country_name, score, delta, lower(iso3) || '-latest' AS report_slug,
           'first line|second line' AS chronology,
           CASE WHEN iso3 > 'NAH' THEN 'driver of ' || country_name ELSE 'n28 of ' || country_name END AS top_drivers,
           'alpha' AS model_name, CAST(30 AS BIGINT) AS horizon_days,
           CASE WHEN iso3 < 'NAP' THEN sha256(iso3) ELSE sha256(iso3 || CAST(forecast_as_of AS VARCHAR)) END
           AS source_snapshot_hash,
           CASE WHEN calibrated_probability >= 0.7 THEN 'alert' WHEN calibrated_probability >= 0.6 THEN 'operating'
                WHEN calibrated_probability >= 0.5 THEN 'warning' ELSE 'below_threshold' END AS alert_band
    FROM ranking""", **PARTS),
)
def country_detail(spark: SparkSession, sf: str) -> DataFrame:
    detail = publish.country_detail(snapshot(spark, sf), published_predictions(spark, sf), reports(spark, sf, True))
    return detail.select(
        "rank", "iso3", "country_name", "score", "delta", "report_slug", F.array_join("chronology", "|").alias("chronology"),
        F.array_join("top_drivers", "|").alias("top_drivers"), "model_name", "horizon_days", "source_snapshot_hash",
        "alert_band",
    )


@query(
    "published_backtest",
    sql("""
    SELECT 'alpha' AS primary_model, CAST(sum(is_new_alert) AS BIGINT) AS new_alert_count,
           count(*) FILTER (is_new_alert = 1 AND next_positive IS NOT NULL) AS true_alert_count
    FROM (SELECT *, CAST(is_alert AND (last_alert IS NULL OR forecast_date - last_alert > 30) AS INT) AS is_new_alert
          FROM (SELECT *, max(CASE WHEN is_alert THEN forecast_date END) OVER (PARTITION BY entity_id ORDER BY forecast_date
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_alert,
                       min(CASE WHEN label = 1 THEN forecast_date END) OVER (PARTITION BY entity_id ORDER BY forecast_date
                              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_positive
                FROM (SELECT *, calibrated_probability >= 0.7 AS is_alert FROM pred)))"""),
)
def published_backtest(spark: SparkSession, sf: str) -> DataFrame:
    rows = prediction_panel(spark, sf)
    table = alerts.alert_table(rows, 0.7, 30)
    limits = spark.range(1).select(F.lit(0.7).alias("publish_threshold"), F.lit(0.7).alias("alert_threshold"))
    summary = backtest.backtest_summary(alerts.alert_summary(table), alerts.ranking_metrics(rows, 0.7), limits)
    measured = metrics.classification_metrics(model_predictions(spark, sf), "raw_score", groups=["model_name"])
    comparison = metrics.model_comparison(measured, "beta")
    published = publish.published_backtest(
        summary, comparison, state(spark, sf), primary_model="alpha", baseline_model="beta", calibration="isotonic"
    )
    return published.select("primary_model", "new_alert_count", "true_alert_count")


@query(
    "published_model_backtest",
    """SELECT 'logit' AS primary_model, 'prior_rate' AS baseline_model, 'isotonic' AS calibration_method, TRUE AS counts_agree,
              TRUE AS knows_top_model, ['logit'] AS compared""",
)
def published_model_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """The published row of a trained backtest: names as given, counts that agree, deltas of all but the baseline."""
    result = backtest.run_backtest(training_rows(spark, sf), BACKTEST)
    row = publish.published_backtest(
        result.summary, result.comparison, state(spark, sf), primary_model="logit", baseline_model="prior_rate",
        calibration="isotonic",
    )
    return row.select(
        "primary_model", "baseline_model", "calibration_method",
        (F.col("new_alert_count") == F.col("true_alert_count") + F.col("false_alert_count")).alias("counts_agree"),
        F.col("top_model_name").isin("logit", "prior_rate").alias("knows_top_model"),
        F.col("baseline_deltas.model_name").alias("compared"),
    )


@query(
    "freshness_and_bands",
    sql("""
    SELECT entity_id, forecast_date,
           CASE WHEN age <= 100 THEN 'fresh' WHEN age <= 1000 THEN 'aging' ELSE 'stale' END AS by_hours,
           CASE WHEN age <= 100 THEN 'fresh' WHEN age <= 1000 THEN 'aging' WHEN age <= 2000 THEN 'stale' ELSE 'critical' END
           AS by_days,
           CASE WHEN calibrated_probability >= 0.7 THEN 'alert' WHEN calibrated_probability >= 0.6 THEN 'operating'
                WHEN calibrated_probability >= 0.5 THEN 'warning' ELSE 'below_threshold' END AS band,
           CASE WHEN n7 % 3 = 0 THEN 'onset' WHEN n7 % 3 = 1 THEN 'escalation' ELSE 'other risk' END AS family
    FROM (SELECT *, greatest(DATE '2001-06-15' - forecast_date, 0) AS age FROM pred)"""),
)
def freshness_and_bands(spark: SparkSession, sf: str) -> DataFrame:
    reference = F.lit("2001-06-15").cast("date")
    name = F.when(F.col("n7") % 3 == 0, "Label_ONSET_30d").when(F.col("n7") % 3 == 1, "x_escalation").otherwise(" Other Risk")
    return prediction_panel(spark, sf).select(
        "entity_id", "forecast_date",
        freshness_by_hours(reference.cast("timestamp"), F.col("forecast_date").cast("timestamp"), 100, 1000).alias("by_hours"),
        freshness_by_days(reference, F.col("forecast_date"), 100, 1000, 2000).alias("by_days"),
        alert_band("calibrated_probability").alias("band"), target_family(name).alias("family"),
    )


@query(
    "table_profile",
    sql("""
    SELECT 'conflict' AS table_name, count(*) AS row_count, CAST(11 AS BIGINT) AS column_count,
           'country_iso3=' || count(*) FILTER (country_iso3 IS NULL) || ';actor2_name=' || count(*) FILTER (actor2_name IS NULL)
           AS null_counts FROM conf
    UNION ALL
    SELECT 'predictions', count(*), 10, 'entity_id=' || count(*) FILTER (entity_id IS NULL) || ';next_event_date='
           || count(*) FILTER (next_event_date IS NULL) FROM pred"""),
)
def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    return quality.profile_tables(
        {
            "conflict": (conflict(spark, sf), ["country_iso3", "actor2_name", "absent"]),
            "predictions": (prediction_panel(spark, sf), ["entity_id", "next_event_date"]),
        }
    )


@query(
    "invalid_rows",
    sql("""SELECT count(*) AS row_count, count(*) FILTER (next_event_date IS NULL OR calibrated_probability IS NULL)
           AS invalid_count FROM pred"""),
)
def invalid_rows(spark: SparkSession, sf: str) -> DataFrame:
    return quality.invalid_rows(prediction_panel(spark, sf), ["next_event_date", "calibrated_probability"])


@query(
    "duplicate_keys",
    sql("""SELECT country_iso3, event_date, count(*) AS row_count FROM conf GROUP BY 1, 2 HAVING count(*) > 1"""),
)
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_keys(conflict(spark, sf), ["country_iso3", "event_date"])


@query(
    "dense_panel_check",
    sql("""
    SELECT entity_id, count(*) AS row_count, count(DISTINCT week_start_date) AS week_count,
           min(week_start_date) AS first_week, max(week_start_date) AS last_week,
           (SELECT count(*) FROM weeks) AS span_weeks, CAST(count(*) = (SELECT count(*) FROM weeks) AS INT) AS is_dense
    FROM panel GROUP BY 1"""),
)
def dense_panel_check(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dense_panel_check(week_panel(spark, sf), "entity_id", "week_start_date")


@query(
    "contract_check",
    sql("""
    SELECT 'country_week_features' AS table_name, count(*) AS row_count FROM base
    UNION ALL SELECT 'entity_day_features', count(*) * 7 FROM base
    UNION ALL SELECT 'entity_day_labels', count(*) * 21 FROM base
    UNION ALL SELECT 'report_inputs', count(DISTINCT entity_id) FROM base
    UNION ALL SELECT 'social_inputs', count(DISTINCT entity_id) FROM base""", **FULL_PARTS),
)
def contract_check(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of the serving tables that meet their contracts; a missing column stops the query."""
    gold = full_panel(spark, sf)
    tables = {
        "country_week_features": gold,
        "entity_day_features": serving.entity_day_features(gold),
        "entity_day_labels": serving.entity_day_labels(gold),
        "report_inputs": serving.report_inputs(gold),
        "social_inputs": serving.social_inputs(gold),
    }
    profiles = quality.profile_tables(
        {name: (checked(frame, name), CONTRACTS[name].keys) for name, frame in tables.items()}
    )
    return profiles.select("table_name", "row_count")


@query(
    "stream_daily_counts",
    """SELECT user_id, CAST(ts AS DATE) AS event_date, count(*) AS event_count, sum(floor(value)) AS whole_value
       FROM events GROUP BY 1, 2""",
)
def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType(
        [T.StructField(f.name, T.TimestampType() if f.name == "ts" else f.dataType) for f in read(spark, sf, "events").schema]
    )
    # Windows need an instant; the files hold local times, which the session zone (UTC) reads unchanged.
    home = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    # Three drops of several files; days of a later one lie among and before those of an earlier one, and the last one
    # adds to days that both have written.
    drop = F.when(F.hour("ts") == 12, 2).otherwise(F.dayofmonth("ts") % 2)
    for number in range(3):
        events.where(drop == number).write.mode("append").parquet(f"{home}/in")
        found = ingest_daily_counts(
            spark, f"{home}/in", schema, "user_id", "ts", base=f"{home}/state", state_partitions=8,
            whole_value=F.sum(F.floor("value")).cast("double"),
        )
    return found


def _profile_sql(name: str, rows: str, columns: int, keys: tuple[str, ...], times: int = 1) -> str:
    """rows: the table as SQL. keys: columns of it whose nulls are counted, with the name behind AS if it differs."""
    nulls = " || ';' || ".join(
        f"'{key.split(' AS ')[-1]}=' || count(*) FILTER ({key.split(' AS ')[0]} IS NULL) * {times}" for key in keys
    )
    return (f"SELECT '{name}' AS table_name, count(*) * {times} AS row_count, CAST({columns} AS BIGINT) AS column_count, "
            f"{nulls} AS null_counts FROM {rows}")


MONTH, YEAR = ("country_iso3", "observation_date"), ("country_iso3", "year")
PROFILES = [
    ("silver_gdelt_events", "newsev", 8, ("country_id", "event_date")),
    ("silver_gdelt_gkg_documents", "arts", 4, ("document_country_id", "document_date")),
    ("silver_acled_events", "conf", 11, ("country_iso3", "event_date", "source_record_id")),
    ("silver_imf_commodity_series", "prices", 7, ("observation_date",)),
    ("silver_fao_food_price_series", "prices", 7, ("observation_date",)),
    ("silver_wgi_country_year_snapshot", "govern", 10, YEAR),
    ("silver_idea_elections", "cal", 3, ("country_iso3", "election_date")),
    ("silver_noaa_climate_series", "weather", 6, MONTH),
    ("silver_sipri_security_series", "arms", 6, YEAR),
    ("silver_nasa_black_marble_night_lights", "lights", 5, MONTH),
    ("silver_un_comtrade_trade_series", "trade", 7, MONTH),
    ("silver_unctad_shipping_series", "ships", 5, MONTH),
    ("silver_unhcr_origin_population", "fled", 6, ("country_iso3 AS country_id", "year")),
    ("silver_ucdp_events", "viol", 8, ("country_iso3", "event_date_start")),
    ("silver_ucdp_interstate_onset", "truth WHERE onset_type = 'interstate'", 7, YEAR),
    ("silver_ucdp_intrastate_onset", "truth WHERE onset_type = 'intrastate'", 7, YEAR),
    ("silver_wdi_indicator_series", "macro", 6, YEAR),
    ("gold_country_week_features", "base", 81, ("entity_id AS country_iso3", "week_start_date")),
    ("gold_entity_day_features", "base", 16, ("entity_id", "week_start_date AS feature_date"), 7),
    ("gold_entity_day_labels", "base", 16, ("entity_id", "week_start_date AS label_date", "entity_id AS horizon_days"), 21),
    ("gold_report_inputs", "nat", 22, ("country_iso3 AS report_id", "country_iso3", "country_iso3 AS report_date")),
    ("gold_social_inputs", "nat", 19, ("country_iso3 AS post_id", "country_iso3 AS platform_name", "country_iso3",
                                       "country_iso3 AS publish_date")),
]


@query("layer_profiles", sql(" UNION ALL ".join(_profile_sql(*row) for row in PROFILES), **FULL_PARTS))
def layer_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """All tables of the typed and serving layers, written and profiled while they are written."""
    root = f"{scratch_dir(spark)}/layers-{uuid.uuid4().hex}"
    written = layers.write_layers(
        spark, root, panel_sources(spark, sf), lambda typed: panel.country_week_features(spark, typed, SNAPSHOT)
    )
    return written.report
