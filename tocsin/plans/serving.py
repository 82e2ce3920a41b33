"""Serving tables derived from the weekly panel, and live signals from raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tocsin.functions import scoring
from tocsin.operators.entity_windows import latest_and_previous, latest_per_key
from tocsin.operators.quality import require_columns
from tocsin.session import kept

# Label columns of each horizon.
HORIZON_LABELS = {
    7: ["label_escalation_7d"],
    30: ["label_escalation_30d", "label_onset_30d", "label_interstate_30d", "label_interstate_onset_30d"],
    90: ["label_onset_90d", "label_interstate_onset_90d"],
}
LABELS = [
    "label_escalation_7d", "label_escalation_30d", "label_onset_30d", "label_onset_90d", "label_interstate_30d",
    "label_interstate_onset_30d", "label_interstate_onset_90d",
]

# Countries whose brief names a pair.
CONFLICT_PAIRS = {
    "CHN": [("TWN", "Taiwan"), ("CHN", "China")],
    "IRN": [("IRN", "Iran"), ("ISR", "Israel")],
    "ISR": [("IRN", "Iran"), ("ISR", "Israel")],
    "LBN": [("LBN", "Lebanon"), ("ISR", "Israel")],
    "RUS": [("UKR", "Ukraine"), ("RUS", "Russia")],
    "TWN": [("TWN", "Taiwan"), ("CHN", "China")],
    "UKR": [("UKR", "Ukraine"), ("RUS", "Russia")],
}

# Columns and constants of the social table.
SOCIAL_COLUMNS = """
post_id platform_name country_iso3 country_name publish_date as_of_date forecast_target forecast_horizon_days
forecast_probability score_delta summary_line top_drivers report_slug headline body call_to_action
destination_url source_snapshot_hash snapshot_ts_utc
""".split()
CALL_TO_ACTION = "Review the latest country monitoring brief."
FORECAST_TARGET, FORECAST_HORIZON = "label_escalation_30d", 30


def _days(day_name: str) -> Column:
    return F.explode(F.sequence("week_start_date", F.date_add("week_start_date", 6))).alias(day_name)


def entity_day_features(panel: DataFrame) -> DataFrame:
    """Each panel row on its seven days, with a digest. Row-local: no shuffle."""
    expanded = panel.select("*", _days("feature_date"))
    digest = F.sha2(
        scoring.json_text(
            ("country_iso3", F.col("country_iso3")),
            ("feature_date", F.date_format("feature_date", "yyyy-MM-dd")),
            ("snapshot_ts_utc", scoring.snapshot_text("snapshot_ts_utc")),
            ("week_start_date", F.date_format("week_start_date", "yyyy-MM-dd HH:mm:ss")),
        ),
        256,
    )
    return expanded.select(
        F.col("country_iso3").alias("entity_id"),
        F.col("country_name").alias("entity_name"),
        F.lit("country").alias("entity_type"),
        "country_iso3",
        "country_name",
        "region_name",
        "feature_date",
        F.col("week_start_date").alias("source_week_start_date"),
        "acled_event_count_7d",
        "acled_event_count_28d",
        "gdelt_event_count_7d",
        "food_price_index",
        "macro_cpi_yoy",
        "climate_drought_severity_index",
        "snapshot_ts_utc",
        digest.alias("feature_snapshot_hash"),
    )


def entity_day_labels(panel: DataFrame) -> DataFrame:
    """Each panel row on its seven days and three horizons; only the labels of the horizon are filled."""
    expanded = panel.select("*", _days("label_date")).withColumn(
        "horizon_days", F.explode(F.array(*[F.lit(horizon).cast("long") for horizon in HORIZON_LABELS]))
    )

    def masked(label: str) -> Column:
        horizon = next(days for days, labels in HORIZON_LABELS.items() if label in labels)
        return F.when(F.col("horizon_days") == horizon, F.col(label)).alias(label)

    return expanded.select(
        F.col("country_iso3").alias("entity_id"),
        F.col("country_name").alias("entity_name"),
        F.lit("country").alias("entity_type"),
        "country_iso3",
        "country_name",
        "label_date",
        F.col("week_start_date").alias("source_week_start_date"),
        "horizon_days",
        *[masked(label) for label in LABELS],
        "snapshot_ts_utc",
    )


def zscores_or_zero(df: DataFrame, columns: list[str]) -> list[Column]:
    """Population z-score of each column over the frame, null as 0; 0 when nothing varies. One aggregate for all."""
    values = {column: F.coalesce(F.col(column).cast("double"), F.lit(0.0)) for column in columns}
    stats = df.agg(
        F.struct(
            *[F.avg(value).alias(f"mean_{column}") for column, value in values.items()],
            *[F.stddev_pop(value).alias(f"deviation_{column}") for column, value in values.items()],
        ).alias("stats")
    ).scalar()
    return [
        F.when(
            stats.getField(f"deviation_{column}") > 0,
            (value - stats.getField(f"mean_{column}")) / stats.getField(f"deviation_{column}"),
        ).otherwise(F.lit(0.0))
        for column, value in values.items()
    ]


def live_signals(events: DataFrame, documents: DataFrame, displacement: DataFrame) -> DataFrame:
    """Per country: counts and tones on the newest day and the 7 days up to it, plus a composite score.

    Events and documents each pass through one filtered aggregate (the newest day is a scalar that reaches the
    scan as a filter); their rows are united by country, the unknown country included.
    """

    def newest(df: DataFrame, column: str) -> Column:
        return df.agg(F.max(column)).scalar()

    event_day, document_day = newest(events, "event_date"), newest(documents, "document_date")
    today = F.col("event_date") == event_day
    event_side = (
        events.where(F.col("event_date").between(F.date_sub(event_day, 6), event_day))
        .groupBy(F.col("country_id"))
        .agg(
            F.count_if(today).alias("_today"),
            F.count(F.when(today, F.col("global_event_id"))).alias("current_event_count"),
            F.avg(F.when(today, F.col("goldstein_scale"))).alias("current_avg_goldstein"),
            F.avg(F.when(today, F.col("avg_tone"))).alias("current_avg_event_tone"),
            F.count("global_event_id").alias("trailing_7d_event_count"),
            F.avg("goldstein_scale").alias("trailing_7d_avg_goldstein"),
        )
        .withColumn("current_event_count", F.when(F.col("_today") > 0, F.col("current_event_count")))
        .drop("_today")
    )
    now = F.col("document_date") == document_day
    document_side = (
        documents.where(F.col("document_date").between(F.date_sub(document_day, 6), document_day))
        .groupBy(F.col("document_country_id").alias("country_id"))
        .agg(
            F.count_if(now).alias("_today"),
            F.count(F.when(now, F.col("document_identifier"))).alias("current_document_count"),
            F.avg(F.when(now, F.col("tone_score"))).alias("current_avg_document_tone"),
            F.count("document_identifier").alias("trailing_7d_document_count"),
            F.avg("tone_score").alias("trailing_7d_avg_document_tone"),
        )
        .withColumn("current_document_count", F.when(F.col("_today") > 0, F.col("current_document_count")))
        .drop("_today")
    )
    measures = [c for c in [*event_side.columns, *document_side.columns] if c != "country_id"]
    combined = (
        event_side.unionByName(document_side, allowMissingColumns=True)
        .groupBy("country_id")
        .agg(*[F.max(column).alias(column) for column in measures])
        .join(displacement, "country_id", "left")
    )
    combined = kept(combined, "signals")  # one row per country, read by the score and its means
    scored = combined.withColumn("_calm", -F.coalesce("current_avg_document_tone", F.lit(0.0)))
    busy, calm, displaced = zscores_or_zero(scored, ["current_event_count", "_calm", "idps"])
    return scored.select(
        "*", F.greatest(event_day, document_day).alias("as_of_date"), (busy + calm + displaced).alias("live_signal_score")
    ).drop("_calm")


def _pairs() -> Column:
    entries: list[Column] = []
    for iso3, members in CONFLICT_PAIRS.items():
        structs = [F.struct(F.lit(code).alias("iso3"), F.lit(name).alias("country_name")) for code, name in members]
        entries += [F.lit(iso3), F.array(*structs)]
    return F.create_map(*entries)


def predicted_conflict(iso3: Column, name: Column) -> Column:
    """Countries named in the brief of a country: its fixed pair, else the country itself."""
    own = F.array(F.struct(F.upper(iso3).alias("iso3"), name.alias("country_name")))
    return F.coalesce(F.element_at(_pairs(), F.upper(iso3)), own)


def countries_json(countries: Column) -> Column:
    """JSON text of an array of (iso3, country_name)."""
    items = F.transform(
        countries,
        lambda c: F.concat(
            F.lit('{"iso3": '), scoring.json_quoted(c["iso3"]), F.lit(', "country_name": '),
            scoring.json_quoted(c["country_name"]), F.lit("}"),
        ),
    )
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def scored_panel(panel: DataFrame) -> DataFrame:
    """Panel with the monitoring score."""
    return panel.withColumn("risk_score", scoring.risk_score())


def narrative_candidates(latest: DataFrame, count: int = 6) -> DataFrame:
    """Codes of the ``count`` highest scores (unknown last) together with the fixed pairs' codes."""
    order = [F.coalesce("risk_score", F.lit(-1.0)).desc(), F.col("country_iso3").asc()]
    top = latest.orderBy(*order).limit(count).select(F.upper("country_iso3").alias("country_iso3"))
    fixed = latest.sparkSession.createDataFrame([(iso3,) for iso3 in CONFLICT_PAIRS], "country_iso3 string")
    return top.unionByName(fixed).distinct()


def report_inputs(panel: DataFrame) -> DataFrame:
    """One brief per country from its newest week."""
    latest = scored_panel(latest_per_key(panel, "country_iso3", "week_start_date")).withColumns(
        {
            "risk_level": scoring.risk_level("risk_score"),
            "report_slug": F.concat(F.lower("country_iso3"), F.lit("-latest")),
            "_pair": predicted_conflict(F.col("country_iso3"), F.col("country_name")),
            "_drivers": scoring.json_array(scoring.driver_texts()),
        }
    )
    report_date = F.date_add("week_start_date", 6)
    return latest.select(
        F.concat(F.lit("report-"), "report_slug").alias("report_id"),
        "report_slug",
        F.concat("country_name", F.lit(" Weekly Risk Brief")).alias("report_title"),
        "country_iso3",
        "country_name",
        "region_name",
        report_date.alias("report_date"),
        report_date.alias("as_of_date"),
        F.lit(FORECAST_HORIZON).cast("long").alias("forecast_horizon_days"),
        F.lit(FORECAST_TARGET).alias("forecast_target"),
        F.col("risk_score").alias("forecast_probability"),
        "risk_level",
        F.lit(6).cast("long").alias("freshness_days"),
        scoring.summary_text("risk_level").alias("summary"),
        F.array_join(F.transform("_pair", lambda c: c["country_name"]), " / ").alias("predicted_conflict_label"),
        countries_json(F.col("_pair")).alias("predicted_conflict_countries"),
        F.lit("report_inputs").alias("reason_source"),
        scoring.json_array(scoring.chronology_texts()).alias("chronology"),
        F.col("_drivers").alias("top_drivers"),
        F.col("_drivers").alias("top_drivers_json"),
        scoring.snapshot_hash().alias("source_snapshot_hash"),
        "snapshot_ts_utc",
    )


def social_inputs(panel: DataFrame) -> DataFrame:
    """One post per country: newest week, change against the week before, band movement."""
    paired = latest_and_previous(scored_panel(panel), "country_iso3", "week_start_date", ["risk_score"])
    score, previous = F.col("risk_score"), F.col("previous_risk_score")
    delta = F.when(score.isNotNull() & previous.isNotNull(), F.bround(score - previous, 1)).when(
        score.isNotNull() & (F.col("row_total") == 1), F.lit(0.0)
    )
    level, before = scoring.risk_level(score), scoring.risk_level(previous)
    signals = F.concat(
        scoring.conflict_phrase(), F.lit(" over 28 days and "), scoring.news_phrase(), F.lit(" over 7 days.")
    )
    movement = F.when(before.isNull(), "enters the ").when(before == level, "remains in the ").otherwise(
        "moved into the "
    )
    summary = F.when(
        score.isNull(),
        F.concat("country_name", F.lit(" remains on the current monitoring board. Latest signals show "), signals),
    ).otherwise(
        F.concat("country_name", F.lit(" "), movement, level, F.lit(" monitoring band after "), signals)
    )
    drivers = scoring.driver_texts()
    slug = F.concat(F.lower("country_iso3"), F.lit("-latest"))
    publish_date = F.date_add("week_start_date", 6)
    values = {
        "post_id": F.concat(F.lit("post-"), slug),
        "platform_name": F.lit("generic"),
        "publish_date": publish_date,
        "as_of_date": publish_date,
        "forecast_target": F.lit(FORECAST_TARGET),
        "forecast_horizon_days": F.lit(FORECAST_HORIZON).cast("long"),
        "forecast_probability": score,
        "score_delta": delta,
        "summary_line": summary,
        "top_drivers": scoring.json_array(drivers),
        "report_slug": slug,
        "headline": F.concat(
            "country_name", F.lit(" monitoring update: "), F.coalesce(level, F.lit("signal watch"))
        ),
        "body": F.concat(summary, F.lit(" Drivers: "), F.array_join(drivers, ", "), F.lit(".")),
        "call_to_action": F.lit(CALL_TO_ACTION),
        "destination_url": F.concat(F.lit("/countries/"), slug),
        "source_snapshot_hash": scoring.snapshot_hash(),
    }
    return paired.select(*[values[name].alias(name) if name in values else name for name in SOCIAL_COLUMNS])


def format_posts(posts: DataFrame) -> DataFrame:
    """Post text from headline, body and call to action, blank parts left out, with its length."""
    require_columns(
        posts,
        ["post_id", "platform_name", "country_iso3", "country_name", "publish_date", "summary_line", "headline", "body",
         "call_to_action", "destination_url", "source_snapshot_hash"],
        "social posts",
    )

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    action = F.when(text("destination_url") == "", text("call_to_action")).otherwise(
        F.trim(F.concat(text("call_to_action"), F.lit(" "), text("destination_url")))
    )
    parts = [F.nullif(part, F.lit("")) for part in (text("headline"), text("body"), action)]
    post = F.trim(F.concat_ws("\n\n", *parts))
    return posts.withColumns(
        {
            "review_status": F.lit("pending_review"),
            "review_notes": F.lit(""),
            "formatted_post": post,
        }
    ).withColumn("character_count", F.length("formatted_post").cast("long"))


def review_queue(social: DataFrame) -> DataFrame:
    """Formatted posts waiting for review, by date, country and id."""
    require_columns(social, SOCIAL_COLUMNS, "social_inputs")
    return format_posts(social).orderBy("publish_date", "country_iso3", "post_id")
