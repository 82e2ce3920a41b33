"""Panel queries: grid windows, as-of values, onset dating, labels, the whole panel."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from registry import query
from registry.standins import (
    SNAPSHOT,
    SNAPSHOT_DAY,
    articles,
    calendar_days,
    conflict,
    monthly_climate,
    monthly_night_lights,
    monthly_prices,
    monthly_shipping,
    monthly_trade,
    nations,
    news,
    onset_truth,
    read,
    rounded,
    sql,
    violence,
    week_panel,
    yearly_displacement,
    yearly_governance,
    yearly_macro,
    yearly_security,
)
from tocsin.functions.calendar import days_between, within_days
from tocsin.functions.scoring import known_flag, short_long_delta
from tocsin.operators import grid
from tocsin.operators.grid import RangeSum
from tocsin.operators.onset import localize_onsets, truth_cutoff
from tocsin.plans import panel as plans
from tocsin.sources.countries import country_dimension, metadata_projection

KEYS = ["entity_id", "week_start_date"]


@query(
    "panel_7d_28d",
    sql("""
    SELECT p.entity_id, p.week_start_date, coalesce(n7, 0) AS n7, coalesce(n28, 0) AS n28,
           coalesce(n7, 0) - coalesce(n28, 0) / 4.0 AS delta, coalesce(f7, 0) AS f7, coalesce(f28, 0) AS f28
    FROM panel p LEFT JOIN (
        SELECT entity_id, week_start_date,
               CAST(sum(CASE WHEN d >= week_start_date - 6 THEN n ELSE 0 END) AS BIGINT) AS n7,
               CAST(sum(n) AS BIGINT) AS n28,
               sum(CASE WHEN d >= week_start_date - 6 THEN f ELSE 0 END) AS f7, sum(f) AS f28
        FROM panel JOIN conf_day ON country_iso3 = entity_id AND d BETWEEN week_start_date - 27 AND week_start_date
        GROUP BY 1, 2) USING (entity_id, week_start_date)"""),
)
def panel_7d_28d(spark: SparkSession, sf: str) -> DataFrame:
    measures = [
        RangeSum("n7", grid.TRAILING_7D), RangeSum("n28", grid.TRAILING_28D),
        RangeSum("f7", grid.TRAILING_7D, "fatalities"), RangeSum("f28", grid.TRAILING_28D, "fatalities"),
    ]
    sums = grid.range_sums(week_panel(spark, sf), conflict(spark, sf), "country_iso3", "event_date", measures)
    return sums.select(*KEYS, "n7", "n28", short_long_delta("n7", "n28", 4).alias("delta"), "f7", "f28")


TYPES = {"protest": "protests", "riot": "riots", "violence_against_civilians": "vac",
         "explosions_remote_violence": "erv", "strategic_developments": "strat"}


@query(
    "panel_typed_counts",
    sql("SELECT p.entity_id, p.week_start_date, "
        + ", ".join(f"CAST(coalesce(sum(CASE WHEN d >= week_start_date - 6 THEN {c} END), 0) AS BIGINT) AS {w}_7d, "
                    f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {w}_28d" for w, c in TYPES.items())
        + " FROM panel p LEFT JOIN conf_day ON country_iso3 = entity_id"
        + " AND d BETWEEN week_start_date - 27 AND week_start_date GROUP BY 1, 2"),
)
def panel_typed_counts(spark: SparkSession, sf: str) -> DataFrame:
    measures = [RangeSum(f"{word}_{name}", days, f"is_{word}") for word in TYPES
                for name, days in (("7d", grid.TRAILING_7D), ("28d", grid.TRAILING_28D))]
    rows = plans.typed_conflict_rows(conflict(spark, sf))
    sums = grid.range_sums(week_panel(spark, sf), rows, "country_iso3", "event_date", measures)
    return sums.select(*KEYS, *[m.name for m in measures])


@query(
    "panel_distinct_actors",
    sql("""
    SELECT entity_id, week_start_date, count(DISTINCT actor1_name) AS actor1_7d, count(DISTINCT actor2_name) AS actor2_7d
    FROM panel LEFT JOIN conf ON conf.country_iso3 = entity_id
         AND event_date BETWEEN week_start_date - 6 AND week_start_date
    GROUP BY 1, 2"""),
)
def panel_distinct_actors(spark: SparkSession, sf: str) -> DataFrame:
    panel = week_panel(spark, sf)
    stacked = grid.stack_cells(panel, [plans.conflict_cells(conflict(spark, sf))])
    windows = {f"{role}_7d": F.coalesce(grid.cell_value("c" + role), F.lit(0)) for role in ("actor1", "actor2")}
    return grid.read_panel(stacked, windows, KEYS)


@query(
    "range_distinct_28d",
    sql("""
    SELECT entity_id, week_start_date, count(DISTINCT actor1_name) AS actors
    FROM panel LEFT JOIN conf ON conf.country_iso3 = entity_id
         AND event_date BETWEEN week_start_date - 27 AND week_start_date
    GROUP BY 1, 2"""),
)
def range_distinct_28d(spark: SparkSession, sf: str) -> DataFrame:
    counted = grid.range_distinct(
        conflict(spark, sf), "country_iso3", "event_date", "actor1_name", grid.TRAILING_28D, "actors"
    )
    return week_panel(spark, sf).select(*KEYS).join(counted, KEYS, "left").fillna(0, ["actors"])


@query(
    "sketched_actors",
    sql("""
    SELECT entity_id, week_start_date, count(DISTINCT actor1_name) FILTER (event_date >= week_start_date - 27) AS actors_28d,
           count(DISTINCT actor1_name) AS actors_52w, TRUE AS close_28d, TRUE AS close_52w
    FROM panel LEFT JOIN conf ON conf.country_iso3 = entity_id
         AND event_date BETWEEN week_start_date - 364 AND week_start_date
    GROUP BY 1, 2"""),
)
def sketched_actors(spark: SparkSession, sf: str) -> DataFrame:
    """Exact distinct actors of long ranges, and whether the sketched ones are within five standard errors."""
    rows, panel = conflict(spark, sf), week_panel(spark, sf)
    ranges = {"28d": grid.TRAILING_28D, "52w": grid.HISTORY_52W}
    measures = [grid.RangeDistinct(f"about_{suffix}", days, "actor1_name") for suffix, days in ranges.items()]
    cells = grid.sum_cells(
        rows, "country_iso3", "event_date", [], "c", plain=grid.sketch_columns(measures, "event_date", "c")
    )
    found = grid.read_panel(
        grid.stack_cells(panel, [cells]), {m.name: grid.range_distinct_estimate(m, "c") for m in measures}, KEYS
    )
    for suffix, days in ranges.items():
        exact = grid.range_distinct(rows, "country_iso3", "event_date", "actor1_name", days, f"actors_{suffix}")
        found = found.join(exact, KEYS, "left").fillna(0, [f"actors_{suffix}"])
    error = 5 * 1.04 / 2 ** (measures[0].lg_k / 2)
    return found.select(
        *KEYS, *[f"actors_{suffix}" for suffix in ranges],
        *[(F.abs(F.col(f"about_{s}") - F.col(f"actors_{s}")) <= F.col(f"actors_{s}") * error + 1).alias(f"close_{s}")
          for s in ranges],
    )


@query(
    "fan_out_30d",
    sql("""
    SELECT entity_id, week_start_date, count(country_iso3) AS events_next_30d
    FROM panel LEFT JOIN conf ON conf.country_iso3 = entity_id
         AND event_date BETWEEN week_start_date + 1 AND week_start_date + 30
    GROUP BY 1, 2"""),
)
def fan_out_30d(spark: SparkSession, sf: str) -> DataFrame:
    daily = conflict(spark, sf).groupBy(F.col("country_iso3").alias("entity_id"), "event_date").agg(
        F.count("*").alias("rows")
    )
    fanned = grid.fan_out(daily, "event_date", grid.FUTURE_30D).groupBy(*KEYS).agg(F.sum("rows").alias("events_next_30d"))
    return week_panel(spark, sf).select(*KEYS).join(fanned, KEYS, "left").fillna(0, ["events_next_30d"])


@query(
    "panel_history_quiet",
    sql("""
    SELECT entity_id, week_start_date, CAST(coalesce(sum(n), 0) AS BIGINT) AS events_52w,
           coalesce(sum(f), 0.0) AS deaths_52w, CAST(coalesce(sum(s), 0) AS BIGINT) AS state_based_52w,
           CAST(coalesce(sum(CASE WHEN d >= week_start_date - 55 THEN f END), 0) = 0 AS BIGINT) AS quiet_56d
    FROM panel LEFT JOIN viol_day ON country_iso3 = entity_id AND d BETWEEN week_start_date - 364 AND week_start_date
    GROUP BY 1, 2"""),
)
def panel_history_quiet(spark: SparkSession, sf: str) -> DataFrame:
    panel = week_panel(spark, sf)
    stacked = grid.stack_cells(panel, [plans.violence_cells(violence(spark, sf))])
    read_rows = grid.read_panel(stacked, {m.name: grid.range_sum(m, "v") for m in plans.VIOLENCE_SUMS}, KEYS)
    return read_rows.select(
        *KEYS, F.col("ucdp_history_event_count_52w").alias("events_52w"),
        F.col("ucdp_history_best_deaths_52w").cast("double").alias("deaths_52w"),
        F.col("ucdp_history_state_based_events_52w").alias("state_based_52w"),
        (F.col("deaths_56d") == 0).cast("long").alias("quiet_56d"),
    )


@query(
    "labels_future_known",
    sql(f"""
    SELECT entity_id, week_start_date,
           CASE WHEN week_start_date + 7 <= DATE '{SNAPSHOT_DAY}' THEN CAST(f7 > 0 AS BIGINT) END AS label_escalation_7d,
           CASE WHEN week_start_date + 30 <= DATE '{SNAPSHOT_DAY}' THEN CAST(f30 > 0 AS BIGINT) END AS label_escalation_30d
    FROM (SELECT entity_id, week_start_date,
                 coalesce(sum(CASE WHEN d <= week_start_date + 7 THEN f END), 0) AS f7, coalesce(sum(f), 0) AS f30
          FROM panel LEFT JOIN viol_day ON country_iso3 = entity_id
               AND d BETWEEN week_start_date + 1 AND week_start_date + 30
          GROUP BY 1, 2)"""),
)
def labels_future_known(spark: SparkSession, sf: str) -> DataFrame:
    snapshot = F.lit(SNAPSHOT_DAY).cast("date")
    measures = [RangeSum("f7", grid.FUTURE_7D, "best_fatalities"), RangeSum("f30", grid.FUTURE_30D, "best_fatalities")]
    sums = grid.range_sums(week_panel(spark, sf), violence(spark, sf), "country_iso3", "event_date_start", measures)
    return sums.select(
        *KEYS,
        known_flag(F.col("f7") > 0, F.date_add("week_start_date", 7) <= snapshot).alias("label_escalation_7d"),
        known_flag(F.col("f30") > 0, F.date_add("week_start_date", 30) <= snapshot).alias("label_escalation_30d"),
    )


@query(
    "asof_global",
    sql("""
    SELECT week_start_date, round(food_price_index, 4) AS food_price_index, food_cereal_price_index
    FROM weeks ASOF LEFT JOIN prices ON week_start_date >= observation_date"""),
)
def asof_global(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    calendar = grid.weekly_calendar(
        orders.agg(F.min("o_orderdate").alias("start_date"), F.max("o_orderdate").alias("end_date"))
    )
    columns = ["food_price_index", "food_cereal_price_index"]
    found = grid.asof_global(calendar, monthly_prices(spark, sf), F.col("observation_date"), columns)
    return found.withColumn("food_price_index", rounded("food_price_index"))


@query(
    "asof_entity",
    sql("""
    SELECT entity_id, week_start_date, round(trade_exports_value_usd, 2) AS trade_exports_value_usd,
           trade_imports_value_usd
    FROM panel ASOF LEFT JOIN trade ON entity_id = country_iso3 AND week_start_date >= observation_date"""),
)
def asof_entity(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["trade_exports_value_usd", "trade_imports_value_usd"]
    found = grid.asof_join(
        week_panel(spark, sf), monthly_trade(spark, sf), "country_iso3", F.col("observation_date"), columns
    )
    return found.select(*KEYS, rounded(columns[0], 2).alias(columns[0]), columns[1])


@query(
    "asof_year",
    sql("""
    SELECT entity_id, week_start_date, macro_population_total, macro_cpi_yoy
    FROM panel ASOF LEFT JOIN macro ON entity_id = country_iso3 AND year(week_start_date) >= year"""),
)
def asof_year(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["macro_population_total", "macro_cpi_yoy"]
    found = grid.asof_join(
        week_panel(spark, sf), yearly_macro(spark, sf), "country_iso3", grid.year_day("year"), columns
    )
    return found.select(*KEYS, *columns)


@query(
    "nearest_dates",
    sql("""
    SELECT entity_id, week_start_date, next_date, last_date,
           next_date - week_start_date AS days_to_next, week_start_date - last_date AS days_since_last,
           CAST(coalesce(next_date - week_start_date <= 30, FALSE) AS BIGINT) AS upcoming_30d,
           CAST(coalesce(week_start_date - last_date <= 90, FALSE) AS BIGINT) AS recent_90d
    FROM (SELECT entity_id, week_start_date, min(election_date) FILTER (election_date >= week_start_date) AS next_date,
                 max(election_date) FILTER (election_date <= week_start_date) AS last_date
          FROM panel LEFT JOIN cal ON country_iso3 = entity_id GROUP BY 1, 2)"""),
)
def nearest_dates(spark: SparkSession, sf: str) -> DataFrame:
    found = grid.nearest_dates(week_panel(spark, sf), calendar_days(spark, sf), "country_iso3", "election_date")
    to_next = days_between("week_start_date", "next_date")
    since_last = days_between("last_date", "week_start_date")
    return found.select(
        *KEYS, "next_date", "last_date", to_next.alias("days_to_next"), since_last.alias("days_since_last"),
        within_days(to_next, 30).alias("upcoming_30d"), within_days(since_last, 90).alias("recent_90d"),
    )


@query(
    "latest_row_asof",
    sql("""
    SELECT country_iso3, observation_date, round(trade_exports_value_usd, 2) AS trade_exports_value_usd
    FROM (SELECT *, row_number() OVER (PARTITION BY country_iso3 ORDER BY observation_date DESC) AS k
          FROM trade WHERE observation_date <= DATE '1999-07-15') WHERE k = 1"""),
)
def latest_row_asof(spark: SparkSession, sf: str) -> DataFrame:
    found = grid.latest_row_asof(
        monthly_trade(spark, sf), "country_iso3", "observation_date", F.lit("1999-07-15").cast("date")
    )
    return found.select("country_iso3", "observation_date",
                        rounded("trade_exports_value_usd", 2).alias("trade_exports_value_usd"))


LOCALIZED = """
    SELECT t.country_iso3, t.country_name, t.onset_type, t.year AS onset_year,
           coalesce(min(CASE WHEN list_contains(regexp_extract_all(t.conflict_ids, '\\d+'),
                                                CAST(v.conflict_new_id AS VARCHAR)) THEN event_date_start END),
                    min(event_date_start)) AS onset_date,
           t.onset20, t.conflict_ids,
           CASE WHEN min(CASE WHEN list_contains(regexp_extract_all(t.conflict_ids, '\\d+'),
                                                 CAST(v.conflict_new_id AS VARCHAR)) THEN event_date_start END)
                     IS NOT NULL THEN 'conflict_id_match' ELSE 'country_year_fallback' END AS localization_method
    FROM truth t JOIN viol v ON t.country_iso3 = v.country_iso3 AND t.year = v.year
    WHERE t.onset1 > 0 GROUP BY t.country_iso3, t.country_name, t.onset_type, t.year, t.onset20, t.conflict_ids"""


@query("onset_localized", sql(LOCALIZED))
def onset_localized(spark: SparkSession, sf: str) -> DataFrame:
    return localize_onsets(violence(spark, sf), onset_truth(spark, sf))


@query(
    "onset_labels",
    sql("""
    SELECT entity_id, week_start_date,
           CASE WHEN week_start_date + 30 <= c THEN CAST(n30 > 0 AS BIGINT) END AS label_onset_30d,
           CASE WHEN week_start_date + 90 <= c THEN CAST(n90 > 0 AS BIGINT) END AS label_onset_90d,
           CASE WHEN week_start_date + 30 <= c THEN CAST(i30 > 0 AS BIGINT) END AS label_interstate_onset_30d,
           CASE WHEN week_start_date + 90 <= c THEN CAST(i90 > 0 AS BIGINT) END AS label_interstate_onset_90d
    FROM (SELECT entity_id, week_start_date, (SELECT make_date(max(year), 12, 31) FROM truth) AS c,
                 count(onset_date) FILTER (onset_date <= week_start_date + 30) AS n30, count(onset_date) AS n90,
                 count(onset_date) FILTER (onset_date <= week_start_date + 30 AND onset_type = 'interstate') AS i30,
                 count(onset_date) FILTER (onset_type = 'interstate') AS i90
          FROM panel LEFT JOIN located ON country_iso3 = entity_id
               AND onset_date BETWEEN week_start_date + 1 AND week_start_date + 90
          GROUP BY 1, 2)""", located=LOCALIZED),
)
def onset_labels(spark: SparkSession, sf: str) -> DataFrame:
    truth = onset_truth(spark, sf)
    panel = week_panel(spark, sf)
    stacked = grid.stack_cells(panel, [plans.onset_cells(localize_onsets(violence(spark, sf), truth))])
    counted = grid.read_panel(stacked, {m.name: grid.range_sum(m, "o") for m in plans.ONSET_SUMS}, KEYS)
    cutoff = truth_cutoff([truth], F.lit("2001-12-31").cast("date"))

    def label(column: str, days: int):
        return known_flag(F.col(column) > 0, F.date_add("week_start_date", days) <= cutoff)

    return counted.select(
        *KEYS,
        label("onsets_next_30d", 30).alias("label_onset_30d"), label("onsets_next_90d", 90).alias("label_onset_90d"),
        label("interstate_onsets_next_30d", 30).alias("label_interstate_onset_30d"),
        label("interstate_onsets_next_90d", 90).alias("label_interstate_onset_90d"),
    )


@query(
    "weekly_news_summary",
    sql("""
    SELECT country_id AS country_iso3, CAST(date_trunc('week', event_date) AS DATE) AS week_start_date,
           count(global_event_id) AS gdelt_event_count_7d, round(avg(goldstein_scale), 6) AS gdelt_avg_goldstein_7d,
           round(avg(avg_tone), 6) AS gdelt_avg_event_tone_7d, sum(num_mentions) AS gdelt_num_mentions_7d,
           sum(num_articles) AS gdelt_num_articles_7d
    FROM newsev GROUP BY 1, 2"""),
)
def weekly_news_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = plans.weekly_news_summary(news(spark, sf))
    return summary.withColumns(
        {c: rounded(c, 6) for c in ("gdelt_avg_goldstein_7d", "gdelt_avg_event_tone_7d")}
    )


@query(
    "weekly_document_summary",
    sql("""
    SELECT document_country_id AS country_iso3, CAST(date_trunc('week', document_date) AS DATE) AS week_start_date,
           count(document_identifier) AS gdelt_document_count_7d, round(avg(tone_score), 6) AS gdelt_avg_document_tone_7d
    FROM arts GROUP BY 1, 2"""),
)
def weekly_document_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = plans.weekly_document_summary(articles(spark, sf))
    return summary.withColumn("gdelt_avg_document_tone_7d", rounded("gdelt_avg_document_tone_7d", 6))


@query(
    "weekly_conflict_summary",
    sql("""
    SELECT country_iso3, CAST(date_trunc('week', event_date) AS DATE) AS week_start_date,
           count(source_record_id) AS acled_event_count_7d, sum(fatalities) AS acled_fatalities_sum_7d,
           count(*) FILTER (event_type_slug = 'protests') AS acled_protest_count_7d,
           count(*) FILTER (event_type_slug = 'riots') AS acled_riot_count_7d,
           count(*) FILTER (event_type_slug = 'violence_against_civilians') AS acled_violence_against_civilians_count_7d,
           count(*) FILTER (event_type_slug = 'explosions_remote_violence') AS acled_explosions_remote_violence_count_7d,
           count(*) FILTER (event_type_slug = 'strategic_developments') AS acled_strategic_developments_count_7d,
           count(DISTINCT actor1_name) AS acled_distinct_actor1_count_7d,
           count(DISTINCT actor2_name) AS acled_distinct_actor2_count_7d
    FROM conf GROUP BY 1, 2"""),
)
def weekly_conflict_summary(spark: SparkSession, sf: str) -> DataFrame:
    return plans.weekly_conflict_summary(conflict(spark, sf))


@query(
    "entity_weeks",
    sql("""SELECT DISTINCT country_iso3 AS entity_id, CAST(date_trunc('week', event_date) AS DATE) AS week_start_date
           FROM conf"""),
)
def entity_weeks(spark: SparkSession, sf: str) -> DataFrame:
    return grid.entity_weeks(conflict(spark, sf), "country_iso3", "event_date")


@query(
    "country_dimension",
    sql("""
    SELECT country_iso3, min(country_name) AS country_name, min(region_name) AS region_name
    FROM (SELECT country_iso3, country_name, region_name FROM viol
          UNION ALL SELECT country_iso3, country_name, NULL FROM conf
          UNION ALL SELECT country_id, NULL, NULL FROM newsev)
    GROUP BY 1"""),
)
def country_dimension_query(spark: SparkSession, sf: str) -> DataFrame:
    named = [
        metadata_projection(conflict(spark, sf)),
        metadata_projection(violence(spark, sf), region="region_name"),
    ]
    return country_dimension(named, None, [news(spark, sf).select(F.col("country_id").alias("country_iso3"))])


@query(
    "panel_bounds",
    sql("""
    SELECT CAST(date_trunc('week', least((SELECT min(event_date) FROM newsev), (SELECT min(event_date) FROM conf),
           (SELECT make_date(min(year), 1, 1) FROM macro))) AS DATE) AS start_date"""),
)
def panel_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return grid.panel_bounds(
        [(news(spark, sf), "event_date"), (conflict(spark, sf), "event_date")], [(yearly_macro(spark, sf), "year")]
    )


@query("truth_cutoff", sql("SELECT least(make_date(max(year), 12, 31), DATE '2001-06-15') AS cutoff FROM truth"))
def truth_cutoff_query(spark: SparkSession, sf: str) -> DataFrame:
    cutoff = truth_cutoff([onset_truth(spark, sf)], F.lit(SNAPSHOT_DAY).cast("date"))
    return spark.range(1).select(cutoff.alias("cutoff"))


def panel_sources(spark: SparkSession, sf: str) -> plans.PanelSources:
    """All stand-in sources of the full panel."""
    truth = onset_truth(spark, sf)
    names = nations(spark, sf).select("country_iso3", "country_name")
    return plans.PanelSources(
        news_events=news(spark, sf),
        news_documents=articles(spark, sf),
        conflict_events=conflict(spark, sf),
        violence_events=violence(spark, sf),
        interstate_onsets=truth.where(F.col("onset_type") == "interstate"),
        intrastate_onsets=truth.where(F.col("onset_type") == "intrastate"),
        food=monthly_prices(spark, sf),
        market=monthly_prices(spark, sf),
        trade=monthly_trade(spark, sf).join(names, "country_iso3"),
        shipping=monthly_shipping(spark, sf),
        climate=monthly_climate(spark, sf),
        night_lights=monthly_night_lights(spark, sf),
        security=yearly_security(spark, sf),
        governance=yearly_governance(spark, sf),
        displacement=yearly_displacement(spark, sf),
        macro=yearly_macro(spark, sf),
        elections=calendar_days(spark, sf).join(names, "country_iso3"),
    )


@functools.cache
def full_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The whole panel over the stand-in sources."""
    return plans.country_week_features(spark, panel_sources(spark, sf), SNAPSHOT)


def _in_range(table: str, lo: int, hi: int, columns: str, day: str = "d", entity: str = "country_iso3") -> str:
    return (f"(SELECT entity_id, week_start_date, {columns} FROM base JOIN {table} ON {entity} = entity_id "
            f"AND {day} BETWEEN week_start_date + ({lo}) AND week_start_date + ({hi}) GROUP BY 1, 2)")


# Only the violence source knows regions. Every source has its first week on the list of starts.
BASE = f"""
    SELECT country_iso3 AS entity_id, country_name,
           CASE WHEN country_iso3 IN (SELECT country_iso3 FROM viol) THEN region_name END AS region_name,
           CAST(w AS DATE) AS week_start_date
    FROM nat CROSS JOIN (SELECT unnest(generate_series(
        (SELECT CAST(date_trunc('week', min(d)) AS DATE) FROM (
           SELECT min(event_date) AS d FROM newsev UNION ALL SELECT min(document_date) FROM arts
           UNION ALL SELECT min(event_date) FROM conf UNION ALL SELECT min(d) FROM viol_day
           UNION ALL SELECT min(election_date) FROM cal UNION ALL SELECT min(observation_date) FROM trade
           UNION ALL SELECT min(observation_date) FROM weather
           UNION ALL SELECT make_date(min(year), 1, 1) FROM macro
           UNION ALL SELECT make_date(min(year), 1, 1) FROM arms)),
        CAST(date_trunc('week', DATE '{SNAPSHOT_DAY}') AS DATE), INTERVAL 7 DAY)) AS w)"""
NEWS_DAY = """
    SELECT country_id AS country_iso3, event_date AS d, count(*) AS n, sum(goldstein_scale) AS g, sum(avg_tone) AS t,
           sum(num_mentions) AS m, sum(num_articles) AS a FROM newsev GROUP BY 1, 2"""
ARTS_DAY = """
    SELECT document_country_id AS country_iso3, document_date AS d, count(*) AS n, sum(tone_score) AS t
    FROM arts GROUP BY 1, 2"""

#: The conflict columns of 7 and 28 days: panel word -> column of a day.
WORDS = {"protest": "protests", "riot": "riots", "violence_against_civilians": "vac",
         "explosions_remote_violence": "erv", "strategic_developments": "strat"}
CONFLICT_SUMS = "CAST(sum(n) AS BIGINT) AS n, sum(f) AS f, " + ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}" for c in WORDS.values())
#: Newest observations: alias -> (table, columns as the panel names them).
MONTHLY = {
    "tr": ("trade", ["trade_imports_value_usd", "trade_exports_3m_change_pct", "trade_imports_3m_change_pct"]),
    "sh": ("ships", ["shipping_lsci_index", "shipping_port_connectivity_index"]),
    "cl": ("weather", ["climate_drought_severity_index", "climate_temperature_anomaly_c", "climate_precipitation_anomaly_pct"]),
    "nl": ("lights", ["climate_night_lights_anomaly_pct", "climate_night_lights_zscore"]),
}
YEARLY = {
    "ma": ("macro", ["macro_gdp_growth_annual_pct", "macro_cpi_yoy"]),
    "se": ("arms", ["security_military_expenditure_usd", "security_military_expenditure_pct_gdp",
                    "security_arms_import_volume_index"]),
    "go": ("govern", ["governance_voice_and_accountability", "governance_political_stability",
                      "governance_government_effectiveness", "governance_regulatory_quality", "governance_rule_of_law",
                      "governance_control_of_corruption", "governance_score"]),
    "di": ("fled", ["refugees AS humanitarian_refugees", "asylum_seekers AS humanitarian_asylum_seekers",
                    "idps AS humanitarian_idps"]),
}
NEWEST = ", ".join(f"{alias}.{column}" for group in (MONTHLY, YEARLY) for alias, (_, columns) in group.items()
                   for column in columns)

FULL_TEXT = f"""
    SELECT b.entity_id AS country_iso3, b.country_name, b.region_name, b.week_start_date,
      CASE WHEN b.week_start_date + 7 <= DATE '{SNAPSHOT_DAY}' THEN CAST(coalesce(vf.f7, 0) > 0 AS BIGINT) END
        AS label_escalation_7d,
      CASE WHEN b.week_start_date + 30 <= DATE '{SNAPSHOT_DAY}' THEN CAST(coalesce(vf.f30, 0) > 0 AS BIGINT) END
        AS label_escalation_30d,
      CASE WHEN b.week_start_date + 30 <= cut THEN CAST(coalesce(o.n30, 0) > 0 AS BIGINT) END AS label_onset_30d,
      CASE WHEN b.week_start_date + 90 <= cut THEN CAST(coalesce(o.n90, 0) > 0 AS BIGINT) END AS label_onset_90d,
      CASE WHEN b.week_start_date + 30 <= cut THEN CAST(coalesce(o.i30, 0) > 0 AS BIGINT) END AS label_interstate_30d,
      CASE WHEN b.week_start_date + 30 <= cut THEN CAST(coalesce(o.i30, 0) > 0 AS BIGINT) END
        AS label_interstate_onset_30d,
      CASE WHEN b.week_start_date + 90 <= cut THEN CAST(coalesce(o.i90, 0) > 0 AS BIGINT) END
        AS label_interstate_onset_90d,
      CAST(coalesce(q.f, 0) = 0 AS BIGINT) AS organized_violence_quiet_56d,
      coalesce(n7.n, 0) AS gdelt_event_count_7d, coalesce(n28.n, 0) AS gdelt_event_count_28d,
      coalesce(n7.n, 0) - coalesce(n28.n, 0) / 4.0 AS gdelt_event_count_7d_delta,
      round(n7.g / n7.n, 6) AS gdelt_avg_goldstein_7d, round(n7.t / n7.n, 6) AS gdelt_avg_event_tone_7d,
      coalesce(n7.m, 0) AS gdelt_num_mentions_7d, coalesce(n7.a, 0) AS gdelt_num_articles_7d,
      coalesce(a7.n, 0) AS gdelt_document_count_7d, coalesce(a28.n, 0) AS gdelt_document_count_28d,
      coalesce(a7.n, 0) - coalesce(a28.n, 0) / 4.0 AS gdelt_document_count_7d_delta,
      round(a7.t / a7.n, 6) AS gdelt_avg_document_tone_7d,
      coalesce(c7.n, 0) AS acled_event_count_7d, coalesce(c7.n, 0) - coalesce(c28.n, 0) / 4.0 AS acled_event_count_7d_delta,
      coalesce(c7.f, 0) AS acled_fatalities_sum_7d,
      coalesce(c7.f, 0) - coalesce(c28.f, 0) / 4.0 AS acled_fatalities_sum_7d_delta,
      {", ".join(f"coalesce(c7.{c}, 0) AS acled_{w}_count_7d" for w, c in WORDS.items())},
      coalesce(c7.protests, 0) - coalesce(c28.protests, 0) / 4.0 AS acled_protest_count_7d_delta,
      coalesce(c7.riots, 0) - coalesce(c28.riots, 0) / 4.0 AS acled_riot_count_7d_delta,
      coalesce(x.x1, 0) AS acled_distinct_actor1_count_7d, coalesce(x.x2, 0) AS acled_distinct_actor2_count_7d,
      coalesce(c28.n, 0) AS acled_event_count_28d, coalesce(c28.f, 0) AS acled_fatalities_sum_28d,
      pr.market_oil_price_usd_per_barrel, pr.market_gas_price_index, pr.market_fertilizer_price_index,
      pr.market_commodity_price_index, round(pr.food_price_index, 4) AS food_price_index, pr.food_cereal_price_index,
      round(tr.trade_exports_value_usd, 2) AS trade_exports_value_usd,
      el.days_to AS days_to_next_election, el.days_since AS days_since_last_election,
      CAST(coalesce(el.days_to <= 30, FALSE) AS BIGINT) AS election_upcoming_30d,
      CAST(coalesce(el.days_to <= 90, FALSE) AS BIGINT) AS election_upcoming_90d,
      CAST(coalesce(el.days_since <= 30, FALSE) AS BIGINT) AS election_recent_30d,
      CAST(coalesce(el.days_since <= 90, FALSE) AS BIGINT) AS election_recent_90d,
      coalesce(h.n, 0) AS ucdp_history_event_count_52w, coalesce(h.f, 0) AS ucdp_history_best_deaths_52w,
      coalesce(h.s, 0) AS ucdp_history_state_based_events_52w,
      CAST(ma.macro_population_total AS DOUBLE) AS macro_population_total, {NEWEST},
      TIMESTAMP '{SNAPSHOT}' AS snapshot_ts_utc
    FROM base b
    CROSS JOIN (SELECT least(make_date(max(year), 12, 31), DATE '{SNAPSHOT_DAY}') AS cut FROM truth)
    LEFT JOIN {_in_range("news_day", -6, 0, "CAST(sum(n) AS BIGINT) AS n, sum(g) AS g, sum(t) AS t, sum(m) AS m, sum(a) AS a")} n7
      USING (entity_id, week_start_date)
    LEFT JOIN {_in_range("news_day", -27, 0, "CAST(sum(n) AS BIGINT) AS n")} n28 USING (entity_id, week_start_date)
    LEFT JOIN {_in_range("arts_day", -6, 0, "CAST(sum(n) AS BIGINT) AS n, sum(t) AS t")} a7
      USING (entity_id, week_start_date)
    LEFT JOIN {_in_range("arts_day", -27, 0, "CAST(sum(n) AS BIGINT) AS n")} a28 USING (entity_id, week_start_date)
    LEFT JOIN {_in_range("conf_day", -6, 0, CONFLICT_SUMS)} c7
      USING (entity_id, week_start_date)
    LEFT JOIN {_in_range("conf_day", -27, 0, CONFLICT_SUMS)} c28
      USING (entity_id, week_start_date)
    LEFT JOIN {_in_range("conf", -6, 0, "count(DISTINCT actor1_name) AS x1, count(DISTINCT actor2_name) AS x2", "event_date", "conf.country_iso3")} x
      USING (entity_id, week_start_date)
    LEFT JOIN {_in_range("viol_day", -55, 0, "sum(f) AS f")} q USING (entity_id, week_start_date)
    LEFT JOIN {_in_range("viol_day", -364, 0, "CAST(sum(n) AS BIGINT) AS n, sum(f) AS f, CAST(sum(s) AS BIGINT) AS s")} h
      USING (entity_id, week_start_date)
    LEFT JOIN {_in_range("viol_day", 1, 30, "sum(CASE WHEN d <= week_start_date + 7 THEN f ELSE 0 END) AS f7, sum(f) AS f30")} vf
      USING (entity_id, week_start_date)
    LEFT JOIN {_in_range("located", 1, 90, "count(*) AS n90, count(*) FILTER (onset_date <= week_start_date + 30) AS n30, count(*) FILTER (onset_type = 'interstate') AS i90, count(*) FILTER (onset_type = 'interstate' AND onset_date <= week_start_date + 30) AS i30", "onset_date", "located.country_iso3")} o
      USING (entity_id, week_start_date)
    LEFT JOIN (SELECT entity_id, week_start_date,
                 min(election_date - week_start_date) FILTER (election_date >= week_start_date) AS days_to,
                 min(week_start_date - election_date) FILTER (election_date <= week_start_date) AS days_since
               FROM base JOIN cal ON country_iso3 = entity_id GROUP BY 1, 2) el USING (entity_id, week_start_date)
    ASOF LEFT JOIN prices pr ON b.week_start_date >= pr.observation_date
    """ + "".join(
    f"""ASOF LEFT JOIN {table} {alias} ON b.entity_id = {alias}.country_iso3
        AND b.week_start_date >= {alias}.observation_date """ for alias, (table, _) in MONTHLY.items()
) + "".join(
    f"""ASOF LEFT JOIN {table} {alias} ON b.entity_id = {alias}.country_iso3 AND year(b.week_start_date) >= {alias}.year """
    for alias, (table, _) in YEARLY.items()
)
FULL_PARTS = {"base": BASE, "news_day": NEWS_DAY, "arts_day": ARTS_DAY, "located": LOCALIZED}
FULL_SQL = sql(FULL_TEXT, **FULL_PARTS)


@query("country_week_features", FULL_SQL)
def country_week_features(spark: SparkSession, sf: str) -> DataFrame:
    """All 81 columns of the panel."""
    digits = {"gdelt_avg_goldstein_7d": 6, "gdelt_avg_event_tone_7d": 6, "gdelt_avg_document_tone_7d": 6,
              "food_price_index": 4, "trade_exports_value_usd": 2}
    panel = full_panel(spark, sf)
    panel = panel.withColumn("macro_population_total", F.col("macro_population_total").cast("double"))
    return panel.select(
        *[rounded(name, digits[name]).alias(name) if name in digits else name for name in panel.columns]
    )
