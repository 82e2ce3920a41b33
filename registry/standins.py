"""Source tables of the library derived from the given tables, as DataFrames and as SQL.

The country of an event is the nation of its customer or supplier; its code is built from the nation key.
Plans (not rows) are kept per session, because the same few frames start nearly every query.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tocsin.operators import grid
from tocsin.operators.grid import RangeSum

# Days on which a nation's total exceeds this bound act as its calendar.
CALENDAR_BOUND = 450_000.0
# The snapshot day of the stand-in panel, inside the covered time.
SNAPSHOT = "2001-06-15 00:00:00"
SNAPSHOT_DAY = "2001-06-15"


@functools.cache
def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def rounded(column: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


# --- DataFrames ---------------------------------------------------------------------------------------------


@functools.cache
def nations(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    key = F.col("n_nationkey")
    code = F.concat(
        F.lit("N"), F.char(F.lit(65) + F.floor(key / 26).cast("int")), F.char(F.lit(65) + key % 26)
    )
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        "n_nationkey", code.alias("country_iso3"), F.col("n_name").alias("country_name"),
        F.col("r_name").alias("region_name"),
    )


@functools.cache
def conflict(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as conflict events."""
    orders, customer = read(spark, sf, "orders"), read(spark, sf, "customer")
    slug = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "protests")
        .when(F.col("o_orderpriority") == "2-HIGH", "riots")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "violence_against_civilians")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "explosions_remote_violence")
        .otherwise("strategic_developments")
    )
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "country_iso3", "country_name", "region_name",
            F.col("o_orderkey").cast("string").alias("source_record_id"),
            F.col("o_orderdate").cast("date").alias("event_date"),
            slug.alias("event_type_slug"),
            F.floor(F.col("o_totalprice") / 1000).cast("double").alias("fatalities"),
            F.col("o_custkey").cast("string").alias("actor1_name"),
            F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("A"), (F.col("o_orderkey") % 50).cast("string"))).alias(
                "actor2_name"
            ),
            F.col("o_orderstatus").alias("status"),
            F.col("o_custkey").alias("conflict_new_id"),
        )
    )


@functools.cache
def violence(spark: SparkSession, sf: str) -> DataFrame:
    """Protest rows of finished orders as organized violence."""
    return conflict(spark, sf).where((F.col("status") == "F") & (F.col("event_type_slug") == "protests")).select(
        "country_iso3", "country_name", "region_name", F.col("event_date").alias("event_date_start"),
        F.col("fatalities").alias("best_fatalities"),
        (F.col("conflict_new_id") % 3 + 1).alias("type_of_violence"),
        "conflict_new_id", F.year("event_date").cast("long").alias("year"),
    )


@functools.cache
def news(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as news events of the supplier's nation."""
    lineitem, supplier = read(spark, sf, "lineitem"), read(spark, sf, "supplier")
    return (
        lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("country_iso3").alias("country_id"),
            F.col("l_orderkey").cast("string").alias("global_event_id"),
            F.col("l_shipdate").cast("date").alias("event_date"),
            (F.col("l_discount") * 100 - 5).alias("goldstein_scale"),
            F.col("l_tax").alias("avg_tone"),
            F.col("l_quantity").alias("num_mentions"),
            F.col("l_linenumber").cast("double").alias("num_articles"),
            F.col("l_extendedprice").alias("price"),
        )
    )


@functools.cache
def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as news documents, spread over days and nations by their keys."""
    documents = read(spark, sf, "documents")
    nation = nations(spark, sf)
    count = nation.agg(F.count("*")).scalar()
    placed = documents.select(
        F.col("doc_id").cast("string").alias("document_identifier"),
        F.date_add(F.lit("2000-01-03").cast("date"), (F.col("doc_id") % 500).cast("int")).alias("document_date"),
        (F.col("n_chars") % count).cast("int").alias("n_nationkey"),
        (F.col("n_chars") % 201 / 10.0 - 10).alias("tone_score"),
    )
    return placed.join(nation, "n_nationkey").select(
        F.col("country_iso3").alias("document_country_id"), "document_identifier", "document_date", "tone_score"
    )


@functools.cache
def monthly_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Global monthly series of food and market prices."""
    return (
        read(spark, sf, "lineitem")
        .groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("observation_date"))
        .agg(
            (F.avg("l_extendedprice") / 1000).alias("food_price_index"), F.max("l_quantity").alias("food_cereal_price_index"),
            F.max("l_quantity").alias("market_oil_price_usd_per_barrel"),
            F.count("*").cast("double").alias("market_gas_price_index"),
            F.min("l_quantity").cast("double").alias("market_fertilizer_price_index"),
            F.max("l_linenumber").cast("double").alias("market_commodity_price_index"),
        )
    )


def _monthly(rows: DataFrame, country: str, day: str = "event_date"):
    return rows.groupBy(F.col(country).alias("country_iso3"), F.trunc(day, "month").alias("observation_date"))


def _yearly(rows: DataFrame, day: str = "event_date"):
    return rows.groupBy("country_iso3", "country_name", F.year(day).cast("long").alias("year"))


@functools.cache
def monthly_trade(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly series per nation."""
    return _monthly(news(spark, sf), "country_id").agg(
        F.sum("price").alias("trade_exports_value_usd"), F.sum("num_mentions").alias("trade_imports_value_usd"),
        F.max("num_articles").alias("trade_exports_3m_change_pct"),
        F.min("num_articles").alias("trade_imports_3m_change_pct"),
    )


def _with_names(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    return rows.join(nations(spark, sf).select("country_iso3", "country_name"), "country_iso3")


@functools.cache
def monthly_shipping(spark: SparkSession, sf: str) -> DataFrame:
    found = _monthly(news(spark, sf), "country_id").agg(
        F.count("*").cast("double").alias("shipping_lsci_index"),
        F.max("num_mentions").cast("double").alias("shipping_port_connectivity_index"),
    )
    return _with_names(spark, sf, found)


@functools.cache
def monthly_climate(spark: SparkSession, sf: str) -> DataFrame:
    found = _monthly(conflict(spark, sf), "country_iso3").agg(
        (F.sum("fatalities") % 97).alias("climate_drought_severity_index"),
        F.max("fatalities").alias("climate_temperature_anomaly_c"),
        F.count("*").cast("double").alias("climate_precipitation_anomaly_pct"),
    )
    return _with_names(spark, sf, found)


@functools.cache
def monthly_night_lights(spark: SparkSession, sf: str) -> DataFrame:
    found = _monthly(news(spark, sf), "country_id").agg(
        F.min("num_mentions").cast("double").alias("climate_night_lights_anomaly_pct"),
        F.max("avg_tone").cast("double").alias("climate_night_lights_zscore"),
    )
    return _with_names(spark, sf, found)


@functools.cache
def yearly_security(spark: SparkSession, sf: str) -> DataFrame:
    return _yearly(conflict(spark, sf)).agg(
        F.sum("fatalities").alias("security_military_expenditure_usd"),
        F.min("fatalities").alias("security_military_expenditure_pct_gdp"),
        F.count("*").cast("double").alias("security_arms_import_volume_index"),
    )


@functools.cache
def yearly_governance(spark: SparkSession, sf: str) -> DataFrame:
    protests = F.count_if(F.col("event_type_slug") == "protests").cast("double")
    return _yearly(conflict(spark, sf)).agg(
        F.count("*").cast("double").alias("governance_voice_and_accountability"),
        protests.alias("governance_political_stability"),
        F.max("fatalities").alias("governance_government_effectiveness"),
        F.min("fatalities").alias("governance_regulatory_quality"),
        F.count("actor2_name").cast("double").alias("governance_rule_of_law"),
        F.max("conflict_new_id").cast("double").alias("governance_control_of_corruption"),
        (F.sum("fatalities") % 101).alias("governance_score"),
    )


@functools.cache
def yearly_displacement(spark: SparkSession, sf: str) -> DataFrame:
    """Years after 1993 only, so that the first weeks of the panel have none."""
    rows = conflict(spark, sf).where(F.year("event_date") > 1993)
    return _yearly(rows).agg(
        F.sum("fatalities").alias("refugees"), F.count("*").cast("double").alias("asylum_seekers"),
        F.max("fatalities").alias("idps"),
    ).withColumnRenamed("country_iso3", "country_id")


@functools.cache
def yearly_macro(spark: SparkSession, sf: str) -> DataFrame:
    """Annual series per nation, even years only, so that odd years take an older value."""
    return _yearly(conflict(spark, sf).where(F.year("event_date") % 2 == 0)).agg(
        F.count("*").alias("macro_population_total"), F.max("fatalities").alias("macro_cpi_yoy"),
        F.min("fatalities").alias("macro_gdp_growth_annual_pct"),
    )


@functools.cache
def calendar_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days with a large order act as a calendar per nation."""
    return conflict(spark, sf).where(F.col("fatalities") >= CALENDAR_BOUND / 1000).select(
        "country_iso3", F.col("event_date").alias("election_date")
    ).distinct()


@functools.cache
def onset_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Years per nation with the smallest and largest id of the December customers as text; 0 = no onset."""
    december = F.when(F.month("event_date") == 12, F.col("conflict_new_id"))
    return (
        conflict(spark, sf).where(F.year("event_date") < 2001)
        .groupBy("country_iso3", "country_name", F.year("event_date").cast("long").alias("year"))
        .agg(
            F.concat_ws(";", F.min(december).cast("string"), F.max(december).cast("string")).alias("ids"),
            (F.count("*") % 4).alias("remainder"),
        )
        .select(
            "country_iso3", "country_name", "year",
            (F.col("remainder") > 0).cast("long").alias("onset1"),
            (F.col("remainder") == 3).cast("long").alias("onset20"),
            F.when(F.col("remainder") != 2, F.nullif("ids", F.lit(""))).alias("conflict_ids"),
            F.when(F.col("year") % 2 == 0, "interstate").otherwise("intrastate").alias("onset_type"),
        )
    )


@functools.cache
def week_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Every nation with every week of the order dates."""
    orders = read(spark, sf, "orders")
    first = orders.agg(F.min("o_orderdate").cast("date")).scalar()
    last = orders.agg(F.max("o_orderdate").cast("date")).scalar()
    return grid.dense_panel(nations(spark, sf).drop("n_nationkey"), first, last).withColumnRenamed(
        "country_iso3", grid.ENTITY
    )


PREDICTION_SUMS = [RangeSum("n7", grid.TRAILING_7D), RangeSum("n28", grid.TRAILING_28D)]
LABEL_SUMS = [RangeSum("v30", grid.FUTURE_30D), RangeSum("v7", grid.FUTURE_7D)]


@functools.cache
def prediction_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Nation-week rows with a deterministic score and a label from the following 30 days, without any training."""
    panel = week_panel(spark, sf)
    stacked = grid.stack_cells(
        panel,
        [
            grid.sum_cells(conflict(spark, sf), "country_iso3", "event_date", PREDICTION_SUMS, "c"),
            grid.sum_cells(violence(spark, sf), "country_iso3", "event_date_start", LABEL_SUMS, "v"),
        ],
    )
    windows = {m.name: grid.range_sum(m, "c") for m in PREDICTION_SUMS}
    windows |= {m.name: grid.range_sum(m, "v") for m in LABEL_SUMS}
    read_rows = grid.read_panel(stacked, windows, panel.columns)
    week_no = (F.datediff("week_start_date", F.lit("1970-01-05").cast("date")) / 7).cast("long")
    return read_rows.select(
        "entity_id", F.col("country_name").alias("entity_name"), "region_name",
        F.col("week_start_date").alias("forecast_date"), "n7", "n28",
        ((F.col("n28") * 13 + week_no) % 97 / 97.0).alias("calibrated_probability"),
        ((F.col("n28") * 7 + F.col("n7") + week_no) % 89 / 89.0).alias("second_probability"),
        (F.col("v30") * 8 > F.col("n28")).cast("long").alias("label"),
        F.when(F.col("v7") > 0, F.date_add("week_start_date", 7)).alias("next_event_date"),
    )


def customer_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions by customer and week with scores that hardly repeat: rows and scores grow with the orders."""
    cents = F.max(F.round(F.col("o_totalprice") * 100).cast("long"))
    return read(spark, sf, "orders").groupBy(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("entity_id"),
        F.trunc("o_orderdate", "week").alias("forecast_date"),
    ).agg(
        (cents % 999_983 / 999_983.0).alias("calibrated_probability"),
        (F.count_if(F.col("o_orderpriority") == "1-URGENT") > 0).cast("long").alias("label"),
    )


@functools.cache
def model_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of two models in long form."""
    rows = prediction_panel(spark, sf)
    models = F.array(
        F.struct(F.lit("alpha").alias("model_name"), F.col("calibrated_probability").alias("raw_score")),
        F.struct(F.lit("beta").alias("model_name"), F.col("second_probability").alias("raw_score")),
    )
    return rows.select("entity_id", "entity_name", "region_name", "forecast_date", "label", F.inline(models))


@functools.cache
def daily_users(spark: SparkSession, sf: str) -> DataFrame:
    """Event rows per user and day as a day-grain entity series."""
    return read(spark, sf, "events").groupBy(
        F.col("user_id").cast("string").alias("entity_id"), F.col("ts").cast("date").alias("as_of_date")
    ).agg(
        F.count("*").alias("event_count"),
        F.count_if(F.col("event_type") == "error").alias("error_count"),
        F.sum(F.floor("value")).cast("double").alias("value_sum"),
    )


CUSTOMER_PREDICTIONS = """
    SELECT 'C' || o_custkey AS entity_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS forecast_date,
           max(CAST(round(o_totalprice * 100) AS BIGINT)) % 999983 / 999983.0::DOUBLE AS calibrated_probability,
           CAST(count(*) FILTER (o_orderpriority = '1-URGENT') > 0 AS BIGINT) AS label
    FROM orders GROUP BY 1, 2"""

# --- the same in SQL ----------------------------------------------------------------------------------------

CTES = {
    "nat": """
        SELECT n_nationkey, 'N' || chr(CAST(65 + n_nationkey // 26 AS INT)) || chr(CAST(65 + n_nationkey % 26 AS INT))
               AS country_iso3, n_name AS country_name, r_name AS region_name
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "conf": """
        SELECT country_iso3, country_name, region_name, CAST(o_orderkey AS VARCHAR) AS source_record_id,
               CAST(o_orderdate AS DATE) AS event_date,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'protests' WHEN '2-HIGH' THEN 'riots'
                    WHEN '3-MEDIUM' THEN 'violence_against_civilians'
                    WHEN '4-NOT SPECIFIED' THEN 'explosions_remote_violence' ELSE 'strategic_developments' END
               AS event_type_slug,
               CAST(floor(o_totalprice / 1000) AS DOUBLE) AS fatalities, CAST(o_custkey AS VARCHAR) AS actor1_name,
               CASE WHEN o_orderstatus <> 'P' THEN 'A' || CAST(o_orderkey % 50 AS VARCHAR) END AS actor2_name,
               o_orderstatus AS status, o_custkey AS conflict_new_id
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nat ON c_nationkey = n_nationkey""",
    "viol": """
        SELECT country_iso3, country_name, region_name, event_date AS event_date_start, fatalities AS best_fatalities,
               conflict_new_id % 3 + 1 AS type_of_violence, conflict_new_id, year(event_date) AS year
        FROM conf WHERE status = 'F' AND event_type_slug = 'protests'""",
    "newsev": """
        SELECT country_iso3 AS country_id, CAST(l_orderkey AS VARCHAR) AS global_event_id,
               CAST(l_shipdate AS DATE) AS event_date, l_discount * 100 - 5 AS goldstein_scale, l_tax AS avg_tone,
               l_quantity AS num_mentions, CAST(l_linenumber AS DOUBLE) AS num_articles, l_extendedprice AS price
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nat ON s_nationkey = n_nationkey""",
    "arts": """
        SELECT country_iso3 AS document_country_id, CAST(doc_id AS VARCHAR) AS document_identifier,
               CAST(DATE '2000-01-03' + CAST(doc_id % 500 AS INTEGER) AS DATE) AS document_date,
               n_chars % 201 / 10.0 - 10 AS tone_score
        FROM documents JOIN nat ON n_chars % (SELECT count(*) FROM nat) = n_nationkey""",
    "prices": """
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS observation_date,
               avg(l_extendedprice) / 1000 AS food_price_index, max(l_quantity) AS food_cereal_price_index,
               max(l_quantity) AS market_oil_price_usd_per_barrel, CAST(count(*) AS DOUBLE) AS market_gas_price_index,
               CAST(min(l_quantity) AS DOUBLE) AS market_fertilizer_price_index,
               CAST(max(l_linenumber) AS DOUBLE) AS market_commodity_price_index
        FROM lineitem GROUP BY 1""",
    "trade": """
        SELECT country_id AS country_iso3, CAST(date_trunc('month', event_date) AS DATE) AS observation_date,
               sum(price) AS trade_exports_value_usd, sum(num_mentions) AS trade_imports_value_usd,
               max(num_articles) AS trade_exports_3m_change_pct, min(num_articles) AS trade_imports_3m_change_pct
        FROM newsev GROUP BY 1, 2""",
    "ships": """
        SELECT country_id AS country_iso3, CAST(date_trunc('month', event_date) AS DATE) AS observation_date,
               CAST(count(*) AS DOUBLE) AS shipping_lsci_index,
               CAST(max(num_mentions) AS DOUBLE) AS shipping_port_connectivity_index FROM newsev GROUP BY 1, 2""",
    "lights": """
        SELECT country_id AS country_iso3, CAST(date_trunc('month', event_date) AS DATE) AS observation_date,
               CAST(min(num_mentions) AS DOUBLE) AS climate_night_lights_anomaly_pct,
               CAST(max(avg_tone) AS DOUBLE) AS climate_night_lights_zscore FROM newsev GROUP BY 1, 2""",
    "weather": """
        SELECT country_iso3, CAST(date_trunc('month', event_date) AS DATE) AS observation_date,
               sum(fatalities) % 97 AS climate_drought_severity_index, max(fatalities) AS climate_temperature_anomaly_c,
               CAST(count(*) AS DOUBLE) AS climate_precipitation_anomaly_pct FROM conf GROUP BY 1, 2""",
    "arms": """
        SELECT country_iso3, country_name, year(event_date) AS year, sum(fatalities) AS security_military_expenditure_usd,
               min(fatalities) AS security_military_expenditure_pct_gdp,
               CAST(count(*) AS DOUBLE) AS security_arms_import_volume_index FROM conf GROUP BY 1, 2, 3""",
    "govern": """
        SELECT country_iso3, country_name, year(event_date) AS year,
               CAST(count(*) AS DOUBLE) AS governance_voice_and_accountability,
               CAST(count(*) FILTER (event_type_slug = 'protests') AS DOUBLE) AS governance_political_stability,
               max(fatalities) AS governance_government_effectiveness, min(fatalities) AS governance_regulatory_quality,
               CAST(count(actor2_name) AS DOUBLE) AS governance_rule_of_law,
               CAST(max(conflict_new_id) AS DOUBLE) AS governance_control_of_corruption,
               sum(fatalities) % 101 AS governance_score FROM conf GROUP BY 1, 2, 3""",
    "fled": """
        SELECT country_iso3, country_name, year(event_date) AS year, sum(fatalities) AS refugees,
               CAST(count(*) AS DOUBLE) AS asylum_seekers, max(fatalities) AS idps
        FROM conf WHERE year(event_date) > 1993 GROUP BY 1, 2, 3""",
    "macro": """
        SELECT country_iso3, country_name, year(event_date) AS year, count(*) AS macro_population_total,
               max(fatalities) AS macro_cpi_yoy, min(fatalities) AS macro_gdp_growth_annual_pct
        FROM conf WHERE year(event_date) % 2 = 0 GROUP BY 1, 2, 3""",
    "cal": f"""
        SELECT DISTINCT country_iso3, event_date AS election_date FROM conf
        WHERE fatalities >= {CALENDAR_BOUND / 1000}""",
    "truth": """
        SELECT country_iso3, country_name, year, CAST(remainder > 0 AS BIGINT) AS onset1,
               CAST(remainder = 3 AS BIGINT) AS onset20,
               CASE WHEN remainder <> 2 THEN nullif(ids, '') END AS conflict_ids,
               CASE WHEN year % 2 = 0 THEN 'interstate' ELSE 'intrastate' END AS onset_type
        FROM (SELECT country_iso3, country_name, year(event_date) AS year, count(*) % 4 AS remainder,
                     concat_ws(';', CAST(min(CASE WHEN month(event_date) = 12 THEN conflict_new_id END) AS VARCHAR),
                               CAST(max(CASE WHEN month(event_date) = 12 THEN conflict_new_id END) AS VARCHAR)) AS ids
              FROM conf WHERE year(event_date) < 2001 GROUP BY 1, 2, 3)""",
    "weeks": """
        SELECT CAST(unnest(generate_series(CAST(date_trunc('week', min(o_orderdate)) AS DATE),
               CAST(date_trunc('week', max(o_orderdate)) AS DATE), INTERVAL 7 DAY)) AS DATE) AS week_start_date
        FROM orders""",
    "panel": """
        SELECT country_iso3 AS entity_id, country_name, region_name, week_start_date FROM nat CROSS JOIN weeks""",
    "conf_day": """
        SELECT country_iso3, event_date AS d, count(*) AS n, sum(fatalities) AS f,
               count(*) FILTER (event_type_slug = 'protests') AS protests,
               count(*) FILTER (event_type_slug = 'riots') AS riots,
               count(*) FILTER (event_type_slug = 'violence_against_civilians') AS vac,
               count(*) FILTER (event_type_slug = 'explosions_remote_violence') AS erv,
               count(*) FILTER (event_type_slug = 'strategic_developments') AS strat
        FROM conf GROUP BY 1, 2""",
    "viol_day": """
        SELECT country_iso3, event_date_start AS d, count(*) AS n, sum(best_fatalities) AS f,
               count(*) FILTER (type_of_violence = 1) AS s
        FROM viol GROUP BY 1, 2""",
    "pred": """
        SELECT entity_id, country_name AS entity_name, region_name, week_start_date AS forecast_date, n7, n28,
               (n28 * 13 + date_diff('day', DATE '1970-01-05', week_start_date) // 7) % 97 / 97.0
               AS calibrated_probability,
               (n28 * 7 + n7 + date_diff('day', DATE '1970-01-05', week_start_date) // 7) % 89 / 89.0
               AS second_probability,
               CAST(v30 * 8 > n28 AS BIGINT) AS label,
               CASE WHEN v7 > 0 THEN CAST(week_start_date + 7 AS DATE) END AS next_event_date
        FROM (
            SELECT p.*, coalesce(c.n7, 0) AS n7, coalesce(c.n28, 0) AS n28, coalesce(v.v30, 0) AS v30,
                   coalesce(v.v7, 0) AS v7
            FROM panel p
            LEFT JOIN (SELECT entity_id, week_start_date,
                              CAST(sum(CASE WHEN d >= week_start_date - 6 THEN n ELSE 0 END) AS BIGINT) AS n7,
                              CAST(sum(n) AS BIGINT) AS n28
                       FROM panel JOIN conf_day ON country_iso3 = entity_id
                            AND d BETWEEN week_start_date - 27 AND week_start_date
                       GROUP BY 1, 2) c USING (entity_id, week_start_date)
            LEFT JOIN (SELECT entity_id, week_start_date,
                              CAST(sum(CASE WHEN d <= week_start_date + 7 THEN n ELSE 0 END) AS BIGINT) AS v7,
                              CAST(sum(n) AS BIGINT) AS v30
                       FROM panel JOIN viol_day ON country_iso3 = entity_id
                            AND d BETWEEN week_start_date + 1 AND week_start_date + 30
                       GROUP BY 1, 2) v USING (entity_id, week_start_date))""",
    "models": """
        SELECT entity_id, entity_name, region_name, forecast_date, label, 'alpha' AS model_name,
               calibrated_probability AS raw_score FROM pred
        UNION ALL
        SELECT entity_id, entity_name, region_name, forecast_date, label, 'beta', second_probability FROM pred""",
    "users": """
        SELECT CAST(user_id AS VARCHAR) AS entity_id, CAST(ts AS DATE) AS as_of_date, count(*) AS event_count,
               count(*) FILTER (event_type = 'error') AS error_count, sum(floor(value)) AS value_sum
        FROM events GROUP BY 1, 2""",
}


def sql(body: str, **extra: str) -> str:
    """Prefix a query with the stand-in tables it names, directly or through each other."""
    known = {**CTES, **extra}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in known.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({known[name]})" for name in needed) + "\n" + body
