"""Queries over scans, normalizers and text functions. Raw text tables are derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from registry import query
from registry.publication import published_predictions
from registry.standins import conflict, nations, news, read, rounded, sql
from tocsin.functions import scoring, text
from tocsin.plans.publish import PREDICTION_COLUMNS
from tocsin.session import scratch_dir
from tocsin.sources import normalize, readers, schemas, sinks
from tocsin.sources.countries import resolve_country

INGESTED = "2024-01-01 00:00:00"


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return nations(spark, sf).select(F.col("country_iso3").alias("iso3"), F.col("country_name").alias("name"))


def _text(column) -> F.Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def place_of(key) -> F.Column:
    """Spellings of a nation: plain, padded, lower case, or unknown."""
    kind, name = F.col(key) % 5, F.col("n_name")
    return F.when(kind == 0, F.concat(F.lit(" "), name, F.lit(" "))).when(kind == 1, F.lower(name)).when(
        kind == 2, F.lit("Atlantis")
    ).otherwise(name)


PLACE = "CASE {k} % 5 WHEN 0 THEN ' ' || n_name || ' ' WHEN 1 THEN lower(n_name) WHEN 2 THEN 'Atlantis' ELSE n_name END"


def raw_conflict(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer, nation = (read(spark, sf, name) for name in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("o_orderkey")
    return joined.select(
        _text(key).alias("data_id"),
        F.when(key % 3 == 0, " ").otherwise(F.concat(F.lit("E"), key.cast("string"))).alias("event_id_cnty"),
        F.lit("n").alias("event_id_no_cnty"),
        F.when(key % 11 == 0, "no date").otherwise(_text(F.col("o_orderdate").cast("date"))).alias("event_date"),
        F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("!")).alias("event_type"),
        F.col("o_orderstatus").alias("sub_event_type"),
        F.concat(F.lit("  "), F.col("c_name")).alias("actor1"),
        F.lit("").alias("assoc_actor_1"),
        F.when(key % 2 == 0, "  ").otherwise("other").alias("actor2"),
        F.lit(None).cast("string").alias("assoc_actor_2"),
        place_of("o_orderkey").alias("country"),
        F.lit("a1").alias("admin1"),
        F.lit(" ").alias("admin2"),
        F.lit("l").alias("location"),
        F.lit("1.5").alias("latitude"),
        F.lit("x").alias("longitude"),
        F.when(key % 7 == 0, "many").otherwise(_text(F.floor("o_totalprice"))).alias("fatalities"),
        F.lit("n").alias("notes"),
        F.lit("s").alias("source"),
        F.lit("2024-01-01").alias("timestamp"),
    )


CODED = """
    SELECT o.*, n_name, c_name, c.iso3 FROM orders o JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT n_nationkey AS k, country_iso3 AS iso3 FROM nat) c ON c.k = n_nationkey"""


@query(
    "normalize_conflict",
    sql("""
    SELECT CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'E' || o_orderkey END AS source_record_id,
           iso3 AS country_iso3, CAST(o_orderdate AS DATE) AS event_date,
           trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS event_type_slug,
           lower(o_orderstatus) AS sub_event_type_slug, c_name AS actor1_name,
           CASE WHEN o_orderkey % 2 = 1 THEN 'other' END AS actor2_name,
           CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice) END AS fatalities, CAST(NULL AS VARCHAR) AS admin2_name,
           1.5::DOUBLE AS latitude, CAST(NULL AS DOUBLE) AS longitude
    FROM coded WHERE o_orderkey % 5 <> 2 AND o_orderkey % 11 <> 0""", coded=CODED),
)
def normalize_conflict(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.conflict_events(raw_conflict(spark, sf), dictionary(spark, sf), INGESTED).select(
        "source_record_id", "country_iso3", "event_date", "event_type_slug", "sub_event_type_slug", "actor1_name",
        "actor2_name", "fatalities", "admin2_name", "latitude", "longitude",
    )


@query(
    "resolve_country",
    sql("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 2 THEN iso3 END AS country_iso3 FROM coded""", coded=CODED),
)
def resolve_country_query(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer, nation = (read(spark, sf, name) for name in ("orders", "customer", "nation"))
    named = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    ).select("o_orderkey", place_of("o_orderkey").alias("country"))
    return resolve_country(named, "country", dictionary(spark, sf)).select("o_orderkey", "country_iso3")


def raw_news(spark: SparkSession, sf: str) -> DataFrame:
    lineitem, supplier, nation = (read(spark, sf, name) for name in ("lineitem", "supplier", "nation"))
    joined = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    )
    values = {
        "global_event_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"),
        "sql_date": F.when(F.col("l_partkey") % 9 == 0, "20001340").otherwise(F.date_format("l_shipdate", "yyyyMMdd")),
        "date_added": F.concat(F.date_format("l_shipdate", "yyyyMMdd"), F.lit("123000")),
        "action_geo_full_name": F.concat(F.lit("Town, "), F.lit("State "), F.lit(", "), place_of("l_partkey"), F.lit(" , ")),
        "goldstein_scale": _text(F.col("l_discount")),
        "num_mentions": _text(F.col("l_quantity")),
        "num_articles": F.lit("none"),
        "avg_tone": _text(F.col("l_tax")),
    }
    return joined.select(
        *[values.get(name, F.lit(None).cast("string")).alias(name) for name in schemas.NEWS_EVENT_COLUMNS]
    )


@query(
    "normalize_news_events",
    sql("""
    SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS global_event_id,
           CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_shipdate AS DATE) END AS event_date,
           strftime(l_shipdate, '%Y-%m-%d 12:30:00') AS published_at,
           CASE WHEN l_partkey % 5 <> 2 THEN country_iso3 END AS country_id,
           CASE l_partkey % 5 WHEN 1 THEN lower(n_name) WHEN 2 THEN 'Atlantis' ELSE n_name END AS source_country_name,
           l_discount AS goldstein_scale, l_quantity AS num_mentions, CAST(NULL AS DOUBLE) AS num_articles
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = nation.n_nationkey
         JOIN nat ON nat.n_nationkey = nation.n_nationkey"""),
)
def normalize_news_events(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.news_events(raw_news(spark, sf), dictionary(spark, sf)).select(
        "global_event_id", "event_date", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        "country_id", "source_country_name", "goldstein_scale", "num_mentions", "num_articles",
    )


def raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with three places each: two whole names, one tail name, one broken entry."""
    def name(shift: int) -> F.Column:
        return F.concat(F.lit("NATION_"), ((F.col("doc_id") + shift * F.col("n_chars")) % 30).cast("string"))

    values = {
        "gkg_record_id": _text("doc_id"),
        "document_identifier": F.concat(F.lit("u"), _text("doc_id")),
        "date": F.lit("20240102030405"),
        "source_common_name": F.col("source"),
        "themes": F.col("lang"),
        "v2_themes": F.col("text"),
        "v2_locations": F.concat(
            F.lit("1#"), name(0), F.lit("#A#A1#0;4#Town, "), name(1), F.lit("#B#B1#;1#broken;1#"), name(2), F.lit("#C#C1;")
        ),
        "v2_tone": F.concat(_text(F.col("n_chars") % 100), F.lit(".5,1,2")),
    }
    return read(spark, sf, "documents").select(
        *[values.get(column, F.lit(None).cast("string")).alias(column) for column in schemas.NEWS_DOCUMENT_COLUMNS]
    )


DOCUMENTS_SQL = sql("""
    SELECT CAST(doc_id AS VARCHAR) AS gkg_record_id, country_iso3 AS document_country_id, DATE '2024-01-02' AS document_date,
           n_chars % 100 + 0.5::DOUBLE AS tone_score, md5(text) AS digest
    FROM documents LEFT JOIN (
        SELECT DISTINCT doc_id, country_iso3
        FROM (SELECT doc_id, 'NATION_' || (doc_id + unnest([0, 1, 2]) * n_chars) % 30 AS name FROM documents)
        JOIN nat ON name = country_name) USING (doc_id)""")


@query("normalize_news_documents", DOCUMENTS_SQL)
def normalize_news_documents(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.news_documents(raw_documents(spark, sf), dictionary(spark, sf)).select(
        "gkg_record_id", "document_country_id", "document_date", "tone_score", F.md5("v2_themes").alias("digest")
    )


@query(
    "list_field_explode",
    """SELECT doc_id, CAST(unnest(range(3)) AS INTEGER) AS position,
              'NATION_' || (doc_id + unnest(range(3)) * n_chars) % 30 AS place FROM documents""",
)
def list_field_explode(spark: SparkSession, sf: str) -> DataFrame:
    entries = text.parse_locations("v2_locations")
    exploded = raw_documents(spark, sf).select(F.col("gkg_record_id").cast("long").alias("doc_id"), F.posexplode(entries))
    return exploded.select("doc_id", F.col("pos").alias("position"), text.last_segment("col.location_name").alias("place"))


def raw_violence(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw_conflict(spark, sf)
    number = F.col("data_id").cast("long")
    blank = {c: F.lit(None).cast("string") for c in (
        "region", "adm_1", "adm_2", "conflict_name", "side_a", "side_b", "high", "low", "where_prec")}
    return rows.select(
        F.col("data_id").alias("id"), "country", F.col("event_date").alias("date_start"), F.col("event_date").alias("date_end"),
        F.when(number % 4 == 0, "").otherwise("2020-02-03; 2021-01-01").alias("source_date"),
        _text(number % 5).alias("type_of_violence"), _text(number % 10).alias("conflict_new_id"),
        _text(number % 10).alias("conflict_dset_id"), F.col("fatalities").alias("best"), "latitude", "longitude",
        F.substring("event_date", 1, 4).alias("year"), *[value.alias(name) for name, value in blank.items()],
    )


@query(
    "normalize_violence",
    sql("""
    SELECT CAST(o_orderkey AS VARCHAR) AS source_record_id, iso3 AS country_iso3, CAST(o_orderdate AS DATE) AS event_date_start,
           CASE o_orderkey % 5 WHEN 1 THEN 'state_based' WHEN 3 THEN 'one_sided' END AS event_type,
           o_orderkey % 5 AS type_of_violence, o_orderkey % 10 AS conflict_new_id,
           CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice) END AS best_fatalities,
           CASE WHEN o_orderkey % 4 <> 0 THEN DATE '2020-02-03' END AS published, year(o_orderdate) AS year
    FROM coded WHERE o_orderkey % 5 <> 2 AND o_orderkey % 11 <> 0 AND year(o_orderdate) >= 1998""", coded=CODED),
)
def normalize_violence(spark: SparkSession, sf: str) -> DataFrame:
    recent = normalize.min_year(raw_violence(spark, sf), 1998)
    return normalize.violence_events(recent, dictionary(spark, sf), INGESTED).select(
        "source_record_id", "country_iso3", "event_date_start", "event_type", "type_of_violence", "conflict_new_id",
        "best_fatalities", F.col("publication_ts_utc").cast("date").alias("published"), "year",
    )


ONSETS_SQL = sql("""
    SELECT iso3 AS country_iso3, 'interstate' AS onset_type, year(o_orderdate) AS year, o_orderkey % 3 AS newconf,
           CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 2 END AS onset1, CAST(0 AS BIGINT) AS onset2,
           CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey || ', ' || o_orderkey END AS conflict_ids
    FROM coded WHERE o_orderkey % 5 <> 2""", coded=CODED)


@query("normalize_onsets", ONSETS_SQL)
def normalize_onsets(spark: SparkSession, sf: str) -> DataFrame:
    return typed_onsets(raw_onsets(spark, sf), spark, sf)


def raw_onsets(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer, nation = (read(spark, sf, name) for name in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("o_orderkey")
    return joined.select(
        place_of("o_orderkey").alias("name"), _text(F.year("o_orderdate")).alias("year"), _text(key % 3).alias("newconf"),
        F.when(key % 4 == 0, "?").otherwise(_text(key % 2)).alias("onset1"),
        *[F.lit(None).cast("string").alias(f"onset{n}") for n in (2, 3, 5, 10, 20)],
        F.when(key % 6 == 0, " ").otherwise(F.concat_ws(", ", "o_custkey", "o_orderkey")).alias("inter_conflict_ids"),
        F.lit("1999").alias("year_prev"),
    )


def typed_onsets(raw: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return normalize.onsets(raw, dictionary(spark, sf), "interstate", INGESTED).select(
        "country_iso3", "onset_type", "year", "newconf", "onset1", "onset2", "conflict_ids"
    )


def raw_series(spark: SparkSession, sf: str) -> DataFrame:
    return news(spark, sf).groupBy("country_id", F.trunc("event_date", "month").alias("month")).agg(
        F.sum("num_mentions").alias("mentions"), F.max("num_articles").alias("articles"), F.count("*").alias("rows")
    )


SERIES = """
    SELECT country_id, CAST(date_trunc('month', event_date) AS DATE) AS month, sum(num_mentions) AS mentions,
           max(num_articles) AS articles, count(*) AS rows FROM newsev GROUP BY 1, 2"""


@query(
    "normalize_series",
    sql("""
    SELECT country_id || '-' || CAST(month AS VARCHAR) AS source_record_id, country_id AS country_iso3,
           month AS observation_date, mentions AS shipping_lsci_index,
           CASE WHEN rows % 4 <> 0 THEN articles END AS shipping_port_connectivity_index,
           (SELECT max(month) FROM monthly WHERE rows % 10 <> 0) AS published
    FROM monthly WHERE rows % 10 <> 0""", monthly=SERIES),
)
def normalize_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.col("rows")
    raw = raw_series(spark, sf).select(
        F.concat(F.lit(" "), F.lower("country_id")).alias("country_iso3"), F.lit(" N ").alias("country_name"),
        F.when(rows % 10 == 0, "?").otherwise(_text("month")).alias("observation_date"),
        _text("mentions").alias("shipping_lsci_index"),
        F.when(rows % 4 == 0, "n/a").otherwise(_text("articles")).alias("shipping_port_connectivity_index"),
    )
    return normalize.series(raw, normalize.SERIES["shipping"], INGESTED).select(
        "source_record_id", "country_iso3", "observation_date", "shipping_lsci_index", "shipping_port_connectivity_index",
        F.col("publication_ts_utc").cast("date").alias("published"),
    )


@query(
    "normalize_global_series",
    sql("""
    SELECT CAST(month AS VARCHAR) AS source_record_id, month AS observation_date, sum(mentions) AS food_price_index,
           max(articles) AS food_cereal_price_index, DATE '2024-05-05' AS published
    FROM monthly GROUP BY 1, 2""", monthly=SERIES),
)
def normalize_global_series(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_series(spark, sf).groupBy(_text("month").alias("observation_date")).agg(
        _text(F.sum("mentions")).alias("food_price_index"), _text(F.max("articles")).alias("food_cereal_price_index")
    )
    return normalize.series(raw, normalize.SERIES["food"], INGESTED, "2024-05-05 00:00:00").select(
        "source_record_id", "observation_date", "food_price_index", "food_cereal_price_index",
        F.col("publication_ts_utc").cast("date").alias("published"),
    )


@query(
    "normalize_country_year",
    sql("""
    SELECT country_id || '-' || year(month) AS source_record_id, country_id AS country_iso3, year(month) AS year,
           sum(mentions) AS security_military_expenditure_usd, max(articles) AS security_military_expenditure_pct_gdp,
           CAST(NULL AS DOUBLE) AS security_arms_import_volume_index
    FROM monthly GROUP BY ALL""", monthly=SERIES),
)
def normalize_country_year(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_series(spark, sf).groupBy(
        F.lower("country_id").alias("country_iso3"), _text(F.year("month")).alias("year")
    ).agg(
        F.lit("n").alias("country_name"), _text(F.sum("mentions")).alias("security_military_expenditure_usd"),
        _text(F.max("articles")).alias("security_military_expenditure_pct_gdp"),
        F.lit("-").alias("security_arms_import_volume_index"),
    )
    return normalize.series(raw, normalize.SERIES["security"], INGESTED).select(
        "source_record_id", "country_iso3", "year", *normalize.SERIES["security"].measures
    )


@query(
    "normalize_governance",
    sql("""
    SELECT country_id AS country_iso3, month, CASE WHEN rows % 2 = 0 THEN mentions END AS governance_political_stability,
           round(CASE WHEN rows % 2 = 0 THEN (mentions + articles) / 2 ELSE articles END, 6) AS governance_score
    FROM monthly""", monthly=SERIES),
)
def normalize_governance(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_series(spark, sf).select(
        F.col("country_id").alias("country_iso3"), _text("month").alias("country_name"), F.lit("2001").alias("year"),
        F.lit("").alias("voice_and_accountability"),
        F.when(F.col("rows") % 2 == 0, _text("mentions")).alias("political_stability_and_absence_of_violence"),
        *[F.lit("NaN").alias(c) for c in ("government_effectiveness", "regulatory_quality", "rule_of_law")],
        _text("articles").alias("control_of_corruption"),
    )
    return normalize.governance(raw, INGESTED).select(
        "country_iso3", F.col("country_name").cast("date").alias("month"), "governance_political_stability",
        rounded("governance_score", 6).alias("governance_score"),
    )


@query(
    "normalize_elections",
    sql("""
    SELECT country_iso3, event_date AS election_date,
           country_iso3 || '-' || event_date || '-' || CASE WHEN conflict_new_id % 2 = 0 THEN event_type_slug ELSE 'unknown' END
           AS source_record_id FROM conf"""),
)
def normalize_elections(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.concat(F.lit(" "), F.replace(F.initcap(F.replace(F.col("event_type_slug"), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(" - ")))
    raw = conflict(spark, sf).select(
        F.lower("country_iso3").alias("country_iso3"), "country_name", _text("event_date").alias("election_date"),
        F.when(F.col("conflict_new_id") % 2 == 0, kind).alias("election_type"),
    )
    return normalize.elections(raw, INGESTED).select("country_iso3", "election_date", "source_record_id")


@query(
    "normalize_displacement",
    sql("""
    SELECT year(month) AS year, country_id, CASE WHEN rows % 3 = 0 THEN 0 ELSE mentions END AS refugees, articles AS idps,
           0.0::DOUBLE AS hst FROM monthly WHERE rows % 7 > 1""", monthly=SERIES),
)
def normalize_displacement(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.col("rows")
    raw = raw_series(spark, sf).select(
        _text(F.year("month")).alias("year"), F.lit("n").alias("coo_name"),
        F.when(rows % 7 == 0, "-").when(rows % 7 > 1, F.col("country_id")).alias("coo_iso"),
        F.when(rows % 3 == 0, "-").otherwise(_text("mentions")).alias("refugees"), _text("articles").alias("idps"),
        *[F.lit(None).cast("string").alias(c) for c in ("asylum_seekers", "returned_refugees", "returned_idps", "stateless", "ooc", "hst")],
    )
    return normalize.displacement(raw).select("year", "country_id", "refugees", "idps", "hst")


def raw_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly values per nation and indicator in the nested layout, one aggregate code among the countries."""
    yearly = raw_series(spark, sf).groupBy("country_id", F.year("month").alias("y")).agg(
        F.sum("mentions").alias("m"), F.max("articles").alias("a"), F.sum("rows").alias("n")
    )
    codes = list(schemas.INDICATOR_COLUMNS)
    items = F.array(
        *[F.struct(F.lit(code).alias("code"), value.cast("string").alias("value"))
          for code, value in zip(codes, (F.col("m"), F.when(F.col("n") % 3 != 0, F.col("a")), F.lit(None)))]
    )
    return yearly.select("country_id", "y", F.inline(items)).select(
        F.struct(F.col("code").alias("id"), F.concat(F.lit("about "), "code").alias("value")).alias("indicator"),
        F.struct(F.lit("X").alias("id"), F.concat(F.lit("Name "), "country_id").alias("value")).alias("country"),
        F.when(F.col("country_id") == "NAB", "1W").otherwise(F.col("country_id")).alias("countryiso3code"),
        _text("y").alias("date"), "value", F.lit("").alias("unit"), F.lit("").alias("obs_status"), F.lit("0").alias("decimal"),
        F.struct(F.lit("2024-02-03").alias("lastupdated")).alias("metadata"),
    )


INDICATORS = """
    SELECT country_id, year(month) AS y, sum(mentions) AS m, max(articles) AS a, sum(rows) AS n FROM monthly
    WHERE country_id <> 'NAB' GROUP BY 1, 2"""


@query(
    "normalize_indicators",
    sql("""
    SELECT country_id AS country_iso3, 'Name ' || country_id AS country_name, indicator_id, y AS year, value,
           DATE '2024-02-03' AS published
    FROM (SELECT country_id, y, 'NY.GDP.MKTP.KD.ZG' AS indicator_id, m AS value FROM yearly
          UNION ALL SELECT country_id, y, 'FP.CPI.TOTL.ZG', CASE WHEN n % 3 <> 0 THEN a END FROM yearly
          UNION ALL SELECT country_id, y, 'SP.POP.TOTL', NULL FROM yearly)""", monthly=SERIES, yearly=INDICATORS),
)
def normalize_indicators(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.indicators(raw_indicators(spark, sf), INGESTED).select(
        "country_iso3", "country_name", "indicator_id", "year", "value",
        F.col("publication_ts_utc").cast("date").alias("published"),
    )


@query(
    "indicator_pivot",
    sql("""
    SELECT country_id AS country_iso3, y AS year, m AS macro_gdp_growth_annual_pct,
           CASE WHEN n % 3 <> 0 THEN a END AS macro_cpi_yoy, CAST(NULL AS DOUBLE) AS macro_population_total,
           DATE '2024-02-03' AS published FROM yearly""", monthly=SERIES, yearly=INDICATORS),
)
def indicator_pivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalize.indicators(raw_indicators(spark, sf), INGESTED)
    return normalize.pivot_indicators(rows).select(
        "country_iso3", "year", *schemas.INDICATOR_COLUMNS.values(),
        F.col("publication_ts_utc").cast("date").alias("published"),
    )


@query(
    "flatten_bronze",
    sql("""
    SELECT CASE country_id WHEN 'NAB' THEN '1W' ELSE country_id END AS countryiso3code, CAST(y AS VARCHAR) AS date,
           'Name ' || country_id AS country_name, 'X' AS country_api_id, c AS indicator_api_id, 'wanted' AS requested_indicator_id
    FROM (SELECT DISTINCT country_id, year(month) AS y FROM monthly),
         (SELECT unnest(['NY.GDP.MKTP.KD.ZG', 'FP.CPI.TOTL.ZG', 'SP.POP.TOTL']) AS c)""", monthly=SERIES),
)
def flatten_bronze(spark: SparkSession, sf: str) -> DataFrame:
    flat = normalize.all_to_text(normalize.flatten_indicators(raw_indicators(spark, sf), "wanted"))
    return flat.select("countryiso3code", "date", "country_name", "country_api_id", "indicator_api_id", "requested_indicator_id")


@query(
    "slug_text",
    """SELECT doc_id, md5(coalesce(trim(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '_', 'g'), '_'), '')) AS digest
       FROM documents""",
)
def slug_text(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(
        "doc_id", F.md5(F.coalesce(text.slug("text"), F.lit(""))).alias("digest")
    )


@query(
    "ints_in_text",
    """SELECT doc_id, CAST(len(ids) AS INTEGER) AS numbers, list_max(ids) AS largest
       FROM (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[0-9]+'),
                    lambda t: TRY_CAST(t AS BIGINT)), lambda t: t IS NOT NULL)) AS ids FROM documents)""",
)
def ints_in_text(spark: SparkSession, sf: str) -> DataFrame:
    numbers = read(spark, sf, "documents").select("doc_id", text.ints_in_text("text").alias("ids"))
    return numbers.select("doc_id", F.size("ids").alias("numbers"), F.array_max("ids").alias("largest"))


@query(
    "driver_labels",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'plain ' || event_type WHEN event_id % 4 = 1 THEN event_type || '|' || user_id
                             WHEN event_id % 4 = 2 THEN event_type || '|solo' ELSE '' END AS labels,
              TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
)
def driver_labels(spark: SparkSession, sf: str) -> DataFrame:
    kind, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    raw = (
        F.when(kind == 0, F.concat(F.lit("plain "), "event_type"))
        .when(kind == 1, F.concat(F.lit('["'), F.col("event_type"), F.lit('", "'), user, F.lit('"]')))
        .when(kind == 2, F.concat(F.lit('[{"feature": "'), F.col("event_type"), F.lit('", "contribution": 1.5}, "solo"]')))
    )
    return read(spark, sf, "events").select(
        "event_id", F.array_join(scoring.driver_labels(raw), "|").alias("labels"),
        F.get_json_object("props", "$.k").try_cast("long").alias("k"),
    )


# --- files ----------------------------------------------------------------------------------------------------


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "csv_round_trip",
    """SELECT o_orderpriority AS priority, count(*) AS rows, sum(o_orderkey) AS keys FROM orders GROUP BY 1""".replace(
        "sum(o_orderkey)", "CAST(sum(o_orderkey) AS BIGINT)"
    ),
)
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["o_orderkey", "o_orderpriority", "o_orderdate"]
    path = _fresh(spark, "csv")
    normalize.all_to_text(read(spark, sf, "orders").select(*columns)).write.csv(path, header=True)
    back = readers.read_csv(spark, path, columns)
    return back.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("rows"), F.sum(text.to_whole("o_orderkey")).alias("keys")
    )


@query(
    "news_event_files",
    sql("""SELECT CASE WHEN l_partkey % 5 <> 2 THEN country_iso3 END AS country_id, count(*) AS rows,
                  sum(l_quantity) AS mentions
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nat ON s_nationkey = n_nationkey GROUP BY 1"""),
)
def news_event_files(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh(spark, "tsv")
    raw_news(spark, sf).write.csv(path, sep="\t", header=False, quote="", emptyValue="")
    events = normalize.news_events(readers.read_news_events(spark, path), dictionary(spark, sf))
    return events.groupBy("country_id").agg(F.count("*").alias("rows"), F.sum("num_mentions").alias("mentions"))


@query(
    "news_document_files",
    sql("""SELECT gkg_record_id, document_country_id, tone_score, md5(regexp_replace(text, '[\\x09-\\x0D]', ' ', 'g')) AS digest
           FROM typed_docs JOIN documents ON CAST(doc_id AS VARCHAR) = gkg_record_id""", typed_docs=DOCUMENTS_SQL),
)
def news_document_files(spark: SparkSession, sf: str) -> DataFrame:
    """Header-less document files with their texts; tabs and line breaks, which such files cannot hold, become spaces."""
    path = _fresh(spark, "documents")
    raw = raw_documents(spark, sf).withColumn("v2_themes", F.regexp_replace("v2_themes", "[\\x09-\\x0D]", " "))
    raw.write.csv(
        path, sep="\t", header=False, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    typed = normalize.news_documents(readers.read_news_documents(spark, path), dictionary(spark, sf))
    return typed.select("gkg_record_id", "document_country_id", "tone_score", F.md5("v2_themes").alias("digest"))


@query("quoted_csv_files", "SELECT doc_id, md5(text) AS digest, source FROM documents")
def quoted_csv_files(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with line breaks and quotes through quoted files whose columns stand in another order."""
    path = _fresh(spark, "quoted")
    docs = read(spark, sf, "documents").select("source", "text", F.col("doc_id").cast("string").alias("doc_id"))
    docs.write.csv(path, header=True, quoteAll=True, escape='"')
    back = readers.read_quoted_csv(spark, path, ["doc_id", "text", "source", "note"], optional=["note"])
    return back.where(F.col("note").isNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), "source"
    )


@query("onset_files", ONSETS_SQL)
def onset_files(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh(spark, "onsets")
    raw_onsets(spark, sf).write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return typed_onsets(readers.read_onsets(spark, path), spark, sf)


@query(
    "json_item_files",
    sql("""SELECT year(month) AS year, country_id, sum(mentions) AS refugees FROM monthly GROUP BY 1, 2""", monthly=SERIES),
)
def json_item_files(spark: SparkSession, sf: str) -> DataFrame:
    yearly = raw_series(spark, sf).groupBy("country_id", F.year("month").alias("year")).agg(F.sum("mentions").alias("m"))
    item = F.struct(_text("year").alias("year"), F.lit("n").alias("coo_name"), F.col("country_id").alias("coo_iso"),
                    _text("m").alias("refugees"))
    # One document per year, as long as the list of countries.
    path = _fresh(spark, "items")
    yearly.groupBy("year").agg(F.collect_list(item).alias("items")).select("year", "items").write.partitionBy("year").json(path)
    return normalize.displacement(readers.read_json_items(spark, f"{path}/*/*.json")).select(
        "year", "country_id", "refugees"
    )


@query(
    "json_pair_files",
    sql("""SELECT country_id AS country_iso3, y AS year, m AS value, DATE '2024-02-03' AS published FROM yearly""",
        monthly=SERIES, yearly=INDICATORS),
)
def json_pair_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw_indicators(spark, sf).where(F.col("indicator.id") == "NY.GDP.MKTP.KD.ZG")
    # One document per year, as long as the list of countries.
    documents = rows.groupBy("date").agg(
        F.to_json(F.collect_list(F.struct(*[c for c in rows.columns if c != "metadata"]))).alias("rows")
    ).select("date", F.concat(F.lit('[{"page":1,"lastupdated":"2024-02-03"},'), "rows", F.lit("]")).alias("value"))
    path = _fresh(spark, "pairs")
    documents.write.partitionBy("date").text(path)
    typed = normalize.indicators(readers.read_json_pair(spark, f"{path}/*/*.txt"), INGESTED)
    return typed.select("country_iso3", "year", "value", F.col("publication_ts_utc").cast("date").alias("published"))


@query("layer_round_trip", sql("SELECT country_iso3, event_date, fatalities, year(event_date)::INTEGER AS part_year FROM conf"))
def layer_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows = conflict(spark, sf).select("country_iso3", "event_date", "fatalities")
    path = sinks.write_layer(
        rows, _fresh(spark, "lake"), "silver", "conflict", "events", date_column="event_date",
        sort_by=["country_iso3", "event_date"],
    )
    return readers.read_table(spark, path)


@query("record_files", sql("SELECT lower(country_iso3) AS record_key, country_name FROM nat"))
def record_files(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.write_records(
        nations(spark, sf).select("country_iso3", "country_name"), _fresh(spark, "records"), partition_by="country_iso3"
    )
    return spark.read.schema("country_iso3 string, country_name string, record_key string").json(path).select(
        "record_key", "country_name"
    )


@query(
    "fallback_scan",
    sql("""SELECT entity_id AS country_iso3, forecast_date, CAST(1 AS INT) AS baseline_used FROM pred"""),
)
def fallback_scan(spark: SparkSession, sf: str) -> DataFrame:
    baseline = published_predictions(spark, sf)
    broken = baseline.withColumn(
        "calibrated_probability", F.when(F.col("country_iso3") != "NAC", F.col("calibrated_probability"))
    )
    chosen = readers.read_with_fallback(broken, baseline, PREDICTION_COLUMNS)
    return chosen.select("country_iso3", "forecast_date", F.col("baseline_used").cast("int").alias("baseline_used"))
