"""Raw text tables to typed tables. Every normalizer is one narrow projection, plus at most a dimension lookup."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tocsin.functions.calendar import parse_day, parse_instant
from tocsin.functions.text import (
    blank_to_null,
    distinct_in_order,
    first_list_instant,
    first_present,
    last_segment,
    leading_number,
    parse_locations,
    row_mean,
    slug,
    to_number,
    to_whole,
    upper_key,
)
from tocsin.sources.countries import alias_table, lookup_key, resolve_country
from tocsin.sources.schemas import GOVERNANCE_COMPONENTS, HUMANITARIAN_COUNTS, INDICATOR_COLUMNS

# Codes of the violence classes.
VIOLENCE_CLASSES = {1: "state_based", 2: "non_state", 3: "one_sided"}

# Day and instant patterns of the news exports.
NEWS_DAY, NEWS_INSTANT = "yyyyMMdd", "yyyyMMddHHmmss"


def _optional(df: DataFrame, column: str) -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast("string")


def _instant(value: str | None) -> Column:
    return F.lit(value).cast("timestamp")


def news_events(raw: DataFrame, dimension: DataFrame) -> DataFrame:
    """News events: typed dates and measures, country from the last part of the place name."""
    named = raw.withColumn("source_country_name", last_segment("action_geo_full_name"))
    resolved = resolve_country(named, "source_country_name", dimension, out="country_id")
    return resolved.select(
        "global_event_id",
        parse_day("sql_date", NEWS_DAY).alias("event_date"),
        parse_instant("date_added", NEWS_INSTANT).alias("published_at"),
        "country_id",
        "source_country_name",
        "action_geo_country_code",
        "action_geo_full_name",
        "event_code",
        "event_base_code",
        "event_root_code",
        "quad_class",
        *[
            to_number(column).alias(column)
            for column in ("goldstein_scale", "num_mentions", "num_sources", "num_articles", "avg_tone")
        ],
        "source_url",
    )


def document_places(raw: DataFrame, dimension: DataFrame) -> DataFrame:
    """(places, countries): the countries of every distinct list of places, in its order.

    A list of places is resolved once, however many documents have it. The names meet the aliases in a plain join,
    whose work does not grow with the number of aliases, and come back to their list by its digest.
    """
    listed = raw.where(F.col("v2_locations").isNotNull()).select("v2_locations").distinct()
    places = listed.select(
        F.sha2("v2_locations", 256).alias("places"), F.posexplode(parse_locations("v2_locations")).alias("position", "place")
    )
    tail = lookup_key(last_segment("place.location_name"))
    whole = F.when(F.col("place.geo_type") == "1", lookup_key("place.location_name")).otherwise(tail)
    choices = F.array(F.struct(F.lit(1).alias("choice"), whole.alias("alias")), F.struct(F.lit(2).alias("choice"), tail.alias("alias")))
    named = places.select("places", "position", F.inline(choices)).where(F.col("alias").isNotNull())
    found = named.join(alias_table(dimension), "alias").groupBy("places").agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("choice") == n, F.struct("position", "iso3")))).alias(f"_{n}")
            for n in (1, 2)
        ]
    )
    best = F.when(F.size("_1") > 0, F.col("_1")).otherwise(F.col("_2"))
    return found.select("places", distinct_in_order(F.transform(best, lambda x: x["iso3"])).alias("countries"))


def news_documents(raw: DataFrame, dimension: DataFrame) -> DataFrame:
    """News documents, one row per distinct country named in a document, or one row without country."""
    prepared = raw.select(
        "gkg_record_id", "document_identifier", "date", "source_common_name", "themes", "v2_themes", "v2_tone",
        F.sha2("v2_locations", 256).alias("places"),
    ).join(document_places(raw, dimension), "places", "left")
    published = parse_instant("date", NEWS_INSTANT)
    return prepared.select(
        "gkg_record_id",
        "document_identifier",
        published.cast("date").alias("document_date"),
        published.alias("published_at"),
        F.explode_outer("countries").alias("document_country_id"),
        "source_common_name",
        "themes",
        "v2_themes",
        leading_number("v2_tone").alias("tone_score"),
    )


def conflict_events(raw: DataFrame, dimension: DataFrame, ingested_at: str) -> DataFrame:
    """Conflict events: record id, code, date, slugs, trimmed texts; rows without country or date are dropped."""
    resolved = resolve_country(raw, "country", dimension)
    typed = resolved.select(
        F.lit("acled").alias("source_name"),
        first_present("event_id_cnty", "data_id", "event_id_no_cnty").alias("source_record_id"),
        "country_iso3",
        F.col("country").alias("country_name"),
        blank_to_null("admin1").alias("admin1_name"),
        blank_to_null("admin2").alias("admin2_name"),
        blank_to_null(_optional(raw, "location")).alias("location_name"),
        parse_day("event_date").alias("event_date"),
        parse_instant(_optional(raw, "timestamp")).alias("publication_ts_utc"),
        _instant(ingested_at).alias("ingestion_ts_utc"),
        "event_type",
        "sub_event_type",
        slug("event_type").alias("event_type_slug"),
        slug("sub_event_type").alias("sub_event_type_slug"),
        blank_to_null("actor1").alias("actor1_name"),
        blank_to_null(_optional(raw, "assoc_actor_1")).alias("actor1_associated_actor_name"),
        blank_to_null("actor2").alias("actor2_name"),
        blank_to_null(_optional(raw, "assoc_actor_2")).alias("actor2_associated_actor_name"),
        to_number("fatalities").alias("fatalities"),
        blank_to_null("notes").alias("notes"),
        to_number("latitude").alias("latitude"),
        to_number("longitude").alias("longitude"),
        _optional(raw, "source").alias("source"),
    )
    return typed.where(F.col("country_iso3").isNotNull() & F.col("event_date").isNotNull())


def min_year(raw: DataFrame, year: int, column: str = "year") -> DataFrame:
    """Keep rows of ``year`` and later, before any other work."""
    return raw.where(to_number(column) >= year)


def violence_events(raw: DataFrame, dimension: DataFrame, ingested_at: str) -> DataFrame:
    """Organized-violence events: dates, class name, death estimates, first source date as publication time."""
    resolved = resolve_country(raw, "country", dimension)
    classes = F.create_map(*[F.lit(item) for pair in VIOLENCE_CLASSES.items() for item in pair])
    typed = resolved.select(
        F.lit("ucdp_ged").alias("source_name"),
        F.col("id").cast("string").alias("source_record_id"),
        "country_iso3",
        F.col("country").alias("country_name"),
        F.col("region").alias("region_name"),
        F.col("adm_1").alias("admin1_name"),
        F.col("adm_2").alias("admin2_name"),
        parse_day("date_start").alias("event_date_start"),
        parse_day("date_end").alias("event_date_end"),
        first_list_instant("source_date").alias("publication_ts_utc"),
        _instant(ingested_at).alias("ingestion_ts_utc"),
        F.element_at(classes, to_number("type_of_violence").cast("int")).alias("event_type"),
        to_whole("type_of_violence").alias("type_of_violence"),
        "conflict_dset_id",
        to_whole("conflict_new_id").alias("conflict_new_id"),
        "conflict_name",
        "side_a",
        "side_b",
        to_number("best").alias("best_fatalities"),
        to_number("high").alias("high_fatalities"),
        to_number("low").alias("low_fatalities"),
        to_number("latitude").alias("latitude"),
        to_number("longitude").alias("longitude"),
        to_number("where_prec").alias("location_precision"),
        to_whole("year").alias("year"),
    )
    return typed.where(F.col("country_iso3").isNotNull() & F.col("event_date_start").isNotNull())


def onsets(raw: DataFrame, dimension: DataFrame, onset_type: str, ingested_at: str) -> DataFrame:
    """Onset truth rows of one type: whole numbers with zero for missing, conflict ids as text."""
    ids_column = next((column for column in raw.columns if "conflict_ids" in column), "conflict_ids")
    resolved = resolve_country(raw, "name", dimension)
    counters = ["newconf", "onset1", "onset2", "onset3", "onset5", "onset10", "onset20"]
    typed = resolved.select(
        F.lit("ucdp_onset").alias("source_name"),
        F.lit(onset_type).alias("onset_type"),
        "country_iso3",
        F.col("name").cast("string").alias("country_name"),
        to_whole("year").alias("year"),
        *[F.coalesce(to_whole(column), F.lit(0).cast("long")).alias(column) for column in counters],
        blank_to_null(F.col(ids_column)).alias("conflict_ids"),
        to_whole("year_prev").alias("year_prev"),
        _instant(ingested_at).alias("ingestion_ts_utc"),
    )
    return typed.where(F.col("country_iso3").isNotNull() & F.col("year").isNotNull())


@dataclass(frozen=True)
class SeriesSpec:
    """Layout of an observation series: dated or annual, global or per country."""

    source_name: str
    measures: tuple[str, ...]
    per_country: bool = True
    annual: bool = False
    date_column: str = field(default="observation_date")


# Measures of the observation series, in table order.
SERIES = {
    "food": SeriesSpec("fao", ("food_price_index", "food_cereal_price_index"), per_country=False),
    "market": SeriesSpec(
        "imf",
        (
            "market_oil_price_usd_per_barrel",
            "market_gas_price_index",
            "market_fertilizer_price_index",
            "market_commodity_price_index",
        ),
        per_country=False,
    ),
    "climate": SeriesSpec(
        "noaa",
        ("climate_drought_severity_index", "climate_temperature_anomaly_c", "climate_precipitation_anomaly_pct"),
    ),
    "night_lights": SeriesSpec(
        "nasa_black_marble", ("climate_night_lights_anomaly_pct", "climate_night_lights_zscore")
    ),
    "trade": SeriesSpec(
        "un_comtrade",
        (
            "trade_exports_value_usd",
            "trade_imports_value_usd",
            "trade_exports_3m_change_pct",
            "trade_imports_3m_change_pct",
        ),
    ),
    "shipping": SeriesSpec("unctad", ("shipping_lsci_index", "shipping_port_connectivity_index")),
    "security": SeriesSpec(
        "sipri",
        (
            "security_military_expenditure_usd",
            "security_military_expenditure_pct_gdp",
            "security_arms_import_volume_index",
        ),
        annual=True,
    ),
}


def series(raw: DataFrame, spec: SeriesSpec, ingested_at: str, published_at: str | None = None) -> DataFrame:
    """Typed observation series. Publication time: as given, else the newest observation (annual: ingestion)."""
    keys: list[Column] = []
    if spec.per_country:
        keys += [upper_key("country_iso3").alias("country_iso3"), F.trim("country_name").alias("country_name")]
    if spec.annual:
        when = to_whole("year").alias("year")
        when_name, when_text = "year", F.col("year").cast("string")
    else:
        when = parse_day(spec.date_column).alias("observation_date")
        when_name, when_text = "observation_date", F.date_format("observation_date", "yyyy-MM-dd")
    typed = raw.select(*keys, when, *[to_number(measure).alias(measure) for measure in spec.measures])
    if published_at is not None:
        publication = _instant(published_at)
    elif spec.annual:
        publication = _instant(ingested_at)
    else:
        publication = typed.agg(F.max("observation_date").cast("timestamp")).scalar()
    record_id = F.concat_ws("-", F.col("country_iso3"), when_text) if spec.per_country else when_text
    kept = typed.where(F.col(when_name).isNotNull())
    if spec.per_country:
        kept = kept.where(F.col("country_iso3").isNotNull())
    return kept.select(
        F.lit(spec.source_name).alias("source_name"),
        record_id.alias("source_record_id"),
        *[column for column in ("country_iso3", "country_name") if spec.per_country],
        when_name,
        *spec.measures,
        publication.alias("publication_ts_utc"),
        _instant(ingested_at).alias("ingestion_ts_utc"),
    )


def governance(raw: DataFrame, ingested_at: str) -> DataFrame:
    """Annual governance components and their mean over the known ones."""
    typed = raw.select(
        upper_key("country_iso3").alias("country_iso3"),
        F.trim("country_name").alias("country_name"),
        to_whole("year").alias("year"),
        *[to_number(source).alias(target) for source, target in GOVERNANCE_COMPONENTS.items()],
        parse_instant(_optional(raw, "publication_ts_utc")).alias("publication_ts_utc"),
    ).where(F.col("country_iso3").isNotNull() & F.col("year").isNotNull())
    return typed.select(
        F.lit("wgi").alias("source_name"),
        F.concat_ws("-", "country_iso3", F.col("year").cast("string")).alias("source_record_id"),
        "country_iso3",
        "country_name",
        "year",
        *GOVERNANCE_COMPONENTS.values(),
        row_mean(*GOVERNANCE_COMPONENTS.values()).alias("governance_score"),
        "publication_ts_utc",
        _instant(ingested_at).alias("ingestion_ts_utc"),
    )


def elections(raw: DataFrame, ingested_at: str) -> DataFrame:
    """Election calendar with past and future dates."""
    typed = raw.select(
        upper_key("country_iso3").alias("country_iso3"),
        F.trim("country_name").alias("country_name"),
        parse_day("election_date").alias("election_date"),
        *[F.trim(_optional(raw, column)).alias(column) for column in ("election_type", "election_name", "status")],
        parse_instant(_optional(raw, "publication_ts_utc")).alias("publication_ts_utc"),
    ).where(F.col("country_iso3").isNotNull() & F.col("election_date").isNotNull())
    kind = F.coalesce(slug(F.coalesce("election_type", F.lit("unknown"))), F.lit(""))
    return typed.select(
        F.lit("idea").alias("source_name"),
        F.concat_ws("-", "country_iso3", F.date_format("election_date", "yyyy-MM-dd"), kind).alias("source_record_id"),
        "country_iso3",
        "country_name",
        "election_date",
        "election_type",
        "election_name",
        "status",
        "publication_ts_utc",
        _instant(ingested_at).alias("ingestion_ts_utc"),
    )


def displacement(raw: DataFrame) -> DataFrame:
    """Displaced people by country of origin and year; a missing or ``-`` origin is dropped."""
    return raw.where(F.col("coo_iso").isNotNull() & (F.col("coo_iso") != "-")).select(
        to_whole("year").alias("year"),
        F.col("coo_iso").alias("country_id"),
        F.col("coo_name").alias("country_name"),
        *[F.coalesce(to_number(column), F.lit(0.0)).alias(column) for column in HUMANITARIAN_COUNTS],
    )


def indicators(raw: DataFrame, ingested_at: str) -> DataFrame:
    """Annual indicator rows; only three-letter country codes are countries."""
    return raw.where(F.col("countryiso3code").rlike("^[A-Z]{3}$")).select(
        F.lit("world_bank_wdi").alias("source_name"),
        F.col("countryiso3code").alias("country_iso3"),
        F.col("country.value").alias("country_name"),
        F.col("indicator.id").alias("indicator_id"),
        F.col("indicator.value").alias("indicator_name"),
        to_whole("date").alias("year"),
        to_number("value").alias("value"),
        F.lit("annual").alias("frequency"),
        parse_instant(F.col("metadata.lastupdated")).alias("publication_ts_utc"),
        _instant(ingested_at).alias("ingestion_ts_utc"),
    )


def pivot_indicators(rows: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """One row per country and year with a column per indicator; years without any value are dropped.

    The indicator list is fixed, so the pivot is one aggregate pass that also carries the newest time stamps.
    """
    columns = columns or INDICATOR_COLUMNS
    keys = ["country_iso3", "country_name", "year"]
    wide = rows.where(F.col("country_name").isNotNull()).groupBy(*keys).agg(
        *[F.min(F.when(F.col("indicator_id") == code, F.col("value"))).alias(name) for code, name in columns.items()],
        F.max("publication_ts_utc").alias("publication_ts_utc"),
        F.max("ingestion_ts_utc").alias("ingestion_ts_utc"),
        F.count_if(F.col("value").isNotNull() & F.col("indicator_id").isin(list(columns))).alias("_measured"),
    )
    return wide.where(F.col("_measured") > 0).drop("_measured")


def flatten_indicators(raw: DataFrame, indicator_id: str) -> DataFrame:
    """Bronze form of indicator rows: nested labels as flat text columns."""
    return raw.select(
        *[column for column in raw.columns if column not in ("country", "indicator", "metadata")],
        F.lit(indicator_id).alias("requested_indicator_id"),
        F.col("country.id").alias("country_api_id"),
        F.col("country.value").alias("country_name"),
        F.col("indicator.id").alias("indicator_api_id"),
        F.col("indicator.value").alias("indicator_name"),
    )


def all_to_text(raw: DataFrame) -> DataFrame:
    """Bronze form with every column as text."""
    return raw.select(*[F.col(column).cast("string").alias(column) for column in raw.columns])
