"""The typed and serving layers as written tables, each profiled by the job that writes it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tocsin.operators.quality import Profile, profile_report
from tocsin.plans import serving
from tocsin.plans.panel import PanelSources
from tocsin.sources.sinks import write_layer

# Tables of the layers and the key columns whose nulls are counted.
SILVER = {
    "silver_gdelt_events": ("news_events", ("country_id", "event_date")),
    "silver_gdelt_gkg_documents": ("news_documents", ("document_country_id", "document_date")),
    "silver_acled_events": ("conflict_events", ("country_iso3", "event_date", "source_record_id")),
    "silver_imf_commodity_series": ("market", ("observation_date",)),
    "silver_fao_food_price_series": ("food", ("observation_date",)),
    "silver_wgi_country_year_snapshot": ("governance", ("country_iso3", "year")),
    "silver_idea_elections": ("elections", ("country_iso3", "election_date", "source_record_id")),
    "silver_noaa_climate_series": ("climate", ("country_iso3", "observation_date")),
    "silver_sipri_security_series": ("security", ("country_iso3", "year")),
    "silver_nasa_black_marble_night_lights": ("night_lights", ("country_iso3", "observation_date")),
    "silver_un_comtrade_trade_series": ("trade", ("country_iso3", "observation_date")),
    "silver_unctad_shipping_series": ("shipping", ("country_iso3", "observation_date")),
    "silver_unhcr_origin_population": ("displacement", ("country_id", "year")),
    "silver_ucdp_events": ("violence_events", ("country_iso3", "event_date_start")),
    "silver_ucdp_interstate_onset": ("interstate_onsets", ("country_iso3", "year")),
    "silver_ucdp_intrastate_onset": ("intrastate_onsets", ("country_iso3", "year")),
    "silver_wdi_indicator_series": ("macro", ("country_iso3", "indicator_id", "year")),
}
GOLD = {
    "gold_country_week_features": ("country_iso3", "week_start_date"),
    "gold_entity_day_features": ("entity_id", "feature_date"),
    "gold_entity_day_labels": ("entity_id", "label_date", "horizon_days"),
    "gold_report_inputs": ("report_id", "country_iso3", "report_date"),
    "gold_social_inputs": ("post_id", "platform_name", "country_iso3", "publish_date"),
}


@dataclass(frozen=True)
class Layers:
    """The written tables, read back, and one profile row for each."""

    tables: dict[str, DataFrame]
    report: DataFrame


def write_layers(
    spark: SparkSession, root: str, sources: PanelSources, panel: Callable[[PanelSources], DataFrame]
) -> Layers:
    """Write all typed tables, the panel that ``panel`` builds from them, and the serving tables built from the panel.

    Every later table starts from the written ones, so nothing is computed twice, and the profiles cost no scan: the
    tasks that write a table count its rows and nulls.
    """
    tables: dict[str, DataFrame] = {}
    profiles: list[Profile] = []

    def written(name: str, df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        layer, dataset = name.split("_", 1)
        profile = Profile(name, keys)
        path = write_layer(df, root, layer, dataset, "table", profile=profile)
        profiles.append(profile)
        tables[name] = spark.read.schema(df.schema).parquet(path)
        return tables[name]

    given = sources.filled(spark)
    typed = {source: written(name, getattr(given, source), keys) for name, (source, keys) in SILVER.items()}
    gold = written("gold_country_week_features", panel(PanelSources(**typed)), GOLD["gold_country_week_features"])
    for name, build in (
        ("gold_entity_day_features", serving.entity_day_features),
        ("gold_entity_day_labels", serving.entity_day_labels),
        ("gold_report_inputs", serving.report_inputs),
        ("gold_social_inputs", serving.social_inputs),
    ):
        written(name, build(gold), GOLD[name])
    return Layers(tables, profile_report(spark, profiles))
