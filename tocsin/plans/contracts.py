"""Serving contracts: key and required columns of each published table, checked before a table is handed on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tocsin.operators.quality import require_columns, require_unique


@dataclass(frozen=True)
class Contract:
    """One row per ``keys``; ``required`` columns must exist."""

    keys: tuple[str, ...]
    required: tuple[str, ...]


# Keys and required columns of the serving tables.
CONTRACTS = {
    "country_week_features": Contract(
        ("country_iso3", "week_start_date"),
        tuple("""
        country_iso3 week_start_date label_escalation_7d label_escalation_30d label_onset_30d label_onset_90d
        label_interstate_30d label_interstate_onset_30d label_interstate_onset_90d
        gdelt_event_count_7d gdelt_avg_goldstein_7d gdelt_avg_event_tone_7d gdelt_num_mentions_7d gdelt_num_articles_7d
        gdelt_document_count_7d gdelt_avg_document_tone_7d ucdp_history_event_count_52w ucdp_history_best_deaths_52w
        ucdp_history_state_based_events_52w macro_gdp_growth_annual_pct macro_cpi_yoy macro_population_total
        humanitarian_refugees humanitarian_asylum_seekers humanitarian_idps climate_drought_severity_index
        climate_temperature_anomaly_c climate_precipitation_anomaly_pct climate_night_lights_anomaly_pct
        climate_night_lights_zscore security_military_expenditure_usd security_military_expenditure_pct_gdp
        security_arms_import_volume_index trade_exports_value_usd trade_imports_value_usd trade_exports_3m_change_pct
        trade_imports_3m_change_pct shipping_lsci_index shipping_port_connectivity_index snapshot_ts_utc
        """.split()),
    ),
    "entity_day_features": Contract(
        ("entity_id", "feature_date"),
        ("entity_id", "entity_type", "country_iso3", "country_name", "feature_date", "source_week_start_date"),
    ),
    "entity_day_labels": Contract(
        ("entity_id", "label_date", "horizon_days"),
        (
            "entity_id", "country_iso3", "label_date", "horizon_days", "label_escalation_7d", "label_escalation_30d",
            "label_onset_30d", "label_onset_90d", "label_interstate_onset_30d", "label_interstate_onset_90d",
        ),
    ),
    "report_inputs": Contract(
        ("country_iso3", "report_date"),
        (
            "country_iso3", "country_name", "region_name", "report_date", "risk_level", "freshness_days", "summary",
            "chronology",
        ),
    ),
    "social_inputs": Contract(
        ("country_iso3", "publish_date"),
        (
            "country_iso3", "country_name", "publish_date", "score_delta", "summary_line", "top_drivers", "report_slug",
        ),
    ),
}


def checked(df: DataFrame, table: str, unique: bool = False) -> DataFrame:
    """The frame itself if it meets its contract; with ``unique`` a job also checks that the keys do not repeat."""
    contract = CONTRACTS[table]
    require_columns(df, contract.required, table)
    return require_unique(df, contract.keys, table) if unique else df
