"""Raw file layouts. Explicit schemas everywhere: no inference pass over the data."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the header-less news-event export, in file order.
NEWS_EVENT_COLUMNS = """
global_event_id sql_date month_year year fraction_date
actor1_code actor1_name actor1_country_code actor1_known_group_code actor1_ethnic_code
actor1_religion1_code actor1_religion2_code actor1_type1_code actor1_type2_code actor1_type3_code
actor2_code actor2_name actor2_country_code actor2_known_group_code actor2_ethnic_code
actor2_religion1_code actor2_religion2_code actor2_type1_code actor2_type2_code actor2_type3_code
is_root_event event_code event_base_code event_root_code quad_class
goldstein_scale num_mentions num_sources num_articles avg_tone
actor1_geo_type actor1_geo_full_name actor1_geo_country_code actor1_geo_adm1_code actor1_geo_adm2_code
actor1_geo_lat actor1_geo_long actor1_geo_feature_id
actor2_geo_type actor2_geo_full_name actor2_geo_country_code actor2_geo_adm1_code actor2_geo_adm2_code
actor2_geo_lat actor2_geo_long actor2_geo_feature_id
action_geo_type action_geo_full_name action_geo_country_code action_geo_adm1_code action_geo_adm2_code
action_geo_lat action_geo_long action_geo_feature_id
date_added source_url
""".split()

# Column names of the header-less news-document export, in file order.
NEWS_DOCUMENT_COLUMNS = """
gkg_record_id date source_collection_identifier source_common_name document_identifier
counts v2_counts themes v2_themes locations v2_locations persons v2_persons
organizations v2_organizations v2_tone dates gcam sharing_image related_images
social_image_embeds social_video_embeds quotations all_names amounts translation_info extras
""".split()

# Header names of the CSV snapshots, in file order.
CONFLICT_EVENT_COLUMNS = """
data_id event_id_cnty event_id_no_cnty event_date event_type sub_event_type actor1 assoc_actor_1
actor2 assoc_actor_2 country admin1 admin2 location latitude longitude fatalities notes source timestamp
""".split()
ONSET_COLUMNS = """
name year newconf onset1 onset2 onset3 onset5 onset10 onset20 conflict_ids year_prev
""".split()

HUMANITARIAN_COUNTS = """
refugees asylum_seekers returned_refugees idps returned_idps stateless ooc hst
""".split()

# Governance component names in the file and in the typed table.
GOVERNANCE_COMPONENTS = {
    "voice_and_accountability": "governance_voice_and_accountability",
    "political_stability_and_absence_of_violence": "governance_political_stability",
    "government_effectiveness": "governance_government_effectiveness",
    "regulatory_quality": "governance_regulatory_quality",
    "rule_of_law": "governance_rule_of_law",
    "control_of_corruption": "governance_control_of_corruption",
}

# Annual indicator codes and their panel columns.
INDICATOR_COLUMNS = {
    "NY.GDP.MKTP.KD.ZG": "macro_gdp_growth_annual_pct",
    "FP.CPI.TOTL.ZG": "macro_cpi_yoy",
    "SP.POP.TOTL": "macro_population_total",
}


def all_text(names: list[str]) -> T.StructType:
    """Every column as a nullable string: typing happens in the normalizers, where bad values become null."""
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


NEWS_EVENTS = all_text(NEWS_EVENT_COLUMNS)
NEWS_DOCUMENTS = all_text(NEWS_DOCUMENT_COLUMNS)
CONFLICT_EVENTS = all_text(CONFLICT_EVENT_COLUMNS)
ONSETS = all_text(ONSET_COLUMNS)

HUMANITARIAN_ITEM = all_text(["year", "coo_id", "coo_name", "coo_iso", *HUMANITARIAN_COUNTS])
HUMANITARIAN_PAGE = T.StructType([T.StructField("items", T.ArrayType(HUMANITARIAN_ITEM))])

CODED_LABEL = all_text(["id", "value"])
INDICATOR_METADATA = all_text(["page", "pages", "per_page", "total", "sourceid", "lastupdated"])
INDICATOR_ROW = T.StructType(
    [
        T.StructField("indicator", CODED_LABEL),
        T.StructField("country", CODED_LABEL),
        *all_text(["countryiso3code", "date", "value", "unit", "obs_status", "decimal"]).fields,
    ]
)
