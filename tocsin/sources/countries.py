"""Country names, codes and regions as a dimension table.

The dimension is an input with ``iso3``, ``name`` and, if known, ``iso2``, ``official_name``, ``common_name`` and
``region`` columns. It has one row per country.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tocsin.functions.text import blank_to_null, upper_key

# Source spellings and the dictionary name they stand for; None = no code.
NAME_OVERRIDES = {
    "Bolivia": "Bolivia, Plurinational State of",
    "Cape Verde": "Cabo Verde",
    "Congo-Kinshasa": "Congo, The Democratic Republic of the",
    "Congo-Brazzaville": "Congo",
    "Czech Republic": "Czechia",
    "Iran": "Iran, Islamic Republic of",
    "Kosovo": None,
    "Laos": "Lao People's Democratic Republic",
    "Moldova": "Moldova, Republic of",
    "North Korea": "Korea, Democratic People's Republic of",
    "Palestine": "Palestine, State of",
    "Russia": "Russian Federation",
    "South Korea": "Korea, Republic of",
    "Syria": "Syrian Arab Republic",
    "Taiwan": "Taiwan, Province of China",
    "Tanzania": "Tanzania, United Republic of",
    "Turkey": "Turkey",
    "Türkiye": "Turkey",
    "Venezuela": "Venezuela, Bolivarian Republic of",
}

# Display names that win over the dictionary.
DISPLAY_NAMES = {
    "IRN": "Iran",
    "PRK": "North Korea",
    "KOR": "South Korea",
    "RUS": "Russia",
    "SYR": "Syria",
    "TUR": "Turkey",
    "TWN": "Taiwan",
    "VEN": "Venezuela",
}

# Regions known without a source.
REGIONS = {
    "AFG": "Asia",
    "ALB": "Europe",
    "AND": "Europe",
    "AGO": "Africa",
    "AIA": "Americas",
    "ARG": "Americas",
    "ARM": "Asia",
    "COL": "Americas",
    "DZA": "Africa",
    "EGY": "Africa",
    "IRN": "Asia",
    "ISR": "Asia",
    "SDN": "Africa",
    "SYR": "Asia",
    "TUR": "Asia",
    "UKR": "Europe",
}


def literal_lookup(table: dict[str, str | None], key: Column) -> Column:
    """Lookup in a small fixed table."""
    pairs = [F.lit(item) for pair in table.items() if pair[1] is not None for item in pair]
    return F.element_at(F.create_map(*pairs), key)


def lookup_key(name: Column | str) -> Column:
    """Spelling to the lower-cased alias under which the dimension knows it."""
    name = blank_to_null(name)
    dropped = [spelling for spelling, target in NAME_OVERRIDES.items() if target is None]
    return F.lower(F.when(~name.isin(dropped), F.coalesce(literal_lookup(NAME_OVERRIDES, name), name)))


def alias_table(dimension: DataFrame) -> DataFrame:
    """(alias, iso3): every known spelling of each country, one row per alias."""
    spellings = [
        column for column in ("iso3", "iso2", "name", "official_name", "common_name") if column in dimension.columns
    ]
    exploded = dimension.select(
        upper_key("iso3").alias("iso3"), F.explode(F.array(*[F.col(column) for column in spellings])).alias("alias")
    )
    return (
        exploded.where(blank_to_null("alias").isNotNull())
        .groupBy(F.lower(F.trim("alias")).alias("alias"))
        .agg(F.min("iso3").alias("iso3"))
    )


def resolve_country(df: DataFrame, name_column: str, dimension: DataFrame, out: str = "country_iso3") -> DataFrame:
    """Add the code of a country name; null if unknown.

    The alias side carries no hint: the planner broadcasts it when its size allows and shuffles otherwise.
    """
    aliases = alias_table(dimension).select(F.col("alias").alias("_alias"), F.col("iso3").alias(out))
    return df.withColumn("_alias", lookup_key(name_column)).join(aliases, "_alias", "left").drop("_alias")


def is_country_code(code: Column | str) -> Column:
    """Three capital letters."""
    code = F.col(code) if isinstance(code, str) else code
    return code.rlike("^[A-Z]{3}$")


def metadata_projection(
    df: DataFrame, iso3: str = "country_iso3", name: str = "country_name", region: str | None = None
) -> DataFrame:
    """(country_iso3, country_name, region_name) of a source; columns it lacks are null."""

    def optional(column: str | None) -> Column:
        return F.col(column).cast("string") if column and column in df.columns else F.lit(None).cast("string")

    return df.where(F.col(iso3).isNotNull()).select(
        F.col(iso3).cast("string").alias("country_iso3"),
        optional(name).alias("country_name"),
        optional(region).alias("region_name"),
    )


def join_metadata(keys: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Fill missing names and regions of the key rows from fixed values and a dictionary table."""
    joined = keys
    fallback_name = F.lit(None).cast("string")
    if dictionary is not None:
        name = F.coalesce(F.col("common_name"), F.col("name")) if "common_name" in dictionary.columns else F.col("name")
        names = dictionary.groupBy(upper_key("iso3").alias("country_iso3")).agg(F.min(name).alias("_dictionary_name"))
        joined = keys.join(names, "country_iso3", "left")
        fallback_name = F.col("_dictionary_name")
    iso3 = F.col("country_iso3")
    return joined.select(
        "country_iso3",
        F.coalesce("country_name", literal_lookup(DISPLAY_NAMES, iso3), fallback_name).alias("country_name"),
        F.coalesce("region_name", literal_lookup(REGIONS, iso3)).alias("region_name"),
    )


def country_dimension(
    sources: list[DataFrame], dictionary: DataFrame | None = None, code_only: list[DataFrame] | None = None
) -> DataFrame:
    """Distinct valid codes over all sources; per code the first non-blank name and region in source order.

    ``sources`` have the :func:`metadata_projection` columns and ``code_only`` only ``country_iso3``. Each source
    first shrinks to one row per code (partial aggregates on the map side), then the short lists are united.
    """
    parts = []
    for order, source in enumerate(sources):
        parts.append(
            source.groupBy(upper_key("country_iso3").alias("country_iso3")).agg(
                F.min(blank_to_null("country_name")).alias("country_name"),
                F.min(blank_to_null("region_name")).alias("region_name"),
            ).withColumn("source_order", F.lit(order))
        )
    for source in code_only or []:
        parts.append(
            source.select(upper_key("country_iso3").alias("country_iso3")).distinct().select(
                "country_iso3", F.lit(None).cast("string").alias("country_name"),
                F.lit(None).cast("string").alias("region_name"), F.lit(len(parts)).alias("source_order"),
            )
        )
    return merged_dimension(reduce(DataFrame.unionByName, parts), dictionary)


def merged_dimension(named: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """One row per valid code of rows (country_iso3, country_name, region_name, source_order): the known name and region
    of the lowest order."""

    def first_known(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("source_order"))).alias(column)

    valid = named.where(is_country_code("country_iso3"))
    keys = valid.groupBy("country_iso3").agg(first_known("country_name"), first_known("region_name"))
    return join_metadata(keys, dictionary)
