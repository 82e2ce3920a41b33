"""Dating of yearly onset truth by the first matching event."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tocsin.functions.text import ints_in_text, to_number


def stack_onsets(frames: dict[str, DataFrame]) -> DataFrame:
    """Onset rows of all types under one another, with the type in ``onset_type``."""
    columns = ["country_iso3", "country_name", "year", "onset1", "onset20", "conflict_ids"]
    parts = [frame.select(*columns, F.lit(kind).alias("onset_type")) for kind, frame in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def localize_onsets(events: DataFrame, onset_rows: DataFrame) -> DataFrame:
    """Date each onset row by the earliest event of its country and year.

    Events of the conflicts named in the row win over the others; a row without any event is dropped. Events
    shrink to one row per country, year and conflict before they meet the onset rows, and the conflict ids are
    matched by an equi-join on the exploded list.
    """
    keys = ["country_iso3", "year"]
    year = F.col("year").cast("long") if "year" in events.columns else F.year("event_date_start").cast("long")
    by_conflict = (
        events.where(F.col("event_date_start").isNotNull() & F.col("country_iso3").isNotNull())
        .select("country_iso3", year.alias("year"), F.col("conflict_new_id").cast("long").alias("_conflict"),
                F.col("event_date_start").cast("date").alias("_day"))
        .groupBy(*keys, "_conflict")
        .agg(F.min("_day").alias("_day"))
    )
    by_year = by_conflict.groupBy(*keys).agg(F.min("_day").alias("_any_day"))
    rows = onset_rows.where(
        F.col("country_iso3").isNotNull()
        & F.col("year").isNotNull()
        & (F.coalesce(to_number("onset1"), F.lit(0.0)) > 0)
    ).withColumn("year", F.col("year").cast("long"))
    named = (
        rows.select(*keys, "conflict_ids").where(F.col("conflict_ids").isNotNull()).distinct()
        .withColumn("_conflict", F.explode(ints_in_text("conflict_ids")))
        .join(by_conflict, [*keys, "_conflict"])
        .groupBy(*keys, "conflict_ids")
        .agg(F.min("_day").alias("_named_day"))
    )
    dated = rows.join(by_year, keys).join(named, [*keys, "conflict_ids"], "left")
    return dated.select(
        "country_iso3",
        "country_name",
        "onset_type",
        F.col("year").alias("onset_year"),
        F.coalesce("_named_day", "_any_day").alias("onset_date"),
        F.coalesce(to_number("onset20").cast("long"), F.lit(0).cast("long")).alias("onset20"),
        "conflict_ids",
        F.when(F.col("_named_day").isNotNull(), "conflict_id_match")
        .otherwise("country_year_fallback")
        .alias("localization_method"),
    )


def truth_cutoff(frames: Sequence[DataFrame], snapshot_day: Column) -> Column:
    """Last day the onset truth covers: Dec 31 of its newest year, at most the snapshot day; null without rows."""
    newest = reduce(DataFrame.unionByName, [frame.select(F.col("year").cast("int").alias("year")) for frame in frames])
    last_day = newest.agg(F.make_date(F.max("year"), F.lit(12), F.lit(31)).alias("day")).scalar()
    return F.when(last_day.isNotNull(), F.least(last_day, snapshot_day))
