"""Text to value conversions. Nothing here fails on bad input: it yields null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tocsin.functions.calendar import parse_instant


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(text: Column | str) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(F.trim(_c(text).cast("string")), F.lit(""))


def upper_key(text: Column | str) -> Column:
    """Upper-cased, trimmed key."""
    return F.trim(F.upper(_c(text).cast("string")))


def to_number(text: Column | str) -> Column:
    """Double, or null for text that is no number (including NaN)."""
    number = _c(text).try_cast("double")
    return F.when(~F.isnan(number), number)


def to_whole(text: Column | str) -> Column:
    """Long, or null for text that is no number."""
    return to_number(text).try_cast("long")


def slug(text: Column | str) -> Column:
    """Lower case, runs of other characters become one underscore, empty becomes null."""
    lowered = F.lower(F.trim(_c(text).cast("string")))
    return F.nullif(F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), F.lit("_")), F.lit(""))


def first_present(*columns: Column | str) -> Column:
    """First value that is neither null nor blank, kept as it is."""
    values = [_c(column).cast("string") for column in columns]
    return F.coalesce(*[F.when(F.length(F.trim(value)) > 0, value) for value in values])


def first_list_instant(text: Column | str, separator: str = ";") -> Column:
    """Timestamp from the first item of a delimited list."""
    first = F.get(F.split(_c(text).cast("string"), separator), F.lit(0))
    return parse_instant(blank_to_null(first))


def last_segment(text: Column | str, separator: str = ",") -> Column:
    """Last non-blank segment of a delimited text, trimmed."""
    kept = F.rtrim(_c(text).cast("string"), F.lit(separator + " \t\r\n"))
    return F.nullif(F.trim(F.substring_index(kept, separator, -1)), F.lit(""))


def parse_locations(text: Column | str) -> Column:
    """``type#name#country#adm1#...;...`` to an array of structs; entries with under 4 fields are dropped."""
    entries = F.transform(F.split(_c(text).cast("string"), ";"), lambda entry: F.split(entry, "#"))
    entries = F.filter(entries, lambda fields: F.size(fields) >= 4)
    empty = F.lit("")
    return F.coalesce(
        F.transform(
            entries,
            lambda fields: F.struct(
                F.get(fields, F.lit(0)).alias("geo_type"),
                F.nullif(F.get(fields, F.lit(1)), empty).alias("location_name"),
                F.nullif(F.get(fields, F.lit(2)), empty).alias("country_code"),
                F.nullif(F.get(fields, F.lit(3)), empty).alias("adm1_code"),
            ),
        ),
        F.array().cast("array<struct<geo_type:string,location_name:string,country_code:string,adm1_code:string>>"),
    )


def leading_number(text: Column | str, separator: str = ",") -> Column:
    """First field of a delimited text as a double (the tone of a document)."""
    return to_number(F.get(F.split(_c(text).cast("string"), separator), F.lit(0)))


def ints_in_text(text: Column | str) -> Column:
    """Distinct integers that occur in the text, in order of appearance."""
    found = F.regexp_extract_all(_c(text).cast("string"), F.lit(r"(\d+)"))
    numbers = F.array_distinct(F.array_compact(F.transform(found, lambda token: token.try_cast("long"))))
    return F.coalesce(numbers, F.array().cast("array<bigint>"))


def distinct_in_order(items: Column | str) -> Column:
    """Array without nulls and repeats, first occurrence kept."""
    return F.array_distinct(F.array_compact(_c(items)))


def row_mean(*columns: Column | str) -> Column:
    """Mean over the non-null columns of one row; null when all are null."""
    values = [_c(column).cast("double") for column in columns]
    total = sum((F.coalesce(value, F.lit(0.0)) for value in values), F.lit(0.0))
    known = sum((value.isNotNull().cast("int") for value in values), F.lit(0))
    return F.when(known > 0, total / known)
