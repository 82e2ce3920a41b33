"""File scans. Each is a lazy read with a fixed schema; columns nobody selects are never parsed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tocsin.sources import schemas


def _by_header(
    spark: SparkSession, path: str | list[str], columns: Sequence[str], optional: Sequence[str], quoted: bool
) -> DataFrame:
    """Text columns by name. The header is read once; a file with another header than the first stops the job."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=quoted, enforceSchema=False, inferSchema=False)
    at = {name.strip().lstrip("\ufeff").lower(): name for name in raw.columns}
    missing = [name for name in columns if name.lower() not in at and name not in optional]
    if missing:
        raise ValueError(f"The file has no column {', '.join(missing)}.")
    return raw.select(
        *[
            F.col(f"`{at[name.lower()]}`").alias(name) if name.lower() in at else F.lit(None).cast("string").alias(name)
            for name in columns
        ]
    )


def read_csv(
    spark: SparkSession, path: str | list[str], columns: Sequence[str], optional: Sequence[str] = ()
) -> DataFrame:
    """Headed CSV snapshot read as text columns by name, in any order. Columns named in ``optional`` may be absent
    and are null then."""
    return _by_header(spark, path, columns, optional, quoted=False)


def read_quoted_csv(
    spark: SparkSession, path: str | list[str], columns: Sequence[str], optional: Sequence[str] = ()
) -> DataFrame:
    """As :func:`read_csv` for files whose quoted fields may hold line breaks.

    Such files cannot be split, so land them as many files of moderate size.
    """
    return _by_header(spark, path, columns, optional, quoted=True)


def _tab_separated(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=False, quote="", emptyValue=None)


def read_news_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header-less news-event export, 61 text columns."""
    return _tab_separated(spark, path, schemas.NEWS_EVENTS)


def read_news_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header-less news-document export, 27 text columns."""
    return _tab_separated(spark, path, schemas.NEWS_DOCUMENTS)


def read_conflict_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Conflict-event CSV snapshot."""
    return read_csv(spark, path, schemas.CONFLICT_EVENT_COLUMNS)


def read_onsets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Onset truth CSV; its conflict-id column varies by file, position does not."""
    return spark.read.schema(schemas.ONSETS).csv(path, header=True, escape='"', enforceSchema=True)


def read_json_items(
    spark: SparkSession, path: str | list[str], schema: T.StructType = schemas.HUMANITARIAN_PAGE
) -> DataFrame:
    """JSON documents with an ``items`` list, one row per item. One document per file, which is not split: many files
    of moderate size."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("items"))


def read_json_pair(
    spark: SparkSession,
    path: str | list[str],
    metadata: T.StructType = schemas.INDICATOR_METADATA,
    row: T.StructType = schemas.INDICATOR_ROW,
) -> DataFrame:
    """JSON documents ``[metadata, rows]``: the rows, with the metadata struct beside each.

    A document of another shape stops the job. A file is not split: many files of moderate size.
    """
    document = spark.read.text(path, wholetext=True).select("value")
    parts = document.withColumn("parts", F.from_json("value", "array<string>"))
    checked = parts.select(
        F.when(F.size("parts") == 2, F.col("parts"))
        .otherwise(F.raise_error(F.lit("Expected a JSON list of metadata and rows.")).cast("array<string>"))
        .alias("parts")
    )
    typed = checked.select(
        F.from_json(F.col("parts")[0], metadata).alias("metadata"),
        F.from_json(F.col("parts")[1], T.ArrayType(row)).alias("rows"),
    )
    return typed.select("metadata", F.inline("rows"))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Feature or prediction table: CSV by suffix (a schema is then required), otherwise Parquet."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        if schema is None:
            raise ValueError("A CSV table needs a schema.")
        return spark.read.schema(schema).csv(path, header=True)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def read_with_fallback(preferred: DataFrame | None, baseline: DataFrame | None, required: list[str]) -> DataFrame:
    """Preferred predictions if they are usable, else the baseline; ``baseline_used`` says which.

    Usable: all required columns are there and no row lacks its date or probability. The row check is one
    aggregate over two columns.
    """
    from tocsin.operators.quality import invalid_row_count, missing_columns

    problems: list[str] = []
    for name, frame in (("preferred", preferred), ("baseline", baseline)):
        if frame is None:
            problems.append(f"{name}: not given")
            continue
        missing = missing_columns(frame, required)
        if missing:
            problems.append(f"{name}: missing {', '.join(missing)}")
            continue
        invalid = invalid_row_count(frame, ["forecast_date", "calibrated_probability"])
        if invalid:
            problems.append(f"{name}: {invalid} invalid row(s)")
            continue
        return frame.withColumn("baseline_used", F.lit(name == "baseline"))
    raise ValueError("No usable prediction table: " + "; ".join(problems))
