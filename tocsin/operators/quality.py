"""Data-quality checks as jobs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Contract columns that the frame lacks. Schema only, no job."""
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Sequence[str], what: str) -> DataFrame:
    """The frame itself, or an error that names the missing contract columns."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{what}: missing columns {', '.join(missing)}")
    return df


def table_profile(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Row count, number of columns and nulls per key column in one aggregate."""
    present = [key for key in keys if key in df.columns]
    nulls = [F.concat(F.lit(f"{key}="), F.count_if(F.col(key).isNull()).cast("string")) for key in present]
    return df.agg(F.count("*").alias("row_count"), F.concat_ws(";", *nulls).alias("null_counts")).select(
        F.lit(table).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("long").alias("column_count"),
        "null_counts",
    )


PROFILE = "table_name string, row_count long, column_count long, null_counts string"


class Profile:
    """The profile of a table that is counted while the table is written, without a scan of its own.

    The counts stand right before the write, so a task that runs again is counted once.
    """

    def __init__(self, table: str, keys: Sequence[str]):
        self.table, self.keys = table, list(keys)
        self.observation = Observation(f"profile_{table}_{uuid.uuid4().hex}")
        self.columns = 0

    def observed(self, df: DataFrame) -> DataFrame:
        self.keys = [key for key in self.keys if key in df.columns]
        self.columns = len(df.columns)
        nulls = [F.count_if(F.col(key).isNull()).alias(f"null_{key}") for key in self.keys]
        return df.observe(self.observation, F.count(F.lit(1)).alias("row_count"), *nulls)

    def row(self) -> tuple[str, int, int, str]:
        """Known once the table is written."""
        counts = self.observation.get
        nulls = ";".join(f"{key}={counts[f'null_{key}']}" for key in self.keys)
        return self.table, counts["row_count"], self.columns, nulls


def profile_report(spark: SparkSession, profiles: Sequence[Profile]) -> DataFrame:
    """One row per written table, in the form of ``table_profile``."""
    return spark.createDataFrame([profile.row() for profile in profiles], PROFILE)


def profile_tables(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Profiles of several tables as one frame."""
    return reduce(
        DataFrame.unionByName, [table_profile(frame, name, keys) for name, (frame, keys) in tables.items()]
    )


def invalid_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many rows lack any of the columns (NaN counts as missing)."""
    types = dict(df.dtypes)

    def lacks(column: str):
        value = F.col(column)
        return value.isNull() | F.isnan(value) if types[column] in ("double", "float") else value.isNull()

    bad = reduce(lambda left, right: left | right, [lacks(column) for column in columns])
    return df.agg(F.count("*").alias("row_count"), F.count_if(bad).alias("invalid_count"))


def invalid_row_count(df: DataFrame, columns: Sequence[str]) -> int:
    return int(invalid_rows(df, columns).first()["invalid_count"])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where(F.col("row_count") > 1)


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The frame itself, or an error when a key repeats."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"{what}: rows are not unique by {', '.join(keys)}")
    return df


def dense_panel_check(panel: DataFrame, entity: str, week: str) -> DataFrame:
    """Per entity: weeks, distinct weeks, weeks in the span of the whole panel, and whether they agree."""
    span = panel.agg((F.datediff(F.max(week), F.min(week)) / 7 + 1).cast("long").alias("span")).scalar()
    counted = panel.groupBy(entity).agg(
        F.count("*").alias("row_count"), F.count_distinct(week).alias("week_count"),
        F.min(week).alias("first_week"), F.max(week).alias("last_week"),
    )
    return counted.withColumn("span_weeks", span).withColumn(
        "is_dense",
        ((F.col("row_count") == F.col("span_weeks")) & (F.col("week_count") == F.col("span_weeks"))).cast("int"),
    )
