"""Windows over the rows of one entity, in date order.

They run on panel-sized tables only: one row per entity and date, so that a partition is as long as the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def ordered(entity: str | Sequence[str], date: str) -> WindowSpec:
    keys = [entity] if isinstance(entity, str) else list(entity)
    return Window.partitionBy(*keys).orderBy(date)


def lookback_sum(value: Column, rows: int, spec: WindowSpec) -> Column:
    """Sum over the previous ``rows`` rows, the current one not included; 0 if there are none."""
    if rows <= 0:
        return F.lit(0.0)
    return F.coalesce(F.sum(value).over(spec.rowsBetween(-rows, -1)), F.lit(0.0))


def future_rows(horizon: int, spec: WindowSpec) -> Column:
    """Number of rows that follow, up to the horizon."""
    return F.count(F.lit(1)).over(spec.rowsBetween(1, horizon))


def future_sum(value: Column, horizon: int, spec: WindowSpec) -> Column:
    """Sum over the next ``horizon`` rows; null when fewer follow."""
    total = F.sum(value).over(spec.rowsBetween(1, horizon))
    return F.when(future_rows(horizon, spec) == horizon, total)


def next_positive_date(value: Column, date: str, horizon: int, spec: WindowSpec) -> Column:
    """First date with a positive value in the next ``horizon`` rows; null when fewer follow."""
    first = F.min(F.when(value > 0, F.col(date))).over(spec.rowsBetween(1, horizon))
    return F.when(future_rows(horizon, spec) == horizon, first)


def lagged(value: Column, rows: int, spec: WindowSpec) -> Column:
    """Value ``rows`` rows earlier, 0 before the start."""
    return F.coalesce(F.lag(value, rows).over(spec), F.lit(0.0))


def rolling_mean(value: Column, rows: int, spec: WindowSpec, min_rows: int = 1) -> Column:
    """Mean over the previous ``rows`` rows, 0 with fewer than ``min_rows`` known values."""
    frame = spec.rowsBetween(-rows, -1)
    return F.coalesce(F.when(F.count(value).over(frame) >= min_rows, F.avg(value).over(frame)), F.lit(0.0))


def rolling_std(value: Column, rows: int, spec: WindowSpec, min_rows: int = 2) -> Column:
    """Sample deviation over the previous ``rows`` rows, 0 with fewer than ``min_rows`` known values."""
    frame = spec.rowsBetween(-rows, -1)
    return F.coalesce(F.when(F.count(value).over(frame) >= min_rows, F.stddev_samp(value).over(frame)), F.lit(0.0))


def deviation_from_mean(value: Column, rows: int, spec: WindowSpec, min_rows: int = 5) -> Column:
    """Value minus the mean of the previous ``rows`` rows, 0 while that mean is unknown."""
    frame = spec.rowsBetween(-rows, -1)
    return F.coalesce(F.when(F.count(value).over(frame) >= min_rows, value - F.avg(value).over(frame)), F.lit(0.0))


def newest_rows(df: DataFrame, entity: str, date: str, count: int = 1, tie_break: Sequence[str] = ()) -> DataFrame:
    """The newest ``count`` rows per entity with their position in ``_recency`` (1 = newest).

    The filter on the row number lets Spark keep only ``count`` rows per entity and task before the shuffle.
    """
    order = [F.col(date).desc(), *[F.col(column).desc() for column in tie_break]]
    return df.withColumn("_recency", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).where(
        F.col("_recency") <= count
    )


def latest_per_key(df: DataFrame, entity: str, date: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """Newest row per entity."""
    return newest_rows(df, entity, date, 1, tie_break).drop("_recency")


def latest_and_previous(df: DataFrame, entity: str, date: str, columns: Sequence[str]) -> DataFrame:
    """Newest row per entity with ``previous_<column>`` of the row before it and ``row_total`` (1 or 2)."""
    recent = newest_rows(df, entity, date, 2)
    newest, before = F.col("_recency") == 1, F.col("_recency") == 2
    row = F.struct(*[column for column in df.columns if column != entity])
    paired = recent.groupBy(entity).agg(
        F.max_by(row, F.when(newest, 1)).alias("_row"),
        *[F.max(F.when(before, F.col(column))).alias(f"previous_{column}") for column in columns],
        F.count("*").alias("row_total"),
    )
    return paired.select(entity, "_row.*", *[f"previous_{column}" for column in columns], "row_total")


def episodes(df: DataFrame, flag: Column, entity: str, date: str, gap_days: int, name: str) -> DataFrame:
    """Group flagged rows into episodes: a new one starts more than ``gap_days`` after the last flagged row.

    Adds ``is_new_<name>`` (0/1) and ``<name>_episode_id`` such as ``E-alert-001`` (null on other rows).
    """
    spec = ordered(entity, date)
    previous = F.last(F.when(F.col("_flag"), F.col(date)), ignorenulls=True).over(
        spec.rowsBetween(Window.unboundedPreceding, -1)
    )
    started = F.col("_flag") & (previous.isNull() | (F.datediff(F.col(date), previous) > gap_days))
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_new", started.cast("int"))
    number = F.sum("_new").over(spec.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.select(
        *df.columns,
        F.col("_new").alias(f"is_new_{name}"),
        F.when(F.col("_flag"), F.format_string(f"%s-{name}-%03d", F.col(entity), number)).alias(f"{name}_episode_id"),
    )
