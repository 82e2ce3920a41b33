"""Table sinks of the raw/bronze/silver/gold layers and of the published records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tocsin.operators.quality import Profile


def layer_path(root: str, layer: str, dataset: str, table: str) -> str:
    return f"{root.rstrip('/')}/{layer}/{dataset}/{table}"


def write_layer(
    df: DataFrame, root: str, layer: str, dataset: str, table: str, *, date_column: str | None = None,
    sort_by: list[str] | None = None, profile: Profile | None = None,
) -> str:
    """Write one table as Parquet and return its folder.

    With ``date_column`` the table is partitioned by year and the rows of a year are spread over tasks by the
    sort key, so that no single task writes a whole year. ``sort_by`` orders rows inside files for row-group
    pruning on the key. ``profile`` is filled by the tasks that write.
    """
    path = layer_path(root, layer, dataset, table)
    if date_column is not None:
        df = df.withColumn("part_year", F.year(date_column))
        df = df.repartitionByRange("part_year", *(sort_by or [date_column]))
    if sort_by:
        leading = ["part_year"] if date_column is not None else []
        df = df.sortWithinPartitions(*leading, *sort_by)
    if profile is not None:
        df = profile.observed(df)
    writer = df.write.mode("overwrite")
    if date_column is not None:
        writer = writer.partitionBy("part_year")
    writer.parquet(path)
    return path


def open_clustered(
    spark: SparkSession, name: str, path: str, schema: T.StructType, entity: str, day: str, buckets: int
) -> DataFrame:
    """A table in buckets of an entity, sorted by entity and day, known to the session by ``name``.

    The same path given again, in a later session too, opens what is there.
    """
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema.fields)
        spark.sql(
            f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY (`{entity}`) SORTED BY (`{entity}`, `{day}`) "
            f"INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def write_clustered(
    df: DataFrame, root: str, layer: str, dataset: str, table: str, *, entity: str, day: str, buckets: int = 64,
    profile: Profile | None = None,
) -> DataFrame:
    """Write one table in buckets of the entity, and return it opened.

    A window or aggregate per entity, or a join with a table in the same buckets, then reads it without a shuffle. Meant
    for tables with a row per entity and day: all rows of an entity are in one file.
    """
    spark = df.sparkSession
    path, name = layer_path(root, layer, dataset, table), f"{layer}_{dataset}_{table}_{uuid.uuid4().hex}"
    open_clustered(spark, name, path, df.schema, entity, day, buckets)
    rows = df.repartition(buckets, entity).sortWithinPartitions(entity, day)
    if profile is not None:
        rows = profile.observed(rows)
    rows.write.insertInto(name, overwrite=True)
    return spark.table(name)


def write_records(df: DataFrame, path: str, *, partition_by: str | None = None) -> str:
    """Write rows as JSON records, one folder per key if asked."""
    writer = df.write.mode("overwrite")
    if partition_by:
        df = df.withColumn("record_key", F.lower(F.col(partition_by)))
        writer = df.write.mode("overwrite").partitionBy("record_key")
    writer.json(path)
    return path
