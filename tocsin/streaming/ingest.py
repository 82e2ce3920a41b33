"""Incremental event ingest from a drop folder and daily counts per entity."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tocsin.session import scratch_dir


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, *, file_format: str = "parquet", glob: str | None = None,
    max_files: int = 24,
) -> DataFrame:
    """Stream of the files that appear in a folder, at most ``max_files`` per batch."""
    reader = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder)


def daily_counts(events: DataFrame, entity: str, ts: str, lateness: str | None, **aggregates: Column) -> DataFrame:
    """Count and further aggregates per entity and day.

    Without ``lateness`` the state keeps every entity and day, and a row of any age reaches its day. With it, rows
    later than that are dropped with their state, which bounds the state instead.
    """
    return (
        (events.withWatermark(ts, lateness) if lateness else events)
        .groupBy(F.col(entity), F.window(ts, "1 day").alias("_window"))
        .agg(F.count("*").alias("event_count"), *[column.alias(name) for name, column in aggregates.items()])
        .select(
            entity, F.to_date("_window.start").alias("event_date"), "event_count", *aggregates
        )
    )


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return system.exists(found)


def _delete(spark: SparkSession, path: str) -> None:
    found, system = _path(spark, path)
    system.delete(found, True)


def daily_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table by day as it stands; empty before the first batch."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def upsert_days(changes: DataFrame, home: str, batch_id: int, keys: Sequence[str], day: str) -> None:
    """Replace the rows of the changed keys in ``home/table``, which has a folder for each day.

    Only the days that occur among the changes are read and written again. The new state of these days is written whole
    to ``home/merged`` first; the table's folders are replaced from there, which can be repeated at any point. A batch
    that is done leaves a mark, so the same batch given again changes nothing. The days of a batch are listed on the
    driver: a calendar, however many rows there are.
    """
    spark = changes.sparkSession
    table, merged, done = f"{home}/table", f"{home}/merged/{batch_id}", f"{home}/done/{batch_id}"
    if _exists(spark, f"{done}/_SUCCESS"):
        return
    if not _exists(spark, f"{merged}/_SUCCESS"):
        given = f"{home}/changes/{batch_id}"
        changes.write.mode("overwrite").parquet(given)
        new = spark.read.schema(changes.schema).parquet(given)
        days = [row[0] for row in new.select(day).distinct().collect()]
        old = daily_table(spark, table, changes.schema).where(F.col(day).isin(days))
        named = new.select(*[F.col(key).alias(f"_{key}") for key in keys])
        same = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys])
        old.join(named, same, "left_anti").unionByName(new).write.mode("overwrite").parquet(merged)
    rows = spark.read.schema(changes.schema).parquet(merged)
    others = [key for key in keys if key != day]
    (
        rows.repartitionByRange(day, *others).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(day).parquet(table)
    )
    spark.range(0, 1, 1, 1).write.mode("overwrite").parquet(done)
    for folder in (merged, f"{home}/changes/{batch_id}", f"{home}/done/{batch_id - 1}"):
        _delete(spark, folder)


def write_updates(counts: DataFrame, home: str, keys: Sequence[str], day: str, checkpoint: str) -> StreamingQuery:
    """Start a run over all files at hand; every batch puts its changed rows into the table by day."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_days(batch, home, batch_id, keys, day)

    return (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def ingest_daily_counts(
    spark: SparkSession, folder: str, schema: T.StructType, entity: str, ts: str, *, glob: str | None = None,
    lateness: str | None = None, base: str | None = None, state_partitions: int | None = None, **aggregates: Column,
) -> DataFrame:
    """Process all files at hand and return the daily counts so far, read from a table with a folder for each day.

    ``base`` keeps table and checkpoint between runs; without it a fresh folder of the shared scratch area is used.
    ``state_partitions`` fixes the number of state partitions at the first run (default: the shuffle partitions of
    the session); it stays the same for the life of the checkpoint.
    """
    home = base or f"{scratch_dir(spark)}/daily-counts-{uuid.uuid4().hex}"
    counts = daily_counts(file_stream(spark, folder, schema, glob=glob), entity, ts, lateness, **aggregates)
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    try:
        if state_partitions is not None:
            spark.conf.set(setting, str(state_partitions))
        # The stream takes the setting at its start.
        query = write_updates(counts, home, [entity, "event_date"], "event_date", f"{home}/checkpoint")
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()
    return daily_table(spark, f"{home}/table", counts.schema)
