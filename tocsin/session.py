"""Session defaults and the shared scratch location used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Call sites of every column expression are only of use in a debugger and slow down wide plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "tocsin", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with UTC time and adaptive execution; extra settings win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary one only for a local master without a setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    local = tempfile.mkdtemp(prefix="tocsin-scratch-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from there.

    Loops that fit several models over the same frame start from the written rows, so a lost executor
    costs one file read and not a recomputation of the whole panel.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once as a table in the shared folder and go on from the table."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/kept-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
