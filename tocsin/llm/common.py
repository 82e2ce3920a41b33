"""What several operators of this subpackage share: patterns, scratch tables and Python word splitting."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.session import scratch_dir

#: White space and words of all contracts (the same text is valid for Java, Python and RE2).
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

WORD_RE = re.compile(WORD)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster."""
    return f"{scratch_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder, wherever that lies."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once to the shared folder and go on from the written table.

    Later stages start from these files, so a lost executor costs a read and no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most ids (8 bytes each) that are sent to every executor; beyond it the join shuffles both sides.
MOST_SENT = 4_000_000


def sendable(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for a broadcast if its counted rows are few enough."""
    return F.broadcast(ids) if ids.count() <= MOST_SENT else ids


class Scratch:
    """Tables of one computation in the shared folder; they go when it has its result."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, scratch_path(spark, "tables")
        self.number = 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.number += 1
        path = f"{self.folder}/{self.number}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        remove(self.spark, self.folder)
