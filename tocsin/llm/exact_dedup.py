"""Exact dedup against a persistent digest index.

Texts are equal when identical without white space. The index is a Parquet table, bucketed and sorted by digest, with one
row for the first batch of a distinct text, which names the row that stays, and one for each later batch that brought it
again, which holds a number. A batch of documents is reduced to one row per digest by an aggregate with map-side partials
(a third of all rows may be copies of one text), what the index does not hold yet is found by a sort-merge anti-join that
reads the index in its buckets without a shuffle, and only that is appended. Rows that the batch itself has appended
before, in a run that failed later, count as its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tocsin.llm.common import WHITE, remove, text_or_empty, written

INDEX_SCHEMA = "digest binary, keep_id bigint, keep_points bigint, group_size bigint, batch string, first boolean"


class DigestIndex:
    """The index table. The same path given again, also in a later session, goes on with what it holds."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.path = path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}"
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} ({INDEX_SCHEMA}) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
            )

    def _add(self, groups: DataFrame, batch: str, first: bool) -> None:
        row = groups.select("digest", "keep_id", "keep_points", "group_size", F.lit(batch).alias("batch"), F.lit(first).alias("first"))
        row.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the groups whose digest is new, and the number of rows of the others. What the batch has added before is
        not added again."""
        known = self.spark.table(self.name)
        self._add(groups.join(known.select("digest").hint("merge"), "digest", "left_anti"), batch, True)
        self.spark.catalog.refreshTable(self.name)
        known = self.spark.table(self.name)
        mine = known.where(F.col("batch") == batch).select("digest")
        self._add(groups.join(mine.hint("merge"), "digest", "left_anti"), batch, False)
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        """Remove the index with its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)

    def all_rows(self) -> DataFrame:
        """The index as plain files: a join on them shuffles both sides, so that hot digests can be split."""
        return self.spark.read.schema(INDEX_SCHEMA).parquet(self.path)

    def rows(self) -> DataFrame:
        """One row per distinct text, that of its first batch."""
        return self.all_rows().where("first")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, code points of the text and the digest of the text without white space."""
    bare = F.regexp_replace(text_or_empty(), f"{WHITE}+", "")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text_or_empty()).cast("long").alias("n_points"),
        F.unhex(F.sha2(bare, 256)).alias("digest"),
    )


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per digest: the row that stays (most code points, then smallest id) and the number of rows.

    The complement of an id orders ids downwards and cannot overflow; a null id comes last.
    """
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("down")))
    return (
        rows.groupBy("digest")
        .agg(best.alias("best"), F.count("*").alias("group_size"))
        .select("digest", F.bitwise_not("best.down").alias("keep_id"), F.col("best.n_points").alias("keep_points"), "group_size")
    )


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Judge every row of a batch against the index and the batch itself, and append the new texts to the index.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row; other columns of the input are not
    read, so their names cannot clash. Texts that an earlier batch brought keep that batch's keep_id, none of their
    rows is kept, and group_size counts the rows of all batches so far. ``batch`` names the batch: the same rows given
    again under the same name, after a failure or not, get the same answers. Null and empty texts are equal. Of rows with
    one id, those with the most code points are kept; rows repeated with the same id and text share one decision. An
    empty table gives no rows and leaves the index as it is. The result does not read the index again.
    """
    batch = batch or uuid.uuid4().hex
    rows = written(digests(docs), "digests")
    groups = written(groups_of(rows), "groups")
    index.append(groups, batch)
    # Few rows a digest; the hot digest is on the left side only, where adaptive execution splits it.
    held = index.all_rows().join(groups.select("digest"), "digest", "left_semi")
    found = held.groupBy("digest").agg(
        F.max(F.when(F.col("first"), F.col("keep_id"))).alias("keep_id"),
        F.max(F.when(F.col("first"), F.col("keep_points"))).alias("keep_points"),
        F.sum("group_size").alias("group_size"),
        F.every(~F.col("first") | (F.col("batch") == batch)).alias("new"),
    )
    found = written(found, "judged")
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    return rows.join(found, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("new") & best).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows with the same id, text and code points, one."""
    kept = deduplicate(docs, index).where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__of"))
    kept = written(kept.agg(F.count("*").alias("__n")), "kept")
    named = docs.withColumn("__text", F.sha2(F.regexp_replace(text_or_empty(), f"{WHITE}+", ""), 256))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__of"))
    once = named.join(kept.where("__n = 1"), same, "left_semi")
    again = named.join(kept.where("__n > 1"), same, "left_semi")
    # Few rows: ids that stand in several rows with one text. The one with the most code points, then any, stays.
    order = Window.partitionBy("__text").orderBy(F.length(text_or_empty()).desc())
    again = again.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")
    return once.unionByName(again).select(*docs.columns)


#: DuckDB SQL for deduplicate() against an empty index.
SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AND n_points = first_value(n_points) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id)
"""
