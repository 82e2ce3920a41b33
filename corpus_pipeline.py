"""From raw documents to token ids: a filter, two dedups, a mix and an encoder, each stage on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. Stages are written as Parquet and read again, so a
lost executor never costs more than one stage's tasks. All but the last return the columns of documents.

Nulls in any column, empty and very long texts, repeated rows, empty tables and further columns are handled as the
operators' docstrings say: null texts count as empty, columns that no stage needs are carried along, and an empty table
gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tocsin.llm import exact_dedup, jaccard_join, mixing, quality_neighbours, sentence_pieces
from tocsin.llm.common import remove, scratch_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour classifier rejects go."""
    return quality_neighbours.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, judged against a new index, which goes again."""
    index = exact_dedup.DigestIndex(spark, f"pipeline_index_{uuid.uuid4().hex}")
    kept = exact_dedup.keep_first_copies(docs, index)
    index.drop()
    return kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_skipped of every row. Copies of a document, in the order of source and lang, are cut
    independently of each other."""
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source", "lang")
    numbered = docs.select("doc_id", "lang", "source", "text", (F.row_number().over(same) - 1).alias("copy"))
    return sentence_pieces.encode(numbered, carry=("lang", "source"), copy="copy")


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mix", mix),
    ("token_ids", token_ids),
]

#: A classifier and an encoder have no SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. A stage's rows are deleted when those of the next one are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        rows = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name)
        rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
