"""Registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm import (
    alignment,
    exact_dedup,
    jaccard_join,
    license_scan,
    merkle,
    mixing,
    packing,
    page_text,
    personal_data,
    quality_neighbours,
    quality_rules,
    sentence_pieces,
    url_reputation,
)
from tocsin.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register(fn) if fn else register


@query
def op1_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded with merge-dropout and decoded again."""
    return sentence_pieces.round_trip(table(spark, folder, "documents"))


@query
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scanned for licenses. The table has no paths: a document is a file in a folder of a thousand ids,
    under its language and source."""
    docs = table(spark, folder, "documents")
    number = F.col("doc_id").cast("string")
    block = F.floor(F.col("doc_id") / 1000).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), block, number)
    found = license_scan.scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text"))
    return found.withColumnRenamed("file_id", "doc_id")


@query(sql=url_reputation.SQL)
def op3_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's url judged; a page is bad when the label of the same number has quality 0."""
    labels = table(spark, folder, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_reputation.judge(table(spark, folder, "pages"), outcomes)


@query
def op4_quality_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored by its labelled neighbours."""
    return quality_neighbours.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(sql=exact_dedup.SQL)
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document judged against a new, empty index."""
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    judged = exact_dedup.deduplicate(table(spark, folder, "documents"), index)
    index.drop()  # the result does not read it
    return judged


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document judged by base counts and the n-gram regression."""
    return quality_rules.apply_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(sql=mixing.SQL)
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to the contract's weights."""
    return mixing.mix(table(spark, folder, "documents"))


@query(sql=jaccard_join.SQL)
def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the component of its near duplicates."""
    return jaccard_join.near_duplicates(table(spark, folder, "documents"))


@query
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """All spans of personal data of every document."""
    return personal_data.find(table(spark, folder, "documents"))


@query
def op10_page_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return page_text.main_text(table(spark, folder, "pages"))


@query(sql=merkle.SQL)
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a leaf, with its proof checked against the root."""
    return merkle.verify(table(spark, folder, "documents"))


@query
def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document packed into sequences of 4,096 tokens."""
    return packing.pack_documents(table(spark, folder, "documents")).rows


@query
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document by two tokenizers, aligned at their common ends."""
    return alignment.scored(table(spark, folder, "documents"))
