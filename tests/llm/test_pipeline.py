"""The pipeline's stages and the registered queries."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from tocsin.llm.queries import ORACLES, QUERIES
from tools_check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark, crowded, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = crowded, [crowded.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == crowded.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] > 0 and seen[4] == seen[5]
    crowded.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the generated tables are not here")
def test_pipeline_follows_its_operators(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    from tocsin.llm import sentence_pieces

    with open(sentence_pieces.DEFAULT_MODEL, "rb") as file:
        model = sentence_pieces.PieceModel(file.read())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert rows and all(model.decode(r["ids"]) == texts[r["doc_id"]] for r in rows if r["ids"])
    again = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the generated tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    found = [tuple(row) for row in df.collect()]
    assert found and len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        con = duckdb.connect()
        for table in TABLES.split():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        result = con.execute(ORACLES[name])
        columns = [item[0] for item in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, found) == rows_of(columns, result.fetchall())
