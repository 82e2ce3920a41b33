"""Shapes of the physical plans that matter at scale."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from registry import QUERIES, load_all
from tocsin.operators import grid
from tocsin.operators.entity_windows import latest_per_key
from tocsin.plans import alerts

FOLDER = "/root/testdata/sf0.001"
load_all()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the generated tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["panel_7d_28d", "asof_entity", "nearest_dates", "threshold_sweep", "pr_auc_roc_auc", "normalize_news_documents"]
)
def test_no_cross_products_and_no_python_workers(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "PythonUDF"):
        assert unwanted not in text


def test_events_meet_the_panel_without_a_join(spark):
    events = spark.read.parquet(f"{FOLDER}/orders.parquet").select(
        F.col("o_orderstatus").alias("e"), F.col("o_orderdate").cast("date").alias("d")
    )
    panel = grid.dense_panel(
        spark.createDataFrame([("F",)], "entity_id string"), F.lit("2000-01-03").cast("date"), F.lit("2001-01-01").cast("date")
    )
    text = plan(grid.range_sums(panel, events, "e", "d", [grid.RangeSum("n", grid.HISTORY_52W)]))
    assert "Join" not in text
    assert "partial_sum" in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2  # cells, then one window pass


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["weekly_document_summary"](spark, FOLDER))
    schemas = re.findall(r"documents\.parquet.*?ReadSchema: (\S+)", text)
    assert schemas and all("text" not in schema for schema in schemas)


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").where(F.col("o_orderkey") >= 100)
    text = plan(grid.entity_weeks(orders, "o_orderstatus", "o_orderdate"))
    assert "GreaterThanOrEqual(o_orderkey,100)" in text


def test_top_rows_are_cut_before_the_shuffle(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    assert "WindowGroupLimit" in plan(latest_per_key(orders, "o_custkey", "o_orderdate"))
    predictions = orders.select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("forecast_date"),
        F.col("o_totalprice").alias("calibrated_probability"),
    )
    assert "WindowGroupLimit" in plan(alerts.date_leaders(predictions, 10))


def test_documents_meet_aliases_in_a_join(spark):
    """No alias table in the plan as a constant, and no job while the plan is made."""
    text = plan(QUERIES["normalize_news_documents"](spark, FOLDER))
    assert "from_json" not in text and "Join" in text


def test_growing_frames(spark):
    """One entity with many dates: frames that end at the last row would take minutes."""
    import time

    from tocsin.operators import grid

    rows = spark.range(50_000).select(
        F.lit("E").alias("entity_id"), F.expr("date_add(DATE '1900-01-01', CAST(id AS INT))").alias("forecast_date"),
        (F.col("id") % 997 / 997.0).alias("calibrated_probability"), (F.col("id") % 5000 == 0).cast("int").alias("label"),
    )
    started = time.perf_counter()
    assert alerts.alert_table(rows, 0.9, 3).count() == 50_000
    assert alerts.threshold_sweep(rows, 3).count() == 997
    panel = rows.select("entity_id", grid.week_start("forecast_date").alias("week_start_date")).distinct()
    calendar = rows.where("label = 1").select("entity_id", F.col("forecast_date").alias("d"))
    assert grid.nearest_dates(panel, calendar, "entity_id", "d").count() == panel.count()
    assert time.perf_counter() - started < 90


def test_scores_are_shuffled_once_for_running_totals(spark, monkeypatch):
    """The written score table is read by one window; starting values are an aggregate of few rows."""
    from tocsin.operators import running

    monkeypatch.setattr(running, "ROWS_PER_RANGE", 50)
    df = spark.range(1000).select((F.col("id") % 500 / 500).alias("s"), F.lit(1).alias("v"))
    text = plan(running.running_totals(df, "s", ["v"]))
    assert len(re.findall(r"Exchange hashpartitioning\(_range", text)) <= 2  # scores; partial totals of the ranges
    assert "Window" in text and "CartesianProduct" not in text
    assert len(re.findall(r"Scan parquet", text)) == 2


def test_every_event_source_is_read_once(spark, tmp_path):
    """Start, countries and onsets come from the cells; the exact distinct actors are the one further pass."""
    from registry.panel import panel_sources
    from tocsin.plans import panel as plans

    fields = {"news_events": "news", "news_documents": "docs", "conflict_events": "conflict", "violence_events": "violence"}
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # whole paths in the plan
    given = panel_sources(spark, FOLDER)
    written = {}
    for name, folder in fields.items():
        frame = getattr(given, name)
        frame.write.parquet(str(tmp_path / folder))
        written[name] = spark.read.schema(frame.schema).parquet(str(tmp_path / folder))
    sources = plans.PanelSources(**{**given.__dict__, **written})
    cells = plan(plans.source_cells(sources.filled(spark)))
    assert "Expand" not in cells
    counts = {folder: len(re.findall(rf"Scan parquet [^\n]*{tmp_path.name}/{folder}\b", cells)) for folder in fields.values()}
    assert counts == {"news": 1, "docs": 1, "violence": 1, "conflict": 2}
    whole = plan(plans.country_week_features(spark, sources, "2001-06-15 00:00:00"))
    assert not re.findall(rf"Scan parquet [^\n]*{tmp_path.name}/(news|docs|violence|conflict)\b", whole)


@pytest.mark.parametrize("name", ["panel_distinct_actors", "weekly_conflict_summary"])
def test_distinct_counts_do_not_expand_rows(spark, name):
    assert "Expand" not in plan(QUERIES[name](spark, FOLDER))


def test_folds_at_every_date_need_no_nested_loop(spark):
    """3,000 dates and a split at nearly each: membership by number, totals by one running sum."""
    import time

    from tocsin.plans import folds

    df = spark.range(6000).select(
        F.expr("date_add(DATE '1990-01-01', CAST(id % 3000 AS INT))").alias("d"), (F.col("id") % 3 == 0).cast("long").alias("label")
    )
    splits = folds.walk_forward_splits(df, "d", 100, 5, 1)
    started = time.perf_counter()
    rows = folds.fold_rows(df, splits, "d", "validation")
    for frame in (rows, folds.fold_trainability(df, splits, "d"), folds.prior_rate_scores(df, splits, "d")):
        assert "NestedLoop" not in plan(frame) and "Cartesian" not in plan(frame)
    assert rows.count() == 2896 * 5 * 2
    last = folds.fold_trainability(df, splits, "d").orderBy(F.col("train_row_count").desc()).first()
    assert (last["train_row_count"], last["validation_row_count"], last["skip_reason"]) == (2995 * 2, 10, None)
    assert folds.fold_dates(df, splits, "d").where("role = 'train'").count() == sum(range(100, 2996))
    assert time.perf_counter() - started < 90


def test_clustered_tables_need_no_shuffle(spark, tmp_path):
    """Labels, episodes and lags of an entity read its bucket; a later session opens the same files."""
    from tocsin.operators import entity_windows as ew
    from tocsin.plans import labels
    from tocsin.sources.sinks import open_clustered, write_clustered

    rows = spark.range(4000).select(
        F.concat(F.lit("e"), (F.col("id") % 50).cast("string")).alias("entity_id"),
        F.expr("date_add(DATE '2020-01-01', CAST(id DIV 50 AS INT))").alias("as_of_date"),
        (F.col("id") % 7).alias("n"), (F.col("id") % 97 / 97).alias("calibrated_probability"),
        (F.col("id") % 31 == 0).cast("int").alias("label"),
    )
    table = write_clustered(rows, str(tmp_path), "gold", "x", "t", entity="entity_id", day="as_of_date", buckets=4)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, rows.collect()))
    definition = labels.LabelDefinition("t", labels.ONSET, "n", 5, forecast_threshold=4.0, quiet_threshold=2.0)
    episodes = alerts.alert_table(table.withColumn("forecast_date", F.col("as_of_date")), 0.9, 3)
    lags = table.select(ew.lagged(F.col("n"), 1, ew.ordered("entity_id", "as_of_date")).alias("lag"))
    for frame in (labels.build_labels(table, definition, 7), episodes, lags):
        assert "Exchange" not in plan(frame)
    assert "Exchange" in plan(labels.build_labels(rows, definition, 7))
    again = open_clustered(spark, "opened_again", f"{tmp_path}/gold/x/t", rows.schema, "entity_id", "as_of_date", 4)
    assert again.count() == 4000 and "Exchange" not in plan(labels.build_labels(again, definition, 7))
