"""Grid windows against plain loops."""

from __future__ import annotations

import datetime
import random

import pytest
from frames import day
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tocsin.operators import grid
from tocsin.operators.grid import DayRange, RangeSum


def monday(date):
    return date - datetime.timedelta(days=date.weekday())


@given(lo=st.integers(-400, 100), length=st.integers(0, 400))
@settings(max_examples=300, deadline=None)
def test_day_range_covers_each_day_once(lo, length):
    days = DayRange(lo, lo + length)
    covered = []
    whole = days.whole()
    if whole:
        covered += [7 * week - offset for week in range(whole[0], whole[1] + 1) for offset in range(7)]
    for week, least, most in days.partial():
        covered += [7 * week - offset for offset in range(least, most + 1)]
    assert sorted(covered) == list(range(days.lo, days.hi + 1))


@pytest.fixture(scope="module")
def events(spark):
    """One entity holds most rows."""
    rng = random.Random(5)
    start = day("2020-01-01")
    rows = [
        (rng.choice("AAAAAAAAB"), start + datetime.timedelta(days=rng.randrange(500)), rng.choice([None, 1.0, 2.5]), rng.choice("xyz"))
        for _ in range(1500)
    ] + [(None, start, 1.0, "x"), ("A", None, 1.0, "x")]
    return rows, spark.createDataFrame(rows, "e string, d date, v double, who string")


@pytest.fixture(scope="module")
def panel(spark):
    dimension = spark.createDataFrame([("A",), ("B",), ("C",)], "entity_id string")
    return grid.dense_panel(dimension, F.lit("2020-03-04").cast("date"), F.lit("2021-03-20").cast("date"))


RANGES = [(-6, 0), (-27, 0), (-55, 0), (-364, 0), (1, 7), (1, 30), (1, 90), (-3, 2), (2, 4)]


def test_range_sums_equal_a_loop(events, panel):
    rows, df = events
    measures = [RangeSum(f"n_{i}", DayRange(*r)) for i, r in enumerate(RANGES)]
    measures += [RangeSum(f"v_{i}", DayRange(*r), "v") for i, r in enumerate(RANGES)]
    found = grid.range_sums(panel, df, "e", "d", measures).collect()
    assert len(found) == 3 * 55
    for row in found:
        week = row["week_start_date"]
        assert week.weekday() == 0
        for i, (lo, hi) in enumerate(RANGES):
            inside = [
                v for e, d, v, _ in rows
                if e == row["entity_id"] and d is not None and lo <= (d - week).days <= hi
            ]
            assert row[f"n_{i}"] == len(inside)
            assert row[f"v_{i}"] == pytest.approx(sum(v or 0 for v in inside))


def test_fan_out_equals_a_loop(events):
    rows, df = events
    for lo, hi in RANGES:
        fanned = grid.fan_out(df.where("d is not null"), "d", DayRange(lo, hi)).select("e", "d", "who", grid.WEEK)
        found = sorted((r["d"], r[grid.WEEK]) for r in fanned.collect())
        expected = []
        for _, d, _, _ in rows:
            if d is None:
                continue
            for step in range(-420, 421):
                week = monday(d) + datetime.timedelta(days=7 * step) if abs(step) < 60 else None
                if week and lo <= (d - week).days <= hi:
                    expected.append((d, week))
        assert found == sorted(expected)


def test_range_distinct_equals_a_loop(events):
    rows, df = events
    found = {(r["entity_id"], r[grid.WEEK]): r["k"] for r in grid.range_distinct(df, "e", "d", "who", grid.TRAILING_28D, "k").collect()}
    for (entity, week), count in found.items():
        seen = {w for e, d, _, w in rows if e == entity and d is not None and -27 <= (d - week).days <= 0}
        assert count == len(seen)


def test_asof_takes_the_whole_newest_row(spark, panel):
    observations = spark.createDataFrame(
        [("A", day("2019-12-01"), 1.0, 10.0), ("A", day("2020-06-01"), None, 20.0), ("B", day("2022-01-01"), 5.0, 5.0)],
        "e string, d date, x double, y double",
    )
    found = {
        (r["entity_id"], r["week_start_date"]): (r["x"], r["y"])
        for r in grid.asof_join(panel, observations, "e", F.col("d"), ["x", "y"]).collect()
    }
    assert found["A", day("2020-03-02")] == (1.0, 10.0)
    assert found["A", day("2020-05-25")] == (1.0, 10.0)
    assert found["A", day("2020-06-01")] == (None, 20.0)
    assert found["B", day("2021-03-15")] == (None, None)


def test_asof_year_uses_the_year_of_the_week(spark):
    dimension = spark.createDataFrame([("A",)], "entity_id string")
    panel = grid.dense_panel(dimension, F.lit("2019-12-23").cast("date"), F.lit("2020-01-13").cast("date"))
    annual = spark.createDataFrame([("A", 2018, 1.0), ("A", 2020, 2.0)], "e string, year long, x double")
    found = {r["week_start_date"]: r["x"] for r in grid.asof_join(panel, annual, "e", grid.year_day("year"), ["x"]).collect()}
    assert found == {
        day("2019-12-23"): 1.0, day("2019-12-30"): 1.0, day("2020-01-06"): 2.0, day("2020-01-13"): 2.0,
    }


def test_nearest_dates_same_day_counts_for_both(spark):
    dimension = spark.createDataFrame([("A",), ("B",)], "entity_id string")
    panel = grid.dense_panel(dimension, F.lit("2026-03-16").cast("date"), F.lit("2026-03-30").cast("date"))
    calendar = spark.createDataFrame(
        [("A", day("2026-03-01")), ("A", day("2026-03-23")), ("A", day("2026-04-12"))], "e string, d date"
    )
    found = {
        (r["entity_id"], r["week_start_date"]): (r["next_date"], r["last_date"])
        for r in grid.nearest_dates(panel, calendar, "e", "d").collect()
    }
    assert found["A", day("2026-03-16")] == (day("2026-03-23"), day("2026-03-01"))
    assert found["A", day("2026-03-23")] == (day("2026-03-23"), day("2026-03-23"))
    assert found["A", day("2026-03-30")] == (day("2026-04-12"), day("2026-03-23"))
    assert found["B", day("2026-03-30")] == (None, None)


def test_latest_row_asof(spark):
    rows = spark.createDataFrame(
        [("A", day("2020-01-01"), 1), ("A", day("2020-02-01"), 2), ("A", day("2020-03-01"), 3), ("B", day("2021-01-01"), 9)],
        "e string, d date, x int",
    )
    cutoff = F.lit("2020-02-10").cast("date")
    assert [tuple(r) for r in grid.latest_row_asof(rows, "e", "d", cutoff).collect()] == [("A", day("2020-02-01"), 2)]
    assert [tuple(r) for r in grid.latest_row_asof(rows.drop("e"), None, "d", cutoff).collect()] == [(day("2020-02-01"), 2)]


def test_sketches_of_cells_merge(spark):
    """Estimates of any range stay within five standard errors, and small counts are exact."""
    import random

    from tocsin.plans import panel as plans

    rng = random.Random(2)
    data = [("A", day("2024-01-01") + datetime.timedelta(days=rng.randrange(200)), f"x{rng.randrange(4000)}") for _ in range(20_000)]
    data += [("B", day("2024-02-01"), "one"), ("B", day("2024-02-03"), None), ("B", day("2024-02-04"), "two")]
    rows = spark.createDataFrame(data, "e string, d date, v string")
    panel = grid.dense_panel(
        spark.createDataFrame([("A",), ("B",), ("C",)], "entity_id string"), F.lit("2024-01-01").cast("date"),
        F.lit("2024-07-01").cast("date"),
    )
    spans = {"a": DayRange(-27, 0), "b": DayRange(-364, 0), "c": DayRange(-3, 2), "d": DayRange(1, 30)}
    measures = [grid.RangeDistinct(name, days, "v", 11) for name, days in spans.items()]
    cells = grid.sum_cells(rows, "e", "d", [], "c", plain=grid.sketch_columns(measures, "d", "c"))
    columns = {m.name: grid.range_distinct_estimate(m, "c") for m in measures}
    found = grid.read_panel(grid.stack_cells(panel, [cells]), columns, ["entity_id", "week_start_date"]).collect()
    assert len(found) == panel.count()
    for row in found:
        for name, days in spans.items():
            low, high = (row["week_start_date"] + datetime.timedelta(days=k) for k in (days.lo, days.hi))
            exact = len({v for e, d, v in data if e == row["entity_id"] and low <= d <= high and v is not None})
            assert abs(row[name] - exact) <= exact * 5 * 1.04 / 2**5.5 + (exact > 50)
    assert "ObjectHashAggregate" in grid.sum_cells(rows, "e", "d", [], "c", plain=grid.sketch_columns(
        measures, "d", "c"))._jdf.queryExecution().executedPlan().toString()
    assert [m.name for m in plans.ActorSketch().measures()][0] == "acled_distinct_actor1_estimate_28d"


def test_distinct_values_of_long_ranges_are_not_fanned_out(spark):
    """Rows that overlap, touch and leave gaps, against a loop; no row is copied to each week of its range."""
    days = [0, 0, 3, 10, 40, 400, 765, 766, 1500]
    rows = [("A", datetime.date(2000, 1, 1) + datetime.timedelta(d), who) for d in days for who in ("x", "y")]
    rows += [("A", datetime.date(2000, 3, 1), "z"), ("B", datetime.date(2000, 3, 6), "x"), (None, datetime.date(2000, 1, 1), "x"),
             ("B", None, "x"), ("B", datetime.date(2000, 3, 6), None)]
    df = spark.createDataFrame(rows, "e string, d date, who string")
    for days in (grid.TRAILING_28D, grid.HISTORY_52W, grid.FUTURE_30D, grid.DayRange(2, 4)):
        counted = grid.range_distinct(df, "e", "d", "who", days, "k")
        found = sorted((r["entity_id"], r[grid.WEEK], r["k"]) for r in counted.collect())
        held = {}
        for entity, day, who in rows:
            if entity is None or day is None or who is None:
                continue
            for back in range(days.lo, days.hi + 1):
                monday = day - datetime.timedelta(back)
                if monday.weekday() == 0:
                    held.setdefault((entity, monday), set()).add(who)
        assert found == sorted((*key, len(values)) for key, values in held.items())
    plan = grid.range_distinct(df, "e", "d", "who", grid.HISTORY_52W, "k")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate"):]  # what is below the totals per week
    assert "sequence(" not in below
