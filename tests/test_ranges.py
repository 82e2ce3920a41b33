"""Positions, running totals and pooled blocks over range partitions against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tocsin.operators import isotonic, ranges, running
from tocsin.session import kept


@pytest.fixture
def many_ranges(spark):
    """Small tables keep all their partitions."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, "true")


def test_positions(many_ranges):
    rng = random.Random(4)
    data = [(rng.choice("aab"), rng.randrange(60), i) for i in range(400)] + [("c", 1, -1)] * 50
    df = many_ranges.createDataFrame(data, "g string, x long, y long").repartition(7)
    found = ranges.positions(df, "g", [F.col("x").desc(), F.col("y").asc()], kept).collect()
    for group in "abc":
        own = sorted(((-x, y) for g, x, y in data if g == group))
        rows = sorted((r for r in found if r["g"] == group), key=lambda r: r["pos"])
        assert [(-r["x"], r["y"]) for r in rows] == own
        assert [r["pos"] for r in rows] == list(range(len(own))) and {r["n"] for r in rows} == {len(own)}


def test_a_row_repeated_without_end_is_many_tasks(many_ranges):
    df = many_ranges.range(20_000).select(F.lit("g").alias("g"), F.lit(1).alias("x")).repartition(5)
    table = kept(ranges.in_ranges(df, [F.col("g").asc(), F.col("x").asc()]), "rows")
    assert table.select(ranges.part_of().alias("p")).distinct().count() == 4


def pooled(points):
    """Blocks by the textbook loop."""
    out = []
    for score, rows, positives in sorted(points):
        out.append([score, score, rows, positives])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return [tuple(block) for block in out]


POINTS = {
    "noise": [(i / 300, 5, random.Random(i).randrange(6)) for i in range(300)],
    "rising": [(i / 300, 1000, i * 3) for i in range(300)],
    "falling": [(i / 300, 1000, 1000 - i * 3) for i in range(300)],
    "signal": [(i / 300, 9, sum(random.Random(i * 7 + k).random() < i / 300 for k in range(9))) for i in range(300)],
    "one": [(0.5, 3, 1)],
    "none": [],
}


@pytest.mark.parametrize("name", POINTS)
@pytest.mark.parametrize("fan", [2, 16])
def test_pooled_blocks(many_ranges, name, fan):
    df = many_ranges.createDataFrame(POINTS[name], "score double, rows long, positives long")
    blocks = isotonic.pooled_blocks(df, kept, fan)
    found = sorted(tuple(r) for r in blocks.select("lo", "hi", "rows", "positives").collect())
    assert found == pooled(POINTS[name])
    if name == "rising":  # nothing to merge: the ranges stay apart
        assert blocks.select("part").distinct().count() > 1


@pytest.mark.parametrize("name", POINTS)
@pytest.mark.parametrize("cells, small", [(1, True), (7, True), (4096, False)])
def test_isotonic_map(many_ranges, monkeypatch, name, cells, small):
    """Constant on blocks, linear between them, constant outside; null and NaN have no value."""
    if not small:
        monkeypatch.setattr(isotonic, "MOST_SENT", 0)
    df = many_ranges.createDataFrame(POINTS[name], "score double, rows long, positives long")
    mapped = isotonic.isotonic_map(df, kept, cells=cells)
    xs = [-1.0, 0.0, 0.1234, 0.5, 0.50001, 0.9999, 7.0, None, float("nan"), *[p[0] for p in POINTS[name][::17]]]
    rows = mapped.apply(many_ranges.createDataFrame([(x, "k") for x in xs], "s double, y string"), "s", "y").collect()
    blocks = pooled(POINTS[name])
    assert len(rows) == len(xs)
    for row in rows:
        x, expected = row["s"], None
        if x is not None and x == x and blocks:
            points = [(b[k], b[3] / b[2]) for b in blocks for k in (0, 1)]
            if x <= points[0][0] or x >= points[-1][0]:
                expected = points[0][1] if x <= points[0][0] else points[-1][1]
            else:
                (x0, y0), (x1, y1) = next((p, q) for p, q in zip(points, points[1:]) if p[0] <= x <= q[0] and p[0] < q[0])
                expected = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
        assert row["y"] == (None if expected is None else pytest.approx(expected, abs=1e-12))


def test_ranges_follow_the_size(spark, monkeypatch):
    monkeypatch.setattr(running, "ROWS_PER_RANGE", 10)
    data = [(float(i % 61), i) for i in range(61)] + [(None, 7), (float("nan"), 5)]
    df = spark.createDataFrame(data, "s double, v long")
    found = running.running_totals(df, "s", ["v"])
    assert running.with_score_range(kept(df, "t"), "s").select("_range").distinct().count() >= 6
    total = 0
    order = sorted(data, key=lambda r: (r[0] is None, r[0] == r[0], -(r[0] or 0)))  # NaN, falling, null
    expected = {}
    for s, v in order:
        total += v
        expected[str(s)] = total
    assert {str(r["s"]): r["cum_v"] for r in found.collect()} == expected
    assert {r["all_v"] for r in found.collect()} == {total}
