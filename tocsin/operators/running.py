"""Running totals and ranks over a whole table, in score order, without a single-task sort.

The table is written once. Scores are cut into ranges by approximate quantiles, as many as the table needs (any cut gives
the same totals; a good cut only balances the tasks). Totals per range, one small row each, give every range its starting
value; inside a range an ordinary window does the rest, which is the only shuffle of the scores. Ranks need no window at
all: rows sorted by ranges of the whole order carry their number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tocsin.operators.ranges import positions
from tocsin.session import kept

#: Rows of a range, about, and the most ranges that are cut; a range grows with the table only beyond their product.
ROWS_PER_RANGE, MOST_RANGES = 65_536, 4_096


def with_score_range(table: DataFrame, score: str, ranges: int | None = None) -> DataFrame:
    """Add ``_range``: the place of the score between quantiles of all scores, nulls lowest; no column if one range will do.

    ``table`` is read twice, so it should be a written one. ranges: None cuts by its size.
    """
    if ranges is None:
        ranges = max(1, min(MOST_RANGES, -(-table.count() // ROWS_PER_RANGE)))
    probabilities = [step / ranges for step in range(1, ranges)]
    cuts = table.agg(F.percentile_approx(score, probabilities, 20_000)).first()[0] if probabilities else None
    if not cuts:
        return table
    splits = [float("-inf"), *sorted({float(cut) for cut in cuts}), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_s", outputCol="_b", handleInvalid="keep").transform(
        table.withColumn("_s", F.col(score).cast("double"))
    )
    place = F.when(F.col(score).isNull(), 0).otherwise(F.col("_b").cast("int"))
    return placed.select(*table.columns, place.alias("_range"))


def _join_starts(df: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the starting values of the ranges; null group keys match each other."""
    renamed = starts.select(*[F.col(key).alias(f"_k_{key}") for key in keys], *[c for c in starts.columns if c not in keys])
    condition = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_k_{key}")) for key in keys])
    return df.join(renamed, condition, "inner").drop(*[f"_k_{key}" for key in keys])


def running_totals(
    df: DataFrame, score: str, values: Sequence[str], groups: Sequence[str] = (), ranges: int | None = None,
    descending: bool = True,
) -> DataFrame:
    """Add ``cum_<value>`` (inclusive running total in score order) and ``all_<value>`` (total), per group.

    Expects one row per group and score (aggregate first; see ``score_table``). Writes them once.
    """
    cut = with_score_range(kept(df, "scores"), score, ranges)
    order = F.col(score).desc() if descending else F.col(score).asc()
    if "_range" not in cut.columns:
        group = Window.partitionBy(*(groups or [F.lit(0)]))
        until = group.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return cut.select(
            "*", *[F.sum(v).over(until).alias(f"cum_{v}") for v in values],
            *[F.sum(v).over(group).alias(f"all_{v}") for v in values],
        )
    keys = [*groups, "_range"]
    totals = cut.groupBy(*keys).agg(*[F.sum(value).alias(value) for value in values])
    ranges_in_order = F.col("_range").desc() if descending else F.col("_range").asc()
    group = Window.partitionBy(*(groups or [F.lit(0)]))
    before = group.orderBy(ranges_in_order).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys,
        *[F.coalesce(F.sum(value).over(before), F.lit(0)).alias(f"_start_{value}") for value in values],
        *[F.sum(value).over(group).alias(f"all_{value}") for value in values],
    )
    within = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cut.select("*", *[F.sum(value).over(within).alias(f"_within_{value}") for value in values])
    return _join_starts(summed, starts, keys).select(
        *df.columns,
        *[(F.col(f"_start_{v}") + F.col(f"_within_{v}")).alias(f"cum_{v}") for v in values],
        *[f"all_{v}" for v in values],
    )


def ranked(df: DataFrame, score: str, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position in the order score descending, then ``order``."""
    placed = positions(df.withColumn("_all", F.lit("")), "_all", [F.col(score).desc(), *order], kept, "_pos", "_of")
    return placed.select(*df.columns, (F.col("_pos") + 1).alias(name))
