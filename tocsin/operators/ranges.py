"""Positions in a global order from range partitions: no single-task sort, no window over a whole group.

Rows are dealt to partitions by ranges of the order and sorted there. A row's number inside its partition and the rows
of its group in earlier partitions add up to its position, and only one small row per (group, partition) is summed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Most rows of starting values that are sent to every executor; more are joined by a shuffle.
MOST_STARTS = 100_000

#: monotonically_increasing_id() holds the partition above this bit and the row number below it.
_ROW_BITS = 33


def in_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows sorted by ranges; ``_row`` ascends with the order over all partitions.

    Write the result before reading ``_row`` twice: another run may cut the ranges elsewhere. Rows that tie in the whole
    order may be cut apart, so even a row repeated without end is dealt to several tasks.
    """
    tie = F.monotonically_increasing_id() % 1024
    return (
        df.withColumn("_tie", tie).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
        .withColumn("_row", F.monotonically_increasing_id())
    )


def part_of(row: str = "_row") -> Column:
    """The range that a row of ``in_ranges`` lies in."""
    return F.shiftright(F.col(row), _ROW_BITS)


def positions(
    df: DataFrame, group: str, order: Sequence[Column], write: Callable[[DataFrame, str], DataFrame], pos: str = "pos",
    total: str = "n",
) -> DataFrame:
    """Add ``pos`` (0-based place in its group) and ``n`` (rows of the group), or columns of the names given.

    ``group`` must not be null. ``write`` keeps a table in shared storage and returns it read back.
    """
    kept = write(in_ranges(df, [F.col(group).asc(), *order]), "ordered")
    sizes = kept.groupBy(group, part_of().alias("_part")).agg(
        F.min("_row").alias("_first"), F.count("*").alias("_rows")
    )
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = write(
        sizes.select(
            group, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
            F.sum("_rows").over(whole).alias("_total"),
        ),
        "starts",
    )
    if starts.count() <= MOST_STARTS:
        starts = F.broadcast(starts)
    return kept.withColumn("_part", part_of()).join(starts, [group, "_part"]).select(
        *df.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias(pos), F.col("_total").alias(total)
    )
