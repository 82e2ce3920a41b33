"""Isotonic regression of 0/1 labels on a score, pooled range by range.

Scores are cut into ranges, and adjacent violators are pooled inside each range in one pass over its sorted rows. What is
left of a range is a short list of blocks. While the last block of a range is not below the first one of the next, lists
of neighbouring ranges are put together and pooled again; only blocks move. Pooling in any order gives the same blocks.
Blocks have distinct rising shares of positives, so n rows leave at most about n to the power 2/3 of them, and the last
merge, if it comes to that, holds no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tocsin.operators.ranges import in_ranges, part_of

BLOCK = "part bigint, lo double, hi double, rows bigint, positives bigint"

#: Neighbouring ranges whose lists are merged in one round.
FAN = 16

#: Cells of scores in which a block is looked up, and the most blocks that are sent to every executor (48 bytes each).
CELLS, MOST_SENT = 4_096, 500_000


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by part and score become pooled blocks. One part's blocks are held at a time."""
    names = [field.split()[0] for field in BLOCK.split(", ")]
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    current, blocks = None, []

    def flushed() -> pa.RecordBatch:
        columns = zip(*[(current, *block) for block in blocks])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        for part, lo, hi, rows, positives in zip(*[batch.column(name).to_pylist() for name in names]):
            if part != current:
                if blocks:
                    yield flushed()
                current, blocks = part, []
            while blocks and blocks[-1][3] * rows >= positives * blocks[-1][2]:
                lo, _, more, found = blocks.pop()
                rows, positives = rows + more, positives + found
            blocks.append((lo, hi, rows, positives))
    if blocks:
        yield flushed()


def _value(rows: str = "rows", positives: str = "positives") -> Column:
    return F.col(positives) / F.col(rows)


def _still_crossing(blocks: DataFrame) -> bool:
    """Whether a range ends with a block that is not below the next range's first; one row per range is compared."""
    edges = blocks.groupBy("part").agg(
        F.min_by(_value(), "lo").alias("first"), F.max_by(_value(), "lo").alias("last")
    )
    before = F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("part"))
    return not edges.select((before >= F.col("first")).alias("bad")).where("bad").isEmpty()


def pooled_blocks(
    points: DataFrame, write: Callable[[DataFrame, str], DataFrame], fan: int = FAN
) -> DataFrame:
    """Blocks (lo, hi, rows, positives) of points (score, rows, positives) with distinct scores, and their range."""
    ranges = in_ranges(points.select("score", "rows", "positives"), [F.col("score").asc()]).select(
        part_of().alias("part"), F.col("score").alias("lo"), F.col("score").alias("hi"), "rows", "positives"
    )
    blocks = write(ranges.mapInArrow(_pool, BLOCK), "blocks")
    while _still_crossing(blocks):
        merged = blocks.withColumn("_wide", F.expr(f"part div {fan}L")).repartition("_wide")
        lists = merged.sortWithinPartitions("_wide", "lo").select(F.col("_wide").alias("part"), "lo", "hi", "rows", "positives")
        blocks = write(lists.mapInArrow(_pool, BLOCK), "blocks")
    return blocks


@dataclass(frozen=True)
class IsotonicMap:
    """A rising map from scores to shares: constant on blocks, linear between them, constant beyond the outer ones.

    steps: one row per block with its cell, where it begins (null for the first) and where the next one begins.
    """

    steps: DataFrame
    cuts: tuple[float, ...]
    small: bool

    def _cell(self, df: DataFrame, column: str, out: str) -> DataFrame:
        if not self.cuts:
            return df.withColumn(out, F.lit(0.0))
        splits = [float("-inf"), *self.cuts, float("inf")]
        return Bucketizer(splits=splits, inputCol=column, outputCol=out, handleInvalid="keep").transform(df)

    def apply(self, df: DataFrame, score: str, out: str) -> DataFrame:
        """The rows with ``out``; null where the score is null or NaN. Blocks are met in an equi-join on the cell."""
        rows = self._cell(df.withColumn("_x", F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))), "_x", "_cell")
        steps = self._cell(self.steps, "_lo", "_cell_of")
        steps = F.broadcast(steps) if self.small else steps
        x = F.col("_x")
        inside = (
            (F.col("_cell") == F.col("_cell_of"))
            & (F.col("_from").isNull() | (x >= F.col("_from"))) & (F.col("_next").isNull() | (x < F.col("_next")))
        )
        between = F.col("_y") + (F.col("_next_y") - F.col("_y")) * (x - F.col("_hi")) / (F.col("_next") - F.col("_hi"))
        value = F.when((x <= F.col("_hi")) | F.col("_next").isNull(), F.col("_y")).otherwise(between)
        found = rows.join(steps, inside, "left")
        return found.select(*[c for c in df.columns if c != out], F.when(x.isNotNull(), value).alias(out))


def isotonic_map(
    points: DataFrame, write: Callable[[DataFrame, str], DataFrame], fan: int = FAN, cells: int = CELLS
) -> IsotonicMap:
    """Fit on points (score, rows, positives) with distinct scores that are neither null nor NaN."""
    blocks = pooled_blocks(points, write, fan)
    own = Window.partitionBy("part").orderBy("lo")
    ranges = Window.partitionBy(F.lit(0)).orderBy("part")  # one row per range
    firsts = blocks.groupBy("part").agg(F.min("lo").alias("_lo"), F.min_by(_value(), "lo").alias("_y"))
    borders = firsts.select(
        "part", F.lead("_lo").over(ranges).alias("_border"), F.lead("_y").over(ranges).alias("_border_y"),
        (F.lag("_lo").over(ranges).isNull()).alias("_first_part"),
    )
    joined = blocks.join(borders, "part")
    steps = write(
        joined.select(
            F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), _value().alias("_y"),
            F.when(~(F.col("_first_part") & F.lag("lo").over(own).isNull()), F.col("lo")).alias("_from"),
            F.coalesce(F.lead("lo").over(own), "_border").alias("_next"),
            F.coalesce(F.lead(_value()).over(own), "_border_y").alias("_next_y"),
        ),
        "steps",
    )
    shares = [k / cells for k in range(1, cells)] or [0.0]
    count, least, cuts = steps.agg(F.count("*"), F.min("_lo"), F.percentile_approx("_lo", shares, 50_000)).first()
    # Each cut is where a block begins, so no block lies in two cells; the first block reaches down without end.
    return IsotonicMap(steps, tuple(sorted({cut for cut in cuts or () if cut > least})), count <= MOST_SENT)
