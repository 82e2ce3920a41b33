"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a hash of its id. A source's share of the mix is a number of whole passes over its documents plus
one partial pass: the documents whose hash lies below a threshold. Thresholds are found from sums of sizes by source
and hash bucket: the bucket where the running sum crosses the budget is refined again and again, only with its own
rows, until a bucket is a single hash value. Nothing is sorted, and a smaller budget's documents are always among a
larger one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.common import WORD, text_or_empty, written

#: Fixed values of the contract.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2

HASH_BITS = 60
STEP_BITS = 12


def hashed_sizes(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, number of words, and 60 bits of the hash of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"),
    )


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS
) -> DataFrame:
    """One row per source: size, target.

    Sharing by weight, capping at `most` times the size and sharing the excess again ends where target =
    min(cap, weight * level) with one level for all. In the order of cap / weight the capped sources come first, so
    the level is the first one at which its own source is not above, which is the largest of those that fit their own
    source: every further cap taken off lowers it. The windows see one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ratio = F.col("cap") / F.col("weight")
    whole = Window.partitionBy()
    upto = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ratio", ratio).withColumn("capped_before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    rows = rows.withColumn(
        "weight_from", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    )
    budget = F.sum("source_size").over(whole) * F.lit(share)
    rows = rows.withColumn("own_level", (budget - F.col("capped_before")) / F.col("weight_from"))
    rows = rows.withColumn("level", F.max(F.when(F.col("own_level") <= F.col("ratio"), F.col("own_level"))).over(whole))
    # No level: every source is at its cap.
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def _same_source(left: DataFrame, right: DataFrame) -> Column:
    return left["source"].eqNullSafe(right["source"])


def thresholds(sizes: DataFrame, budgets: DataFrame, bits: int = HASH_BITS, step: int = STEP_BITS) -> DataFrame:
    """One row per source: `below` takes every hash under it, so that the taken size comes nearest to the budget.

    sizes: source, size, hash. budgets: source, budget (at most the source's size). Each round sums the sizes of one
    more part of the hash; rows outside the boundary bucket leave, so the second round reads about one row in 4096.
    """
    open_rows = sizes.select("source", "size", "hash")
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("sum"))
    left = bits
    while left:
        width = min(step, left)
        left -= width
        part = F.shiftright(F.col("hash"), left).bitwiseAND(F.lit((1 << width) - 1))
        sums = (
            open_rows.withColumn("part", part)
            .groupBy(F.col("source").alias("of"), "part")
            .agg(F.sum("size").alias("part_size"))
        )
        each = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        runs = (
            state.join(sums, state["source"].eqNullSafe(sums["of"]))
            .withColumn("upto", F.col("sum") + F.sum("part_size").over(each))
            .where(F.col("upto") > F.col("budget"))
        )
        first = runs.groupBy("source").agg(
            F.min_by(F.struct("part", (F.col("upto") - F.col("part_size")).alias("before"), "upto"), "part").alias("at")
        )
        first = first.select(F.col("source").alias("of"), "at")
        # A source without such a bucket stays within its budget with all its rows.
        after = state.join(first, state["source"].eqNullSafe(first["of"]), "left").select(
            "source",
            "budget",
            F.when(F.col("at").isNull(), F.lit(1 << bits)).otherwise(
                F.col("start") + F.shiftleft(F.col("at.part"), left)
            ).alias("start"),
            F.coalesce("at.before", "sum").alias("sum"),
            F.col("at.upto").alias("upto"),
        )
        after = written(after, f"thresholds_{left}")
        state = after.select("source", "budget", "start", "sum")
        bound = after.select(F.col("source").alias("of"), F.shiftright("start", left).alias("bucket"))
        open_rows = (
            open_rows.withColumn("bucket_of", F.shiftright("hash", left))
            .join(bound, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket_of") == F.col("bucket")), "left_semi")
            .select("source", "size", "hash")
        )
        if left + width == bits:
            open_rows = written(open_rows, "boundary")  # about one row in 4,096, read by all further rounds
    # The last bucket is one hash value; it is taken where that comes nearer to the budget than leaving it.
    nearer = (F.col("upto") - F.col("budget")) < (F.col("budget") - F.col("sum"))
    return after.select("source", (F.col("start") + F.coalesce(nearer, F.lit(False)).cast("long")).alias("below"))


def _mixed(docs: DataFrame, seed: str, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row. Copies depend on the id and the source alone."""
    sizes = written(hashed_sizes(docs, seed), "sizes")
    targets = written(source_targets(sizes, weights, share, most), "targets")
    passes = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(
        F.floor(F.col("target") / F.col("source_size"))
    ).cast("long")
    plan = targets.withColumn("passes", passes).withColumn(
        "budget", F.col("target") - F.col("passes") * F.col("source_size")
    )
    below = thresholds(sizes, plan.select("source", "budget"))
    below = below.withColumnRenamed("source", "of")
    plan = plan.join(below, plan["source"].eqNullSafe(below["of"])).drop("of", "budget").withColumnRenamed("source", "of")
    # A source whose target is a whole number of passes has budget 0: its threshold is at its first document at most.
    copies = F.col("passes") + F.when(
        (F.col("passes") < most) & (F.col("hash") < F.col("below")), F.lit(1)
    ).otherwise(F.lit(0))
    joined = sizes.join(plan, sizes["source"].eqNullSafe(plan["of"])).withColumn("copies", copies)
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies")


def mix(
    docs: DataFrame,
    seed: str = "mix",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every row.

    Other columns of the input are not read, so their names cannot clash. A null source is a source of its own, the
    last one. Null and empty texts have size 0 and are taken like others at no cost. Rows repeated with the same id
    have the same hash and are taken together. An empty table gives no rows.
    """
    found = _mixed(docs, seed, weights, share, most)
    return found.select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_documents(
    docs: DataFrame, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS
) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns.

    Rows meet their copies by id and source, nulls included, so an id that several sources share is taken from each as
    the mix says, and reruns agree.
    """
    found = _mixed(docs, seed, weights, share, most).where("copies > 0")
    copies = found.select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__of"), F.col("copies").cast("int").alias("__n")
    ).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__of"))
    return docs.join(copies, same).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


#: DuckDB SQL for mix() with the contract's numbers.
SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0.0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS own_level
  FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least(cap, coalesce(weight * max(CASE WHEN own_level <= ratio THEN own_level END) OVER (), cap)) AS target
  FROM l),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS passes FROM t),
h AS (SELECT source, hash, sum(size)::BIGINT AS own FROM d GROUP BY source, hash),
c AS (SELECT *, sum(own) OVER (PARTITION BY source ORDER BY hash) AS upto FROM h),
b AS (
  SELECT p.source, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS budget, c.hash, c.upto, c.own,
         max(CASE WHEN c.upto <= p.target - p.passes * p.source_size THEN c.upto ELSE 0 END) OVER (PARTITION BY p.source) AS before
  FROM p JOIN c ON p.source IS NOT DISTINCT FROM c.source)
SELECT d.doc_id, d.size, b.source_size, b.target,
       b.passes + CASE WHEN b.passes < 2 AND (b.upto <= b.budget
           OR (b.upto - b.own = b.before AND b.upto - b.budget < b.budget - b.before)) THEN 1 ELSE 0 END AS copies,
       d.size * (b.passes + CASE WHEN b.passes < 2 AND (b.upto <= b.budget
           OR (b.upto - b.own = b.before AND b.upto - b.budget < b.budget - b.before)) THEN 1 ELSE 0 END) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.hash = b.hash
"""
