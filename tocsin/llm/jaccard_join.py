"""Near duplicates: all documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

A size-aware join over distinct sets. Two sets of n and m shingles link when they share c(n, m) = ceil(4 (n + m) / 9)
of them, and then they miss so few that both show a common shingle early in any fixed order of all shingles.

1. Survivors. From every distinct set only the shingles below a fixed hash value are exploded (a quarter of them, at
   least as many as the bound needs) and counted. A set whose early places are all taken by shingles of its own has no
   partner; most sets of a corpus leave here, exactly.
2. Lists. All shingles of the survivors are counted and ordered from rare to frequent. Large sets go to the inverted
   lists of their early shingles. Small sets with a small partner meet in lists of fixed-size subsets: if they link,
   they share a subset of c(n, m) shingles. The boundary between small and large is where the number of subsets,
   counted from the sizes at hand, begins to exceed the cost of postings.
3. Links. In each list first only the most central set (the one with the most frequent shingles) meets the others.
   Links found so far make components; then only sets of different components still meet, and of those only the ones
   outside a list's largest component are paired with the rest. A group of thousands of near copies costs a row for
   each member, not for each pair, and no link between different components is left out.

Every pair is checked against the whole sets. Places in the order cut most pairs before that: sets at places p and q of
a list share at most 1 + min(n - p, m - q) shingles.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.batches import chunks, mixed, words
from tocsin.llm.common import Scratch, sendable, written
from tocsin.llm.connected import components

#: Fixed values of the contract.
WORDS = 5

#: Share of the hash range whose shingles are counted for the survivors.
FIRST_SHARE = 0.25
#: No set beyond this size is ever small: subsets are too many whatever the costs.
SMALLEST_LARGE = 17
#: Cost of a shingle in the lists against that of a subset: it is counted, joined to its count and ranked before.
POSTING_COST = 4

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def needed(n: int, m: int) -> int:
    """Shingles that sets of n and m must share: 100 i >= 80 (n + m - i)."""
    return -(-4 * (n + m) // 9)


def early(n: int) -> int:
    """Places of the order in which a set of n shows a common shingle, whatever its partner's size."""
    return n - needed(n, -(-4 * n // 5)) + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text."""
    hashes, counts = words(data, offsets, lower=True)
    ends = np.concatenate([[0], np.cumsum(counts)])
    n = len(hashes) - WORDS + 1
    rows = mixed(sum(hashes[k : n + k] * _FACTORS[k] for k in range(WORDS))) if n > 0 else hashes[:0]
    out = []
    for start, count in zip(ends, counts):
        if count >= WORDS:
            out.append(np.unique(rows[start : start + count - WORDS + 1]))
        elif count:
            short = (hashes[start : start + count] * _FACTORS[:count]).sum(dtype=np.uint64)
            out.append(mixed(np.array([short + np.uint64(count)])))
        else:
            out.append(hashes[:0])
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(a) for a in arrays)])
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def first_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, digest of the whole set, n_first, first: the shingles below the fixed value, and at least the early ones."""
    limit = np.uint64(int(FIRST_SHARE * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                sets = shingle_sets(data, offsets)
                below = [int(np.searchsorted(s, limit)) for s in sets]
                first = [s[: max(b, early(len(s)) if len(s) else 0)] for s, b in zip(sets, below)]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                columns = [
                    batch.column("doc_id").slice(low, high - low),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    _lists(first),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "first"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, n bigint, digest binary, first array<bigint>")


def whole_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                sets = shingle_sets(data, offsets)
                ids = batch.column("doc_id").slice(low, high - low)
                columns = [ids, pa.array([len(s) for s in sets], pa.int64()), _lists(sets)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, n bigint, shingles array<bigint>")


def rows_of(docs: DataFrame, near: DataFrame) -> DataFrame:
    """doc_id, text of the survivors. Only ids that are listed more than once need a shuffle to become one row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    once = docs.join(sendable(near.where("count = 1").select("doc_id")), "doc_id", "left_semi")
    again = docs.join(sendable(near.where("count > 1").select("doc_id")), "doc_id", "left_semi")
    return once.unionByName(again.dropDuplicates(["doc_id"]))


def _needed(n: Column, m: Column) -> Column:
    return F.ceil((n + m) * 4 / 9)


def _early(n: Column) -> Column:
    return n - _needed(n, F.ceil(n * 4 / 5)) + 1


def _shared_only(postings: DataFrame) -> DataFrame:
    """Postings of shingles that stand in two sets or more, with that number."""
    counts = postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    return postings.join(counts.hint("shuffle_hash"), "key")


def survivors(distinct: DataFrame) -> DataFrame:
    """doc_id of the distinct sets that may have a partner.

    The order here puts the shingles below the fixed value first, by their number of sets. Shingles beyond it, which
    only sets with few below it need, keep their set in play, since their numbers are not known. A set that is listed
    twice with the same id counts its shingles twice, which keeps it in play too.
    """
    limit = int(FIRST_SHARE * 2**64)
    # Signed values from -2^63: unsigned value below the limit means 0 <= value < limit here, as the share is below half.
    assert limit < 2**63
    postings = distinct.select("doc_id", F.explode("first").alias("key"))
    low = postings.where((F.col("key") >= 0) & (F.col("key") < limit))
    shared = _shared_only(low).groupBy("doc_id").agg(F.count("*").alias("n_shared"))
    n_low = F.size(F.filter("first", lambda x: (x >= 0) & (x < limit)))
    rows = distinct.select("doc_id", "n", n_low.alias("n_low")).join(shared, "doc_id", "left")
    own = F.col("n_low") - F.coalesce("n_shared", F.lit(0))
    # Some place up to the bound is a shared shingle, or lies beyond the counted ones.
    return rows.where((own < _early(F.col("n"))) & ((F.col("n_shared") > 0) | (F.col("n_low") < _early(F.col("n"))))).select("doc_id")


def _subset_count(n: int, small: int) -> int:
    """Subsets that a set of n gives for all partners of up to `small` shingles."""
    return sum(comb(n, needed(n, m)) for m in range(-(-4 * n // 5), min(small, 5 * n // 4) + 1))


def boundary(sizes: dict[int, int]) -> int:
    """Largest size that counts as small: where subsets save most against postings. sizes: sets by size."""
    saved = {0: 0}
    for b in range(1, SMALLEST_LARGE):
        subsets = sum(k * _subset_count(n, b) for n, k in sizes.items() if n <= b)
        # All shingles of a set are counted. Sets near the boundary have large partners too and stay in the lists.
        postings = sum(k * n for n, k in sizes.items() if 5 * n < 4 * (b + 1))
        saved[b] = POSTING_COST * postings - subsets
    return max(saved, key=lambda b: (saved[b], -b))


def subset_lists(sets: DataFrame, small: int) -> DataFrame:
    """key, doc_id, n, place: lists of the fixed-size subsets of small sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, sizes = [], [], []
            for doc_id, n, row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "shingles"))):
                for m in range(-(-4 * n // 5), min(small, 5 * n // 4) + 1):
                    for subset in itertools.combinations(row, needed(n, m)):
                        name = np.array([min(n, m), max(n, m), *subset], np.int64).tobytes()
                        keys.append(int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little", signed=True))
                        ids.append(doc_id)
                        sizes.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], ["key", "doc_id", "n"]
            )

    rows = sets.where((F.col("n") > 0) & (F.col("n") <= small)).mapInArrow(run, "key bigint, doc_id bigint, n bigint")
    # A subset of the needed size is enough by itself: the place cuts nothing.
    return rows.select("key", "doc_id", "n", F.lit(1).cast("long").alias("place"), F.lit(0.0).alias("central"))


def shingle_lists(sets: DataFrame, small: int) -> DataFrame:
    """key, doc_id, n, place, central: inverted lists of the early shingles, ordered from rare to frequent."""
    large = sets.where(5 * F.col("n") >= 4 * (small + 1))
    shared = _shared_only(large.select("doc_id", "n", F.explode("shingles").alias("key")))
    of = Window.partitionBy("doc_id")
    rank = F.row_number().over(of.orderBy("df", "key"))
    n_shared = F.count("*").over(of)
    rows = shared.withColumn("place", F.col("n") - n_shared + rank)
    rows = rows.withColumn("central", F.sum("df").over(of) / F.col("n"))
    return rows.where(F.col("place") <= _early(F.col("n"))).select("key", "doc_id", "n", F.col("place").cast("long").alias("place"), "central")


def _may_link(a: str, b: str) -> Column:
    """Whether the places of two sets in a list leave room for enough common shingles."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    room = F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place")) + 1
    return room >= _needed(n, m)


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def central_pairs(lists: DataFrame) -> DataFrame:
    """a, b: the most central set of each list with every other one."""
    best = F.max(F.struct("central", F.bitwise_not("doc_id").alias("down"), "n", "place")).alias("best")
    hubs = lists.groupBy("key").agg(best, F.count("*").alias("k")).where("k > 1")
    hubs = hubs.select("key", F.bitwise_not("best.down").alias("doc_id"), "best.n", "best.place")
    met = lists.alias("x").join(hubs.alias("y"), "key").where((F.col("x.doc_id") != F.col("y.doc_id")) & _may_link("x", "y"))
    return met.select(*_ordered(F.col("x.doc_id"), F.col("y.doc_id"))).distinct()


def crossing_pairs(lists: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: sets of different components that meet in a list. Only sets outside the list's largest component are
    taken as the first of a pair."""
    rows = lists.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    rows = rows.withColumn("component", F.coalesce("component", "doc_id"))
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("k"))
    most = parts.groupBy("key").agg(F.max(F.struct("k", "component")).alias("most"), F.count("*").alias("parts"))
    most = most.where("parts > 1").select("key", F.col("most.component").alias("main"))
    rows = scratch.written(rows.join(most, "key"), "crossing")
    outside = rows.where("component <> main")
    other = F.col("x.component") != F.col("y.component")
    # Of two sets outside, the pair is met once.
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.doc_id") < F.col("y.doc_id"))
    met = outside.alias("x").join(rows.alias("y"), "key").where(other & once & _may_link("x", "y"))
    return met.select(*_ordered(F.col("x.doc_id"), F.col("y.doc_id"))).distinct()


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("t"))
    common = F.size(F.array_intersect("s", "t"))
    both = pairs.join(one, "a").join(two, "b")
    return both.where(100 * common >= 80 * (F.size("s") + F.size("t") - common)).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Null and empty texts and texts without words have no shingles and are a component each. Shorter texts than five
    words are one shingle. Equal sets are one set throughout and get their smallest id; rows repeated with the same id
    are rows of one document. Texts are read whole. Other columns are not read. An empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        return written(_near_duplicates(docs, scratch), "near_duplicates")


def _near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    sets = scratch.written(first_sets(docs), "first_sets")
    names = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    names = scratch.written(names, "names")
    reps = sendable(names.select(F.col("rep").alias("doc_id")))
    near = survivors(sets.where("n > 0").join(reps, "doc_id", "left_semi"))
    near = scratch.written(near.groupBy("doc_id").count(), "survivors")
    whole = scratch.written(whole_sets(rows_of(docs, near)), "whole_sets")
    few = whole.where(F.col("n") < SMALLEST_LARGE).groupBy("n").count().collect()  # at most 16 rows
    small = boundary({row["n"]: row["count"] for row in few})
    lists = shingle_lists(whole, small)
    if small:
        lists = lists.unionByName(subset_lists(whole, small))
    lists = scratch.written(lists, "lists")
    first = scratch.written(links(central_pairs(lists), whole), "links")
    found = components(first, scratch)
    rest = scratch.written(links(crossing_pairs(lists, found, scratch), whole), "links")
    if not rest.isEmpty():  # the components found so far are stars by now
        stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components(stars.unionByName(rest), scratch)
    labels = names.join(found, F.col("rep") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id")
    )
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(labels, "digest", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that link, directly or not, to a smaller id; all columns stay."""
    gone = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_anti")


#: DuckDB SQL for near_duplicates(): shared shingles counted for all pairs, components by recursion.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b
      WHERE 100 * i >= 80 * (x.n_shingles + y.n_shingles - i)),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT n.doc_id, n.n_shingles, m.component_id
FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
