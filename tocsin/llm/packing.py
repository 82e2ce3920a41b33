"""Best-fit packing of documents into sequences of a fixed number of tokens, with certified bounds.

Pieces are dealt to partitions of bounded size, and each is packed by best fit in decreasing order. Dual feasible
functions give a lower bound for the bins of each partition and for all of them. While all bins together are more than
the bound, partitions release documents: one whose bins meet its bound keeps all but its least filled bin, one with a gap
keeps only full bins. What is released is dealt anew, across partitions, and packed again; a round that saves nothing
is undone. Full pieces are sequences of their own.

Null and empty texts are one piece, the closing id. Rows with the same id are documents of their own, and so are repeated
rows. Long texts are cut only where they are longer than a sequence. An empty table gives no rows. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.chunk_tokens import chunk_tokenizer, text_groups, words_apart
from tocsin.llm.common import written

DEFAULT_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Pieces that one task packs at a time, on average (24 bytes each).
PER_TASK = 50_000

#: Rounds of exchange at most; a packing that stops here is whole, only its gap may be open.
ROUNDS = 8


def pieces(
    docs: DataFrame, tokenizer_file: str = DEFAULT_TOKENIZER, capacity: int = 4096, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids if asked for, and ``_key``, a number of its own for every piece.

    The tokenizer file is read by the tasks; its path must hold on every executor. The result is written once.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    last = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chunk_tokenizer(tokenizer_file, words_apart, plain=False)
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            doc_ids = batch.column("doc_id").to_pylist()
            for first, end in text_groups(texts):
                out: list[tuple] = []
                for doc_id, found in zip(doc_ids[first:end], tokenizer.encode_all(texts[first:end])):
                    ids = found + last
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        row = (doc_id, piece, start, len(own) // 4, zlib.crc32(own))
                        out.append((*row, np.frombuffer(own, "<i4")) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return written(rows.mapInArrow(run, schema).withColumn("_key", F.monotonically_increasing_id()), "pieces")


def lower_bound(counts: np.ndarray) -> int:
    """Least number of bins, by dual feasible functions. counts: items of each size, 0 to the capacity.

    The functions sum to at most one over any set of sizes that fits into a bin, so the rounded-up sum over all items is
    a bound: sizes above C - e as whole bins and below e as nothing, for all e; (k + 1)-fold sizes rounded down over k;
    and, for all e, half-open steps of e above C / 2 with equal shares below.
    """
    capacity = len(counts) - 1
    if capacity < 1 or not counts.any():
        return 0
    sizes = np.flatnonzero(counts)
    times = counts[sizes].astype(np.int64)
    volume = np.concatenate([[0], np.cumsum(np.arange(capacity + 1) * counts.astype(np.int64))])
    number = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    e = np.arange(capacity // 2 + 1)
    whole = number[-1] - number[capacity - e + 1]
    best = int((whole - (-(volume[capacity - e + 1] - volume[e]) // capacity)).max())
    for k in range(1, 33):
        rounded = np.where((k + 1) * sizes % capacity == 0, k * sizes, capacity * ((k + 1) * sizes // capacity))
        best = max(best, -(-int((rounded * times).sum()) // (capacity * k)))
    large = sizes * 2 > capacity
    for step in range(1, capacity // 2 + 1):
        share = capacity // step
        value = np.where(large, share - (capacity - sizes) // step, sizes >= step)
        best = max(best, -(-int((value * times).sum()) // share))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place in the bin of each item, and the fill of each bin; items are placed in the order given.

    An item goes to the fullest bin that still takes it. The rests that bins have are bits of one number.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
    rests = 0
    for item, size in enumerate(sizes.tolist()):
        fitting = rests >> size
        if fitting:
            rest = size + (fitting & -fitting).bit_length() - 1
            stack = by_rest[rest]
            chosen = stack.pop()
            if not stack:
                rests ^= 1 << rest
        else:
            rest, chosen = capacity, len(fills)
            fills.append(0)
        bins[item], offsets[item] = chosen, fills[chosen]
        fills[chosen] += size
        rest -= size
        if rest:
            by_rest[rest].append(chosen)
            rests |= 1 << rest
    return bins, offsets, np.array(fills, np.int64)


class Packing(NamedTuple):
    """rows: the pieces with sequence_id and offset. sequences: their number. bound: no packing has fewer."""

    rows: DataFrame
    sequences: int
    bound: int


_PLACED = "sequence_id bigint, offset bigint, _open boolean"


def _packed(items: DataFrame, parts: int, seed: int, capacity: int) -> DataFrame:
    """Items dealt to ``parts`` by a hash and packed there. _open: the item's bin may be released."""
    dealt = items.withColumn("_part", F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(parts)))

    def run(group: pa.Table) -> pa.Table:
        keys, sizes = group.column("_key").to_numpy(), group.column("length").to_numpy()
        order = np.lexsort((keys, -sizes))
        bins, offsets, fills = best_fit(sizes[order], capacity)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1))
        names = np.full(len(fills), np.iinfo(np.int64).max)
        np.minimum.at(names, bins, keys[order])
        may_go = fills < capacity if len(fills) > bound else np.arange(len(fills)) == fills.argmin()
        out = group.drop_columns(["_part"]).take(pa.array(order))
        for name, values in (("sequence_id", names[bins]), ("offset", offsets), ("_open", may_go[bins])):
            out = out.append_column(name, pa.array(values))
        return out

    kinds = ", ".join(f"{name} {kind}" for name, kind in items.dtypes)
    return dealt.groupBy("_part").applyInArrow(run, f"{kinds}, {_PLACED}")


def pack(items: DataFrame, capacity: int = 4096, per_task: int = PER_TASK, rounds: int = ROUNDS) -> Packing:
    """items: ``_key`` (unique), ``length`` (1 to the capacity) and further columns, from a written table.

    A sequence is named by its smallest key.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in items.groupBy("length").count().collect():  # one row per length, so the capacity bounds them
        if length is None or not 1 <= length <= capacity:
            raise ValueError(f"A piece has 1 to {capacity} tokens, not {length}.")
        counts[length] = n
    bound, closed = lower_bound(counts), int(counts[capacity])
    own = [F.col("_key").alias("sequence_id"), F.lit(0).cast("long").alias("offset")]
    done = [items.where(F.col("length") == capacity).select(*items.columns, *own)]
    pool, pool_bins, pool_items = items.where(F.col("length") < capacity), None, int(counts[:capacity].sum())
    for seed in range(rounds):
        if not pool_items:
            break
        parts = -(-pool_items // per_task)
        now = written(_packed(pool.select(*items.columns), parts, seed, capacity), "packed")
        first = F.col("offset") == 0
        bins, open_bins, open_items = now.agg(
            F.count_if(first), F.count_if(first & F.col("_open")), F.count_if(F.col("_open"))
        ).first()
        if pool_bins is not None and bins >= pool_bins:
            if parts == 1:
                break
            continue  # the packing before stays; another deal may do better
        pool, pool_bins, pool_items = now, bins, int(open_items)
        if closed + bins == bound or parts == 1 or seed + 1 == rounds:
            break
        done.append(now.where(~F.col("_open")).drop("_open"))
        closed, pool, pool_bins = closed + bins - open_bins, now.where("_open"), open_bins
    if pool_bins is not None:
        done.append(pool.drop("_open"))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return Packing(rows, closed + (pool_bins or 0), bound)


def pack_documents(
    docs: DataFrame, tokenizer_file: str = DEFAULT_TOKENIZER, capacity: int = 4096, end_id: int = 1, per_task: int = PER_TASK
) -> Packing:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    found = pack(pieces(docs, tokenizer_file, capacity, end_id), capacity, per_task)
    return found._replace(rows=found.rows.drop("_key"))


def sequences(
    docs: DataFrame, tokenizer_file: str = DEFAULT_TOKENIZER, capacity: int = 4096, end_id: int = 1, per_task: int = PER_TASK
) -> DataFrame:
    """sequence_id, ids (at most ``capacity``), doc_ids in the order of their pieces."""
    whole = pieces(docs, tokenizer_file, capacity, end_id, with_ids=True)
    places = pack(whole.select("_key", "length"), capacity, per_task).rows.select("_key", "sequence_id", "offset")
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return whole.join(places, "_key").groupBy("sequence_id").agg(parts.alias("_parts")).select(
        "sequence_id", F.flatten("_parts.ids").alias("ids"), F.col("_parts.doc_id").alias("doc_ids")
    )
