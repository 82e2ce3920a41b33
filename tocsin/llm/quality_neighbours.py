"""Quality classifier: nearest labelled neighbours in a latent-semantic space vote by similarity.

Terms of a text are hashed words, pairs of neighbouring character classes, and how much it repeats itself. A bounded
sample of labelled documents gives inverse document frequencies and a truncated singular value decomposition; the
sample's vectors are broadcast (rows and dimensions are parameters, so the size is fixed). Every document is projected
and its cosine to every labelled vector is computed exactly, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.batches import N_SHAPES, chunks, shape_pairs, words

WORD_TERMS = 4096
SHAPE_TERMS = N_SHAPES * N_SHAPES
REPEAT_TERMS = 16
TERMS = WORD_TERMS + SHAPE_TERMS + 2 * REPEAT_TERMS


@dataclass(frozen=True)
class Settings:
    """per_class: most labelled rows of each class the fit may use, smallest hash of the id first."""

    per_class: int = 1500
    dimensions: int = 48
    neighbours: int = 31
    power: float = 6.0
    block: int = 256
    threshold: float = 0.7


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of all terms, a row for each text of a chunk."""
    n = len(offsets) - 1
    hashes, counts = words(data, offsets)
    owner = np.repeat(np.arange(n), counts)
    out = np.zeros((n, TERMS), dtype=np.float32)
    bucket = (hashes % np.uint64(WORD_TERMS)).astype(np.int64)
    out[:, :WORD_TERMS] = np.bincount(owner * WORD_TERMS + bucket, minlength=n * WORD_TERMS).reshape(n, -1)
    codes, of = shape_pairs(data, offsets)
    low, high = WORD_TERMS, WORD_TERMS + SHAPE_TERMS
    out[:, low:high] = np.bincount(of * SHAPE_TERMS + codes, minlength=n * SHAPE_TERMS).reshape(n, -1)
    # Shares of words equal to the one before, and of words seen before in the text, as one term for each level.
    before = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
    order = np.lexsort((hashes, owner))
    seen = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again = np.bincount(owner[order][1:][seen], minlength=n)
    for k, share in enumerate((before / np.maximum(counts, 1), again / np.maximum(counts, 1))):
        level = np.minimum((share * REPEAT_TERMS).astype(int), REPEAT_TERMS - 1)
        # As heavy as the words together: repetition weighs the same in short and long texts.
        out[np.arange(n), high + k * REPEAT_TERMS + level] = np.where(level > 0, counts, 0)
    return out


class Model:
    """What goes to the executors: term weights, projection, labelled vectors with their vote weights."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int]], shares: dict[int, float], settings: Settings):
        self.settings = settings
        self.prior = shares.get(1, 0.5)
        labels = np.array([label for _, _, label in rows], dtype=np.float64)
        df = np.zeros(TERMS, dtype=np.int64)
        for index, _, _ in rows:
            df[index] += 1  # a term stands once in a row's list
        self.idf = np.log((1 + len(rows)) / (1 + df)).astype(np.float32)

        def parts() -> Iterator[tuple[int, np.ndarray]]:
            """The weighted rows in blocks, so that never more than a block of them is laid out in full."""
            for at in range(0, len(rows), settings.block):
                block = rows[at : at + settings.block]
                terms = np.zeros((len(block), TERMS), dtype=np.float32)
                for i, (index, value, _) in enumerate(block):
                    terms[i, index] = value
                yield at, self.weighted(terms)

        self.basis = _leading(parts, len(rows), settings.dimensions)
        vectors = [part @ self.basis for _, part in parts()]
        self.vectors = _unit(np.concatenate(vectors)) if vectors else np.zeros((0, self.basis.shape[1]), np.float32)
        self.labels = labels
        # A vote counts as its class in all labelled rows, not as in the sample.
        self.vote = np.array([shares.get(int(y), 0.0) / max(1, (labels == y).sum()) for y in labels])

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of the neighbours' similarity that is for label 1; the labelled share without any neighbour."""
        out = np.full(len(counts), self.prior)
        k = min(self.settings.neighbours, len(self.labels))
        if not k:
            return out
        for at in range(0, len(counts), self.settings.block):
            part = _unit(self.weighted(counts[at : at + self.settings.block]) @ self.basis)
            cosine = part @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(np.float64) ** self.settings.power
            weight = weight * self.vote[near]
            total = weight.sum(axis=1)
            ok = total > 0
            out[at : at + len(part)][ok] = (weight * self.labels[near]).sum(axis=1)[ok] / total[ok]
        return np.clip(out, 0.0, 1.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _leading(parts: Callable[[], Iterator[tuple[int, np.ndarray]]], rows: int, k: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start, over blocks of rows."""
    k = min(k, rows, TERMS)
    basis = np.random.default_rng(7).standard_normal((TERMS, k)).astype(np.float32)
    for _ in range(6 if k else 0):
        product = np.zeros((TERMS, k), dtype=np.float32)
        for _, part in parts():
            product += part.T @ (part @ basis)
        basis, _ = np.linalg.qr(product)
    return np.ascontiguousarray(basis, dtype=np.float32)


def held_out(doc_id: str = "doc_id"):
    """Rows whose label is never learnt from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[DataFrame, dict[int, float]]:
    """Up to per_class labelled documents of each class outside the held-out rows, and the classes' shares."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & ~held_out())
    counts = {row["quality"]: row["count"] for row in known.groupBy("quality").count().collect()}
    picked = None
    for label in (0, 1):
        one = known.where(F.col("quality") == label).dropDuplicates(["doc_id"])
        one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.per_class)
        picked = one if picked is None else picked.unionByName(one)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = max(1, sum(counts.values()))
    return texts.join(picked, "doc_id"), {label: n / total for label, n in counts.items()}


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from the labelled sample. Only it comes to the driver, as term counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                counts = term_counts(data, offsets)
                found = [np.flatnonzero(row) for row in counts]
                columns = [
                    batch.column("doc_id").slice(low, high - low),
                    batch.column("quality").slice(low, high - low),
                    pa.array([f.astype("<i4").tobytes() for f in found], pa.binary()),
                    pa.array([row[f].astype("<f4").tobytes() for row, f in zip(counts, found)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "at", "n"])

    sample, shares = labelled_sample(docs, labels, settings)
    rows = sample.mapInArrow(run, "doc_id bigint, quality int, at binary, n binary").collect()
    rows.sort(key=lambda row: (row["doc_id"], bytes(row["at"])))
    return Model(
        [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<f4"), r["quality"]) for r in rows], shares, settings
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    A text without terms (null, empty, only spaces have few or none) that is like no labelled one gets the labelled
    share of class 1, as does every text when there are no labels. Long texts are read whole, one at a time. Equal
    texts have equal scores; rows repeated stay repeated. Other columns are not read. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                for at in range(0, high - low, 512):
                    part = offsets[at : min(at + 512, high - low) + 1]
                    scores = sent.value.scores(term_counts(data[part[0] : part[-1]], part - part[0]))
                    names = batch.column("doc_id").slice(low + at, len(part) - 1)
                    yield pa.RecordBatch.from_arrays([names, pa.array(scores, pa.float64())], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= model.settings.threshold).cast("int").alias("predicted"),
    )


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit on the labels outside the held-out rows and score every document."""
    return score(docs, fit(docs, labels, settings))


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""
    bad = classify(docs, labels, settings).where("predicted = 0").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_anti")
