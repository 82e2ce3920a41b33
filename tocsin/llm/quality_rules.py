"""Quality rules: counts every text must pass, then a logistic regression on hashed n-grams.

The base counts are fixed rules. The method is a logistic regression over hashed words, word pairs, byte triples and
pairs of character classes, trained on a bounded sample of labelled rows, with its margin calibrated to a probability
on a part of the sample that the weights have not seen. Every document is scored in Arrow batches and judged against a
fixed probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.batches import N_SHAPES, chunks, mixed, segment_means, shape_pairs, words

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
FEWEST_WORDS = 10
MOST_REPEATED = 20  # per cent
WINDOW = 5

WORD_BITS = 15
BYTE_BITS = 14
N_WORD = 1 << WORD_BITS
N_BYTE = 1 << BYTE_BITS
#: Where each kind of n-gram starts: words, word pairs, byte triples, class pairs, whether neighbours are equal.
PLACES = np.cumsum([0, N_WORD, N_WORD, N_BYTE, N_SHAPES * N_SHAPES, 2])
N_WEIGHTS = int(PLACES[-1])


@dataclass(frozen=True)
class Settings:
    """per_class: most labelled rows of each class the fit may use, smallest hash of the id first."""

    per_class: int = 1200
    rounds: int = 150
    rate: float = 0.5
    penalty: float = 1e-4
    keep_from: float = 0.5


def repeated_words(hashes: np.ndarray) -> int:
    """Words that stand in a 5-word window found twice or more.

    Windows are compared by a 64-bit hash; only if some are equal are they ranked exactly, by pairs of ranks.
    """
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    coarse = sum(hashes[k : n + k] * np.uint64(2 * k * k + 2 * k + 0x9E3779B9 | 1) for k in range(WINDOW))
    coarse = np.sort(coarse)
    if not (coarse[1:] == coarse[:-1]).any():
        return 0
    _, one = np.unique(hashes, return_inverse=True)
    _, two = np.unique(one[:-1] * np.int64(len(one)) + one[1:], return_inverse=True)
    _, four = np.unique(two[:-2] * np.int64(len(one)) + two[2:], return_inverse=True)
    _, five, count = np.unique(four[:-1] * np.int64(len(one)) + one[4:], return_inverse=True, return_counts=True)
    covered = np.zeros(len(hashes) + 1, dtype=np.int64)
    twice = np.flatnonzero(count[five] > 1)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_COUNTS = np.zeros(256, dtype=np.int64)  # code points that are no white space
_COUNTS[[b for b in range(256) if b & 0xC0 != 0x80 and b not in (9, 10, 11, 12, 13, 32)]] = 1


def base_counts(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    def sums(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])

    ends = np.concatenate([[0], np.cumsum(counts)])
    n = len(counts)
    return {
        "n_words": counts,
        "word_chars": sums(_COUNTS[data]),
        "n_symbols": sums(_SYMBOL[data]),
        "n_dup_lines": np.array([repeated_lines(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(n)], np.int64),
        "n_repeat_words": np.array([repeated_words(hashes[ends[i] : ends[i + 1]]) for i in range(n)], np.int64),
    }


def n_grams(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: weight numbers of all n-grams in order, and how many each text has."""
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    same = owner[1:] == owner[:-1]
    pairs = mixed(hashes[:-1] * np.uint64(3) + hashes[1:])[same]
    equal = (hashes[:-1] == hashes[1:])[same].astype(np.int64)
    pair_counts = np.maximum(counts - 1, 0)
    wide = data.astype(np.uint32)
    triples = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:] if len(data) > 2 else np.zeros(0, np.uint32)
    place = np.repeat(np.arange(n), np.diff(offsets))
    inside = place[2:] == place[:-2] if len(data) > 2 else np.zeros(0, bool)
    triples = ((triples * np.uint32(2654435761)) >> np.uint32(32 - BYTE_BITS))[inside].astype(np.int64)
    codes, of = shape_pairs(data, offsets)
    bits = np.uint64(64 - WORD_BITS)
    return [
        ((hashes >> bits).astype(np.int64) + PLACES[0], counts),
        ((pairs >> bits).astype(np.int64) + PLACES[1], pair_counts),
        (triples + PLACES[2], np.maximum(np.diff(offsets) - 2, 0)),
        (codes + PLACES[3], np.bincount(of, minlength=n)),
        (equal + PLACES[4], pair_counts),
    ]


def margins(weights: np.ndarray, bias: float, grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Bias plus, for each kind, the mean weight of a text's n-grams."""
    return bias + sum(segment_means(weights[at], counts) for at, counts in grams)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    settings: Settings

    def probabilities(self, grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return _sigmoid(self.slope * margins(self.weights, self.bias, grams) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], shares: dict[int, float], settings: Settings) -> Model:
    """Full-batch gradient steps with a rate for each weight; every fifth row is left for the calibration."""
    if len({label for _, _, label in rows}) < 2:
        # One class or none: its share is all that is known.
        share = min(max(shares.get(1, 0.5), 1e-3), 1 - 1e-3)
        return Model(np.zeros(N_WEIGHTS), 0.0, 1.0, float(np.log(share / (1 - share))), settings)
    label = np.array([y for _, _, y in rows], dtype=np.float64)
    size = {y: max(1, (label == y).sum()) for y in (0, 1)}
    importance = np.array([shares[int(y)] / size[int(y)] for y in label]) * len(label)
    fold = np.arange(len(rows)) % 5 == 4
    lengths = np.array([len(at) for at, _, _ in rows])
    at = np.concatenate([at for at, _, _ in rows]).astype(np.int64)
    value = np.concatenate([value for _, value, _ in rows]).astype(np.float64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    weights, bias = np.zeros(N_WEIGHTS), 0.0
    squares, bias_square = np.full(N_WEIGHTS, 1e-8), 1e-8
    fit = np.where(fold, 0.0, 0.5 * len(rows) / np.where(label == 1, size[1], size[0]))  # both classes weigh the same
    fit /= fit.sum()
    for _ in range(settings.rounds):
        z = bias + np.bincount(owner, weights[at] * value, minlength=len(rows))
        error = (_sigmoid(z) - label) * fit
        slope = np.bincount(at, error[owner] * value, minlength=N_WEIGHTS) + settings.penalty * weights
        squares += slope**2
        weights -= settings.rate * slope / np.sqrt(squares)
        bias_square += error.sum() ** 2
        bias -= settings.rate * error.sum() / np.sqrt(bias_square)
    z = bias + np.bincount(owner, weights[at] * value, minlength=len(rows))
    return Model(weights, bias, *_calibrated(z[fold], label[fold], importance[fold]), settings)


def _calibrated(z: np.ndarray, label: np.ndarray, importance: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability for a margin: Newton steps with a light pull to slope 1."""
    a, b = 1.0, 0.0
    # Targets a little inside 0 and 1, so that separable rows do not lead to infinity.
    n = {y: max(1.0, (label == y).sum()) for y in (0, 1)}
    target = np.where(label == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    for _ in range(30):
        p = _sigmoid(a * z + b)
        gap, curve = importance * (p - target), importance * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(gap * z).sum() + 0.1 * (a - 1), gap.sum()])
        h = np.array([[(curve * z * z).sum() + 0.1, (curve * z).sum()], [(curve * z).sum(), curve.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return float(max(a, 0.05)), float(b)


def _sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[DataFrame, dict[int, float]]:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {row["quality"]: row["count"] for row in known.groupBy("quality").count().collect()}
    parts = [
        known.where(F.col("quality") == label)
        .dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.per_class)
        for label in (0, 1)
    ]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = max(1, sum(counts.values()))
    return texts.join(parts[0].unionByName(parts[1]), "doc_id"), {label: n / total for label, n in counts.items()}


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from a bounded sample of labelled rows, which comes to the driver as n-gram shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                at, value = [], []
                for i in range(high - low):
                    text = data[offsets[i] : offsets[i + 1]]
                    ends = np.array([0, len(text)])
                    grams = n_grams(text, ends, *words(text, ends))
                    found = [np.unique(numbers, return_counts=True) for numbers, _ in grams]
                    at.append(np.concatenate([f[0] for f in found]).astype("<i4").tobytes())
                    value.append(np.concatenate([f[1] / max(1, f[1].sum()) for f in found]).astype("<f4").tobytes())
                ids, y = batch.column("doc_id").slice(low, high - low), batch.column("quality").slice(low, high - low)
                columns = [ids, y, pa.array(at, pa.binary()), pa.array(value, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "at", "n"])

    sample, shares = _sample(docs, labels, settings)
    rows = sample.mapInArrow(run, "doc_id bigint, quality int, at binary, n binary").collect()
    rows.sort(key=lambda row: (row["doc_id"], bytes(row["at"])))
    return train(
        [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<f4"), r["quality"]) for r in rows], shares, settings
    )


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept.

    Null counts as a text without words: it fails. Equal texts get equal results, repeated rows stay repeated, texts
    are read whole. Other columns are not read. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                hashes, counts = words(data, offsets)
                base = base_counts(data, offsets, hashes, counts)
                chance = sent.value.probabilities(n_grams(data, offsets, hashes, counts))
                columns = [pa.array(base[name], pa.int64()) for name in names]
                ids = batch.column("doc_id").slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [ids, *columns, pa.array(chance, pa.float64())], ["doc_id", *names, "probability"]
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id bigint, " + ", ".join(f"{name} bigint" for name in names) + ", probability double"
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        texts.mapInArrow(run, kinds)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("probability") >= model.settings.keep_from))
    )


def apply_rules(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Train on the labelled rows and judge every document."""
    return judge(docs, fit(docs, labels, settings))
