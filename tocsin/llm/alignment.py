"""Alignment of two tokenizations of a text at the byte offsets where tokens of both end.

The ends of the tokens are two ascending lists, those of many texts one after the other. Merge-path partitioning cuts the
merge of both lists into pieces of equal work: on each diagonal a binary search finds where the merge crosses it, so a
piece depends on no other, and a text of any length is many pieces. A piece emits the pairs of tokens that end together;
the runs of tokens between them, cut by the borders of pieces, are stitched into groups.

Links are counted over all texts by an aggregate with map-side partials. The most frequent pairs, at most a fixed
number, are sent to all tasks; the others, which no text can have often, are joined by a shuffle.

Null and empty texts have no tokens; neither has a text whose tokens do not spell a space and the text. Rows that share an
id are texts of their own, repeated rows are counted as often as they occur. Long texts are aligned whole. An empty table
gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.chunk_tokens import byte_signs, chunk_tokenizer, text_groups, words_with_space
from tocsin.llm.common import written

FILE_A = public_tokenizers.path("byte_bpe_50k.json")
FILE_B = public_tokenizers.path("piece_bpe_32k.model")

#: Ends of both sides that a piece of the merge holds.
WORK = 1 << 15

#: Pairs that are sent to every task (17 bytes each).
MOST_SENT = 1_000_000


class Pieces:
    """Ids and bytes of the tokens of texts. tokens[id] is the id's bytes, sizes[id] their number."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(token) for token in tokens], dtype=np.int64)

    def spell(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        raise NotImplementedError


class BytePieces(Pieces):
    """A byte-level vocabulary; a space is put in front of a text."""

    def __init__(self, path: str):
        self.tokenizer = chunk_tokenizer(path, words_with_space, plain=True)
        signs = {sign: byte for byte, sign in byte_signs().items()}
        vocabulary = self.tokenizer.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            if all(sign in signs for sign in entry):
                tokens[number] = bytes(map(signs.__getitem__, entry))
        super().__init__(tokens)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, "<u4") for ids in self.tokenizer.encode_all([" " + text for text in texts])]


class SpacePieces(Pieces):
    """A vocabulary of pieces with a mark for spaces; the library puts the space in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = []
        for number in range(self.processor.get_piece_size()):
            piece = self.processor.id_to_piece(number)
            one = self.processor.is_byte(number)
            tokens.append(bytes([int(piece[3:5], 16)]) if one else piece.replace("▁", " ").encode())
        super().__init__(tokens)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, "<u4") for ids in self.processor.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=4)
def pieces_of(path: str) -> Pieces:
    """By the kind of the file: JSON is byte-level, anything else a model of pieces."""
    return BytePieces(path) if path.endswith(".json") else SpacePieces(path)


def crossings(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two strictly ascending lists is cut: ends i of a's parts and j of b's parts.

    Each diagonal i + j = k * work is searched by itself; equal ends go to the same piece, so one may hold one end more.
    """
    diagonal = np.arange(work, len(a) + len(b), work)
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        at, other = np.where(open_, middle, 0), np.where(open_, diagonal - middle - 1, 0)
        further = open_ & (a[at] <= b[other])
        low, high = np.where(further, middle + 1, low), np.where(open_ & ~further, middle, high)
    i, j = low, diagonal - low
    inside = (i > 0) & (j < len(b))
    j[inside] += a[i[inside] - 1] == b[j[inside]]
    return np.append(i, len(a)), np.append(j, len(b))


def meetings(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one piece: the places in a and in b of the ends that both have."""
    at = np.searchsorted(b, a)
    both = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a) if len(b) else np.zeros(0, np.int64)
    return both, at[both]


def align(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Last token on each side of every group, given the ends of the tokens.

    Pieces are independent; a group that begins in one piece and ends in another is closed by the pair that the later one
    emits, so stitching is putting the pairs one after the other.
    """
    i, j = crossings(a, b, max(work, 2))
    found = [
        (left + i0, right + j0)
        for i0, i1, j0, j1 in zip([0, *i[:-1]], i, [0, *j[:-1]], j)
        for left, right in [meetings(a[i0:i1], b[j0:j1])]
    ]
    return np.concatenate([left for left, _ in found]), np.concatenate([right for _, right in found])


class Batch:
    """Texts of a batch, tokenized and aligned together. Texts without tokens have none on either side."""

    def __init__(self, a: Pieces, b: Pieces, texts: list[str | None], work: int):
        some = [k for k, text in enumerate(texts) if text]
        sides = [side.encode_all([texts[k] for k in some]) if some else [] for side in (a, b)]
        none = np.zeros(0, "<u4")
        self.ids_a, self.ids_b = [none] * len(texts), [none] * len(texts)
        for k, left, right in zip(some, *sides):
            whole = b" " + texts[k].encode()
            if a.spell(left) == whole and b.spell(right) == whole:
                self.ids_a[k], self.ids_b[k] = left, right
        self.flat_a, self.from_a = self._flat(self.ids_a)
        self.flat_b, self.from_b = self._flat(self.ids_b)
        ends_a, ends_b = np.cumsum(a.sizes[self.flat_a]), np.cumsum(b.sizes[self.flat_b])
        self.last_a, self.last_b = align(ends_a, ends_b, work)
        self.from_group = np.searchsorted(self.last_a, self.from_a)

    @staticmethod
    def _flat(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        starts = np.concatenate([[0], np.cumsum([len(own) for own in ids], dtype=np.int64)])
        return np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64), starts

    def links(self) -> np.ndarray:
        """The pair of ids of each link as one number."""
        return (self.flat_a[self.last_a] << 32) | self.flat_b[self.last_b]

    def written_groups(self) -> Iterator[str]:
        """For each text its groups as ``a1,a2|b1;a3|b2,b3``."""
        top = int(max(self.flat_a.max(initial=0), self.flat_b.max(initial=0))) + 1
        names = _names(top)
        kind_a, kind_b = np.zeros(len(self.flat_a), np.int64), np.zeros(len(self.flat_b), np.int64)
        kind_a[self.last_a], kind_b[self.last_b] = 1, 2
        size_a, size_b = np.diff(self.last_a, prepend=-1), np.diff(self.last_b, prepend=-1)
        place_a = np.arange(len(kind_a)) + np.repeat(self.last_b + 1 - size_b, size_a)
        place_b = np.arange(len(kind_b)) + np.repeat(self.last_a + 1, size_b)
        order = np.empty(len(kind_a) + len(kind_b), np.int64)
        order[place_a], order[place_b] = self.flat_a * 3 + kind_a, self.flat_b * 3 + kind_b
        signs = names[order].tolist()
        for low, high in zip(self.from_a[:-1] + self.from_b[:-1], self.from_a[1:] + self.from_b[1:]):
            yield "".join(signs[low:high])[:-1]


_known_names = np.array([], dtype=object)


def _names(top: int) -> np.ndarray:
    """Decimal ids below ``top``, each followed by a comma, a bar and a semicolon."""
    global _known_names
    if len(_known_names) < 3 * top:
        _known_names = np.array([f"{i}{sign}" for i in range(top * 2) for sign in ",|;"], dtype=object)
    return _known_names


def _batches(docs: DataFrame, file_a: str, file_b: str, work: int, schema: str, rows) -> DataFrame:
    """rows(batch, doc_ids) gives the columns of an output batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = pieces_of(file_a), pieces_of(file_b)
        for batch in batches:
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for first, end in text_groups([text or "" for text in texts]):
                yield rows(Batch(a, b, texts[first:end], work), doc_ids.slice(first, end - first))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, schema)


def alignments(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B, work: int = WORK) -> DataFrame:
    """doc_id, a_ids, b_ids, a_ends, b_ends: the ids of both sides and, for each group, the tokens up to its end."""
    names = ["a_ids", "b_ids", "a_ends", "b_ends"]

    def rows(batch: Batch, doc_ids: pa.Array) -> pa.RecordBatch:
        cuts = list(zip(batch.from_group[:-1], batch.from_group[1:]))
        ends_a = [batch.last_a[low:high] + 1 - batch.from_a[k] for k, (low, high) in enumerate(cuts)]
        ends_b = [batch.last_b[low:high] + 1 - batch.from_b[k] for k, (low, high) in enumerate(cuts)]
        lists = [pa.array(c, pa.list_(pa.int32())) for c in (batch.ids_a, batch.ids_b, ends_a, ends_b)]
        return pa.RecordBatch.from_arrays([doc_ids, *lists], ["doc_id", *names])

    return _batches(docs, file_a, file_b, work, "doc_id bigint" + "".join(f", {n} array<int>" for n in names), rows)


_DIGEST = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "_pairs array<bigint>, _times array<int>"
)


def digests(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B, work: int = WORK) -> DataFrame:
    """Counts and digest of each text's groups, its distinct linked pairs (a's id above 32 bits) and how often each is
    linked."""

    def rows(batch: Batch, doc_ids: pa.Array) -> pa.RecordBatch:
        n_groups = np.diff(batch.from_group)
        links, hashes, pairs, times = batch.links(), [], [], []
        for text in batch.written_groups():
            hashes.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
        for low, high in zip(batch.from_group[:-1], batch.from_group[1:]):
            own, n = np.unique(links[low:high], return_counts=True)
            pairs.append(own)
            times.append(n)
        counts = [pa.array(c, pa.int64()) for c in (np.diff(batch.from_a), np.diff(batch.from_b), n_groups, n_groups)]
        offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
        lists = [
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c), kind))
            for c, kind in ((pairs, pa.int64()), (times, pa.int32()))
        ]
        return pa.RecordBatch.from_arrays(
            [doc_ids, *counts, pa.array(hashes, pa.string()), *lists],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_pairs", "_times"],
        )

    return _batches(docs, file_a, file_b, work, _DIGEST, rows)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, count, best: links of each pair in all texts, and whether no pair with the same b has more."""
    each = found.select(F.explode(F.arrays_zip("_pairs", "_times")).alias("p"))
    counts = each.groupBy(F.col("p._pairs").alias("pair")).agg(F.sum("p._times").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit(2**32 - 1))
    counts = written(counts.select("pair", "count", b.alias("_b")), "counts")
    most = counts.groupBy("_b").agg(F.max("count").alias("_most"))
    return counts.join(most, "_b").select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))


def _least_sent(counts: DataFrame, most_sent: int) -> int:
    """Smallest power of two such that at most ``most_sent`` pairs have that count or more."""
    sizes = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("size")).agg(F.count("*").alias("n")).collect()
    total = 0
    for size, n in sorted(sizes, reverse=True):  # at most 64 rows
        total += n
        if total > most_sent:
            return 2 ** (size + 1)
    return 1


def scored(
    docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B, work: int = WORK, most_sent: int = MOST_SENT
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    found = written(digests(docs, file_a, file_b, work).withColumn("_row", F.monotonically_increasing_id()), "digests")
    counts = written(pair_counts(found), "pairs")
    least = _least_sent(counts, most_sent)
    sent = counts.where(F.col("count") >= least).toArrow()
    order = np.argsort(sent.column("pair").to_numpy())
    table = docs.sparkSession.sparkContext.broadcast([sent.column(c).to_numpy()[order] for c in ("pair", "count", "best")])
    rest = least > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = table.value
        for batch in batches:
            own = batch.column("_pairs")
            values, times = own.flatten().to_numpy(), batch.column("_times").flatten().to_numpy().astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])
            at = np.minimum(np.searchsorted(pair, values), max(len(pair) - 1, 0))
            known = pair[at] == values if len(pair) else np.zeros(len(values), bool)
            at = np.where(known, at, 0)
            sums = []
            for weight in (best, count):
                gains = np.where(known, weight[at] * times, 0) if len(pair) else np.zeros(len(values), np.int64)
                sums.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(gains)])[starts]), pa.int64()))
            left = np.concatenate([[0], np.cumsum(~known)])[starts].astype(np.int32)
            others = [pa.ListArray.from_arrays(pa.array(left), pa.array(v[~known])) for v in (values, times)]
            keep = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*keep, *sums, *others], [*columns, "n_best", "count_sum", "_pairs", "_times"])

    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_row"]
    kinds = ", ".join(f"{name} {kind}" for name, kind in found.select(*columns).dtypes)
    out = found.mapInArrow(run, f"{kinds}, n_best bigint, count_sum bigint, _pairs array<bigint>, _times array<bigint>")
    if rest:
        out = written(out, "frequent")
        rare = out.select("_row", F.explode(F.arrays_zip("_pairs", "_times")).alias("p"))
        rare = rare.select("_row", F.col("p._pairs").alias("pair"), F.col("p._times").alias("times"))
        gained = rare.join(counts.where(F.col("count") < least), "pair").groupBy("_row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"),
            F.sum(F.col("times") * F.col("count")).alias("_sum"),
        )
        out = out.join(gained, "_row", "left").withColumns(
            {
                "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)),
                "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)),
            }
        )
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
