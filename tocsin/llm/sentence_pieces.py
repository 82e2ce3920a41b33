"""SentencePiece encoding with seeded merge-dropout, and decoding.

A merge-type model joins neighbouring pieces by an agenda: the candidate of the best rank goes first, the leftmost of
equals. With dropout, a candidate that comes up is skipped when the keyed hash of its place and its merged piece falls
below the rate. The key depends on the seed, the document's id and text, the number of the copy and the place of the run
in the text, so each occurrence of a word draws anew, yet every rerun gives the same ids.

Pieces never cross the borders between letters, digits and other characters (checked when a model is loaded), so each
run is a merge problem of its own. A bounded cache of the Python worker keeps what is not random: the ids of a run without
dropout, and the candidates that come up on the way. Where none of them is skipped, these ids are the result; the other
occurrences are merged anew, those of about the same length together.

Decoding is lossless for every text: characters outside the vocabulary, and the model's own space mark when it stands
in a text, are written as bytes.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_LITERAL = "\x00" + SPACE  # a space mark of the text itself; no piece looks like this
_WORDS = re.compile(r" *[^ ]+| +")
_MASK = (1 << 64) - 1
_PLACE, _RANK, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x94D049BB133111EB)

RUNS_TOGETHER = 100_000

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _drops(key: int, start: int, rank: int, below: int) -> bool:
    """Whether the candidate at this place with this merged piece is skipped."""
    h = (key ^ (start * 0x9E3779B97F4A7C15 + rank * 0xD6E8FEB86659FD93)) & _MASK
    return (((h ^ (h >> 31)) * 0x94D049BB133111EB) & _MASK) >> 32 < below


class _Merged(NamedTuple):
    """Runs merged together: all ids in a row, ids and skipped candidates of each run; without dropout also the terms
    that places and ranks of the candidates add to a hash, in the order in which they come up, and their number."""

    ids: np.ndarray
    sizes: np.ndarray
    skipped: np.ndarray
    terms: np.ndarray
    counts: np.ndarray


class PieceModel:
    """Ranks and ids of a merge-type model file."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("A merge-type model with byte fallback is needed.")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("A model that changes texts before encoding is not lossless.")
        self.prefix = " " if spec.add_dummy_prefix else ""
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type in (1, 4, 5)]
        scores = sorted({score for _, _, score in normal}, reverse=True)
        places = {score: rank for rank, score in enumerate(scores)}
        self.rank = {piece: places[score] for _, piece, score in normal}
        self.none = len(scores)
        self.id = {piece: i for i, piece, _ in normal}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.bytes = [b""] * len(proto.pieces)
        for i, piece, _ in normal:
            self.bytes[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.byte_id.items():
            self.bytes[i] = bytes([value])
        self.runs = self._runs()

    def _runs(self) -> re.Pattern:
        """Splits a text where no piece can cross: between letters, digits and the rest, or at spaces only."""
        odd = {c for piece in self.id for c in piece if c.isalnum() and not c.isalpha() and not c.isdecimal()}
        odd = re.escape("".join(sorted(odd)) + "_")
        runs = re.compile(rf" *[^\W\d{odd}]+| *(?:[^\w ]|[{odd}])+| *\d+| +")
        return runs if all(runs.fullmatch(piece.replace(SPACE, " ")) for piece in self.id) else _WORDS

    def symbols(self, run: str) -> list[str]:
        if SPACE in run:
            return [SPACE if c == " " else _LITERAL if c == SPACE else c for c in run]
        return list(run.replace(" ", SPACE))

    def merge(self, symbols: list[str], key: int, drop_below: int) -> tuple[list[str], int]:
        """The pieces after all merges, and how many candidates were skipped."""
        return (self.merge_short if len(symbols) <= 48 else self.merge_long)(symbols, key, drop_below)

    def merge_short(self, symbols: list[str], key: int, drop_below: int) -> tuple[list[str], int]:
        """The agenda as a list of ranks that is searched anew: fast for words."""
        get, none, skipped = self.rank.get, self.none, 0
        ranks = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        starts = list(range(len(symbols)))
        while ranks:
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)
            if drop_below:  # _drops(), written out for speed
                h = (key ^ (starts[i] * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93)) & _MASK
                if (((h ^ (h >> 31)) * 0x94D049BB133111EB) & _MASK) >> 32 < drop_below:
                    skipped += 1
                    ranks[i] = none
                    continue
            piece = symbols[i] + symbols[i + 1]
            symbols[i] = piece
            del symbols[i + 1], starts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(piece + symbols[i + 1], none)
            if i:
                ranks[i - 1] = get(symbols[i - 1] + piece, none)
        return symbols, skipped

    def merge_long(self, symbols: list[str], key: int, drop_below: int) -> tuple[list[str], int]:
        """The agenda as a heap over linked symbols: n log n for runs of any length."""
        rank, n, skipped = self.rank, len(symbols), 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            r = rank.get(symbols[i] + symbols[i + 1])
            if r is not None:
                agenda.append((r, i, symbols[i] + symbols[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            r, i, piece = heapq.heappop(agenda)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(symbols[j]) != len(piece) or left + symbols[j] != piece:
                continue
            if drop_below and _drops(key, i, r, drop_below):
                skipped += 1
                continue
            symbols[i], symbols[j] = piece, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(piece + symbols[k])
                if r is not None:
                    heapq.heappush(agenda, (r, i, piece + symbols[k]))
            h = before[i]
            if h >= 0:
                r = rank.get(symbols[h] + piece)
                if r is not None:
                    heapq.heappush(agenda, (r, h, symbols[h] + piece))
        return [s for s in symbols if s is not None], skipped

    @functools.cached_property
    def tables(self) -> _PairTables:
        return _PairTables(self)

    def merge_many(self, runs: list[str], keys: np.ndarray | None, drop_below: int) -> _Merged:
        """Many short runs of about the same length, merged step by step together.

        Column k of all tables belongs to run k, row i to the character at place i: the agenda of a run is its column
        of ranks. Every step takes the best candidate of each run, the first of equals, as merge_short() does.
        """
        t, none, n = self.tables, self.none, len(runs)
        lengths = np.fromiter(map(len, runs), dtype=np.int64, count=n)
        depth = int(lengths.max())
        place = np.arange(depth)[:, None]
        points = np.full((n, depth), 0xFFFF, dtype=np.uint32)
        points[place.T < lengths[:, None]] = np.frombuffer("".join(runs).encode("utf-32-le"), dtype=np.uint32)
        mark, space = points == ord(SPACE), points == ord(" ")
        points[mark], points[space] = 0xFFFF, ord(SPACE)
        sym = t.symbol[points.T]
        alive = np.broadcast_to(place < lengths, sym.shape).copy()
        after = np.broadcast_to(place + 1, sym.shape).astype(np.int16)
        before = np.broadcast_to(place - 1, sym.shape).astype(np.int16)
        rank = np.full(sym.shape, none, dtype=np.int32)
        into = np.zeros(sym.shape, dtype=np.int32)
        for i in range(depth - 1):
            rank[i], into[i] = t.look_up(sym[i], sym[i + 1])
        rank[np.broadcast_to(place + 1 >= lengths, sym.shape)] = none
        skipped = np.zeros(n, dtype=np.int64)
        owners, terms = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        open_ = np.arange(n)
        while len(open_):
            part = rank[:, open_]
            at = part.argmin(axis=0)
            best = part[at, np.arange(len(open_))]
            more = best < none
            open_, p, r = open_[more], at[more], best[more]
            c = open_
            term = p.astype(np.uint64) * _PLACE + r.astype(np.uint64) * _RANK
            if not drop_below:
                owners.append(c)
                terms.append(term)
            else:
                h = keys[c] ^ term
                h = (h ^ (h >> np.uint64(31))) * _SPREAD
                gone = (h >> np.uint64(32)) < np.uint64(drop_below)
                rank[p[gone], c[gone]] = none
                skipped[c[gone]] += 1
                c, p = c[~gone], p[~gone]
            q, piece = after[p, c], into[p, c]
            sym[p, c] = piece
            alive[q, c] = False
            rank[q, c] = none
            follows = after[q, c]
            after[p, c] = follows
            rank[p, c] = none
            ok = follows < lengths[c]
            pk, ck, fk = p[ok], c[ok], follows[ok]
            before[fk, ck] = pk
            rank[pk, ck], into[pk, ck] = t.look_up(piece[ok], sym[fk, ck])
            ahead = before[p, c]
            ok = ahead >= 0
            ak, ck = ahead[ok], c[ok]
            rank[ak, ck], into[ak, ck] = t.look_up(sym[ak, ck], piece[ok])
        alive = alive.T
        flat, sizes = sym.T[alive], alive.sum(axis=1)
        unknown = np.flatnonzero((alive & (sym.T == t.unknown)).any(axis=1)).tolist()
        if unknown:
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            for k in unknown:
                starts = [*np.flatnonzero(alive[k]).tolist(), len(runs[k])]
                symbols = self.symbols(runs[k])
                found = self.ids(["".join(symbols[a:b]) for a, b in zip(starts, starts[1:])])
                parts[k], sizes[k] = np.array(found, dtype=np.int32), len(found)
            flat = np.concatenate(parts)
        owner = np.concatenate(owners)
        return _Merged(
            flat, sizes, skipped, np.concatenate(terms)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n)
        )

    def ids(self, pieces: list[str]) -> tuple[int, ...]:
        try:
            return tuple([self.id[piece] for piece in pieces])
        except KeyError:
            pass
        out: list[int] = []
        for piece in pieces:
            i = self.id.get(piece)
            if i is not None:
                out.append(i)
            else:
                text = SPACE if piece == _LITERAL else piece
                out.extend(self.byte_id[b] for b in text.encode())
        return tuple(out)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()[len(self.prefix) :]


class _PairTables:
    """Symbols by code point, and which two symbols join to which piece of which rank."""

    def __init__(self, model: PieceModel):
        self.none, self.unknown = model.none, max(model.id.values()) + 1
        self.symbol = np.full(0x110000, self.unknown, dtype=np.int32)
        pairs = {}
        for piece, i in model.id.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
            for k in range(1, len(piece)):
                a, b = model.id.get(piece[:k]), model.id.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * (self.unknown + 1) + b] = (model.rank[piece], i)
        keys = sorted(pairs)
        self.keys = np.array([*keys, -1], dtype=np.int64)
        self.keys[-1] = np.iinfo(np.int64).max
        self.ranks = np.array([*(pairs[k][0] for k in keys), self.none], dtype=np.int32)
        self.pieces = np.array([*(pairs[k][1] for k in keys), 0], dtype=np.int32)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * (self.unknown + 1) + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], self.none), self.pieces[at]


#: Short runs that are merged together.
MERGED_TOGETHER = 4096


def _alike(runs: Iterable[str]) -> Iterator[list[str]]:
    """Runs of about the same length, so many as are merged together."""
    ordered = sorted(runs, key=len)
    for at in range(0, len(ordered), MERGED_TOGETHER):
        yield ordered[at : at + MERGED_TOGETHER]


def _stretches(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of stretches of the given sizes, one after the other."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


class _Variant(dict):
    """Segmentations of runs under one variant; emptied when full, which changes no result."""

    def __init__(self, model: PieceModel, seed: str, variant: int, drop_below: int, most: int):
        self.model, self.drop_below, self.most = model, drop_below, most
        self.seed = xxhash.xxh3_64_intdigest(f"{seed}:{variant}")

    def learn(self, runs: set[str]) -> None:
        """Segment the runs of this set that are not known, those of about the same length together."""
        for part in _alike(run for run in runs if run not in self and len(run) <= 48):
            keys = np.array([xxhash.xxh3_64_intdigest(run, self.seed) for run in part], dtype=np.uint64)
            merged = self.model.merge_many(part, keys, self.drop_below)
            ids, ends = merged.ids.tolist(), [0, *np.cumsum(merged.sizes).tolist()]
            found = [tuple(ids[a:b]) for a, b in zip(ends, ends[1:])]
            self.update(zip(part, zip(found, merged.skipped.tolist())))

    def __missing__(self, run: str):
        key = xxhash.xxh3_64_intdigest(run, self.seed)
        pieces, skipped = self.model.merge(self.model.symbols(run), key, self.drop_below)
        found = (self.model.ids(pieces), skipped)
        if len(run) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[run] = found
        return found


class _Fresh:
    """Segmentations that each occurrence of a run draws anew; what is kept changes no result."""

    def __init__(self, model: PieceModel, drop_below: int, most: int):
        self.model, self.drop_below, self.most = model, drop_below, most
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.start = self.size = self.first = self.count = np.zeros(0, dtype=np.int64)
        self.terms = np.zeros(0, dtype=np.uint64)

    def learn(self, runs: Iterable[str]) -> None:
        """The merges of new runs without dropout, as the terms that a candidate's place and rank add to its hash."""
        ids, sizes, terms, counts = [self.ids], [self.size], [self.terms], [self.count]
        for part in _alike(runs):
            self.index.update(zip(part, itertools.count(len(self.index))))
            merged = self.model.merge_many(part, None, 0)
            for known, added in zip((ids, sizes, terms, counts), (merged.ids, merged.sizes, merged.terms, merged.counts)):
                known.append(added)
        self.ids, self.size = np.concatenate(ids), np.concatenate(sizes)
        self.terms, self.count = np.concatenate(terms), np.concatenate(counts)
        self.start, self.first = np.cumsum(self.size) - self.size, np.cumsum(self.count) - self.count

    def _places(self, runs: Iterable[str], n: int) -> np.ndarray:
        return np.fromiter(map(self.index.get, runs, itertools.repeat(-1)), dtype=np.int64, count=n)

    def find(self, runs: list[str], keys: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
        """Ids and skipped candidates of each run under its own key."""
        ids, sizes, skipped = self.draw(runs, keys)
        ends = [0, *np.cumsum(sizes).tolist()]
        return [(tuple(ids[a:b].tolist()), s) for a, b, s in zip(ends, ends[1:], skipped.tolist())]

    def draw(self, runs: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids and of skipped candidates of each run under its own key."""
        if len(self.index) > self.most:
            self.forget()
        at = self._places(runs, len(runs))
        missing = np.flatnonzero(at < 0)
        self.learn(dict.fromkeys(run for run in map(runs.__getitem__, missing.tolist()) if len(run) <= 48))
        at[missing] = self._places(map(runs.__getitem__, missing.tolist()), len(missing))
        known = np.flatnonzero(at >= 0)
        u = at[known]
        count = self.count[u]
        owner = np.repeat(np.arange(len(known)), count)
        h = keys[known][owner] ^ self.terms[_stretches(self.first[u], count)]
        h = (h ^ (h >> np.uint64(31))) * _SPREAD
        gone = np.bincount(owner[(h >> np.uint64(32)) < np.uint64(self.drop_below)], minlength=len(known)) > 0
        # Runs by number, their ids in a row and the number of ids of each.
        kept = u[~gone]
        found = [(known[~gone], self.ids[_stretches(self.start[kept], self.size[kept])], self.size[kept])]
        skipped = np.zeros(len(runs), dtype=np.int64)
        redo = known[gone]
        lengths = np.fromiter(map(len, map(runs.__getitem__, redo.tolist())), dtype=np.int64, count=len(redo))
        redo = redo[np.argsort(lengths, kind="stable")]
        for start in range(0, len(redo), MERGED_TOGETHER):
            part = redo[start : start + MERGED_TOGETHER]
            merged = self.model.merge_many([runs[k] for k in part.tolist()], keys[part], self.drop_below)
            found.append((part, merged.ids, merged.sizes))
            skipped[part] = merged.skipped
        for k in np.flatnonzero(at < 0).tolist():
            pieces, skipped[k] = self.model.merge(self.model.symbols(runs[k]), int(keys[k]), self.drop_below)
            ids = np.array(self.model.ids(pieces), dtype=np.int32)
            found.append((np.array([k]), ids, np.array([len(ids)])))
        sizes = np.zeros(len(runs), dtype=np.int64)
        for part, _, own in found:
            sizes[part] = own
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), dtype=np.int32)
        for part, ids, own in found:
            out[_stretches(starts[part], own)] = ids
        return out, sizes, skipped


def _run_keys(base: int, n: int) -> np.ndarray:
    """Keys of n runs in a row from the key of their text."""
    key = np.uint64(base) + np.arange(1, n + 1, dtype=np.uint64) * _PLACE
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(27))) * _SPREAD
    return key ^ (key >> np.uint64(31))


class Encoder:
    """Encodes and decodes texts; holds a bounded number of cached runs.

    variants: none lets each occurrence of a run draw anew; a number allows a run only so many segmentations.
    """

    def __init__(self, model: PieceModel, seed: str, rate: float, variants: int | None = None, most: int = 100_000):
        below = min(int(rate * 2**32), 2**32)
        self.fresh = _Fresh(model, below, most) if below and variants is None else None
        count = (variants or 1) if below else 1
        self.model, self.seed = model, seed
        self.cached = [_Variant(model, seed, v, below, most) for v in range(count)]

    def runs(self, text: str) -> list[str]:
        return self.model.runs.findall(self.model.prefix + text) if text else []

    def _first(self, name: str) -> int:
        return xxhash.xxh3_64_intdigest(f"{self.seed}:{name}") % len(self.cached)

    def encode_all(self, texts: list[str], names: list[str]) -> Iterator[tuple[list[int], int]]:
        """encode() of several texts: the runs that are new to a variant are segmented together first."""
        if self.fresh:
            yield from self._draw(texts, names)
            return
        runs, n = [self.runs(text) for text in texts], len(self.cached)
        for v, cache in enumerate(self.cached):
            if len(cache) > cache.most:
                cache.clear()
            cache.learn(set().union(*(own[(v - self._first(name)) % n :: n] for own, name in zip(runs, names))))
        for own, name in zip(runs, names):
            yield self._encode(own, name)

    def encode(self, text: str, name: str) -> tuple[list[int], int]:
        """Ids and the number of skipped merges. name: what tells this text from others, such as its id."""
        if self.fresh:
            return next(self._draw([text], [name]))
        return self._encode(self.runs(text), name)

    def _draw(self, texts: list[str], names: list[str]) -> Iterator[tuple[list[int], int]]:
        """Texts are taken together up to RUNS_TOGETHER runs; a longer text is taken in pieces."""
        waiting: list[int] = []
        runs: list[str] = []
        keys: list[np.ndarray] = []
        for k, (text, name) in enumerate(zip(texts, names)):
            own = self.runs(text)
            waiting.append(len(own))
            runs += own
            start = xxhash.xxh3_64_intdigest(f"{self.seed}:{name}")
            keys.append(_run_keys(xxhash.xxh3_64_intdigest(text, start), len(own)))
            if len(runs) < RUNS_TOGETHER and k + 1 < len(texts):
                continue
            every, found = np.concatenate(keys), []
            for at in range(0, max(len(runs), 1), RUNS_TOGETHER):
                found.append(self.fresh.draw(runs[at : at + RUNS_TOGETHER], every[at : at + RUNS_TOGETHER]))
            ids, sizes, skipped = (np.concatenate(parts) for parts in zip(*found))
            ends = np.cumsum([0, *waiting])
            ends_ids, ends_skipped = (np.concatenate([[0], np.cumsum(x)])[ends].tolist() for x in (sizes, skipped))
            for a, b, low, high in zip(ends_ids, ends_ids[1:], ends_skipped, ends_skipped[1:]):
                yield ids[a:b].tolist(), high - low
            waiting, runs, keys = [], [], []

    def _encode(self, runs: list[str], name: str) -> tuple[list[int], int]:
        start = self._first(name)
        turn = itertools.cycle(self.cached[start:] + self.cached[:start])
        ids: list[int] = []
        skipped = 0
        for found, s in [cache[run] for cache, run in zip(turn, runs)]:
            ids += found
            skipped += s
        return ids, skipped

    def decode(self, ids) -> str:
        return self.model.decode(ids) if len(ids) else ""


@functools.lru_cache(maxsize=2)
def _encoder(data: bytes, seed: str, rate: float, variants: int | None) -> Encoder:
    return Encoder(PieceModel(data), seed, rate, variants)


def encode(
    docs: DataFrame,
    model_file: str = DEFAULT_MODEL,
    seed: str = "pieces",
    rate: float = 0.1,
    variants: int | None = None,
    carry: tuple[str, ...] = (),
    copy: str | None = None,
) -> DataFrame:
    """doc_id, the columns named in carry, ids (array of int), n_skipped (merges dropped).

    The model file is read on the driver (half a megabyte) and goes with the tasks. Null and empty texts have no ids.
    copy names a column that numbers the copies of a document; rows repeated with the same id, text and number have the
    same ids. variants as for Encoder. Whole texts are encoded; a run longer than 48 characters is not cached. Other columns are not read. An empty table gives no rows.
    """
    with open(model_file, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data.value, seed, rate, variants)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, names = part.column("text"), part.column("doc_id")
                copies = part.column("__copy").to_pylist()
                ids, counts, skipped = [], [0], []
                texts = [text or "" for text in texts.to_pylist()]
                for found, s in encoder.encode_all(texts, [f"{name}:{c}" if c else str(name) for name, c in zip(names.to_pylist(), copies)]):
                    ids.append(np.array(found, dtype=np.int32))
                    counts.append(counts[-1] + len(found))
                    skipped.append(s)
                values = pa.array(np.concatenate(ids)) if ids else pa.array([], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), values)
                columns = [names, *(part.column(c) for c in carry), lists, pa.array(skipped, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *carry, "ids", "n_skipped"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *carry,
        F.col("text").cast("string").alias("text"),
        (F.col(copy).cast("long") if copy else F.lit(0).cast("long")).alias("__copy"),
    )
    kinds = "".join(f", `{c}` {kind}" for c, kind in docs.select(*carry).dtypes) if carry else ""
    return rows.mapInArrow(run, f"doc_id bigint{kinds}, ids array<int>, n_skipped bigint")


def decode(encoded: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids. Null ids give an empty text."""
    with open(model_file, "rb") as file:
        data = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data.value, "", 0.0, 1)
        for batch in batches:
            texts = [encoder.decode(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model_file: str = DEFAULT_MODEL, seed: str = "pieces", rate: float = 0.1, variants: int | None = None) -> DataFrame:
    """doc_id, n_ids, n_skipped, ids_sha256 (of little-endian 32-bit ids), lossless: encode and decode in one pass.

    The ids of a text do not leave the worker, so nothing but the digest is written. Rows as in encode().
    """
    with open(model_file, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data.value, seed, rate, variants)
        for part in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
            out: list[list] = [[], [], [], []]
            texts = [text or "" for text in part.column("text").to_pylist()]
            names = [str(name) for name in part.column("doc_id").to_pylist()]
            for text, (ids, skipped) in zip(texts, encoder.encode_all(texts, names)):
                digest = hashlib.sha256(np.array(ids, dtype="<i4").tobytes()).hexdigest()
                for column, value in zip(out, (len(ids), skipped, digest, encoder.decode(ids) == text)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds))],
                ["doc_id", "n_ids", "n_skipped", "ids_sha256", "lossless"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_ids bigint, n_skipped bigint, ids_sha256 string, lossless boolean")
