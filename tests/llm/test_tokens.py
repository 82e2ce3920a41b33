"""Packing and alignment against plain versions that use the tokenizers directly."""

from __future__ import annotations

import bisect
import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tocsin.llm import alignment, chunk_tokens, packing

ODD_TEXTS = [
    "", " ", "  a  b", "a\n\n b\t c ", "don't  we'll 's", "x   y  z", " a 　 b", "a\x1c!\x1c!b", "Ünïcôde ß ΑΣ Σ",
    "é ́x", "<|endoftext|> a<|startoftext|>b", "日本語のテキスト 😀😀 \x00", "a▁b", "▁", "<s> </s> <0x41>", "﻿a b",
    "1234 5,678.90 #*$%", "a" * 200, " \n" * 50, "a\x85b \x85 c", "​zero​ width", "İstanbul ǅ ﬁ",
]


def byte_tokenizer():
    tokenizer = Tokenizer.from_file(alignment.FILE_A)
    tokenizer.encode_special_tokens = True
    return tokenizer


# stretches


@pytest.mark.parametrize("path, split, plain", [
    (packing.DEFAULT_TOKENIZER, chunk_tokens.words_apart, False), (alignment.FILE_A, chunk_tokens.words_with_space, True),
])
def test_stretches_have_the_ids_of_the_whole(path, split, plain):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    rng = random.Random(3)
    mixed = ["".join(rng.choice(ODD_TEXTS + [" ", "\n", "  ", "a", "B'", " ", "!"]) for _ in range(12)) for _ in range(400)]
    signs = [chr(c) for c in range(256)] + ["'s", "'LL", "  ", " \n ", "ab", "12", "ÀÿŁ", "İ", "!?"]
    mixed += ["".join(rng.choice(signs) for _ in range(30)) for _ in range(2000)]
    texts = ODD_TEXTS + mixed
    found = chunk_tokens.ChunkTokenizer(path, split, plain).encode_all(texts)
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_the_table_of_stretches_is_bounded(monkeypatch):
    monkeypatch.setattr(chunk_tokens, "MOST", 3)
    own = chunk_tokens.ChunkTokenizer(packing.DEFAULT_TOKENIZER, chunk_tokens.words_apart, False)
    for text in ("a b c d e", "a b c", "x" * 100):
        own.encode_all([text])
    assert len(own.known) <= 5 and len(own.old) <= 5 and "x" * 100 not in own.known


# packing


def plain_pieces(rows, capacity=4096):
    tokenizer = Tokenizer.from_file(packing.DEFAULT_TOKENIZER)
    out = []
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            out.append((doc_id, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return sorted(out, key=repr)


def check_places(rows, capacity):
    """Sequences are filled without gaps and hold at most the capacity; returns their number."""
    by_sequence = collections.defaultdict(list)
    for row in rows:
        by_sequence[row["sequence_id"]].append((row["offset"], row["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity, per_task", [(4096, 50_000), (64, 50_000), (64, 40)])
def test_packing(docs, small_docs, capacity, per_task):
    found = packing.pack_documents(docs, capacity=capacity, per_task=per_task)
    rows = found.rows.collect()
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(row[c] for c in columns) for row in rows), key=repr) == plain_pieces(small_docs, capacity)
    assert check_places(rows, capacity) == found.sequences >= found.bound
    assert found.sequences <= found.bound + 2


def test_packing_odd_tables(spark, crowded, no_docs, small_docs):
    assert len(packing.pack_documents(crowded).rows.collect()) == len(plain_pieces(small_docs))
    none = packing.pack_documents(no_docs)
    assert (none.rows.collect(), none.sequences, none.bound) == ([], 0, 0)
    same = spark.createDataFrame([(7, "one two three")] * 300 + [(8, None)] * 5, "doc_id bigint, text string")
    found = packing.pack_documents(same, capacity=9, per_task=30)  # 300 of four ids, five of one
    assert check_places(found.rows.collect(), 9) == found.sequences == found.bound == 150


def test_partitions_exchange_what_does_not_fill_their_bins(spark):
    """Each partition alone wastes up to a bin; after the exchange the bound for all is met."""
    rng = random.Random(8)
    rows = [(i, rng.choice([rng.randrange(1, 60), rng.randrange(30, 101)])) for i in range(3000)]
    items = spark.createDataFrame(rows, "_key bigint, length bigint")
    alone = packing.pack(items, 100, per_task=100, rounds=1)
    found = packing.pack(items, 100, per_task=100)
    assert alone.bound == found.bound <= found.sequences < alone.sequences
    assert check_places(found.rows.collect(), 100) == found.sequences
    assert check_places(alone.rows.collect(), 100) == alone.sequences
    assert sorted(row["_key"] for row in found.rows.collect()) == list(range(3000))


def test_sequences_hold_their_ids(docs, small_docs):
    rows = packing.sequences(docs, capacity=256).collect()
    tokenizer = Tokenizer.from_file(packing.DEFAULT_TOKENIZER)
    total = sum(len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1 for _, text, *_ in small_docs)
    assert sum(len(row.ids) for row in rows) == total
    assert all(len(row.ids) <= 256 and row.ids.count(1) >= len(row.doc_ids) - 1 for row in rows)


def fewest_bins(sizes, capacity):
    """Exact, by trying everything."""
    best = len(sizes)

    def place(k, rests):
        nonlocal best
        if len(rests) >= best:
            return
        if k == len(sizes):
            best = len(rests)
            return
        for rest in {r for r in rests if r >= sizes[k]}:
            i = rests.index(rest)
            place(k + 1, rests[:i] + [rest - sizes[k]] + rests[i + 1 :])
        place(k + 1, rests + [capacity - sizes[k]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bounds_hold(sizes):
    sizes = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    exact = fewest_bins(sizes.tolist(), 20)
    bins, offsets, fills = packing.best_fit(sizes, 20)
    assert packing.lower_bound(np.bincount(sizes, minlength=21)) <= exact <= len(fills)
    assert (np.bincount(bins, sizes, len(fills)) == fills).all() and (fills <= 20).all()


def test_best_fit_takes_the_fullest_bin():
    sizes = np.array([sorted([random.Random(i).randrange(1, 101) for _ in range(60)], reverse=True) for i in range(20)])
    for own in sizes:
        rests: list[int] = []
        for size in own.tolist():
            rests.sort()
            k = bisect.bisect_left(rests, size)
            rests[k : k + 1] = [rests[k] - size] if k < len(rests) else [100 - size]
        fills = packing.best_fit(own, 100)[2]
        assert sorted(100 - fills) == sorted(rests)


def test_bounds_beyond_the_volume():
    assert packing.lower_bound(np.bincount([51] * 10, minlength=101)) == 10
    assert packing.lower_bound(np.bincount([34] * 10, minlength=101)) == 5


# alignment


@pytest.fixture(scope="module")
def sides():
    tokenizer, model = byte_tokenizer(), sentencepiece.SentencePieceProcessor(model_file=alignment.FILE_B)
    signs, hidden = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            signs[chr(b)] = b
        else:
            signs[chr(256 + hidden)] = b
            hidden += 1

    def tokens(text):
        if not text:
            return [], []
        a = tokenizer.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(signs[c] for c in token)) for i, token in zip(a.ids, a.tokens)]
        right = []
        for i in model.encode(text):
            piece = model.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if any(b"".join(t for _, t in side) != whole for side in (left, right)):
            return [], []
        return left, right

    return tokens


def plain_groups(left, right):
    ends = [list(itertools.accumulate(len(t) for _, t in side)) for side in (left, right)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups, low = [], 0
    for cut in cuts:
        groups.append([[i for (i, _), end in zip(side, own) if low < end <= cut] for side, own in zip((left, right), ends)])
        low = cut
    return groups


def plain_scores(rows, sides):
    all_groups = {}
    for _, text, *_ in rows:
        if text not in all_groups:
            left, right = sides(text)
            all_groups[text] = (len(left), len(right), plain_groups(left, right))
    counts = collections.Counter((g[0][-1], g[1][-1]) for _, text, *_ in rows for g in all_groups[text][2])
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, text, *_ in rows:
        n_a, n_b, groups = all_groups[text]
        links = [(g[0][-1], g[1][-1]) for g in groups]
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            doc_id, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(written.encode()).hexdigest() if written else "",
        ))
    return sorted(out, key=repr)


@pytest.mark.parametrize("work, most_sent", [(1 << 15, 1_000_000), (7, 40), (2, 0)])
def test_alignment(spark, small_docs, sides, work, most_sent):
    """Pieces of any size, and pairs that are joined instead of sent, give the same rows."""
    rows = [row for row in small_docs if not row[1] or len(row[1]) < 100_000]
    rows += [(1000 + i, text, None, None, None) for i, text in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = sorted((tuple(row) for row in alignment.scored(docs, work=work, most_sent=most_sent).collect()), key=repr)
    assert found == plain_scores(rows, sides)


def test_alignment_odd_tables(docs, crowded, no_docs):
    assert alignment.scored(no_docs).collect() == []
    assert sorted(map(repr, alignment.scored(crowded).collect())) == sorted(map(repr, alignment.scored(docs).collect()))


def test_groups_are_written_out(docs, small_docs, sides):
    for row, (_, text, *_) in zip(alignment.alignments(docs.limit(40)).collect(), small_docs):
        groups = plain_groups(*sides(text))
        ends = list(zip(row.a_ends, row.b_ends))
        starts = [(0, 0), *ends]
        assert [[row.a_ids[a0:a1], row.b_ids[b0:b1]] for (a0, b0), (a1, b1) in zip(starts, ends)] == groups


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(2, 9))
def test_merge_path(a, b, work):
    a, b = (np.array(sorted(x), dtype=np.int64) for x in (a, b))
    left, right = alignment.align(a, b, work)
    common = np.intersect1d(a, b)
    assert (a[left] == common).all() and (b[right] == common).all()
    i, j = alignment.crossings(a, b, work)
    sizes = np.diff(np.concatenate([[0], i])) + np.diff(np.concatenate([[0], j]))
    assert (sizes <= work + 1).all()
