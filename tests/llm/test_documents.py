"""Operators over documents against plain-Python versions, on rows with every odd case."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re
import sys
import uuid
import zlib

import pytest

from tocsin.llm import (
    connected,
    exact_dedup,
    jaccard_join,
    license_scan,
    mixing,
    personal_data,
    quality_neighbours,
    quality_rules,
    sentence_pieces,
)
from tocsin.llm.common import WORD_RE, Scratch

PIECES = sentence_pieces.DEFAULT_MODEL


def words(text):
    return WORD_RE.findall(text or "")


def collected(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)


def new_index(spark):
    return exact_dedup.DigestIndex(spark, f"index_{uuid.uuid4().hex}", buckets=4)


# exact dedup


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup(spark, docs, crowded, small_docs):
    groups = collections.defaultdict(list)
    for d, t, *_ in small_docs:
        groups[bare(t)].append((-len(t or ""), d is None, d))
    expected = []
    for d, t, *_ in small_docs:
        first = min(groups[bare(t)], key=lambda g: (g[0], g[1], g[2] if g[2] is not None else 0))
        best = first[2]
        expected.append((d, best, len(groups[bare(t)]), d == best and -len(t or "") == first[0], hashlib.sha256(bare(t).encode()).hexdigest()))
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert collected(exact_dedup.deduplicate(docs, new_index(spark)), *columns) == sorted(expected, key=repr)
    assert collected(exact_dedup.deduplicate(crowded, new_index(spark)), *columns) == sorted(expected, key=repr)


def test_a_batch_may_be_run_again(spark):
    """After its append too; counts of all batches add up, and of rows with one id the longest is kept."""
    def rows(*texts):
        return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")

    def answers(df, batch):
        return collected(exact_dedup.deduplicate(df, index, batch), "doc_id", "keep_id", "group_size", "kept")

    index = new_index(spark)
    one, two = rows("a", "a ", "b"), rows("a", "c", "a", " a")
    first = answers(one, "one")
    assert first == [(0, 1, 2, False), (1, 1, 2, True), (2, 2, 1, True)] == answers(one, "one")
    second = answers(two, "two")
    assert second == [(0, 1, 5, False), (1, 1, 1, True), (2, 1, 5, False), (3, 1, 5, False)] == answers(two, "two")
    assert answers(rows("a"), "three") == [(0, 1, 6, False)]
    assert index.rows().count() == 3 and index.all_rows().count() == 5
    same = spark.createDataFrame([(7, "x y"), (7, "x  y"), (7, "x  y"), (None, "z")], "doc_id bigint, text string")
    found = collected(exact_dedup.deduplicate(same, new_index(spark)), "doc_id", "keep_id", "kept")
    assert found == sorted([(7, 7, False), (7, 7, True), (7, 7, True), (None, None, True)], key=repr)
    assert [r["text"] for r in exact_dedup.keep_first_copies(same.where("doc_id = 7"), new_index(spark)).collect()] == ["x  y"]
    path = index.path
    index.drop()
    assert not spark.catalog.tableExists(index.name)
    import os

    assert not os.path.exists(path.removeprefix("file:"))


def test_index_persists(spark, docs):
    name = f"index_{uuid.uuid4().hex}"
    first = exact_dedup.DigestIndex(spark, name, buckets=4)
    one, two = docs.where("doc_id < 30"), docs.where("doc_id >= 20 OR doc_id IS NULL")
    kept = exact_dedup.deduplicate(one, first).where("kept").select("doc_id").distinct().count()
    n = first.rows().count()
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    again = exact_dedup.DigestIndex(spark, name, first.path, buckets=4)
    late = exact_dedup.deduplicate(two, again).collect()
    assert kept == n and all(not r["kept"] for r in late if r["doc_id"] is not None and 20 <= r["doc_id"] < 30)
    texts = {bare(r["text"]) for r in docs.collect()}
    assert again.rows().count() == len(texts) == again.rows().select("digest").distinct().count()


def test_keep_first_copies(spark, crowded, no_docs):
    kept = exact_dedup.keep_first_copies(crowded, new_index(spark))
    assert kept.columns == crowded.columns
    texts = [bare(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({bare(r["text"]) for r in crowded.collect()})
    assert exact_dedup.keep_first_copies(no_docs, new_index(spark)).count() == 0


# mixing


def test_mixing(spark, docs, crowded, small_docs, no_docs):
    found = mixing.mix(docs).collect()
    size = collections.Counter()
    for _, t, _, s, _ in small_docs:
        size[s] += len(words(t))
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, rest = {s: 0.0 for s in size}, 1.5 * sum(size.values())
    open_ = set(size)
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in list(open_):
            if target[s] >= 2 * size[s]:
                rest += target[s] - 2 * size[s]
                target[s] = 2.0 * size[s]
                open_.discard(s)
    by_size = {s: (size[s], target[s]) for s in size}
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    taken, targets = collections.Counter(), {}
    for row in found:
        s = next(k for k, v in by_size.items() if v[0] == row["source_size"])
        assert row["target"] == pytest.approx(by_size[s][1])
        assert row["taken"] <= 2 * row["size"] and row["taken"] == row["copies"] * row["size"]
        taken[s] += row["taken"]
    longest = max(len(words(t)) for _, t, *_ in small_docs)
    assert all(abs(taken[s] - target[s]) <= longest / 2 + 1 for s in size)
    assert collected(mixing.mix(crowded), "doc_id", "taken") == collected(docs.sparkSession.createDataFrame(found), "doc_id", "taken")
    assert mixing.mix(no_docs).count() == 0


def test_mixes_are_nested(docs):
    """What a smaller budget takes, a larger one takes too."""
    sizes = mixing.hashed_sizes(docs, "x").where("size < 1000")
    totals = sizes.groupBy("source").sum("size").collect()
    spark = docs.sparkSession
    chosen = []
    for share in (0.0, 0.3, 0.7, 1.0):
        budgets = spark.createDataFrame([(r[0], r[1] * share) for r in totals], "source string, budget double")
        below = {r["source"]: r["below"] for r in mixing.thresholds(sizes, budgets).collect()}
        rows = sizes.collect()
        chosen.append({(r["doc_id"], r["hash"]) for r in rows if r["hash"] < below[r["source"]]})
        for source, total in totals:
            got = sum(r["size"] for r in rows if r["source"] == source and r["hash"] < below[source])
            assert abs(got - total * share) <= 120
    assert chosen[0] <= chosen[1] <= chosen[2] <= chosen[3] and chosen[1] < chosen[2]


def test_ids_shared_by_sources(spark):
    """Each source is taken as the mix says, though its rows have the ids, null too, of other sources' rows."""
    rows = [(None if i == 0 else i, f"w{i} " * (5 + i % 3), s) for s in ("a", "b", "c") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    expected = sum(r["copies"] for r in mixing.mix(df).collect())
    out = mixing.mixed_documents(df)
    assert out.count() == expected
    taken = collections.Counter()
    for r in mixing._mixed(df, "mix", mixing.WEIGHTS, mixing.SHARE, mixing.MOST_REPEATS).collect():
        taken[r["source"]] += r["copies"]
    assert {r["source"]: r["count"] for r in out.groupBy("source").count().collect()} == dict(taken)


def test_mixed_documents(crowded):
    out = mixing.mixed_documents(crowded)
    assert out.columns == crowded.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(crowded).collect()}
    rows = collections.Counter(r["doc_id"] for r in crowded.collect())
    assert collections.Counter(r["doc_id"] for r in out.collect()) == {d: rows[d] * n for d, n in copies.items() if n}


# sentence pieces


@pytest.fixture(scope="module")
def piece_model():
    with open(PIECES, "rb") as file:
        return sentence_pieces.PieceModel(file.read())


def test_no_dropout_is_the_library(piece_model, small_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoder = sentence_pieces.Encoder(piece_model, "s", 0.0, 1)
    odd = ["a  b   c ", " x²³ ½", "日本語 text\x00z", "\n\n a\tb", " " * 40 + "q" + "-" * 70, "don't _x_ 12,345.6", "e\u0301é"]
    for text in odd + [t for _, t, *_ in small_docs if t and "▁" not in t]:
        assert encoder.encode(text, "1")[0] == library.encode(text)


def test_agendas_agree(piece_model, small_docs):
    for k, (_, text, *_) in enumerate(small_docs):
        for run in piece_model.runs.findall(" " + (text or "")[:3000]) + [(text or "")[:48]]:
            for below in (0, 1 << 29, 1 << 32):
                short = piece_model.merge_short(piece_model.symbols(run), k * 7919, below)
                assert short == piece_model.merge_long(piece_model.symbols(run), k * 7919, below)


def test_runs_merged_together_are_those_merged_alone(piece_model, small_docs):
    texts = [t or "" for _, t, *_ in small_docs] + ["", " ", "x" * 47 + " " + "y" * 49, "😀 é é \uffff"]
    names = [str(i) for i in range(len(texts))]
    for rate in (0.0, 0.1, 0.6, 1.0):
        together = sentence_pieces.Encoder(piece_model, "s", rate, 3).encode_all(texts, names)
        alone = sentence_pieces.Encoder(piece_model, "s", rate, 3)
        assert list(together) == [alone.encode(t, n) for t, n in zip(texts, names)]


def test_dropout_round_trip(docs, crowded, small_docs, no_docs):
    rows = sentence_pieces.round_trip(docs).collect()
    assert len(rows) == len(small_docs) and all(r["lossless"] for r in rows)
    encoded = sentence_pieces.encode(crowded, carry=("source",))
    back = sentence_pieces.decode(encoded)
    expected = sorted(((d, t or "") for d, t, *_ in small_docs), key=repr)
    assert collected(back, "doc_id", "text") == expected
    assert collected(sentence_pieces.encode(docs), "doc_id", "ids") == collected(encoded, "doc_id", "ids")
    other = sentence_pieces.encode(docs, seed="another")
    assert collected(other, "doc_id", "ids") != collected(encoded, "doc_id", "ids")
    assert collected(sentence_pieces.decode(other), "doc_id", "text") == expected
    assert sentence_pieces.round_trip(no_docs).count() == 0 and sentence_pieces.encode(no_docs).count() == 0


def test_dropout_varies_and_drops_at_the_rate(piece_model):
    encoder = sentence_pieces.Encoder(piece_model, "s", 0.2, 4)
    ids, skipped = encoder.encode("international " * 400, "1")
    cuts = {tuple(encoder.cached[v]["▁international"[0].replace("▁", " ") + "international"][0]) for v in range(4)}
    assert len(cuts) > 1 and skipped > 0
    everything = sentence_pieces.Encoder(piece_model, "s", 1.0, 4)
    assert everything.encode("abc def", "1")[0] == [piece_model.id[c] for c in "▁abc▁def"]


def test_each_occurrence_draws_anew(piece_model, small_docs):
    """A run has more segmentations than four, others in a copy, and each is what its own key gives."""
    encoder = sentence_pieces.Encoder(piece_model, "s", 0.2)
    run = " international"
    keys = sentence_pieces._run_keys(5, 3000)
    found = encoder.fresh.find([run] * 3000, keys)
    assert len({ids for ids, _ in found}) > 4
    below = encoder.fresh.drop_below
    for key, (ids, skipped) in zip(keys.tolist(), found):
        pieces, s = piece_model.merge_short(piece_model.symbols(run), key, below)
        assert (ids, skipped) == (piece_model.ids(pieces), s)
    texts = [t or "" for _, t, *_ in small_docs] + ["", " ", "x" * 47 + " " + "y" * 49, "😀 é é \uffff", run * 500]
    names = [str(i) for i in range(len(texts))]
    together = list(encoder.encode_all(texts, names))
    alone = sentence_pieces.Encoder(piece_model, "s", 0.2)
    assert together == [alone.encode(t, n) for t, n in zip(texts, names)]
    assert all(encoder.decode(ids) == t for (ids, _), t in zip(together, texts))
    assert alone.encode(run * 500, "1") != alone.encode(run * 500, "1:1")
    few = sentence_pieces.Encoder(piece_model, "s", 0.2, most=1)
    assert together == list(few.encode_all(texts, names))


def test_copies_of_the_pipeline_are_cut_apart(spark):
    import corpus_pipeline

    text = "international understanding of several documents " * 40
    docs = spark.createDataFrame([(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, "en", "a", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = corpus_pipeline.token_ids(spark, docs, "").collect()
    assert len(rows) == 3 and len({tuple(r["ids"]) for r in rows}) == 3
    assert {r["text"] for r in sentence_pieces.decode(spark.createDataFrame(rows)).collect()} == {text}


# quality


def test_neighbours(docs, crowded, labels, small_docs, no_docs):
    out = quality_neighbours.classify(docs, labels).collect()
    assert len(out) == len(small_docs)
    for row in out:
        held = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2
        assert row["held_out"] == held and 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.7)
    columns = ("doc_id", "score", "predicted")
    assert collected(quality_neighbours.classify(crowded, labels), *columns) == sorted(((r["doc_id"], r["score"], r["predicted"]) for r in out), key=repr)
    kept = quality_neighbours.keep_good(crowded, labels)
    assert kept.columns == crowded.columns
    assert quality_neighbours.classify(no_docs, labels).count() == 0
    assert {r["score"] for r in quality_neighbours.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_are_not_learnt(docs, labels):
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(quality_neighbours.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    columns = ("doc_id", "score")
    assert collected(quality_neighbours.classify(docs, labels), *columns) == collected(quality_neighbours.classify(docs, flipped), *columns)


def test_scores_are_blocked_cosines():
    """Blocks give what one product over all rows gives, and votes follow the definition."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        at = np.unique(rng.integers(0, quality_neighbours.TERMS, 40))
        rows.append((at, rng.integers(1, 5, len(at)).astype("f4"), k % 2))
    settings = quality_neighbours.Settings(block=7, neighbours=9, dimensions=12)
    model = quality_neighbours.Model(rows, {0: 0.5, 1: 0.5}, settings)
    counts = np.zeros((30, quality_neighbours.TERMS), dtype=np.float32)
    for k, (at, value, _) in enumerate(rows[:30]):
        counts[k, at] = value
    got = model.scores(counts)
    vectors = quality_neighbours._unit(model.weighted(counts) @ model.basis)
    for k, v in enumerate(vectors):
        cosine = model.vectors @ v
        near = np.argsort(-cosine)[:9]
        w = np.maximum(cosine[near], 0) ** settings.power
        assert got[k] == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=1e-3)


TABLES = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    import os

    if not os.path.isdir(TABLES):
        pytest.skip("the generated tables are not here")
    docs, labels = spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")
    out = quality_neighbours.classify(docs, labels).where("held_out").join(labels, "doc_id")
    hits = [r["predicted"] == r["quality"] for r in out.collect()]
    assert sum(hits) >= 0.97 * len(hits)
    judged = quality_rules.apply_rules(docs, labels.where(~quality_neighbours.held_out())).join(labels, "doc_id")
    judged = judged.where(quality_neighbours.held_out()).collect()
    hits = [(r["probability"] >= 0.5) == bool(r["quality"]) for r in judged]
    assert sum(hits) >= 0.95 * len(hits)


def base_counts(text):
    text = text or ""
    w = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules(docs, crowded, labels, small_docs, no_docs):
    rows = quality_rules.apply_rules(docs, labels)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert collected(rows, *columns) == sorted(((d, *base_counts(t)) for d, t, *_ in small_docs), key=repr)
    for r in rows.collect():
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["probability"] >= 0.5)
    assert collected(quality_rules.apply_rules(crowded, labels), *columns, "kept") == collected(rows, *columns, "kept")
    assert quality_rules.apply_rules(no_docs, labels).count() == 0
    assert quality_rules.apply_rules(docs, labels.limit(0)).count() == len(small_docs)


# near duplicates


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(pairs):
    sets = [(d, shingles(t)) for d, t in pairs]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if sets[i][0] == sets[j][0] and sets[i][0] is not None or a and b and 100 * len(a & b) >= 80 * len(a | b):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i))) for i, (d, s) in enumerate(sets)]


def test_near_duplicates(docs, crowded, small_docs, no_docs):
    expected = sorted(brute_components([(d, t) for d, t, *_ in small_docs]), key=repr)
    columns = ("doc_id", "n_shingles", "component_id")
    assert collected(jaccard_join.near_duplicates(docs), *columns) == expected
    assert collected(jaccard_join.near_duplicates(crowded), *columns) == expected
    kept = jaccard_join.keep_one_of_each(crowded)
    assert kept.columns == crowded.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _, c in expected if d == c}
    assert jaccard_join.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_small_sets_and_chains(spark, seed):
    """Short texts, where subsets do the work, and long chains of near copies without one centre."""
    import random

    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(25):
        text = [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(4, 20))]
        for _ in range(6):
            rows.append((n, " ".join(text)))
            n += 1
            text = text[rng.randrange(2) :] + ([rng.choice("abcdefgh")] if rng.random() < 0.7 else [])
    chain = [f"w{rng.randrange(10**6)}" for _ in range(70)]
    for k in range(30):
        rows.append((n, " ".join(chain)))
        n += 1
        chain = chain[1:] + [f"w{rng.randrange(10**6)}"]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = collected(jaccard_join.near_duplicates(df), "doc_id", "n_shingles", "component_id")
    assert found == sorted(brute_components(rows), key=repr)


def test_bounds():
    """Brute force over small sizes: the needed overlap, the early places, the boundary."""
    for n in range(1, 40):
        for m in range(1, 40):
            least = next((i for i in range(min(n, m) + 1) if 100 * i >= 80 * (n + m - i)), None)
            if least is not None:
                assert jaccard_join.needed(n, m) == least
                assert n - least + 1 <= jaccard_join.early(n)
    assert jaccard_join.boundary({}) == 0 and 5 <= jaccard_join.boundary({n: 100 for n in range(1, 17)}) <= 16


@pytest.mark.parametrize("least", [connected.HUB_LEAST, 2])
def test_components(spark, monkeypatch, least):
    """Also when nearly every node counts as a hub."""
    import random

    monkeypatch.setattr(connected, "HUB_LEAST", least)
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(900, i) for i in range(901, 990)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    for n in [n for edge in edges for n in edge]:
        root(n)
    with Scratch(spark) as scratch:
        found = connected.components(spark.createDataFrame(edges, "a bigint, b bigint"), scratch)
        assert dict(collected(found, "node", "component")) == {n: root(n) for n in parent if root(n) != n}
        assert connected.components(spark.createDataFrame([], "a bigint, b bigint"), scratch).count() == 0


def test_a_hub_of_50000_edges(spark):
    """Its edges are met by a broadcast of the hubs: no row of it is left for the shuffled join."""
    from pyspark.sql import functions as F

    spokes = spark.range(50_000).select(F.lit(7).cast("long").alias("a"), (F.col("id") + 100).alias("b"))
    pairs = spark.range(500).select((F.col("id") * 2 + 200_000).alias("a"), (F.col("id") * 2 + 200_001).alias("b"))
    with Scratch(spark) as scratch:
        found = connected.components(spokes.unionByName(pairs), scratch)
        counts = dict(collected(found.groupBy("component").count(), "component", "count"))
        assert counts[7] == 50_000 and len(counts) == 501 and set(counts.values()) == {1, 50_000}
    edges = spokes.unionByName(pairs).select(F.col("a").alias("u"), F.col("b").alias("v"))
    known, least = connected._with_least(edges, max(connected.HUB_LEAST, 50_500 // connected.HUB_SHARE))
    assert known.count() == 50_500 and least.count() == 501
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan and known.where("u = 7 AND m = 100").count() == 50_000


# personal data

sys.set_int_max_str_digits(0)


def brute_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


ODD_SPANS = [
    "a@b.c_d@e.f g@h.i.j@k.l",
    "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 1.2.3",
    "4111 1111 1111 1111-1 4111-1111-1111-1111 41111111 11111111 😀 4111111111111112",
    "+1 555 555 5555 +49 (0)30.123-456 +1+1555555555 +12 34",
    "9" * 30_000 + ".1.2.3",
    "x@y" + ".z" * 20_000,
    "+1" + " " * 20_000 + "2",
    "-".join("12" for _ in range(20_000)),
]


def test_base_spans(spark, docs, small_docs, crowded, no_docs):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD_SPANS)], "doc_id bigint, text string")
    rows = personal_data.find(docs.select("doc_id", "text").unionByName(extra)).collect()
    texts = [(d, t) for d, t, *_ in small_docs] + [(1000 + i, t) for i, t in enumerate(ODD_SPANS)]
    expected = []
    for d, t in texts:
        spans = brute_spans(t)
        kinds = collections.Counter(s.split(":")[0] for s in spans)
        expected.append((d, *(kinds[k] for k in personal_data.KINDS), hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans)))
    found = []
    for r in rows:
        kept = [s for s in r["spans"].split(",") if s and not s.startswith("secret:")]
        assert len(r["spans"].split(",")) - len(kept) - (not r["spans"]) == r["n_secret"]
        assert len(r["spans"].split(",")) - (not r["spans"]) == r["n_spans"]
        found.append((r["doc_id"], *(r[f"n_{k}"] for k in personal_data.KINDS), r["base_sha256"], ",".join(kept)))
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert personal_data.find(crowded).count() == len(small_docs)
    assert personal_data.find(no_docs).count() == 0


def test_secrets(spark):
    rng = __import__("random").Random(2)
    rows, secret = [], set()
    for i in range(120):
        token = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        if i % 3 == 0:
            rows.append((i, f"some words here password={token} and more"))
            secret.add(i)
        elif i % 3 == 1:
            rows.append((i, f"the part mk2engineoilfilter{i % 7} is in store near you"))
        else:
            rows.append((i, "nothing to see"))
    found = personal_data.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in found if r["n_secret"]} == secret
    at = next(r["spans"] for r in found if r["doc_id"] == 0)
    assert at == "secret:25:57"


def test_estimate():
    """Reliable labelers outweigh one that votes at random."""
    patterns = [((1, 1, 0), 50), ((1, 1, 1), 50), ((0, 0, 0), 100), ((0, 0, 1), 100), ((None, 1, 0), 5)]
    p = personal_data.estimate(patterns)
    assert p[(1, 1, 0)] > 0.95 and p[(0, 0, 1)] < 0.05 and p[(None, 1, 0)] > 0.9
    assert personal_data.estimate([]) == {}


# licenses


def test_license_scan(spark):
    apache = license_scan.TEMPLATES["Apache-2.0"][1]
    rows = [
        (1, "a/b/c/code.py", "x = 1"),
        (2, "a/LICENSE", "Released under the MIT License."),
        (3, "a/b/LICENSE.txt", apache.replace(". ", ".\n")),
        (4, "a/d/code.py", None),
        (5, "e/code.py", ""),
        (6, "a/b/own.c", "/* This work is licensed under the GNU General Public License, version 3. */\nint main;"),
        (7, "top.txt", "the license of the text is not said here"),
        (8, None, "Licensed under CC BY-NC 4.0."),
        (9, "a/b/c/code.py", "x = 1"),
        (10, "a/b/c/d/e/f.txt", "word " * 50_000),
        (11, "ab/code.py", "y"),
    ]
    df = spark.createDataFrame(rows, "file_id bigint, path string, text string")
    found = {r["file_id"]: r for r in license_scan.scan(df).collect()}
    assert len(found) == len(rows)
    assert {i: found[i]["final"] for i in found} == {
        1: "Apache-2.0", 2: "MIT", 3: "Apache-2.0", 4: "MIT", 5: None, 6: "GPL-3.0", 7: None, 8: "CC-BY-NC-4.0", 9: "Apache-2.0",
        10: "Apache-2.0", 11: None,
    }
    assert found[1]["from_directory"] == "a/b" and found[4]["from_directory"] == "a" and found[6]["inherited"] is None
    assert license_scan.scan(df.limit(0)).count() == 0
    from pyspark.sql import functions as F

    crowded = df.select("*", *(F.lit(0).alias(c) for c in "license score directory depth ancestor held inherited df word".split()))
    assert collected(license_scan.scan(crowded), "file_id", "final") == collected(license_scan.scan(df), "file_id", "final")


def test_cosine_is_exact():
    """Inverted lists give the dense cosine, and no unit without an anchor reaches the least similarity."""
    import math

    t = license_scan.Templates({"the": 900, "of": 800, "license": 3}, 1000)
    units = [x for texts in license_scan.TEMPLATES.values() for x in texts] + ["the of and is", "Licensed under the MIT License, version 2.0"]
    dense = [t.vector(license_scan.words_of(x)) for texts in map(license_scan.TEMPLATES.get, sorted(license_scan.TEMPLATES)) for x in texts]
    for unit in units:
        row = t.vector(license_scan.words_of(unit))
        cosines = [sum(v * other.get(k, 0.0) for k, v in row.items()) for other in dense]
        score, name, _ = t.best(unit)
        if t.anchors & set(license_scan.words_of(unit)):
            assert score == pytest.approx(max(cosines)) and cosines[t.names.index(name)] <= score + 1e-9
        else:
            assert max(cosines) < license_scan.LEAST
        assert math.sqrt(sum(v * v for v in row.values())) == pytest.approx(1.0)


def test_whole_license_texts(spark):
    """Full texts, in files of their own, in comments and beside other text, and headers that are wrapped."""
    import textwrap

    full = {name: texts[0] for name, texts in license_scan.text_templates().items() if len(texts[0]) > 600}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-3.0", "ISC", "CC-BY-NC-4.0"} <= set(full)
    title = "Copyright (c) 2015-2024 Zoltan Quux and the Frobnicator contributors <quux@frob.example>\n\n"
    mit = full["MIT"].partition("\n\n")[2]
    apache = license_scan.HEADERS["Apache-2.0"][0]
    gpl = license_scan.TEMPLATES["GPL-3.0"][1]
    comment = lambda text: "".join(f" * {line}".rstrip() + "\n" for line in text.split("\n"))
    code = "\n".join(f"int frob{k}(int quux{k}) {{ return quux{k} << {k}; }}" for k in range(300))
    prose = "\n".join(f"gorp{k} blin{k * 7} trel{k % 13} vosk{k % 5} mun" for k in range(300))
    cases = [(name, f"{name}/LICENSE", title + text) for name, text in full.items()]
    cases += [
        ("MIT", "in/comment.c", f"/*\n{comment(title + mit)} */\n{code}"),
        ("MIT", "in/read.me", f"{prose}\n\n{title}{mit}\n\n{prose}"),
        ("Apache-2.0", "in/wrapped.py", "# " + "\n# ".join(textwrap.wrap(apache, 40)) + "\nimport os\n" + code),
        ("GPL-3.0", "in/wrapped.sh", "#!/bin/sh\n# " + "\n# ".join(textwrap.wrap(gpl, 50)) + "\n\n" + code),
        ("Apache-2.0", "opening/LICENSE", full["Apache-2.0"].partition("   APPENDIX")[0]),
        ("GPL-3.0", "unclosed/COPYING", full["GPL-3.0"].partition("How to Apply")[0]),
        ("GPL-2.0", "unclosed2/COPYING", full["GPL-2.0"].partition("How to Apply")[0]),
        (None, "none/code.c", code),
        (None, "none/text", prose + "\nthe software is provided to you in good order and the copyright is mine\n" + prose),
    ]
    rows = [(k, path, text) for k, (_, path, text) in enumerate(cases)]
    rows += [(1000 + k, f"{name}/src/deep/x.py", "x = 1") for k, name in enumerate(full)]
    rows += [(2000 + k, f"other/{k}", f"{prose[k * 11 : k * 11 + 900]} the of and to a in is it") for k in range(200)]
    found = {r["file_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "file_id bigint, path string, text string")).collect()}
    assert [(path, found[k]["license"]) for k, (_, path, _) in enumerate(cases)] == [(path, name) for name, path, _ in cases]
    for k, name in enumerate(full):
        assert found[k]["license_file"] and found[1000 + k]["inherited"] == name


def test_each_star_is_planned_alone(spark):
    """The driver plans one star at a time: no written table of a round joins more than the hubs and the others."""
    joins = []

    class Watched(Scratch):
        def written(self, df, name):
            joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
            return super().written(df, name)

    edges = [(i, i + 1) for i in range(40)]
    with Watched(spark) as scratch:
        found = connected.components(spark.createDataFrame(edges, "a bigint, b bigint"), scratch)
        assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(1, 41)]
    assert max(joins) <= 3


def test_components_are_sought_again_only_for_new_links(spark, monkeypatch):
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(1, words + " a"), (2, words + " b"), (3, "another text of other words than these")], "doc_id bigint, text string"
    )
    calls = []
    monkeypatch.setattr(jaccard_join, "components", lambda *given: calls.append(1) or connected.components(*given))
    rows = sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect())
    assert rows == [(1, 1), (2, 1), (3, 3)] and len(calls) == 1


def test_new_runs_are_learned_together(piece_model, monkeypatch):
    """Runs without unknown characters are not merged one by one; each gets what its own key gives."""
    runs = [" international", " of", "zebra", " 2024", " naïve", "\ttab", " x" * 20, " ▁ 😀"] * 50
    runs += [f" word{i}" for i in range(300)]
    keys = sentence_pieces._run_keys(9, len(runs))
    encoder = sentence_pieces.Encoder(piece_model, "s", 0.3)
    expected = []
    for run, key in zip(runs, keys.tolist()):
        pieces, skipped = piece_model.merge_short(piece_model.symbols(run), key, encoder.fresh.drop_below)
        expected.append((piece_model.ids(pieces), skipped))
    split, alone = piece_model.symbols, []
    monkeypatch.setattr(piece_model, "symbols", lambda run: alone.append(run) or split(run))
    assert encoder.fresh.find(runs, keys) == expected
    assert not {run for run in alone if run.startswith((" word", " of", "zebra"))}
