"""Merkle manifest against trees built by plain recursion."""

from __future__ import annotations

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tocsin.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc_id, text, lang, source, n_chars):
    return digest(*[field(v) for v in (doc_id, source, lang, n_chars, text)])


def tree(leaves, arity):
    """Root and, for each leaf, the siblings (left, right) of its ancestors."""
    paths = [[] for _ in leaves]
    level, members = leaves, [[i] for i in range(len(leaves))]
    while len(level) > 1:
        nodes, below = [], []
        for at in range(0, len(level), arity):
            run = level[at : at + arity]
            nodes.append(digest(*run))
            below.append(sum(members[at : at + arity], []))
            for k in range(len(run)):
                for i in members[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        level, members = nodes, below
    return level[0], paths


def expected(rows, arity=2):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf(*row), row))
    names = sorted(groups, key=lambda g: b"" if g is None else b"=" + g.encode())
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in names}
    root, above = tree([trees[g][0] for g in names], arity)
    out = []
    for g, up in zip(names, above):
        subroot, paths = trees[g]
        for (_, _, own, row), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths):
            doc_id, text, lang, source, n = row
            node = own
            if doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
                node = leaf(doc_id, text, lang, source, n + 1)
            for left, right in path + up:
                node = digest(left, node, right)
            proof = digest(*[left + right for left, right in path + up])
            out.append((doc_id, own, subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


@pytest.mark.parametrize("arity, span", [(2, 12), (2, 2), (3, 1), (5, 2)])
def test_manifest(docs, small_docs, arity, span):
    """Blocks of few levels give the same tree as one block; a node may have more than two children."""
    rows = found(merkle.verify(docs, arity, span))
    assert rows == expected(small_docs, arity)
    assert {row[-1] for row in rows} == {True, False}


def test_odd_tables(docs, crowded, no_docs, small_docs):
    assert found(merkle.verify(crowded)) == expected(small_docs)
    assert found(merkle.verify(no_docs)) == []
    one = docs.where("doc_id = 12")
    assert found(merkle.verify(one)) == expected([row for row in small_docs if row[0] == 12])
    assert merkle.verify(one).first()["root"] == leaf(*[r for r in small_docs if r[0] == 12][0])


def test_one_group_over_many_blocks(spark):
    """A group of 1,000 rows in blocks of eight: several levels of block tables, the last run of a level shorter."""
    rows = [(i, f"t{i}", "en" if i % 50 else None, "s", i) for i in range(1000)]
    rows += [(0, "t0", None, "s", 0)] * 9
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert found(merkle.verify(df, span=3)) == expected(rows)


def test_a_changed_row_fails_alone(docs):
    rows = merkle.verify(docs).select("doc_id", "verified", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7).alias("r"),
                                      "leaf", "folded_root", "root").collect()
    assert all(row.verified == (row.folded_root == row.root) for row in rows)
    assert all(row.verified for row in rows if row.r != 0 or row.doc_id is None)


def test_largest_count(spark):
    """n_chars at its largest cannot grow; the changed row then has none and still differs."""
    row = next((i, "x", "en", "s", 2**63 - 1) for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0)
    df = spark.createDataFrame([row], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert merkle.verify(df).first()["verified"] is False
