from __future__ import annotations

import random

import pytest

from tocsin.llm import common

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def small_docs():
    """Rows with nulls, empty and long texts, ties, repeated rows, exact and near copies, personal data."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeo") for _ in range(rng.randrange(2, 7))) for _ in range(300)]

    def prose(n: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base = [prose(rng.randrange(1, 120)) for _ in range(60)]
    rows = [(i, text) for i, text in enumerate(base)]
    for i in range(40):  # near copies: a few words changed
        words = rng.choice(base).split(" ")
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, base[3].replace(" ", "  ") if i % 2 else base[3]) for i in range(9)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "WORD!! " * 40), (304, "a b c d"), (305, "A b  c D")]
    rows += [(306, prose(30_000)), (307, "x" * 60_000), (308, "a▁b ▁ ▁▁ 日本語 \x00 😀\n\n  end "), (309, "one two three four five")]
    rows += [(310, "mail me a@b.c_d@e.f or 4111 1111 1111 1111 at 1.2.3.4.5 +1 (555) 555-5555 😀 password=0123456789abcdef01")]
    rows += [(5, base[5]), (5, base[5]), (None, "no id here"), (None, None)]
    out = []
    for k, (doc_id, text) in enumerate(rows):
        source = None if k % 11 == 0 else f"s{k % 4}"
        out.append((doc_id, text, None if k % 7 == 0 else "en", source, None if text is None else len(text)))
    return out


@pytest.fixture(scope="module")
def docs(spark, small_docs):
    return spark.createDataFrame(small_docs, SCHEMA)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def crowded(docs):
    """The same rows with columns that have the names of the operators' own."""
    from pyspark.sql import functions as F

    names = (
        "size hash keep_id digest best batch score predicted held_out probability n first key place component "
        "component_id copies target source_size __id0 ids host path rule verdict bad word df spans base candidates"
    )
    return docs.select("*", *(F.lit("clash").alias(name) for name in names.split()))


@pytest.fixture(scope="module")
def labels(spark, small_docs):
    rows = [(d, int(not (t or "").startswith("WORD")), 0) for d, t, *_ in small_docs if d is not None]
    junk = [(d, None, None) for d in (1, 2)]
    return spark.createDataFrame([*dict((r[0], r) for r in rows).values(), *junk], "doc_id bigint, quality int, toxic int")


def words(text):
    return common.WORD_RE.findall(text or "")
