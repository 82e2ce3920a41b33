"""License scan: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

Terms are words and word pairs. Their weights come from the templates and from the number of documents that hold each
template word, counted over all documents. Every line, sentence and run of neighbouring lines of a text is compared, if
it holds an anchor: anchors are the rarest template words, as many as it takes for the others not to reach the least
similarity by themselves, so no unit that could match is passed over.

The full texts of the licenses, their usual headers and the long notices are further templates. The whole file, its
paragraphs, its comments and the runs of lines that read like license texts are compared with them. A text that lacks
the terms to reach the least similarity with any of them, whatever its length, is passed over. Words that no template
has weigh a bounded amount there, so names and years do not hide a license. What a full text covers is not judged again
by the notices inside it.

A file without a notice of its own takes the license of the nearest directory above it that has a license file.
Directories are reduced to one row each and joined to their ancestors by path.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import WORD_RE, written

#: Notices of well-known licenses. Fixed values.
TEMPLATES: Mapping[str, Sequence[str]] = {
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal.",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "MPL-2.0": (
        "Released under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

#: Usual headers of source files and grants, as in the licenses' own instructions.
_PROGRAM = (
    "This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{stop} either version {n} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
    "You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
HEADERS: Mapping[str, Sequence[str]] = {
    "AGPL-3.0": (_PROGRAM.format(mark=":", name="Affero General Public License", stop=",", n=3),),
    "Apache-2.0": (
        TEMPLATES["Apache-2.0"][1]
        + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-2.0": (
        _PROGRAM.format(mark=";", name="General Public License", stop=";", n=2),
        _PROGRAM.format(mark=";", name="General Public License", stop=";", n=2).partition(" If not")[0]
        + " if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "GPL-3.0": (_PROGRAM.format(mark=":", name="General Public License", stop=",", n=3),),
    "LGPL-2.1": (_PROGRAM.replace("program", "library").format(mark=";", name="Lesser General Public License", stop=";", n="2.1"),),
    "LGPL-3.0": (_PROGRAM.format(mark=":", name="Lesser General Public License", stop=",", n=3),),
    "MIT": (
        TEMPLATES["MIT"][1]
        + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
}

#: A template or unit of fewer words is a notice, not a text; a unit of more than NOTICE_WORDS is too long for a notice.
TEXT_WORDS = 20
NOTICE_WORDS = 400

LEAST = 0.75
#: A file is a license file when its name says so or notices make up this share of its words.
FILE_SHARE = 0.5
FILE_NAME = r"(?i)^(?:licen[sc]e|copying|notice|unlicense)(?:[-.].*)?$"

_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_SENTENCE = re.compile(r"(?<=[.!?;])[\x20\t]+")


def words_of(text: str) -> list[str]:
    return _TERM.findall(text.lower())


@functools.cache
def text_templates() -> Mapping[str, Sequence[str]]:
    """Full texts (files of this package, named by license), usual headers and long notices."""
    out = {file.stem: [file.read_text(encoding="utf-8")] for file in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    for some in (HEADERS, TEMPLATES):
        for name, texts in some.items():
            out.setdefault(name, []).extend(text for text in texts if len(words_of(text)) >= TEXT_WORDS)
    return {name: texts for name, texts in out.items() if texts}


_MARK = re.compile(r"[\x20\t]*(?:#|//|/\*|\*|--|;|%|<!--|(?i:rem)\b|dnl\b)")


def _runs(flags: Sequence[bool]) -> Iterator[tuple[int, int]]:
    """First and end of each run of true flags."""
    start = None
    for k, flag in enumerate([*flags, False]):
        if flag and start is None:
            start = k
        elif not flag and start is not None:
            yield start, k
            start = None


class Vectors:
    """Unit vectors of templates as inverted lists. outside: the weight of words that no template has."""

    def __init__(self, df: Mapping[str, int], n_docs: int, templates: Mapping[str, Sequence[str]], least: float, bounded: bool):
        self.least = least
        self.rarest = math.log(1 + n_docs) + 1
        self.word_idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) + 1 for w in template_words(templates)}
        self.outside = sorted(self.word_idf.values())[len(self.word_idf) // 2] if bounded else self.rarest
        self.names: list[str] = []
        self.lists: dict[object, list[tuple[int, float]]] = {}
        self.rows: list[dict[object, float]] = []
        for name, texts in sorted(templates.items()):
            for text in texts:
                row = self.vector(words_of(text))
                for term, weight in row.items():
                    self.lists.setdefault(term, []).append((len(self.names), weight))
                self.names.append(name)
                self.rows.append(row)

    def vector(self, words: list[str]) -> dict[object, float]:
        counts: Counter = Counter(words)
        counts.update(zip(words, words[1:]))
        idf = lambda w: self.word_idf.get(w, self.outside)
        row = {t: (1 + math.log(k)) * (idf(t) if isinstance(t, str) else max(map(idf, t))) for t, k in counts.items()}
        norm = math.sqrt(sum(v * v for v in row.values())) or 1.0
        return {t: v / norm for t, v in row.items()}

    def nearest(self, words: list[str]) -> tuple[float, str]:
        """(similarity, license); the first name of equals."""
        sums: dict[int, float] = {}
        for term, weight in self.vector(words).items():
            for k, other in self.lists.get(term, ()):
                sums[k] = sums.get(k, 0.0) + weight * other
        score, k = max(((round(v, 9), -k) for k, v in sums.items()), default=(0.0, 0))
        return score, self.names[-k]


class Texts(Vectors):
    """Vectors of full texts and headers."""

    def __init__(self, df: Mapping[str, int], n_docs: int, templates: Mapping[str, Sequence[str]] | None = None, least: float = LEAST):
        super().__init__(df, n_docs, templates or text_templates(), least, bounded=True)
        # By word: the squared weights of a template's terms that start with it.
        self.place = {w: k for k, w in enumerate(sorted(self.word_idf))}
        self.gain = np.zeros((len(self.place), len(self.names)))
        for k, row in enumerate(self.rows):
            for term, weight in row.items():
                self.gain[self.place[term if isinstance(term, str) else term[0]], k] += weight * weight

    def possible(self, words: list[str]) -> bool:
        """Whether a unit of these words, or of a part of them, can reach the least similarity.

        By Cauchy and Schwarz a cosine is at most the norm of the part of the template whose terms the unit has.
        """
        least = self.least * self.least * 0.999
        places = [self.place[w] for w in self.place.keys() & set(words)]
        if not places or self.gain[places].sum(axis=0).max() < least:
            return False
        sums: Counter = Counter()
        for term in self.lists.keys() & {*words, *zip(words, words[1:])}:
            for k, weight in self.lists[term]:
                sums[k] += weight * weight
        return max(sums.values()) >= least

    def units(self, lines: list[str], by_line: list[list[str]]) -> list[tuple[int, int]]:
        """First and end of the file, its paragraphs, blocks without an empty line, comments, and runs of lines most of
        whose word pairs a template has."""
        legal = [
            not words or (2 * sum(pair in self.lists for pair in zip(words, words[1:])) >= len(words) - 1 and words[0] in self.place)
            for words in by_line
        ]
        kinds = (
            [True] * len(lines),
            [bool(words) for words in by_line],
            [bool(line.strip()) for line in lines],
            [_MARK.match(line) is not None for line in lines],
            legal,
        )
        found = set()
        for flags in kinds:
            for start, end in _runs(flags):
                while start < end and not by_line[start]:
                    start += 1
                while end > start and not by_line[end - 1]:
                    end -= 1
                if start < end:
                    found.add((start, end))
        return sorted(found)


class Templates(Vectors):
    """Vectors of the notices and the anchors, and the full texts beside them."""

    def __init__(
        self,
        df: Mapping[str, int],
        n_docs: int,
        templates: Mapping[str, Sequence[str]] = TEMPLATES,
        least: float = LEAST,
        texts: Texts | None = None,
    ):
        super().__init__(df, n_docs, templates, least, bounded=False)
        self.texts = texts
        rows = self.rows
        order = sorted(self.word_idf, key=lambda w: (-self.word_idf[w], w))
        self.anchors: set[str] = set()
        for word in order:
            # A pair holds an anchor if one of its words is one.
            rest = [
                sum(v * v for t, v in row.items() if not (self.anchors & ({t} if isinstance(t, str) else set(t)))) for row in rows
            ]
            if max(rest, default=0.0) < least * least * 0.999:
                break
            self.anchors.add(word)
        self.search = re.compile("|".join(re.escape(a) for a in sorted(self.anchors, key=len, reverse=True)) or r"(?!)").search

    def best(self, text: str) -> tuple[float, str, int]:
        """(similarity, license, words) of a unit; the first name of equals."""
        words = words_of(text)
        if not self.anchors.intersection(words):
            return 0.0, "", 0
        return *self.nearest(words), len(WORD_RE.findall(text))

    def scan(self, text: str) -> tuple[str | None, float, int, int]:
        """(license or none, best similarity, words of matching units, words) of a whole text.

        A text counts instead of the notices, and the smaller texts, that lie inside it.
        """
        n_words = len(WORD_RE.findall(text))
        words = words_of(text)
        near = self.texts is not None and self.texts.possible(words)
        if not near and self.anchors.isdisjoint(words):
            return None, 0.0, 0, n_words
        lines = text.split("\n")
        found: list[tuple[int, int, float, str]] = []  # first line, end, similarity, license
        covered = [0] * len(lines)
        if self.texts is not None:
            by_line = [words_of(line) for line in lines]
            units = self.texts.units(lines, by_line)
            sizes = {(a, b): sum(map(len, by_line[a:b])) for a, b in units}
            for a, b in sorted(units, key=lambda u: (-sizes[u], u)):
                if any(x <= a and b <= y for x, y, _, _ in found):
                    continue
                unit = [w for words in by_line[a:b] for w in words]
                score, name = self.texts.nearest(unit) if near and len(unit) >= TEXT_WORDS and self.texts.possible(unit) else (0.0, "")
                if score >= self.least:
                    found.append((a, b, score, name))
        texts = list(found)
        inside = lambda a, b: any(x <= a and b <= y for x, y, _, _ in texts)
        anchored = [bool(line) and self.search(line.lower()) is not None for line in lines]
        for k, line in enumerate(lines):
            if anchored[k] and not inside(k, k + 1):
                parts = [line, *(s for s in _SENTENCE.split(line) if s != line)]
                matching = [(s, name, n) for s, name, n in map(self.best, parts) if s >= self.least]
                found += [(k, k + 1, s, name) for s, name, _ in matching]
                covered[k] = max((n for _, _, n in matching), default=0)
        runs = {run for run in _runs(anchored) if run[1] - run[0] > 1}
        if self.texts is not None:  # notices that go on over lines without an anchor
            runs |= {(a, b) for a, b in units if b - a > 1 and any(anchored[a:b]) and sizes[a, b] <= NOTICE_WORDS}
        for a, b in sorted(runs):
            if not inside(a, b):
                score, name, _ = self.best(" ".join(lines[a:b]))
                if score >= self.least:
                    found.append((a, b, score, name))
                    covered[a:b] = [max(c, len(WORD_RE.findall(line))) for c, line in zip(covered[a:b], lines[a:b])]
        for a, b, _, _ in texts:
            covered[a:b] = [len(WORD_RE.findall(line)) for line in lines[a:b]]
        if not found:
            return None, 0.0, 0, n_words
        score = max(s for _, _, s, _ in found)
        return min(name for _, _, s, name in found if s == score), score, min(sum(covered), n_words), n_words


def template_words(templates: Mapping[str, Sequence[str]] = TEMPLATES) -> frozenset[str]:
    return frozenset(w for texts in templates.values() for text in texts for w in words_of(text))


def document_frequencies(files: DataFrame, vocabulary: frozenset[str]) -> tuple[dict[str, int], int]:
    """Documents that hold each template word, and all documents. A row for each word and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(vocabulary.intersection(words_of(text.as_py() or "")))
                counts[""] += 1
        yield pa.RecordBatch.from_pydict({"word": list(counts), "df": list(counts.values())}, pa.schema([("word", pa.string()), ("df", pa.int64())]))

    rows = files.select("text").mapInArrow(run, "word string, df bigint").groupBy("word").agg(F.sum("df").alias("df"))
    found = {row["word"]: row["df"] for row in rows.collect()}
    return found, found.pop("", 0)


def notices(files: DataFrame, templates: Templates) -> DataFrame:
    """file_id, path, license, score, n_notice, n_words."""
    sent = files.sparkSession.sparkContext.broadcast(templates.__dict__ | {"search": None})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Templates.__new__(Templates)
        local.__dict__.update(sent.value)
        local.search = re.compile("|".join(re.escape(a) for a in sorted(local.anchors, key=len, reverse=True)) or r"(?!)").search
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
        for batch in batches:
            found = [local.scan(text.as_py() or "") for text in batch.column("text")]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_id"), batch.column("path"), *columns], ["file_id", "path", "license", "score", "n_notice", "n_words"]
            )

    return files.mapInArrow(run, "file_id bigint, path string, license string, score double, n_notice bigint, n_words bigint")


def _directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), "")


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds license_file, inherited (license of the nearest ancestor directory with a license file) and from_directory.

    Of several license files in a directory the one most like its template counts, then the first path.
    """
    base = F.regexp_extract("path", "([^/]*)$", 1)
    is_file = F.col("license").isNotNull() & (
        base.rlike(FILE_NAME) | (F.col("n_notice") >= FILE_SHARE * F.greatest(F.col("n_words"), F.lit(1)))
    )
    rows = scanned.withColumn("license_file", is_file).withColumn("directory", _directory(F.col("path")))
    holders = (
        rows.where("license_file AND directory IS NOT NULL")
        .groupBy("directory")
        .agg(F.min(F.struct((-F.col("score")).alias("order"), "path", "license")).alias("first"))
        .select(F.col("directory").alias("ancestor"), F.col("first.license").alias("held"))
    )
    parts = F.split("directory", "/", -1)
    depths = F.sequence(F.lit(0), F.when(F.col("directory") == "", 0).otherwise(F.size(parts)))
    above = rows.where("license IS NULL AND directory IS NOT NULL").select("directory").distinct()
    above = above.select("directory", F.explode(depths).alias("depth")).withColumn(
        "ancestor", F.concat_ws("/", F.slice(parts, 1, F.col("depth")))
    )
    nearest = (
        above.join(holders, "ancestor")
        .groupBy("directory")
        .agg(F.max(F.struct("depth", "held", "ancestor")).alias("near"))
        .select("directory", F.col("near.held").alias("inherited"), F.col("near.ancestor").alias("from_directory"))
    )
    return rows.join(nearest, "directory", "left")


def scan(files: DataFrame) -> DataFrame:
    """files: file_id, path, text. Returns file_id, path, license (its own), score, license_file, inherited,
    from_directory, final (its own license, else the inherited one).

    Null and empty texts have no notice and may inherit. A null path inherits nothing. Repeated rows get equal results.
    Other columns are not read. An empty table gives no rows. Whole texts are scanned.
    """
    files = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    df, n_docs = document_frequencies(files, template_words() | template_words(text_templates()))
    rows = inherit(written(notices(files, Templates(df, n_docs, texts=Texts(df, n_docs))), "notices"))
    own = F.col("license")
    return rows.select(
        "file_id",
        "path",
        "license",
        "score",
        "license_file",
        F.when(own.isNull(), F.col("inherited")).alias("inherited"),
        F.when(own.isNull(), F.col("from_directory")).alias("from_directory"),
        F.coalesce(own, F.col("inherited")).alias("final"),
    )
