"""Tokenizers of the ``tokenizers`` library that encode each distinct stretch of text once.

Both kinds of tokenizer here cut a text by a fixed pattern and never merge over a cut, so its ids are those of the
stretches, one after the other. Stretches recur, so a bounded table of their ids saves most of the work. Texts of ASCII
and Latin-1 letters are cut by the tokenizer's own pattern, spelled out for these signs; in other texts only white space
is a sure border, and the tokenizer cuts the rest.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np

from tocsin.llm.common import WORD_RE

#: Longer stretches are not kept; a table of this number of entries becomes the old one, which goes when the next is full.
LONGEST, MOST = 64, 300_000

_SPACE = r"\t-\r "
_LOWER, _LETTER = "a-zß-öø-ÿ", "A-Za-zÀ-ÖØ-öø-ÿ"

#: The patterns of the tokenizers, for ASCII and the letters above.
_CUT_APART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[0-9]|[^{_SPACE}{_LOWER}0-9]+")
_CUT_WITH_SPACE = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_OTHER_SIGN = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]")

#: White space in front of a word belongs to its first token; what follows the last word stands alone.
_LEADING = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")

#: White space beyond ASCII, for the tokenizer's pattern or for Python: the rule above does not hold beside it.
_OTHER = [
    *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030),
    *range(0x205F, 0x2065), 0x3000, 0xFEFF,
]
_OTHER_SPACE = re.compile(f"[{''.join(map(chr, _OTHER))}]")


def byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte: itself if it shows, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_SIGNS = byte_signs()

#: Whether the stretches are cut by the pattern itself, and the stretches.
Stretches = tuple[bool, list[str]]


def words_apart(text: str) -> Stretches:
    """For the tokenizer of lower-cased words without white space. ``<|`` may begin one of its special tokens."""
    if "<|" in text or _OTHER_SIGN.search(text):
        return False, WORD_RE.findall(text)
    return True, _CUT_APART.findall(text.lower())


def words_with_space(text: str) -> Stretches:
    """For the byte-level tokenizer whose tokens may begin with a space."""
    if not _OTHER_SIGN.search(text):
        return True, _CUT_WITH_SPACE.findall(text)
    return False, [text] if _OTHER_SPACE.search(text) else _LEADING.findall(text)


class ChunkTokenizer:
    """split: the stretches of a text. plain: strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str, split: Callable[[str], Stretches], plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.split, self.model = split, self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, cut: list[str], whole: list[str]) -> list[list[int]]:
        """Ids of new stretches. Those cut by the pattern go to the model at once, written in its signs for bytes."""
        written = [chunk.encode().decode("latin-1").translate(_SIGNS) for chunk in cut]
        found = [[token.id for token in self.model.tokenize(chunk)] for chunk in written]
        return found + [one.ids for one in self.tokenizer.encode_batch(whole, add_special_tokens=False)]

    def _learn(self, cut: set[str], whole: set[str]) -> list[str]:
        """Puts the ids of all stretches into the table; returns those that were in neither table."""
        if len(self.known) > MOST:
            self.known, self.old = {}, self.known
        missing = (cut | whole).difference(self.known)
        again = missing.intersection(self.old)
        self.known.update(zip(again, map(self.old.__getitem__, again)))
        new = missing - again
        first, rest = list(new & cut), list(new - cut)
        found = self._ids(first, rest)
        ends = [4 * end for end in accumulate(map(len, found), initial=0)]
        data = np.fromiter(chain.from_iterable(found), dtype="<u4", count=ends[-1] // 4).tobytes()
        self.known.update(zip(first + rest, [data[low:high] for low, high in pairwise(ends)]))
        return first + rest

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        split = [self.split(text) for text in texts]
        sides = [[own for is_cut, own in split if is_cut == side] for side in (True, False)]
        new = self._learn(set().union(*sides[0]), set().union(*sides[1]))
        known = self.known.__getitem__
        found = [b"".join(map(known, own)) for _, own in split]
        for chunk in new:
            if len(chunk) > LONGEST:
                del self.known[chunk]
        return found


@functools.lru_cache(maxsize=4)
def chunk_tokenizer(path: str, split: Callable[[str], Stretches], plain: bool) -> ChunkTokenizer:
    """One for all tasks of a Python worker."""
    return ChunkTokenizer(path, split, plain)


def text_groups(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts with about ``most`` characters; a longer text is alone."""
    first = size = 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > most:
            yield first, k
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)
