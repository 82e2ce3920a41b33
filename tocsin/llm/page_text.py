"""Main text of web pages: markup, then a suffix array over the pages of a host.

A page is cut into blocks with a small tokenizer of tags. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments of readers are known by element or class. Where a page marks its article, the article's
blocks are its text, whatever other pages hold. Where it does not, markup cannot tell the rest of the frame from the
article; there the host's pages are read together: the words of a page's blocks outside articles are concatenated, across
the borders of blocks, runs of eight words or more that stand on several distinct pages of the host are found, and what
these runs cover is removed from the unmarked pages, so that their unique runs stay. A shorter block that stands as a
whole on as many pages goes too where nothing that stays lies between it and an edge of the page.

A host's pages are dealt at random to groups of bounded size, so a host with a third of all pages is many tasks. A suffix
array counts the pages of each run in a group; the counts of equal runs (by hash) are added up over the groups of the
host, and the runs that stand on enough pages go back to the groups that hold them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import written
from tocsin.llm.url_reputation import host_of

#: Elements and class words outside the article. Fixed values.
OUTSIDE = frozenset("nav aside footer form dialog menu button select fieldset".split())
UNSEEN = frozenset("head script style noscript template iframe object svg math canvas textarea title audio video".split())
OUTSIDE_CLASSES = re.compile(
    r"(?i)(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|promo|sponsor|sponsored|nav|navbar|"
    r"navigation|menu|breadcrumb|breadcrumbs|sidebar|header|masthead|footer|cookie|cookies|consent|notice|popup|modal|"
    r"newsletter|subscribe|share|sharing|social|related|comment|comments|reply|replies|discussion|disqus)(?:$|[\s_-])"
)
#: Inside an article a class alone does not tell furniture from text about it ("social-history", "related-work"). Adverts
#: and reader comments go by their class; the words below need a second sign. Fixed values.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising promo sponsor sponsored".split())
COMMENT_WORDS = frozenset("comment comments reply replies disqus".split())
FURNITURE_WORDS = frozenset(
    "banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent notice popup modal "
    "newsletter subscribe share sharing social related".split()
)
#: Words that make one of those before them a part of the page's frame.
FRAME_WORDS = FURNITURE_WORDS | frozenset(
    "bar buttons button links link list box widget signup form icons toolbar panel posts articles stories".split()
)
#: Elements that are text themselves: only an advert's class takes them out of an article.
PROSE = frozenset(
    "h1 h2 h3 h4 h5 h6 p blockquote pre table tbody thead tr td th figure figcaption dl dt dd header hgroup address".split()
)
CONTROLS = frozenset("form button input select textarea".split())
#: Class words that only say what else is on the page.
_ABOUT = re.compile(r"(?i)(?:^|(?<=\s))(?:has|with|no|is|without)[-_][\w-]+")
COMMENT_CLASSES = re.compile(r"(?i)(?:^|[\s_-])(?:comment|comments|reply|replies|discussion|disqus)(?:$|[\s_-])")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^>]*(?P<open>>|\Z)",
    re.S,
)
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_CLASS = re.compile(r"(?:\s|^)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_CLASS_ONLY = re.compile(r"(?:\s|^)class\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_ID_ONLY = re.compile(r"(?:\s|^)id\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WHITE = re.compile(r"[\x20\x09-\x0D]+")

RUN = 8
PAGES_IN_GROUP = 128
CHARS_IN_GROUP = 4_000_000
#: A run is a host's frame when it stands on so many of the host's pages, however many pages the host has.
LEAST_PAGES = 3
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(RUN + 1)], dtype=np.uint64)


def _tokens(pattern: re.Pattern, rest: str) -> list[list[str]]:
    """Words of each class or id of a tag."""
    marks = _ABOUT.sub("", " ".join(m.strip("\"'") for m in pattern.findall(rest)))
    return [re.split(r"[_-]+", token) for token in marks.lower().split()]


def _inside_article(name: str, rest: str) -> str:
    """Role of an element inside an article by its classes: article, outside, comments, or doubt.

    A class of two frame words ("share-bar", "cookie-notice") is its own second sign; one word alone leaves a doubt that
    the element's content settles. Ids say what a part is called and count only for comments, on plain boxes and lists.
    """
    classes = _tokens(_CLASS_ONLY, rest) if rest else []
    if any(word in ADVERT_WORDS for words in classes for word in words):
        return "outside"
    if name in PROSE:
        return "article"
    ids = _tokens(_ID_ONLY, rest) if name in ("div", "ol", "ul") else []
    if any(word in COMMENT_WORDS for words in classes + ids for word in words):
        return "comments"
    doubt = False
    for words in classes:
        first = next((k for k, word in enumerate(words) if word in FURNITURE_WORDS), None)
        if first is not None:
            if any(word in FRAME_WORDS for k, word in enumerate(words) if k != first):
                return "outside"
            doubt = True
    return "doubt" if doubt else "article"


def blocks_of(page: str) -> tuple[list[str], list[tuple[bool, str]], bool]:
    """(blocks of marked articles, other blocks with whether markup leaves open what they are, has articles)."""
    article: list[str] = []
    other: list[tuple[bool, str]] = []
    stack: list[tuple[str, str]] = []  # element, its role: article, outside, comments, unseen or nothing
    piece: list[str] = []
    role, found, at = "", False, 0
    #: The open element in doubt: its place in the stack, blocks before it, characters, those in links, has controls.
    doubt: list[int] = []

    def settle() -> None:
        """An element in doubt goes when at least half of its text is links, or when it holds controls."""
        _, blocks, chars, linked, controls = doubt
        if controls or 2 * linked >= max(chars, 1):
            del article[blocks:]
        doubt.clear()

    def flush() -> None:
        text = _WHITE.sub(" ", html.unescape("".join(piece))).strip(" ")
        piece.clear()
        if not text or role == "unseen":
            return
        if role in ("article", "doubt"):
            article.append(text)
        else:
            other.append((role == "", text))

    for tag in _TAG.finditer(page):
        if tag.start() < at:
            continue
        piece.append(page[at : tag.start()])
        if doubt and role == "doubt":
            size = len(piece[-1].strip())
            doubt[2] += size
            doubt[3] += size if any(open_ == "a" for open_, _ in stack[doubt[0] :]) else 0
        at = tag.end()
        name = tag["name"]
        if name is None:
            bad = _NAME.match(tag[0]) if tag[0][1] not in "!?" else None
            if bad is None or tag["open"] != ">":
                continue  # a comment, a declaration, or a tag that the page's end cuts off
            name, closes, rest = bad[1], tag[0][1] == "/", tag[0][bad.end() : -1]
        else:
            closes, rest = bool(tag["close"]), tag["rest"]
        name = name.lower()
        if name not in INLINE:
            flush()
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    after = stack[-1][1] if stack else ""
                    if after != role:
                        flush()
                    role = after
                    if doubt and k <= doubt[0]:
                        settle()
                    break
            continue
        marks = _ABOUT.sub("", " ".join(m.strip("\"'") for m in _CLASS.findall(rest))) if rest else ""
        inside = role
        if inside != "unseen":
            if name in UNSEEN:
                inside = "unseen"
            elif role in ("article", "doubt"):
                if name in OUTSIDE:
                    inside = "outside"
                elif name not in ("html", "body", "article", "main"):
                    inside = _inside_article(name, rest)
                    inside = "doubt" if role == "doubt" and inside == "article" else inside
                if doubt and name in CONTROLS:
                    doubt[4] = 1
            elif COMMENT_CLASSES.search(marks):
                inside = "comments"
            elif name in OUTSIDE or name == "header" or OUTSIDE_CLASSES.search(marks):
                if name not in ("html", "body", "article", "main"):
                    inside = "comments" if role == "comments" else "outside"
            elif (name in ("article", "main") or re.search(r"(?:^|\s)main(?:$|\s)", marks)) and role != "comments":
                inside, found = "article", True
        if inside != role:
            flush()
        if name not in VOID and not rest.endswith("/"):
            if inside == "doubt" and not doubt:
                doubt[:] = [len(stack), len(article), 0, 0, 0]
            stack.append((name, inside))
            role = inside
            if name in ("script", "style", "textarea", "title"):
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = end.start() if end else len(page)
    piece.append(page[at:])
    flush()
    if doubt:
        settle()
    return article, other, found


def _ranked(words: list[str], page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of the run of RUN words at each place, and the distinct pages of each rank. page: -1 for a break.

    The suffixes are ordered by their first RUN words by doubling: ranks of 1, 2, 4, 8 words.
    """
    n = len(words)
    names: dict[str, int] = {}
    rank = np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)
    breaks = np.flatnonzero(page < 0)
    rank[breaks] = len(names) + np.arange(len(breaks))  # no run crosses a break
    width = 1
    while width < RUN:
        follow = np.full(n, -1, dtype=np.int64)
        follow[:-width] = rank[width:]
        _, rank = np.unique(rank * np.int64(2 * n + 2) + follow + 1, return_inverse=True)
        width *= 2
    suffixes = np.lexsort((page, rank))
    same_run = rank[suffixes][1:] == rank[suffixes][:-1]
    new_page = np.concatenate([[True], ~same_run | (page[suffixes][1:] != page[suffixes][:-1])])
    return rank, np.bincount(rank[suffixes][new_page], minlength=int(rank.max()) + 1)


def _covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run that starts at one of these places."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + RUN, -1)
    return np.cumsum(change)[:n] > 0


def _repeated(words: list[str], page: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a run of RUN or more that stands on `least` distinct pages. page: -1 for a break."""
    n = len(words)
    if n < RUN:
        return np.zeros(n, dtype=bool)
    rank, pages = _ranked(words, page)
    starts = np.flatnonzero((pages[rank] >= least) & (page >= 0))
    return _covered(n, starts[starts + RUN <= n]) & (page >= 0)


class _Sequence:
    """The words of some pages' blocks in a row, a break after each page, and hashes of runs and of short blocks."""

    def __init__(self, pages: list[list[str]]):
        self.words: list[str] = []
        page: list[int] = []
        self.blocks: list[list[tuple[int, int]]] = []
        for k, blocks in enumerate(pages):
            mine = []
            for text in blocks:
                split = text.split(" ")
                mine.append((len(self.words), len(self.words) + len(split)))
                self.words += split
            self.blocks.append(mine)
            self.words.append("")
            page += [k] * (len(self.words) - 1 - len(page)) + [-1]
        self.page = np.array(page, dtype=np.int64)
        known: dict[str, int] = {}
        for w in self.words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        self.hashes = np.array([known[w] for w in self.words], dtype=np.uint64)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places where a run of RUN words lies in one page, and the runs' hashes."""
        n = len(self.words) - RUN + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        # Pages stand in order, so a page with its break is between different ends of a run.
        places = np.flatnonzero((self.page[:n] >= 0) & (self.page[:n] == self.page[RUN - 1 :]))
        total = np.zeros(len(places), dtype=np.uint64)
        for k in range(RUN):
            total += self.hashes[places + k] * _POWERS[k]
        return places, total.view(np.int64)

    def short(self, start: int, end: int) -> int:
        """Hash of a whole block of fewer words than a run."""
        total = _POWERS[RUN] * np.uint64(end - start)
        for k in range(start, end):
            total += self.hashes[k] * _POWERS[k - start]
        return int(np.array([total], dtype=np.uint64).view(np.int64)[0])


def _counted(group: pa.Table) -> pa.Table:
    """Each run and short block of a group with the group's pages that hold it."""
    sequence = _Sequence(group.column("other").to_pylist())
    found: list[tuple[int, int]] = []
    places, hashes = sequence.runs()
    if len(places):
        rank, pages = _ranked(sequence.words, sequence.page)
        _, first = np.unique(rank[places], return_index=True)
        found += zip(hashes[first].tolist(), pages[rank[places[first]]].tolist())
    blocks: dict[int, set[int]] = {}
    for k, mine in enumerate(sequence.blocks):
        for start, end in mine:
            if end - start < RUN:
                blocks.setdefault(sequence.short(start, end), set()).add(k)
    found += [(h, len(on)) for h, on in blocks.items()]
    host, part, parts = (group.column(name)[0].as_py() for name in ("host", "part", "parts"))
    if parts == 1:  # the host has no other group
        found = [(h, n) for h, n in found if n >= LEAST_PAGES]
    columns = [pa.array([host] * len(found), pa.string()), pa.array([part] * len(found), pa.int32())]
    columns += [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
    return pa.Table.from_arrays(columns, ["host", "part", "run", "pages"])


def _without(blocks: list[list[str]], left: list[list[bool]], frame: np.ndarray) -> list[str]:
    """Texts of unmarked pages without the runs and short blocks whose hashes are in frame."""
    sequence = _Sequence(blocks)
    places, hashes = sequence.runs()
    covered = _covered(len(sequence.words), places[np.isin(hashes, frame)])
    repeated = set(frame.tolist())
    out = []
    for mine, open_ in zip(sequence.blocks, left):
        whole = [end - start < RUN and sequence.short(start, end) in repeated for start, end in mine]
        for order in (range(len(mine)), range(len(mine) - 1, -1, -1)):
            # From an edge of the page, as far as all goes.
            for k in order:
                start, end = mine[k]
                if whole[k]:
                    covered[start:end] = True
                if open_[k] and not covered[start:end].all():
                    break
        kept = (" ".join(w for w, c in zip(sequence.words[a:b], covered[a:b]) if not c) for (a, b), o in zip(mine, open_) if o)
        out.append(" ".join(text for text in kept if text))
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            found = [blocks_of(page.as_py() or "") for page in part.column("html")]
            columns = [
                *(part.column(name) for name in ("page_id", "url", "host", "part", "parts")),
                # None: the host's other pages decide.
                pa.array([" ".join(f[0]) if f[2] or not any(o for o, _ in f[1]) else None for f in found], pa.string()),
                pa.array([[text for _, text in f[1]] for f in found], pa.list_(pa.string())),
                pa.array([[left for left, _ in f[1]] for f in found], pa.list_(pa.bool_())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "part", "parts", "text", "other", "left"])


def _cleaned(pages: pa.Table, frames: pa.Table) -> pa.Table:
    frame = np.asarray(frames.column("run").to_numpy(), dtype=np.int64)
    texts = _without(pages.column("other").to_pylist(), pages.column("left").to_pylist(), frame) if pages.num_rows else []
    return pages.select(["page_id", "url"]).append_column("text", pa.array(texts, pa.string()))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null and empty pages have an empty text. A null url, or one without a host, belongs to the pages without a host.
    A tag that the end of a page cuts off is dropped; what is not closed ends with the page. Equal rows are pages of
    their own. Other columns are not read. An empty table gives no rows. Nothing is cut from long pages; groups are
    bounded by characters too.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("host", host_of(F.col("url")))
    size = rows.groupBy("host").agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))
    parts = F.greatest(F.ceil(F.col("pages") / PAGES_IN_GROUP), F.ceil(F.col("chars") / CHARS_IN_GROUP), F.lit(1))
    size = written(size.select("host", parts.cast("int").alias("parts")), "hosts")
    rows = rows.join(size, "host").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).cast("int"))
    kinds = "page_id bigint, url string, host string, part int, parts int, text string, other array<string>, left array<boolean>"
    parsed = rows.select("page_id", "url", "host", "part", "parts", "html").mapInArrow(_parsed, kinds)
    parsed = written(parsed, "parsed")
    known = parsed.where("text IS NOT NULL").select("page_id", "url", "text")
    unmarked = parsed.where("text IS NULL")
    # By host and part, so that the groups of a large host are not dealt to one task.
    groups = unmarked.select("host", "parts").distinct()
    groups = groups.select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    counts = (
        parsed.where(F.size("other") > 0)
        .select("host", "part", "parts", "other")
        .join(groups, ["host", "part"], "left_semi")
        .groupBy("host", "part")
        .applyInArrow(_counted, "host string, part int, run bigint, pages bigint")
    )
    frames = counts.groupBy("host", "run").agg(F.sum("pages").alias("pages"), F.collect_list("part").alias("in_parts"))
    frames = frames.where(F.col("pages") >= LEAST_PAGES).select("host", F.explode("in_parts").alias("part"), "run")
    cleaned = (
        unmarked.select("page_id", "url", "host", "part", "other", "left")
        .groupBy("host", "part")
        .cogroup(frames.groupBy("host", "part"))
        .applyInArrow(_cleaned, "page_id bigint, url string, text string")
    )
    return known.unionByName(cleaned).withColumn("n_chars", F.length("text").cast("long"))
