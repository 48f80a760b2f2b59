"""Chapters from what a book's file lists: a PDF's outline, or the table of contents of an EPUB package."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from lectern.functions import titles
from lectern.sources import books

from .structure import chapter_number

# Limits of a plausible list of chapters, and of the probes that find a document's text.
MOST, PER_PAGE, FEW, DEEPEST, NUMBERED = 150, 0.5, 4, 3, 2
PROBE, PROBE_LEAST, PROBE_AT = 48, 16, (0, 48, 160)
_PART = re.compile(r"(?i)\s*(?:part|часть|частина)\s+(?:[IVXLC]+|\d+)\b")
_NUMBER = re.compile(r"(?i)\s*(?:\d+(?:[.:)]|\s|$)|[ivxlc]+[.:)](?:\s|$))")
_LABEL = re.compile(r"(?i)\s*(?:chapter|глава|розділ|раздел)\s*(?:\d+|[ivxlc]+)(?:[^\w]|\d|_|$)")
_NAMES = ("introduction", "intro", "prologue", "overview", "getting started", "вступ", "введение", "пролог")

Start = tuple[str, int]


@dataclass
class _Node:
    title: str
    level: int
    entry: tuple
    children: list[_Node] = field(default_factory=list)


def _tree(entries: list[tuple[str, int, tuple]]) -> list[_Node]:
    """Entries in order as a tree; a jump of levels is no fault."""
    top, above = [], []
    for title, level, entry in entries:
        node = _Node(title, level, entry)
        while above and above[-1].level >= level:
            above.pop()
        (above[-1].children if above else top).append(node)
        above.append(node)
    return top


def _front(title: str) -> bool:
    return titles.matter_title(title) == "front"


def _body_like(title: str) -> bool:
    normal = titles.normal_title(title)
    return bool(_NUMBER.match(title) or _LABEL.match(title)) or any(normal == n or normal.startswith(n + " ") for n in _NAMES)


def _without_front(nodes: list[_Node]) -> list[_Node]:
    """Leading front matter goes, and with it one book title right before it."""
    at = 0
    if len(nodes) > 1:
        first = nodes[0].title
        at = int(not (_front(first) or _PART.match(first) or _body_like(first)) and _front(nodes[1].title))
    while at < len(nodes) and _front(nodes[at].title):
        at += 1
    return nodes[at:]


def _opened(nodes: list[_Node], when: Callable[[_Node], bool]) -> list[_Node]:
    return [x for n in nodes for x in (n.children if n.children and when(n) else [n])]


def chapter_level(entries: list[tuple[str, int, tuple]], is_part: Callable[[_Node], bool] = lambda n: bool(_PART.match(n.title))) -> list[tuple]:
    """The entries of the level that holds the chapters: parts are opened, and levels of under four entries, down to the third."""
    nodes = _without_front(_opened(_without_front(_tree(entries)), is_part))
    while len(nodes) < FEW:
        deeper = _opened(nodes, lambda n: n.level < DEEPEST)
        if len(deeper) == len(nodes):
            break
        nodes = _without_front(deeper)
    return [n.entry for n in nodes]


def title_line(text: str, start: int, end: int, title: str) -> int | None:
    """Where the first line of a range begins that is the title, its beginning, or begins with it."""
    want, at = titles.normal_title(title), start
    while want and at < end:
        stop = text.find("\n", at, end)
        stop = end if stop < 0 else stop
        line = titles.normal_title(text[at:stop])
        if line and (line.startswith(want) or len(line) >= min(6, len(want)) and want.startswith(line)):
            return at
        at = stop + 1
    return None


def _rising(found: Iterator[Start]) -> list[Start]:
    """Starts that lie behind the ones before them."""
    out: list[Start] = []
    for title, at in found:
        if not out or at > out[-1][1]:
            out.append((title, at))
    return out


def outline_chapters(text: str, entries: list[tuple[str, int | None, int]]) -> list[Start] | None:
    """(title, start) by an outline (title, page, level) of a text with page breaks; None if it makes no plausible list."""
    pages = [0, *(m.end() for m in re.finditer("\f", text))]
    if len(pages) < 2:
        return None
    picked = [e for e in chapter_level([(t, level, (t, page)) for t, page, level in entries]) if e[1] is not None]
    if not 2 <= len(picked) <= min(MOST, max(2, len(pages) * PER_PAGE)):
        return None

    def places() -> Iterator[Start]:
        for title, page in picked:
            if page <= len(pages):
                start, end = pages[page - 1], pages[page] if page < len(pages) else len(text)
                found = title_line(text, start, end, title)
                yield title, start if found is None else found

    out = _rising(places())
    return out if len(out) >= 2 else None


def _folded(text: str) -> tuple[str, list[int]]:
    """Letters and digits in lower case and compatibility form, and where each came from."""
    out, at = [], []
    for i, ch in enumerate(text):
        for c in ch.lower() if ch.isascii() else unicodedata.normalize("NFKC", ch).lower():
            if c.isalnum():
                out.append(c)
                at.append(i)
    return "".join(out), at


def anchors(text: str, documents: list[tuple[str, str]]) -> list[Start]:
    """(path, start) of the documents (path, markup) found in a converted text, by their first words, each behind the one before."""
    folded, at = _folded(text)
    out: list[Start] = []
    behind = 0
    for path, markup in documents:
        words, _ = _folded(books.visible_text(markup))
        probes = (words[k : k + PROBE] for k in PROBE_AT if k + PROBE_LEAST <= len(words))
        hit = next(((i, len(p)) for p in probes if (i := folded.find(p, behind)) >= 0), None)
        if hit:
            start = text.rfind("\n", 0, at[hit[0]]) + 1
            if not out or start > out[-1][1]:
                out.append((path, start))
            behind = hit[0] + hit[1]
    return out


def contents_chapters(text: str, entries: list[books.Entry], found: list[Start]) -> list[Start] | None:
    """(title, start) by a table of contents and the anchors of its documents; None if it makes no plausible list.

    An entry with two numbered chapters below it is a part.  One that points into a document goes to its title's line there.
    """
    if len(found) < 2:
        return None
    numbered = lambda n: sum(chapter_number(c.title) is not None for c in n.children) >= NUMBERED
    picked = chapter_level([(e[0], e[1], e) for e in entries], lambda n: bool(_PART.match(n.title)) or numbered(n))
    order = {path: i for i, (path, _) in enumerate(found)}

    def places() -> Iterator[Start]:
        last = -1
        for title, _, path, fragment in picked:
            if path not in order:
                continue
            i = order[path]
            start, end = found[i][1], found[i + 1][1] if i + 1 < len(found) else len(text)
            place = start
            if fragment:
                line = title_line(text, max(start, last + 1), end, title)
                place = start if line is None else line
            if place > last:
                last = place
            yield title, place

    out = _rising(places())
    return out if 2 <= len(out) <= MOST else None


def outline_table(df: DataFrame, key: str, text: str, xml: str) -> DataFrame:
    """(key, number, title, char_start, char_end) of texts whose outline gives a plausible list of chapters."""

    def run(batches):
        for b in batches:
            rows = []
            for k, t, x in zip(b[key], b[text], b[xml]):
                found = outline_chapters(t or "", books.outline(x or "")) or []
                ends = [*(at for _, at in found[1:]), len(t or "")]
                rows += [(k, i + 1, title, at, end) for i, ((title, at), end) in enumerate(zip(found, ends))]
            yield pd.DataFrame(rows, columns=[key, "number", "title", "char_start", "char_end"])

    return df.select(key, text, xml).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, number int, title string, char_start int, char_end int")
