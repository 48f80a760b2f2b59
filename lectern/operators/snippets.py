"""What of a passage is shown: the window that a query's rarest words fill, and highlights that belong to the query."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import fold_text as fold

from . import languages, stemming

# Widths, shortest stem, how far before a word its sentence may begin, share of the width that a late window keeps, weight of an anchor against the rarest.
WIDTH, LIBRARY_WIDTH, STEM_CHARS, LEAD, TAIL_SHARE, ANCHOR_SHARE = 320, 800, 3, 160, 2 / 3, 0.5


def topic_stems(query: str, packs: Sequence[stemming.Pack] = stemming.PACKS) -> frozenset[str]:
    """Stems of a query's words that are no function words and not too short."""
    words = ((stemming.stem(m.group(), packs=packs), m.group().lower().replace("ё", "е")) for m in stemming._WORD.finditer(query))
    return frozenset(s for s, raw in words if raw not in languages.STOP and len(s) >= STEM_CHARS)


class _Sentences:
    """Where sentences begin: behind the blanks that follow an end sign, and behind each line break.

    A start counts for a look back from a place only if its sign lies within it; a line break among an end sign's
    blanks counts by itself only if that sign does not.
    """

    def __init__(self, text: str):
        self.at, self.sign, self.before = [], [], []
        for m in re.finditer(r"([.!?…]?)(\s+)", text):
            if m.group(1):
                found = [(m.end(), m.start(), -1)]
            else:
                found = []
            found += [(m.start(2) + i + 1, m.start(2) + i, m.start() if m.group(1) else -1) for i, c in enumerate(m.group(2)) if c == "\n"]
            for start, sign, before in sorted(found):
                self.at.append(start)
                self.sign.append(sign)
                self.before.append(before)

    def _counts(self, i: int, low: int) -> bool:
        return self.sign[i] >= low and not self.before[i] >= low

    def last(self, low: int, high: int) -> int | None:
        """The last start at or before ``high`` whose sign is at or behind ``low``."""
        i = bisect_right(self.at, high) - 1
        while i >= 0 and self.at[i] > low:
            if self._counts(i, low):
                return self.at[i]
            i -= 1
        return None

    def first(self, low: int, high: int) -> int | None:
        for i in range(bisect_left(self.at, low + 1), bisect_right(self.at, high)):
            if self._counts(i, low):
                return self.at[i]
        return None


def _placed(body: str, sentences: _Sentences, at: int, width: int) -> int:
    """Where a window for a word begins: at its sentence, or near the end of the body early enough to keep its width."""
    low = max(0, at - LEAD)
    found = sentences.last(low, at)
    start = found if found is not None else 0 if low == 0 else at
    late = len(body) - width
    if start <= late:
        return start
    if late == 0 or body[late - 1] == "\n" or body[late - 1].isspace() and body[late - 2 : late - 1] in tuple(".!?…"):
        early = late
    else:
        early = sentences.first(late, start)
    if early is not None and len(body) - early >= width * TAIL_SHARE:
        return early
    if late == 0 or body[late - 1].isspace():
        return late
    blank = re.compile(r"\s").search(body, late, start)
    return blank.end() if blank else late


def _head(body: str, width: int) -> int:
    """Where a passage without a hit is shown from: its start, or its first sentence if it opens inside one."""
    m = re.search(r"\S", body)
    if m is None or not regex.match(r"\p{Ll}", m.group()):
        return 0
    start = _Sentences(body).first(m.start(), len(body))
    return start if start is not None and start <= LEAD and len(body) - start >= width * TAIL_SHARE else 0


def window(body: str, terms: frozenset[str], width: int = WIDTH, packs: Sequence[stemming.Pack] = stemming.PACKS) -> tuple[int, str]:
    """(start, text) of the window whose distinct terms weigh most, each one over its occurrences in the body.

    Windows open at words that weigh half as much as the rarest or more, the first of the best.  Such windows begin
    further on from word to word, so two ends that only move forward count what is inside: time is linear in the body.
    """
    if len(body) <= width:
        return 0, body
    known = stemming.sought(set(stemming._WORD.findall(body)), terms, packs) if terms else {}
    hits = [(m.start(), m.end(), known[m.group()]) for m in stemming._WORD.finditer(body) if m.group() in known] if known else []
    if not hits:
        start = _head(body, width)
    else:
        sentences = _Sentences(body)
        counts = Counter(s for *_, s in hits)
        least = min(counts.values())
        inside: Counter = Counter()
        first = last = 0
        start, most = 0, -1.0
        for at, _, s in hits:
            if 1 / counts[s] < ANCHOR_SHARE / least:
                continue
            here = _placed(body, sentences, at, width)
            while last < len(hits) and hits[last][1] <= here + width:
                inside[hits[last][2]] += 1
                last += 1
            while first < last and hits[first][0] < here:
                inside[hits[first][2]] -= 1
                first += 1
            weight = sum(1 / counts[t] for t, n in inside.items() if n > 0)
            if weight > most + 1e-12:
                start, most = here, weight
    text = body[start : start + width]
    return start, ("…" if start else "") + text


_WINDOW = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())])


def snippet(body: str, query: str, width: int = WIDTH) -> Column:
    """(start, text) of each body's window for one query; a null body has none."""
    terms = topic_stems(query)

    @F.pandas_udf(_WINDOW)
    def cut(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if t is None else window(t, terms, width) for t in s], columns=["start", "text"])

    return cut(F.col(body))


# Highlights.

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_TOKENS = regex.compile(r'"[^"]*"|[()]|[^\s()"]+')
_OPERATORS = frozenset(("AND", "OR", "NOT", "NEAR"))
# Shortest word that may match by its stem, longest that only a short ending may part, letters that longer ones share and may differ in.
SHORT, INFLECTED, SHARED, ENDING = 3, 4, 4, 3


@dataclass(frozen=True)
class Unit:
    """Words that stand in a row in a match; with ``prefix`` a word may go on."""

    words: tuple[str, ...]
    prefix: bool = False


def query_units(query: str) -> tuple[Unit, ...]:
    """What a match of a query may show: its phrases and words, without those that it excludes."""
    tokens = _TOKENS.findall(regex.sub(r",\s*\d+\s*\)", ")", query))
    out: list[Unit] = []
    depth, skip_to, skip_next = 0, None, False
    for i, t in enumerate(tokens):
        if t == "(":
            depth += 1
            if skip_next:
                skip_to, skip_next = depth, False
            continue
        if t == ")":
            if skip_to == depth:
                skip_to = None
            depth -= 1
            continue
        if skip_to is not None:
            continue
        if skip_next:
            # NEAR excludes the group that follows it.
            skip_next = t == "NEAR" and tokens[i + 1 : i + 2] == ["("]
            continue
        if t in _OPERATORS:
            skip_next = t == "NOT"
        elif t.startswith('"'):
            if words := tuple(_WORD.findall(t)):
                out.append(Unit(words))
        else:
            out += [Unit((w,), t.endswith("*")) for w in _WORD.findall(t)]
    return tuple(out)


def word_matches(word: str, term: str, prefix: bool = False) -> bool:
    """Whether a word is a term, by letters without accents, by stem, or up to an ending."""
    w, t = fold(word.lower()), fold(term.lower())
    if w == t:
        return True
    if prefix:
        return w.startswith(t)
    if len(w) < SHORT:
        return False
    if stemming.stem(w) == stemming.stem(t):
        return True
    same = next((i for i, (a, b) in enumerate(zip(w, t)) if a != b), min(len(w), len(t)))
    short = min(len(w), len(t))
    return same == short and abs(len(w) - len(t)) <= 2 if short < INFLECTED else same >= max(SHARED, short - ENDING)


def repaired(snippet: str, units: Sequence[Unit], start: str = ">>", end: str = "<<") -> str:
    """A snippet whose highlights all belong to the query, as it is; else with the query's own highlights in place of the wrong ones.

    A highlight is a stretch of one line between tight markers; a snippet without one gets none.
    """
    signs = re.escape(start + end)
    pattern = regex.compile(rf"{re.escape(start)}(?![{signs}\s])([^{signs}\n]+?)(?<![{signs}\s]){re.escape(end)}")
    marked = list(pattern.finditer(snippet))
    belongs = lambda text: all(any(word_matches(w, t, u.prefix) for u in units for t in u.words) for w in _WORD.findall(text))
    right = [belongs(m.group(1)) for m in marked]
    if not units or all(right):
        return snippet
    # The text between right highlights, and the places where wrong ones began and ended, which part words.
    out, plain, edges, at = [], "", [], 0
    for m, good in zip(marked, right):
        plain += snippet[at : m.start()]
        if good:
            out += [_highlighted(plain, units, edges, start, end), m.group()]
            plain, edges = "", []
        else:
            edges += [len(plain), len(plain) + len(m.group(1))]
            plain += m.group(1)
        at = m.end()
    return "".join([*out, _highlighted(plain + snippet[at:], units, edges, start, end)])


def _highlighted(text: str, units: Sequence[Unit], edges: Sequence[int], start: str, end: str) -> str:
    """All occurrences of units marked, longer ones first."""
    words = []
    for m in _WORD.finditer(text):
        cuts = [m.start(), *(e for e in edges if m.start() < e < m.end()), m.end()]
        words += list(zip(cuts[:-1], cuts[1:]))
    ordered = sorted(units, key=lambda u: -len(u.words))
    out, at, i = [], 0, 0
    while i < len(words):
        fits = lambda u: i + len(u.words) <= len(words) and all(word_matches(text[slice(*words[i + k])], t, u.prefix) for k, t in enumerate(u.words))  # noqa: B023, E731
        unit = next((u for u in ordered if fits(u)), None)
        if unit is None:
            i += 1
            continue
        a, b = words[i][0], words[i + len(unit.words) - 1][1]
        out += [text[at:a], start, text[a:b], end]
        at, i = b, i + len(unit.words)
    return "".join([*out, text[at:]])


def repaired_snippets(column: str, query: str, start: str = ">>", end: str = "<<") -> Column:
    """Snippets of one query with their highlights repaired; null stays null."""
    units = query_units(query)

    @F.pandas_udf(T.StringType())
    def mend(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else repaired(t, units, start, end))

    return mend(F.col(column))
