"""Kinds of matter in a book: front and back matter, indexes, bibliographies, and what of them is worth reading.

A passage's lines become a code with one letter for each line, which says what the line
looks like; every rule is a count of letters or a pattern over the code.  The same
patterns make codes in Python and, as columns, on the JVM.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import titles

# Places of front and back matter, and how many lines of a passage must look alike.
BACK_START, FRONT_ZONE, INDEX_LINES, INDEX_SHARE, BIB_LINES, BIB_SHARE = 0.85, 0.1, 8, 0.4, 4, 0.3
PROSE_LONG, PROSE_SHORT, PROSE_LINES, SENTENCES = 60, 20, 2, 2
CONTENTS_ENTRIES, CONTENTS_TITLES = 4, 3
# Signs of matter that isn't a book's text.
PAGE_END = r"(?:[\s,.]\d{1,4}(?:\s*[-–]\s*\d{1,4})?|\.{2,}\s*[ivxlc]{1,7})\s*$"
KEYWORD = r"(?i)^\s*(?:chapter|part|section|appendix|глава|часть|раздел|розділ|частина|додаток)\b"
CITED = r"(?i)\((?:1[5-9]|20)\d{2}[a-z]?\)|\bpp\.|\bdoi:|\barxiv:"
LEGAL = r"(?i)all rights reserved|\bISBN\b|printed in|library of congress|все права защищены"
CONTENTS = ("contents", "table of contents", "brief contents", "оглавление", "содержание", "зміст")
_WORD = r"\p{L}[\p{L}’'-]*"
# Five words and an end sign; what stands before the fifth last word does not matter.
SENTENCE = rf"(?:^|[\s(“\"‘])(?:{_WORD}[,;:]?\s+){{4}}{_WORD}[.!?](?=[\"”’)]?(?:\s|$))"
NOT_TITLE_END, NOT_TITLE_START = ".!?;:,", "\"“«—–-"

# What a line is, one bit each; a line's letter is that of its sum in ALPHABET.
PAGED, NAMED, YEAR, TITLED, MEDIUM, LONG, LISTS, BOOKS = (1 << i for i in range(8))
ALPHABET = "".join(chr(0x100 + i) for i in range(256))


def _letters(*wanted: tuple[int, int]) -> str:
    """A class of the letters with all bits of one of the (bits, no bits of) pairs."""
    return "[" + "".join(ALPHABET[i] for i in range(256) if any(i & has == has and not i & no for has, no in wanted)) + "]"


_PAGED, _CITED = _letters((PAGED, 0)), _letters((YEAR, 0))
_LONG, _PLAIN = _letters((LONG, PAGED)), _letters((MEDIUM, PAGED | NAMED))
_LISTED = rf"{_letters((PAGED, 0), (TITLED | NAMED, 0))}{{{CONTENTS_ENTRIES}}}|{_letters((LISTS, 0))}{_letters((TITLED, 0))}{{{CONTENTS_TITLES}}}"
_BOOKS = _letters((BOOKS, 0))
_compiled: dict[str, regex.Pattern] = {}


def _has(pattern: str, text: str) -> bool:
    found = _compiled.get(pattern)
    if found is None:
        found = _compiled[pattern] = regex.compile(pattern)
    return found.search(text) is not None


def line_bits(line: str) -> int:
    lettered, name = _has(r"\p{L}", line), titles.normal_title(line)
    bits = {
        PAGED: lettered and _has(PAGE_END, line), NAMED: _has(KEYWORD, line), YEAR: _has(CITED, line), MEDIUM: len(line) > PROSE_SHORT, LONG: len(line) > PROSE_LONG,
        TITLED: lettered and len(line) <= PROSE_LONG and line[-1] not in NOT_TITLE_END and line[0] not in NOT_TITLE_START, LISTS: name in CONTENTS, BOOKS: name in titles.BIBLIOGRAPHY_TITLES,
    }
    return sum(bit for bit, holds in bits.items() if holds)


def lines_of(body: str) -> list[str]:
    return [s for x in body.split("\n") if (s := x.strip())]


def code(body: str) -> str:
    return "".join(ALPHABET[line_bits(x)] for x in lines_of(body))


def _count(letters: str, of: str) -> int:
    return len(regex.findall(letters, of))


def has_prose(body: str) -> bool:
    c = code(body)
    return _count(_LONG, c) > PROSE_LINES or _count(_PLAIN, c) > PROSE_LINES


def has_sentences(body: str) -> bool:
    return _count(SENTENCE, " ".join(lines_of(body))) >= SENTENCES


def has_contents(body: str) -> bool:
    return _has(_LISTED, code(body))


def kind(body: str, position: float, in_front: bool, heading: str = "") -> str:
    """front, back_index, back_biblio, back_other or body."""
    c, above = code(body), titles.matter_title(heading)
    behind = position > BACK_START
    tests = {
        "front": in_front,
        "back_index": behind and (above == "index" or len(c) >= INDEX_LINES and _count(_PAGED, c) > INDEX_SHARE * len(c)) and not (has_prose(body) and has_sentences(body)),
        "back_biblio": (behind or above == "bibliography" or _has(_BOOKS, c)) and _count(_CITED, c) >= max(BIB_LINES, BIB_SHARE * len(c)),
        "back_other": (behind or position < FRONT_ZONE) and _has(LEGAL, body),
    }
    return next((k for k, holds in tests.items() if holds), "body")


def is_strong(what: str, body: str) -> bool:
    """Matter that is never worth a rerank: an index, legal pages, front matter without prose or with a table of contents."""
    return what in ("back_index", "back_other") or what == "front" and (has_contents(body) or not has_prose(body))


# The same as columns.  Bodies should be normalised (compatibility forms of letters are told apart here).


def _jvm(pattern: str) -> str:
    return "(?U)" + pattern


def code_of(body: str) -> Column:
    lines = F.filter(F.transform(F.split(F.col(body), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")

    def letter(x: Column) -> Column:
        name = F.btrim(F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")))
        lettered, n = x.rlike(r"\p{L}"), F.length(x)
        titled = lettered & (n <= PROSE_LONG) & ~F.substring(x, -1, 1).isin(*NOT_TITLE_END) & ~F.substring(x, 1, 1).isin(*NOT_TITLE_START)
        tests = ((PAGED, lettered & x.rlike(_jvm(PAGE_END))), (NAMED, x.rlike(_jvm(KEYWORD))), (YEAR, x.rlike(_jvm(CITED))), (TITLED, titled), (MEDIUM, n > PROSE_SHORT), (LONG, n > PROSE_LONG), (LISTS, name.isin(*CONTENTS)), (BOOKS, name.isin(*titles.BIBLIOGRAPHY_TITLES)))
        bits = F.lit(1)
        for bit, holds in tests:
            bits = bits + F.when(holds, bit).otherwise(0)
        return F.substring(F.lit(ALPHABET), bits, F.lit(1))

    return F.array_join(F.transform(lines, letter), "")


# In each line that CITED finds is one of these; letters that other letters fold to (i, k, s) are left out of them.
_CITED_SIGNS = ("(1", "(2", "pp.", "Pp.", "pP.", "PP.", "v:", "V:", "i:", "I:", "\u0131:", "\u0130:")


def may_need_code(body: str, position: float) -> bool:
    """False for bodies, not of front matter, whose kind can be told without a look at each line: not at the end, and without BIB_LINES citations."""
    return position > BACK_START or sum(body.count(s) for s in _CITED_SIGNS) >= BIB_LINES


def with_kind(df, body: str, position: Column, in_front: Column, heading: str | None = None, coded: Column | None = None):
    """Rows with matter_kind and strong; ``heading`` names the column of the nearest heading's matter (see titles.matter_titles).

    Where ``coded`` is false, lines are not looked at (see may_need_code), and strong is not to be used.
    """
    c = F.col("_code")
    n = lambda letters: F.length(c) - F.length(F.regexp_replace(c, letters, ""))
    above = F.coalesce(F.col(heading), F.lit("")) if heading else F.lit("")
    joined = F.regexp_replace(F.col(body), r"(?U)\s*\n\s*", " ")
    sentences = F.regexp_count(joined, F.lit(_jvm(SENTENCE))) >= SENTENCES
    prose, listed = (n(_LONG) > PROSE_LINES) | (n(_PLAIN) > PROSE_LINES), c.rlike(_LISTED)
    behind = position > BACK_START
    indexed = (above == "index") | (F.length(c) >= INDEX_LINES) & (n(_PAGED) > INDEX_SHARE * F.length(c))
    cited = n(_CITED) >= F.greatest(F.lit(float(BIB_LINES)), BIB_SHARE * F.length(c))
    what = (
        F.when(in_front, "front").when(behind & indexed & ~(prose & sentences), "back_index").when((behind | (above == "bibliography") | c.rlike(_BOOKS)) & cited, "back_biblio")
        .when((behind | (position < FRONT_ZONE)) & F.col(body).rlike(_jvm(LEGAL)), "back_other").otherwise("body")
    )
    code = code_of(body) if coded is None else F.when(coded, code_of(body))
    rows = df.withColumn("_code", code).withColumn("matter_kind", what)
    strong = F.col("matter_kind").isin("back_index", "back_other") | (F.col("matter_kind") == "front") & (listed | ~prose)
    return rows.withColumn("strong", F.coalesce(strong, F.lit(False))).drop("_code")
