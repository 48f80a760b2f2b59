"""Text keys and predicates: native expressions, and Arrow functions where Unicode needs Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse_ws(x: Column | str) -> Column:
    return F.btrim(F.regexp_replace(_c(x), r"\s+", " "))


def light(x: Column | str) -> Column:
    return F.lower(collapse_ws(x))


def identical_key(title: Column | str, authors: Column | str) -> Column:
    """Title and sorted authors, in lower case; equal keys are the same work in the same words."""
    names = F.array_sort(F.transform(F.coalesce(_c(authors), F.array().cast("array<string>")), light))
    return F.concat_ws("\u0001", light(title), F.array_join(names, "\u0002"))


# Name endings that stay behind a comma-less name.
_ENDINGS = ("jr", "sr", "ii", "iii", "iv", "phd", "md")


def author_sort(x: Column | str) -> Column:
    """First Last to Last, First; a name with a comma, or of one word, stays."""
    s = collapse_ws(x)
    parts = F.split(s, " ")
    tail = F.when(F.regexp_replace(F.lower(F.element_at(parts, -1)), r"\.", "").isin(*_ENDINGS) & (F.size(parts) > 2), 1).otherwise(0)
    last = F.element_at(parts, -1 - tail)
    first = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1 - tail, F.lit(0))), " ")
    ending = F.when(tail == 1, F.concat(F.lit(" "), F.element_at(parts, -1))).otherwise("")
    return F.when(s.contains(",") | (F.size(parts) < 2), s).otherwise(F.concat(last, F.lit(", "), first, ending))


def pub_year(x: Column | str) -> Column:
    """Year of an ISO date; the 0101 placeholder and years up to 1000 are none."""
    year = F.regexp_extract(_c(x), r"^(\d{4})-", 1).try_cast("int")
    return F.when(year > 1000, year)


def is_empty_date(x: Column | str) -> Column:
    """Nothing, or the placeholder of no date."""
    return F.coalesce(_c(x) == "", F.lit(True)) | _c(x).startswith("0101-01-01")


def same_day(a: Column | str, b: Column | str) -> Column:
    """Dates at most a day apart; equal text when one is no date."""
    x, y = (F.substring(_c(v), 1, 10).try_cast("date") for v in (a, b))
    return F.coalesce(F.abs(F.datediff(x, y)) <= 1, _c(a).eqNullSafe(_c(b)))


def same_number(a: Column | str, b: Column | str) -> Column:
    x, y = (_c(v).try_cast("double") for v in (a, b))
    return F.coalesce(x == y, _c(a).eqNullSafe(_c(b)))


def slice_sentence(text: str, start: int, size: int, floor: float = 0.5) -> tuple[int, int]:
    """Bounds of a reading window: at most ``size`` characters, trimmed to a sentence or paragraph end past ``floor``."""
    end = min(start + size, len(text))
    if end < len(text):
        part = text[start:end]
        ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", part)]
        if ends and ends[-1] >= floor * size:
            end = start + ends[-1]
        else:
            cut = part.rfind("\n\n")
            if cut >= floor * size:
                end = start + cut
    return start, end


_FOLD_BASE = re.compile(r"[A-ɏͰ-ϿḀ-῿]")


def fold_text(s: str) -> str:
    """Accents dropped after Latin and Greek letters only; ё becomes е."""
    if s.isascii():
        return s
    out: list[str] = []
    for ch in unicodedata.normalize("NFKD", s):
        if unicodedata.combining(ch) and out and _FOLD_BASE.match(next((c for c in reversed(out) if not unicodedata.combining(c)), "")):
            continue
        out.append(ch)
    return unicodedata.normalize("NFC", "".join(out)).replace("ё", "е").replace("Ё", "Е")


@F.pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fold_text(x))


def html_text(x: Column | str) -> Column:
    """Text of an HTML fragment: scripts, styles and comments go, tags become breaks, entities are decoded."""
    t = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<(br|/p|/h[1-6]|/li|/div)\b[^>]*>", "\n"), r"<[^>]*>", " ")
    # The entities of plain markup; the ampersand last.
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"[ \t\x0B\f\r]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def cut_at_word(x: Column | str, most: int = 1800) -> Column:
    """At most so many characters, cut at white space."""
    s = _c(x)
    cut = F.regexp_replace(F.substring(s, 1, most + 1), r"\s+\S*$", "")
    return F.when(F.length(s) <= most, s).otherwise(cut)
