"""Sections of a book: entries of an outline or a table of contents placed in its text, put in order, nested, and given a kind.

A section ends where the next one of its level or above starts, and its parent is the
nearest one before it of a lower level.  Levels are few (LEVELS), so both are one window
over a book's sections.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import outlines, spans

# Levels kept, characters of a title, entries that an outline or table of contents must place, kinds by precedence at a tie.
LEVELS, TITLE_CHARS, LEAST_ENTRIES = 4, 200, 2
KINDS = ("body", "front", "back_index", "back_biblio", "back_other")
SOURCES = ("pdf-outline", "epub-toc", "chapters")


def title_of(raw: str) -> Column:
    """A heading's text without its number signs, white space as one space, cut to TITLE_CHARS."""
    t = F.btrim(F.regexp_replace(F.regexp_replace(F.col(raw), r"^#+\s*", ""), r"(?U)\s+", " "))
    return F.rtrim(F.substring(t, 1, TITLE_CHARS))


def placed(books: DataFrame, entries: DataFrame, book: str, text: str = "text") -> DataFrame:
    """(book, seq, title, level, char_start) of entries (book, seq, title, level, lo, hi, snaps).

    An entry starts at ``lo``, or at the first line of its title in [lo, hi) where ``snaps`` holds; a line that the
    entry before took is not taken again.  Entries without a range, or deeper than LEVELS, go.
    """
    usable = entries.where(F.col("lo").isNotNull() & (F.col("level") <= LEVELS))
    listed = usable.groupBy(book).agg(F.sort_array(F.collect_list(F.struct("seq", "title", "level", "lo", "hi", "snaps"))).alias("_e"))

    def run(batches):
        for b in batches:
            rows = []
            for k, t, found in zip(b[book], b[text], b["_e"]):
                last = -1
                for e in found:
                    at = e["lo"]
                    if e["snaps"] and t:
                        after = last + 1 if e["lo"] <= last < e["hi"] else e["lo"]
                        line = outlines.title_line(t, after, e["hi"], e["title"]) if after < e["hi"] else None
                        at = e["lo"] if line is None else line
                    last = at
                    rows.append((k, e["seq"], e["title"], e["level"], at))
            yield pd.DataFrame(rows, columns=[book, "seq", "title", "level", "char_start"])

    kind = books.schema[book].dataType.simpleString()
    return books.select(book, text).join(listed, book).mapInPandas(run, f"{book} {kind}, seq int, title string, level int, char_start int")


def ordered(entries: DataFrame, book: str) -> DataFrame:
    """Entries (book, seq, title, level, char_start) with clean titles that go on in the text.

    One that starts before an earlier one goes, and so does one at the same place that is not deeper; so an entry stays
    if place and level are above all before it.  Untitled ones go.
    """
    before = Window.partitionBy(book).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    named = entries.withColumn("title", title_of("title")).where(F.col("title") != "")
    at = F.struct("char_start", "level")
    last = F.max(at).over(before)
    return named.withColumn("_new", last.isNull() | (at > last)).where("_new").drop("_new")


def nested(sections: DataFrame, book: str, total: str) -> DataFrame:
    """Ordered sections with their position (from 0), char_end, and the position of their parent (null at the top); ``total`` is the text's length."""
    order = Window.partitionBy(book).orderBy("char_start", "level")
    later, before = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = sections.withColumn("position", F.row_number().over(order) - 1)
    end, parent = F.lit(None).cast("int"), F.lit(None).cast("int")
    for level in range(1, LEVELS + 1):
        end = F.when(F.col("level") == level, F.min(F.when(F.col("level") <= level, F.col("char_start"))).over(later)).otherwise(end)
        parent = F.when(F.col("level") == level, F.max(F.when(F.col("level") < level, F.col("position"))).over(before)).otherwise(parent)
    return numbered.withColumns({"char_end": F.coalesce(end, F.col(total)).cast("int"), "parent": parent})


def kinds_of(sections: DataFrame, units: DataFrame, book: str, section: str = "position", kind: str = "matter_kind", kinds: Sequence[str] = KINDS) -> DataFrame:
    """Sections with the kind of most of their characters; ties go to the earlier of ``kinds``, and body to one that no unit covers."""
    rank = F.coalesce(*(F.when(F.col(kind) == k, F.lit(-i)) for i, k in enumerate(kinds)), F.lit(-len(kinds)))
    covered = spans.covered_by_kind(sections, units.withColumn(kind, F.coalesce(kind, F.lit(kinds[0]))), book, section, kind)
    best = covered.groupBy(book, section).agg(F.max_by(kind, F.struct("chars", rank)).alias("_kind"))
    return sections.join(best, [book, section], "left").withColumn(kind, F.coalesce("_kind", F.lit(kinds[0]))).drop("_kind")


def picked(sources: dict[str, DataFrame], book: str) -> DataFrame:
    """Entries of each book's first source, of SOURCES in order, that placed enough of them; chapters count from one on."""
    out = None
    for name in SOURCES:
        if name not in sources:
            continue
        rows = sources[name]
        least = 1 if name == "chapters" else LEAST_ENTRIES
        enough = rows.groupBy(book).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(book)
        rows = rows.join(enough, book, "left_semi").withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows.join(out.select(book).distinct(), book, "left_anti"))
    return out


def paths(points: DataFrame, sections: DataFrame, book: str, at: str, keys: list[str], last: int = 3) -> DataFrame:
    """Titles of the sections that hold a point, outermost first, the ``last`` levels of them."""
    return spans.section_paths(points, sections, book, at, keys, last)


def book_sections(books: DataFrame, entries: DataFrame, units: DataFrame, book: str, text: str = "text", source: str = "pdf-outline") -> DataFrame:
    """The section table of books from placed ranges (as ``placed`` takes them): position, level, title, char_start, char_end, parent, matter_kind."""
    found = picked({source: placed(books, entries, book, text)}, book)
    total = books.select(book, F.length(text).alias("_total"))
    tree = nested(ordered(found, book).join(total, book), book, "_total").drop("_total", "seq")
    return kinds_of(tree, units, book)


def outline_ranges(entries: DataFrame, books: DataFrame, book: str, text: str = "text") -> DataFrame:
    """What ``placed`` takes from an outline (book, seq, title, page, level): an entry's page; texts without page breaks have none."""
    parts = books.select(book, F.posexplode(F.split(text, "\f")).alias("_p", "_t"), F.length(text).alias("_n"))
    order = Window.partitionBy(book).orderBy("_p")
    lo = F.coalesce(F.sum(F.length("_t") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    pages = parts.select(book, (F.col("_p") + 1).alias("page"), lo.alias("lo"), F.least(lo + F.length("_t") + 1, "_n").alias("hi"), F.count("*").over(Window.partitionBy(book)).alias("_of")).where("_of > 1").drop("_of")
    return entries.join(pages, [book, "page"], "left").select(book, "seq", "title", "level", "lo", "hi", F.lit(True).alias("snaps"))


def contents_ranges(entries: DataFrame, anchors: DataFrame, books: DataFrame, book: str, text: str = "text") -> DataFrame:
    """What ``placed`` takes from a table of contents (book, seq, title, level, href, fragment) and where its documents start (book, href, start)."""
    ends = F.lead("start").over(Window.partitionBy(book).orderBy("start"))
    ranges = anchors.join(books.select(book, F.length(text).alias("_n")), book).select(book, "href", F.col("start").alias("lo"), F.coalesce(ends, "_n").alias("hi"))
    return entries.join(ranges, [book, "href"], "left").select(book, "seq", "title", "level", "lo", "hi", (F.coalesce("fragment", F.lit("")) != "").alias("snaps"))
