"""Lookups between offsets, spans, sections and pages. Offsets count code points; spans are half open."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def holding(points: DataFrame, spans: DataFrame, book: str, at: str, start: str = "char_start", end: str = "char_end", how: str = "left") -> DataFrame:
    """Points with the spans that hold them.

    A span lies in one or two cells of the width that is the power of two above its length, so a point is looked up in
    one cell for each such width that occurs (64 at most): an equi join of about as many candidates as there are hits.
    """
    width = F.greatest(F.ceil(F.log2((F.col(end) - F.col(start)).cast("double"))), F.lit(0)).cast("int")
    at_width = lambda place: F.expr(f"shiftright(cast({place} as long), _w)")
    s = spans.where(F.col(start) < F.col(end)).withColumnRenamed(book, "_book").withColumn("_w", width)
    s = s.withColumn("_cell", F.explode(F.sequence(at_width(f"`{start}`"), at_width(f"(`{end}` - 1)"))))
    widths = [r[0] for r in s.select("_w").distinct().collect()]
    wanted = points.select(F.col(book).alias("_b"), F.col(at).alias("_at")).where(F.col(at).isNotNull()).distinct()
    looked = wanted.withColumn("_pw", F.explode(F.array(*(F.lit(w) for w in widths)).cast("array<int>"))).withColumn("_pc", F.expr("shiftright(cast(_at as long), _pw)"))
    on = (F.col("_b") == F.col("_book")) & (F.col("_pw") == F.col("_w")) & (F.col("_pc") == F.col("_cell"))
    held = looked.join(s, on).where((F.col("_at") >= F.col(start)) & (F.col("_at") < F.col(end))).drop("_book", "_w", "_cell", "_pw", "_pc")
    return points.join(held, (F.col(book) == F.col("_b")) & (F.col(at) == F.col("_at")), how).drop("_b", "_at")


def section_paths(points: DataFrame, sections: DataFrame, book: str, at: str, keys: list[str], last: int = 3) -> DataFrame:
    """Titles of the sections that hold a point, outermost first, the last few levels."""
    held = holding(points, sections.select(book, "level", "title", "char_start", "char_end"), book, at)
    path = F.transform(F.sort_array(F.collect_list(F.when(F.col("title").isNotNull(), F.struct("level", "char_start", "title")))), lambda s: s["title"])
    return held.groupBy(*keys).agg(path.alias("path")).withColumn("path", F.expr(f"slice(path, greatest(size(path) - {last - 1}, 1), {last})"))


def pages(units: DataFrame, book: str, start: str, text: str) -> DataFrame:
    """Page at each unit's start: form feeds in the book's units before it, plus one; null in a book without any.

    Where the units before do not join up to the start (a gap, or an overlap), how many lie before it isn't known: null.
    """
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\f"), F.lit("")))
    w = Window.partitionBy(book).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    covered, reached = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0)), F.coalesce(F.max(F.col(start) + F.length(text)).over(w), F.lit(0))
    known = (covered == F.col(start)) & (reached == F.col(start)) & (F.sum(breaks).over(Window.partitionBy(book)) > 0)
    return units.withColumn("page", F.when(known, F.coalesce(F.sum(breaks).over(w), F.lit(0)) + 1))


def page_starts(bookmarks: DataFrame, texts: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """Bookmarks with the offset at which their page begins; null for a page the text doesn't have."""
    parts = texts.select(book, F.posexplode(F.split(text, "\f")).alias("_p", "_t"))
    before = F.coalesce(F.sum(F.length("_t") + 1).over(Window.partitionBy(book).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(book, (F.col("_p") + 1).alias(page), before.alias("char_start"))
    return bookmarks.join(starts, [book, page], "left")


def covered_by_kind(sections: DataFrame, units: DataFrame, book: str, section: str, kind: str) -> DataFrame:
    """(book, section, kind, chars, first): characters of units of each kind within each section, and the first start of one that overlaps.

    How much of a kind lies before a place is a running sum over starts and ends; a section's share is the
    difference between its two ends.  So nothing is joined by range: one pass in order over a book's places.
    """
    kinds = units.select(book, kind).distinct()
    blank = {section: F.lit(None).cast(sections.schema[section].dataType), "_sign": F.lit(0), "_s": F.lit(None).cast("long"), "_z": F.lit(None).cast("long")}

    def edge(at: str, sign: int) -> DataFrame:
        rows = units.where(F.col("char_start") < F.col("char_end")).select(book, kind, F.col(at).cast("long").alias("_at"), F.lit(sign).cast("long").alias("_n"), (F.col(at).cast("long") * sign).alias("_w"))
        return rows.select("*", F.lit(0).alias("_side"), *(v.alias(k) for k, v in blank.items()))

    def point(at: str, sign: int) -> DataFrame:
        rows = sections.join(kinds.select(F.col(book).alias("_kb"), F.col(kind).alias("_k")), F.col(book) == F.col("_kb"))
        return rows.select(book, F.col("_k").alias(kind), F.col(at).cast("long").alias("_at"), F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_w"), F.lit(1).alias("_side"), section, F.lit(sign).alias("_sign"), F.col("char_start").cast("long").alias("_s"), F.col("char_end").cast("long").alias("_z"))

    events = edge("char_start", 1).unionByName(edge("char_end", -1)).unionByName(point("char_end", 1)).unionByName(point("char_start", -1))
    so_far = Window.partitionBy(book, kind).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("_at") * F.sum("_n").over(so_far) - F.sum("_w").over(so_far)
    summed = events.withColumn("_before", before).where("_side = 1").groupBy(book, section, kind).agg(F.sum(F.col("_before") * F.col("_sign")).alias("chars"))
    return summed.where("chars > 0")


def majority_kind(sections: DataFrame, units: DataFrame, book: str, section: str) -> DataFrame:
    """For each section the kind that covers most of its characters; ties go to the kind of which a unit in it starts first."""
    summed = covered_by_kind(sections, units, book, section, "kind")
    most = summed.join(summed.groupBy(book, section).agg(F.max("chars").alias("_most")), [book, section]).where(F.col("chars") == F.col("_most"))
    # Only kinds that tie need their first unit looked up.
    tied = most.withColumn("_ties", F.count("*").over(Window.partitionBy(book, section)))
    some = tied.where("_ties > 1").join(sections.select(book, section, F.col("char_start").alias("_s"), F.col("char_end").alias("_z")), [book, section])
    u = units.select(F.col(book).alias("_b"), F.col("kind").alias("_k"), F.col("char_start").alias("_us"), F.col("char_end").alias("_ue"))
    firsts = some.join(u, (F.col(book) == F.col("_b")) & F.col("kind").eqNullSafe(F.col("_k")) & (F.col("_us") < F.col("_z")) & (F.col("_ue") > F.col("_s"))).groupBy(section).agg(F.min_by("kind", "_us").alias("kind"))
    best = tied.where("_ties = 1").select(section, "kind").unionByName(firsts.select(section, "kind"))
    return sections.select(section).join(best, section, "left").withColumn("kind", F.coalesce("kind", F.lit("body")))


def section_ends(headings: DataFrame, book: str, total: str, levels: int = 6) -> DataFrame:
    """End of each heading's section: the next start of the same level or above, else the text's end.

    One window over a book's headings in order: for each level the next start at it or above.  Levels are 1 to ``levels``.
    """
    later = Window.partitionBy(book).orderBy("char_start").rangeBetween(1, Window.unboundedFollowing)
    nexts = [F.min(F.when(F.col("level") <= i, F.col("char_start"))).over(later) for i in range(1, levels + 1)]
    own = F.get(F.array(*nexts), F.least(F.col("level"), F.lit(levels)).cast("int") - 1)
    return headings.withColumn("char_end", F.coalesce(own, total))


def chapter_ends(chapters: DataFrame, book: str, total: str) -> DataFrame:
    return chapters.withColumn("char_end", F.coalesce(F.lead("char_start").over(Window.partitionBy(book).orderBy("char_start")), F.col(total)))


def paired_by_position(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """The i-th of one side with the i-th of the other in each group; leftovers of both sides stay."""
    n = lambda d, o: d.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(o)))
    return n(left, left_order).join(n(right, right_order), [*keys, "position"], "full_outer")


def last_before(points: DataFrame, starts: DataFrame, key: str, at: str, start: str, slack: int = 4000) -> DataFrame:
    """The last start at or before each point, at most ``slack`` back: points and starts in one order, and the last start so far."""
    s = starts.select(key, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.col(start).alias("_start"), F.lit(None).cast(points.schema).alias("_point"))
    p = points.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(starts.schema[start].dataType).alias("_start"), F.struct(*points.columns).alias("_point"))
    so_far = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = s.unionByName(p).withColumn("_last", F.last("_start", ignorenulls=True).over(so_far)).where("_side = 1")
    return out.select("_point.*", F.when(F.col("_at") - F.col("_last") <= slack, F.col("_last")).alias("opened"))


def encode_offset_map(edits: str = "edits"):
    """m1: gap,raw length,clean length for each edit of an array of (in_start, in_end, out_start, out_end)."""
    e = F.col(edits)
    gap = lambda x, i: x["in_start"] - F.coalesce(F.when(i > 0, F.get(e, i - 1)["in_end"]), F.lit(0))
    one = F.transform(e, lambda x, i: F.concat_ws(",", gap(x, i).cast("string"), (x["in_end"] - x["in_start"]).cast("string"), (x["out_end"] - x["out_start"]).cast("string")))
    return F.concat(F.lit("m1:"), F.array_join(one, ","))


# Maps that are Python objects at a time.
ROWS = 64
_EDITS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("in_start", "in_end", "out_start", "out_end")]))


def _decoded(encoded: pa.Array) -> pa.Array:
    """Running sums over all triples, and from each the sum before its map began; flat arrays of integers only."""
    names = [f.name for f in _EDITS.elementType.fields]
    bodies = [None if x is None else x.removeprefix("m1:") for x in encoded.to_pylist()]
    flat = np.array(",".join(b for b in bodies if b).split(",") if any(bodies) else [], np.int64).reshape(-1, 3)
    counts = np.array([0 if not b else (b.count(",") + 1) // 3 for b in bodies], np.int64)
    ends = np.concatenate(([0], np.cumsum(counts)))
    gap, raw, clean = flat.T
    columns = []
    for n in (raw, clean):
        so_far = np.cumsum(gap + n)
        base = np.repeat(np.concatenate(([0], so_far))[ends[:-1]], counts)
        end = so_far - base
        columns += [end - n, end]
    structs = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], names)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), structs, mask=pa.array([b is None for b in bodies]))


@F.arrow_udf(_EDITS)
def _decode(s: pa.Array) -> pa.Array:
    parts = [_decoded(s.slice(at, ROWS)) for at in range(0, len(s), ROWS)]
    return pa.concat_arrays(parts) if parts else _decoded(s)


def decode_offset_map(encoded: str = "map"):
    """The edits of an encoded map, by running sums over its triples; linear in them, which an array fold isn't."""
    return _decode(F.col(encoded))
