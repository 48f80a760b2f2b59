"""Figures: caption lines of a text, their match to an inventory, captions read off a page's layout, and pictures of markup documents.

Equal labels are joined first; what order demands is then one pass over each book's few
candidate pairs.  Layout and document order are windows over lines and events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources import books as files

from . import etl, structure

# Characters of a caption's head, of the shortest prefix, of a caption in a marker, and how far a caption may lie behind its picture.
HEAD_CHARS, PREFIX_CHARS, MARKER_CHARS, CAPTION_REACH = 30, 12, 120, 2000
_RULES = tuple(r for r in etl.RULES if r[0] != "hyphens")


@F.pandas_udf(T.StringType())
def _cleaned(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else etl.normalise(t, _RULES)[0])


def cleaned(text: Column) -> Column:
    """A text after the character rules; printable ASCII has nothing to clean and stays on the JVM."""
    return F.when(text.rlike(r"[^\x20-\x7E]"), _cleaned(text)).otherwise(text)


def comparable(text: Column) -> Column:
    """A text without white space, backslashes and hyphens, in lower case."""
    return F.lower(F.regexp_replace(cleaned(F.coalesce(text, F.lit(""))), r"(?U)[\s\\\-\x{2010}\x{2011}]+", ""))


def plain_label(label: Column) -> Column:
    return F.regexp_replace(F.coalesce(label, F.lit("")), r"[-\x{2013}.,]", ".")


def _shown(line: str, markdown: bool) -> tuple[str, bool]:
    """A line without what markup a converter left, and whether it is set apart as a whole."""
    text = regex.sub(r"^[\s>#]+", "", line)
    if markdown:
        text = regex.sub(r"`([^`]*)`", lambda m: regex.sub(r"([*_])", r"\\\1", m.group(1)), text)
        # Emphasis ends where a separator would stand, so it leaves a gap.
        text = regex.sub(r"(?<!\\)[*_]{1,2}((?:\\[*_]|[^*_])+?)(?<!\\)[*_]{1,2}", r"\1  ", text)
        text = regex.sub(r"(?<!\\)[*`]+", "", text)
    return text.strip(), markdown and bool(regex.match(r"\s*#|\s*[*_].*[*_]\s*$", line))


_APART = regex.compile(r"^(?:Figure|FIGURE|Fig\.|Рис(?:унок|\.)?)\s?(\d+(?:[-–.]\d+)*[a-z]?)[.:]?\s*(?:[–—-]\s+)?(\S.*)?$")
_LABEL_ALONE = regex.compile(r"^[\f\s]*(?:Figure|FIGURE|Fig\.|Рис(?:унок|\.)?)\s?(\d+(?:[-–.]\d+)?[a-z]?)[.:]?\s*$")


def caption_in(text: str, apart: bool) -> tuple[str, str] | None:
    """(label, text) of a line; one set apart (a heading, a caption element) needs no separator behind its label."""
    if apart and len(text) <= structure.CAPTION_CHARS and (m := _APART.match(" ".join(text.split()))):
        return m.group(1), m.group(2) or ""
    if m := _LABEL_ALONE.match(text):
        return m.group(1), ""
    return structure.caption_of(text)


def caption_lines(books: DataFrame, book: str, text: str, markdown: bool = True) -> DataFrame:
    """(book, line, char_start, label, shown, caption, next_line, bare): lines of a text that are captions; ``line`` counts them.

    A label alone borrows the next line as its caption.
    """

    def found(t: str) -> Iterator[tuple]:
        at, lines = 0, t.split("\n")
        for i, raw in enumerate(lines):
            if "ig" in raw or "IG" in raw or "Рис" in raw or "рис" in raw:
                shown, apart = _shown(raw, markdown)
                if hit := caption_in(shown, apart):
                    after = lines[i + 1].strip() if i + 1 < len(lines) else ""
                    yield (at, hit[0], f"{shown} {after}", after, "", True, shown) if not hit[1] else (at, hit[0], shown, hit[1], after, False, shown)
            at += len(raw) + 1

    def run(batches):
        for b in batches:
            rows = [(k, n, *r) for k, t in zip(b[book], b[text]) if t for n, r in enumerate(found(t))]
            yield pd.DataFrame(rows, columns=[book, "line", "char_start", "label", "shown", "caption", "next_line", "bare", "own"])

    kind = books.schema[book].dataType.simpleString()
    return books.select(book, text).mapInPandas(run, f"{book} {kind}, line int, char_start int, label string, shown string, caption string, next_line string, bare boolean, own string")


def candidates(entries: DataFrame, lines: DataFrame, book: str, pages: DataFrame | None = None) -> DataFrame:
    """(book, entry, line, by_page): caption lines that a figure may be, by label and caption, or by label and page.

    ``entries`` (book, entry, label, caption, page); ``pages`` (book, page, lo, hi) are the ranges of paged texts.
    """
    caption = F.regexp_replace(cleaned(F.coalesce("caption", F.lit(""))), r"(?U)\s+", " ")
    e = entries.select(F.col(book).alias("_b"), "entry", F.col("page").alias("_page"), plain_label(F.col("label")).alias("_label"), comparable(F.col("caption")).alias("_full"), comparable(F.substring(F.btrim(caption), 1, HEAD_CHARS)).alias("_head"))
    own, both = comparable(F.col("caption")), comparable(F.concat_ws(" ", "caption", "next_line"))
    shown = lines.select(book, "line", "char_start", "bare", plain_label(F.col("label")).alias("_l"), comparable(F.col("shown")).alias("_shown"), own.alias("_own"), both.alias("_both"))
    pairs = shown.join(e, (F.col(book) == F.col("_b")) & (F.col("_l") == F.col("_label")))
    begins = (F.length("_own") >= PREFIX_CHARS) & F.col("_full").startswith(F.col("_own"))
    wrapped = (F.col("_own") != "") & (F.length("_both") >= PREFIX_CHARS) & (F.length("_full") >= PREFIX_CHARS) & (F.col("_full").startswith(F.col("_both")) | F.col("_both").startswith(F.col("_full")))
    by_text = (F.col("_head") == "") | F.contains(F.col("_shown"), F.col("_head")) | begins | wrapped
    found = pairs.where(by_text).select(book, "entry", "line", F.lit(False).alias("by_page"))
    if pages is None:
        return found
    p = pages.select(F.col(book).alias("_pb"), F.col("page").alias("_pp"), "lo", "hi")
    # A line that opens a page begins on its form feed.
    here = pairs.where("bare").join(p, (F.col(book) == F.col("_pb")) & (F.col("_page") == F.col("_pp"))).where((F.col("char_start") + 1 >= F.col("lo")) & (F.col("char_start") + 1 < F.col("hi")))
    return found.unionByName(here.select(book, "entry", "line", F.lit(True).alias("by_page")))


def in_order(pairs: DataFrame, book: str) -> DataFrame:
    """(book, entry, line, by_page): for each entry in turn the first of its lines behind the one before's, by text if there is one, else by page.

    Pairs stream in order of book and entry, so a book of any size takes the memory of one entry's pairs.
    """

    def run(batches):
        own, entry, cursor, best = None, None, 0, None  # best: (by_page, line)
        for b in batches:
            out = []
            for k, e, line, by_page in zip(b[book], b["entry"], b["line"], b["by_page"]):
                if (k, e) != (own, entry):
                    if best is not None:
                        out.append((own, entry, best[1], best[0]))
                    cursor = (0 if k != own else cursor) if best is None or k != own else best[1] + 1
                    own, entry, best = k, e, None
                if line >= cursor and best is None:
                    best = (by_page, line)
            yield pd.DataFrame(out, columns=[book, "entry", "line", "by_page"])
        if best is not None:
            yield pd.DataFrame([(own, entry, best[1], best[0])], columns=[book, "entry", "line", "by_page"])

    kind = pairs.schema[book].dataType.simpleString()
    laid = pairs.repartition(book).sortWithinPartitions(book, "entry", "by_page", "line")
    return laid.mapInPandas(run, f"{book} {kind}, entry int, line int, by_page boolean")


def placements(entries: DataFrame, lines: DataFrame, book: str, pages: DataFrame | None = None) -> DataFrame:
    """Entries with ``at`` (null: unplaced), ``how`` (caption, label, page) and the caption that a marker shows there."""
    matched = in_order(candidates(entries, lines, book, pages), book)
    known = lines.select(book, "line", F.col("char_start").alias("_at"), "shown", "own")
    out = entries.join(matched.join(known, [book, "line"]), [book, "entry"], "left")
    at, how = F.col("_at"), F.when(F.col("_at").isNotNull(), F.when(F.col("by_page"), "label").otherwise("caption"))
    if pages is not None:
        out = out.join(pages.select(book, "page", F.col("lo").alias("_lo")), [book, "page"], "left")
        at, how = F.coalesce(at, "_lo"), F.coalesce(how, F.when(F.col("_lo").isNotNull(), "page"))
    composed = F.concat_ws(". ", *(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)) for c in ("label", "caption")))
    shown = F.when(how == "caption", F.col("shown")).when(how == "label", F.concat_ws(" ", "own", F.coalesce("caption", F.lit("")))).when(how == "page", composed)
    text = F.btrim(F.regexp_replace(cleaned(shown), r"(?U)\s+", " "))
    cut = F.when(F.length(text) > MARKER_CHARS, F.concat(F.substring(text, 1, MARKER_CHARS - 1), F.lit("…"))).otherwise(text)
    return out.select(*entries.columns, at.alias("at"), how.alias("how"), cut.alias("shown"))


# Layout: lines of a page with boxes, in reading order.

# Gap to a caption beside its label in heights, bounds of the ratio of heights, slack of an edge, most lines, width of a column in label widths, lines of a block set wide.
BESIDE_GAP, RATIO_LEAST, RATIO_MOST, EDGE, MOST_LINES, COLUMN_WIDTHS, WIDE_LINES = 3, 0.75, 1.3, 3, 20, 3.5, 2
_KEYWORD = r"(?:Figure|FIGURE|Fig\.|Рис\.?|Рисунок|рис\.?|рисунок)"
_ADMONITION = r"(?i)^(?:note|tip|warning|caution|important)\b"


def layout_lines(pages: DataFrame, keys: list[str], markup: str) -> DataFrame:
    """(keys, page, seq, block, x0, y0, x1, y1, text) of what a page converter prints with boxes of blocks, lines and words."""

    def found(t: str) -> Iterator[tuple]:
        page = block = seq = 0
        box, words, word = None, [], False
        for kind, name, attrs in files.events(t):
            if kind == "open" and name == "page":
                page, block, seq = page + 1, 0, 0
            elif kind == "open" and name == "line":
                box, words = [float(attrs.get(a, "nan")) for a in ("xmin", "ymin", "xmax", "ymax")], []
            elif kind == "open" and name == "word":
                word = True
                words.append("")
            elif kind == "text" and word:
                words[-1] += name
            elif kind == "close" and name == "word":
                word = False
            elif kind == "close" and name == "line" and box:
                if words:
                    yield (page, seq, block, *box, " ".join(words))
                    seq += 1
                box = None
            elif kind == "close" and name == "block":
                block += 1

    def run(batches):
        for b in batches:
            rows = [(*k, *r) for *k, t in b[[*keys, markup]].itertuples(index=False) if t for r in found(t)]
            yield pd.DataFrame(rows, columns=[*keys, "page", "seq", "block", "x0", "y0", "x1", "y1", "text"])

    kinds = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, markup).mapInPandas(run, f"{kinds}, page int, seq int, block int, x0 double, y0 double, x1 double, y1 double, text string")


def _joined(lines: Column) -> Column:
    """Texts as one, as structure.joined_line joins two; none is added to one of the full length."""
    def more(a: Column, b: Column) -> Column:
        soft = a.rlike("[¬­]$") | a.rlike("[а-яё]-$") & b.rlike("^[а-яё]")
        kept = a.rlike("[A-Za-z]-$") & b.rlike("^[a-z]")
        one = F.when(soft, F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b)).when(kept, F.concat(a, b)).otherwise(F.concat_ws(" ", a, b))
        return F.when(a == "", b).when(F.length(a) >= structure.CAPTION_CHARS, a).otherwise(one)

    return F.aggregate(lines, F.lit(""), more)


def recovered(labels: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Labels (keys, label) with the caption that the page's layout (keys, seq, block, box, text) gives them; null if none or several.

    A line that is the label alone is an anchor.  Its caption stands beside it on its base line, with the lines that
    wrap below in its block; or below it as a narrow column flush with an edge; or as a wide block of its own that ends a sentence.
    """
    line = F.struct("seq", "block", "x0", "y0", "x1", "y1", F.btrim("text").alias("text"))
    bare = F.regexp_replace(F.regexp_extract("text", rf"^\s*{_KEYWORD}\s?(\d\S*?)\s*[.:,]*(?:\s[.:\x{{2013}}\x{{2014}}-])*\s*$", 1), r"[.:,]+$", "")
    on = lines.select(*keys, plain_label(bare).alias("_l"), line.alias("a")).where(F.col("_l") != "")
    anchors = labels.select(*keys, "label").distinct().withColumn("_l", plain_label(F.regexp_replace("label", r"[.:,]+$", ""))).join(on.hint("merge"), [*keys, "_l"]).select(*keys, "label", "a")
    # Lines may be made from far fewer bytes than they have, so an estimate must not get them broadcast.
    pairs = anchors.join(lines.select(*keys, line.alias("l")).hint("merge"), keys).where(F.col("l.seq") != F.col("a.seq"))
    height = lambda c: F.col(f"{c}.y1") - F.col(f"{c}.y0")
    sized = (height("l") / height("a")).between(RATIO_LEAST, RATIO_MOST)
    near = lambda p, q: F.abs(F.col(p) - F.col(q)) <= EDGE
    overlap = F.least("l.y1", "a.y1") - F.greatest("l.y0", "a.y0")
    beside = (F.col("l.x0") >= F.col("a.x1") - 1) & (overlap >= 0.5 * F.least(height("a"), height("l"))) & (F.col("l.x0") - F.col("a.x1") <= BESIDE_GAP * height("a")) & sized
    under = (F.col("l.y0") - F.col("a.y1")).between(-1, height("a"))
    narrow = (F.col("l.x1") - F.col("l.x0") <= COLUMN_WIDTHS * (F.col("a.x1") - F.col("a.x0"))) & sized
    flush = F.when(narrow, near("l.x0", "a.x0").cast("int") + 2 * near("l.x1", "a.x1").cast("int")).otherwise(0)
    one = [*keys, "label", F.col("a.seq")]
    page = Window.partitionBy(*one)
    known = pairs.withColumns({"_flush": flush, "_under": under, "_sized": sized})
    firsts = known.withColumns({
        "_beside": F.min(F.when(beside, F.struct("l.x0", "l.seq", "l"))).over(page)["l"],
        "_below": F.min(F.when(F.col("_under") & (F.col("_flush") > 0), F.struct("l.y0", "l.seq", "l"))).over(page)["l"],
        "_wide": F.min(F.when(F.col("_under") & near("l.x0", "a.x0") & F.col("_sized"), F.struct("l.seq", "l"))).over(page)["l"],
    })
    order = Window.partitionBy(*one).orderBy("l.seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag("l").over(order)

    def run_from(first: str, goes_on: Column, most: int) -> Column:
        """The texts of a first line and of the lines right behind it in its block, as long as they go on."""
        inside = (F.col("l.seq") >= F.col(f"{first}.seq")) & (F.col("l.block") == F.col(f"{first}.block"))
        started = F.col("l.seq") == F.col(f"{first}.seq")
        return inside & (started | goes_on), most

    gap = F.col("l.y0") - before["y1"]
    left = near("l.x0", "_beside.x0") | near("l.x0", "a.x0")
    within = (F.col("l.x0") >= F.col("_beside.x0") - EDGE) & (F.col("l.x1") <= F.col("_beside.x1") + EDGE)
    like_first = ((F.col("l.y1") - F.col("l.y0")) / (F.col("_beside.y1") - F.col("_beside.y0"))).between(RATIO_LEAST, RATIO_MOST)
    wraps = (left | within) & like_first & gap.between(-1, before["y1"] - before["y0"])
    behind = F.col("l.seq") >= F.col("_below.seq")
    edges = F.bit_and(F.when(behind, F.col("_flush"))).over(so_far)
    column = (edges > 0) & gap.between(-1, height("a"))
    steps = firsts.withColumns({"_b": run_from("_beside", wraps, MOST_LINES)[0], "_c": run_from("_below", column, MOST_LINES)[0]})
    # A run ends at the first line that breaks it.
    broken = lambda first, ok: F.sum(F.when((F.col("l.seq") >= F.col(f"{first}.seq")) & ~F.coalesce(F.col(ok), F.lit(False)), 1).otherwise(0)).over(so_far)
    runs = steps.withColumns({"_bx": broken("_beside", "_b"), "_cx": broken("_below", "_c"), "_same": F.coalesce(F.col("l.block") == F.col("_wide.block"), F.lit(False))})
    ends = r"[.!?][\"'\x{201D}\x{BB})]?$"
    collect = lambda cond: F.transform(F.slice(F.sort_array(F.collect_list(F.when(cond, F.struct("l.seq", "l.text")))), 1, MOST_LINES), lambda s: s["text"])
    groups = runs.groupBy(*keys, "label", F.col("a.seq").alias("_anchor")).agg(
        collect(F.col("_b") & (F.col("_bx") == 0)).alias("_beside_t"),
        collect(F.col("_c") & (F.col("_cx") == 0)).alias("_below_t"),
        F.max(F.col("_below").isNotNull()).alias("_narrow"),
        collect(F.col("_same")).alias("_wide_t"),
        F.min(F.when(F.col("_same"), near("l.x0", "_wide.x0") & ((F.col("l.y1") - F.col("l.y0")) / (F.col("_wide.y1") - F.col("_wide.y0"))).between(RATIO_LEAST, RATIO_MOST))).alias("_even"),
        F.min(F.when(F.col("_same"), F.col("l.seq"))).alias("_block_first"), F.max("_wide.seq").alias("_wide_first"),
        F.max_by(F.when(F.col("_same"), F.col("l.text")), F.when(F.col("_same"), F.col("l.seq"))).alias("_block_last"),
    )
    whole = F.coalesce(~F.col("_narrow") & F.col("_even") & (F.col("_block_first") == F.col("_wide_first")) & (F.size("_wide_t") <= WIDE_LINES) & F.col("_block_last").rlike(ends), F.lit(False))
    text = lambda c: F.regexp_replace(_joined(F.col(c)), r"^[\x{E000}-\x{F8FF}]\s*", "")
    figure = r"^\s*(?:Figure|FIGURE|Fig\.|Рис)"
    is_text = lambda t: t.rlike(r"^[\p{L}\d(]") & ~t.rlike(r"^[\d\s.,\x{2013}-]+$") & ~t.rlike(_ADMONITION) & t.rlike(r"\p{L}{2}") & ~t.rlike(figure)
    words = lambda t: F.size(F.filter(F.split(t, r"[\s-]+"), lambda w: w.rlike(r"\p{L}")))
    is_column = lambda t: is_text(t) & t.rlike(r"^[\p{Lu}\d(]") & (words(t) >= 2) & ~t.rlike(r"[\s,]\d{1,4}(?:[\x{2013}-]\d{1,4})?$")
    t1, t2 = text("_beside_t"), F.when(F.col("_narrow"), text("_below_t")).when(whole, text("_wide_t"))
    read = groups.withColumn("_t", F.coalesce(F.when(is_text(t1), t1), F.when(is_column(t2), t2)))
    long = F.length("_t") > structure.CAPTION_CHARS
    unique = read.groupBy(*keys, "label").agg(F.collect_set("_t").alias("_s")).where(F.size("_s") == 1).withColumn("_t", F.col("_s")[0])
    mark = F.when(long, F.concat(F.substring("_t", 1, structure.CAPTION_CHARS - 1), F.lit("…"))).otherwise(F.col("_t"))
    return labels.join(unique.select(*keys, "label", mark.alias("caption")).hint("merge"), [*keys, "label"], "left")


# Pictures of markup documents.

_CLOSERS = frozenset("p h1 h2 h3 h4 h5 h6 figcaption div figure caption li td".split())
_CAPTION_ELEMENTS = frozenset("figcaption h1 h2 h3 h4 h5 h6 caption".split())
_TOKEN = regex.compile(r"(?i)<svg\b[\s\S]*?</svg\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>|[^<]+|<")


def _attribute(tag: str, name: str) -> str | None:
    m = regex.search(rf'(?i)\b{name}="([^"]+)"', tag)
    return m.group(1) if m else None


def _picture(tag: str, folder: str) -> tuple[str | None, str, int | None, int | None] | None:
    """(file, source, width, height) of a picture's tag: a raster, or a drawing that has to be rendered; None if it names nothing."""
    drawn = tag[:4].lower() == "<svg"
    inner = regex.search(r"(?i)<image\b[^>]*>", tag) if drawn else None
    own = inner.group() if inner else tag
    ref = (_attribute(own, "href") or _attribute(own, "xlink:href")) if drawn else _attribute(tag, "src")
    if not drawn and not ref:
        return None
    if drawn and not (inner and ref):
        own, ref = tag, None
    place = None if ref is None else files.resolved(folder, ref)
    size = [int(v) if (v := _attribute(own, a)) and regex.fullmatch(r"[0-9]+", v) else None for a in ("width", "height")]
    return place, "svg-render" if place is None or place.lower().endswith(".svg") else "raster", *size


def document_events(docs: DataFrame, book: str, html: str = "html") -> DataFrame:
    """(book, page, at, end, kind, tag, value, source, width, height): pictures, texts and ends of blocks of documents (book, page, href, html) in order."""

    def found(t: str, folder: str) -> Iterator[tuple]:
        for m in _TOKEN.finditer(t):
            tag, name = m.group(), (m.group(2) or "").lower()
            if tag[:4].lower() == "<svg" or name == "img" and not m.group(1):
                if p := _picture(tag, folder):
                    yield m.start(), m.end(), "picture", None, *p
                else:  # it names nothing, but a caption search stops at it
                    yield m.start(), m.end(), "stop", None, None, None, None, None
            elif not name:
                yield m.start(), m.end(), "text", None, tag, None, None, None
            elif m.group(1) and name in _CLOSERS:
                yield m.start(), m.end(), "close", name, None, None, None, None

    def run(batches):
        for b in batches:
            rows = [(k, n, *r) for k, n, ref, t in zip(b[book], b["page"], b["href"], b[html]) if t for r in found(t, ref.rpartition("/")[0] if ref else "")]
            yield pd.DataFrame(rows, columns=[book, "page", "at", "end", "kind", "tag", "value", "source", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    kind = docs.schema[book].dataType.simpleString()
    return docs.select(book, "page", "href", html).mapInPandas(run, f"{book} {kind}, page int, at int, end int, kind string, tag string, value string, source string, width int, height int")


_CAPTION = T.StructType([T.StructField("label", T.StringType()), T.StructField("caption", T.StringType())])


@F.pandas_udf(_CAPTION)
def _caption(text: pd.Series, apart: pd.Series) -> pd.DataFrame:
    import html

    found = [caption_in(" ".join(html.unescape(t).split()), bool(a)) if t else None for t, a in zip(text, apart)]
    return pd.DataFrame([f or (None, None) for f in found], columns=["label", "caption"])


def pictures(docs: DataFrame, book: str, html: str = "html") -> DataFrame:
    """(book, index, page, at, file, source, width, height, label, caption): the pictures of documents in order, with the caption next to each.

    A caption is the first block of text behind a picture, within CAPTION_REACH characters and before the next picture.
    One window over a document's events says which picture each text follows, and whether its block has ended.
    """
    events = document_events(docs, book, html)
    order = Window.partitionBy(book, "page").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stands = F.col("kind").isin("picture", "stop")
    owned = events.withColumns({"_n": F.count(F.when(stands, 1)).over(order), "_from": F.last(F.when(stands, F.col("end")), ignorenulls=True).over(order)}).where("_n > 0")
    reach = owned.where(stands | (F.col("at") < F.col("_from") + CAPTION_REACH)).withColumn("value", F.when(F.col("kind") == "text", F.expr(f"substring(value, 1, _from + {CAPTION_REACH} - at)")).otherwise(F.col("value")))
    mine = Window.partitionBy(book, "page", "_n").orderBy("at")
    wrote = F.max(F.when((F.col("kind") == "text") & F.col("value").rlike(r"\S"), 1).otherwise(0)).over(mine.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ended = reach.withColumn("_ends", (F.col("kind") == "close") & (wrote == 1) & (F.col("end") <= F.col("_from") + CAPTION_REACH))
    over = F.count(F.when(F.col("_ends"), 1)).over(mine.rowsBetween(Window.unboundedPreceding, -1))
    block = ended.withColumn("_over", over).where("_over = 0")
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "text", F.struct("at", "value")))), lambda s: s["value"]), "")
    first = lambda c: F.max(F.when(F.col("kind") == "picture", F.col(c)))
    rows = block.groupBy(book, "page", "_n").agg(first("at").alias("at"), first("value").alias("file"), first("source").alias("source"), first("width").alias("width"), first("height").alias("height"), texts.alias("_text"), F.max(F.when(F.col("_ends"), F.col("tag"))).alias("_tag")).where("at is not null")
    read = rows.withColumn("_c", _caption("_text", F.coalesce(F.col("_tag").isin(*_CAPTION_ELEMENTS), F.lit(False))))
    index = F.row_number().over(Window.partitionBy(book).orderBy("page", "at")) - 1
    return read.select(book, index.alias("index"), "page", "at", "file", "source", "width", "height", "_c.label", "_c.caption")


# Search of figures.

WEIGHTS = {"caption_stem": 1.0, "caption": 1.0, "book_meta": 0.5}


def units(figures: DataFrame, book: str, meta: DataFrame | None = None) -> DataFrame:
    """(figure, book, index, caption, caption_stem, book_meta) of captioned figures, ready for an index; ``meta`` (book, title, lang) names their books."""
    from . import stemming

    named = figures.where(F.coalesce("caption", F.lit("")) != "")
    if meta is None:
        named = named.withColumns({"title": F.lit(""), "lang": F.lit(None).cast("string")})
    else:
        named = named.join(meta.select(book, "title", "lang"), book, "left")
    stem = lambda c: F.array_join(stemming.stems(c, "lang"), " ")
    titled = named.withColumn("title", F.coalesce("title", F.lit("")))
    return titled.select(F.concat_ws(":", book, "index").alias("figure"), book, "index", "caption", stem("caption").alias("caption_stem"), stem("title").alias("book_meta"))


def search(figures: DataFrame, terms: list, k: int, weights: dict[str, float] | None = None, allow: DataFrame | None = None) -> DataFrame:
    """(figure, score, rank) of the k best figures (as ``units`` gives them) by BM25 over captions and books; ``allow`` names books."""
    from . import keyword

    weights = weights or WEIGHTS
    size = sum((F.size(keyword.terms_of(c)) for c in list(weights)[1:]), F.size(keyword.terms_of(next(iter(weights)))))
    facts = figures.select(size.alias("n")).agg(F.count("*").alias("t"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("m")).first()
    scored = keyword.bm25(keyword.postings(figures, "figure", list(weights)), "figure", terms, facts.t, facts.m, weights)
    if allow is not None:
        book = next(c for c in figures.columns if c in allow.columns)
        scored = scored.join(figures.join(allow, book, "left_semi").select("figure"), "figure", "left_semi")
    best = scored.orderBy(*keyword.by_score("figure")).limit(max(k, 0))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*keyword.by_score("figure"))))
