"""Figures and sections against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import figures, sections, spans


def test_caption_lines_and_candidates(spark):
    text = "\n".join([
        "Intro", "**Figure 1.1** A map of things", "see Figure 1.1 for it", "##### Figure 2-1 Loops and their ends", "",
        "Figure 3.1", "The caption that stands below", "Figure 4.1. Wraps over", "two lines of text", "Рис. 5.1 Отношение, которое", "`Figure 6.1` code",
    ])
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "b long, t string")
    got = [(r.line, r.char_start, r.label, r.caption, r.bare) for r in figures.caption_lines(df, "b", "t").orderBy("line").collect()]
    at = [text.index(x) for x in ("**Figure 1.1", "##### Fig", "Figure 3.1", "Figure 4.1", "Рис")]
    assert got == [(0, at[0], "1.1", "A map of things", False), (1, at[1], "2-1", "Loops and their ends", False), (2, at[2], "3.1", "The caption that stands below", True), (3, at[3], "4.1", "Wraps over", False), (4, at[4], "5.1", "Отношение, которое", False)]
    lines = figures.caption_lines(df, "b", "t")
    entries = [(1, 0, "1-1", "A Map  of things", 1), (1, 1, "2.1", "Loops and their ends credit: x", 1), (1, 2, "3.1", "the caption that stands below", 1), (1, 3, "4.1", "Wraps over two lines of text and more", 1), (1, 4, "5.1", None, 1), (1, 5, "9.9", "x", 1), (1, 6, "1.1", "A map of things", 1)]
    e = spark.createDataFrame(entries, "b long, entry int, label string, caption string, page int")
    placed = {r.entry: (r.at, r.how) for r in figures.placements(e, lines, "b").collect()}
    assert placed == {0: (at[0], "caption"), 1: (at[1], "caption"), 2: (at[2], "caption"), 3: (at[3], "caption"), 4: (at[4], "caption"), 5: (None, None), 6: (None, None)}


def test_pages_place_what_captions_do_not(spark):
    text = "Page one\n\fFigure 1.5\nunrelated words\n\fFigure 1.6. Named here\n"
    df = spark.createDataFrame([(1, text)], "b long, t string")
    starts = [0, text.index("\f") + 1, text.rindex("\f") + 1, len(text)]
    pages = spark.createDataFrame([(1, p + 1, starts[p], starts[p + 1]) for p in range(3)], "b long, page int, lo int, hi int")
    entries = [(1, 0, "1.4", "Nowhere in the text", 1), (1, 1, "1.5", "Read from the layout", 2), (1, 2, "1.6", "Named here", 3), (1, 3, "1.7", "past the end", 9)]
    e = spark.createDataFrame(entries, "b long, entry int, label string, caption string, page int")
    got = {r.entry: (r.at, r.how, r.shown) for r in figures.placements(e, figures.caption_lines(df, "b", "t", False), "b", pages).collect()}
    assert got == {0: (0, "page", "1.4. Nowhere in the text"), 1: (starts[1] - 1, "label", "Figure 1.5 Read from the layout"), 2: (starts[2] - 1, "caption", "Figure 1.6. Named here"), 3: (None, None, None)}


def test_order_preserving_match(spark):
    rng = random.Random(3)
    pairs, want = [], []
    for b in range(12):
        cursor = 0
        for e in range(rng.randint(1, 9)):
            own = sorted({(rng.random() < 0.3, rng.randrange(10)) for _ in range(rng.randint(0, 4))})
            pairs += [(b, e, line, by) for by, line in own]
            hit = next(((line, by) for by, line in own if line >= cursor), None)
            if hit:
                want.append((b, e, *hit))
                cursor = hit[0] + 1
    df = spark.createDataFrame(pairs, "b long, entry int, line int, by_page boolean").repartition(5)
    assert sorted(map(tuple, figures.in_order(df, "b").collect())) == sorted(want)


def line(seq, block, x0, y0, x1, text, h=10.0):
    return (1, 1, seq, block, float(x0), float(y0), float(x1), float(y0 + h), text)


LAYOUT = "b long, page int, seq int, block int, x0 double, y0 double, x1 double, y1 double, text string"


@pytest.mark.parametrize("lines,want", [
    ([line(0, 0, 50, 100, 100, "Figure 1.5"), line(1, 1, 110, 100, 300, "How events flow from pro-"), line(2, 1, 110, 111, 250, "ducers to readers"), line(3, 1, 110, 150, 250, "Too far below")], "How events flow from pro-ducers to readers"),
    ([line(0, 0, 50, 100, 100, "FIGURE 1-5:"), line(1, 0, 40, 111, 100, "A drawing"), line(2, 0, 45, 122, 100, "set flush right"), line(3, 0, 20, 133, 90, "not flush")], "A drawing set flush right"),
    ([line(0, 0, 50, 100, 100, "Figure 1.5"), line(1, 1, 50, 111, 400, "The whole width of the page is taken"), line(2, 1, 50, 122, 300, "by this one sentence.")], "The whole width of the page is taken by this one sentence."),
    ([line(0, 0, 50, 100, 100, "Figure 1.5"), line(1, 1, 50, 111, 400, "A paragraph that goes on and on"), line(2, 1, 50, 122, 400, "and on")], None),
    ([line(0, 0, 50, 100, 100, "Figure 1.5"), line(1, 1, 110, 100, 300, "12 14 15")], None),
    ([line(0, 0, 50, 100, 100, "Figure 1.5"), line(1, 1, 110, 100, 300, "Too large a type", 16.0)], None),
    ([line(0, 0, 50, 100, 100, "Figure 1.5"), line(1, 1, 200, 100, 300, "In the next column")], None),
    ([line(0, 0, 50, 100, 100, "Figure 1.5"), line(1, 1, 110, 100, 300, "One reading"), line(2, 2, 50, 300, 100, "Figure 1.5"), line(3, 3, 110, 300, 300, "Another reading")], None),
    ([line(0, 0, 50, 100, 100, "Figure 1.5 is cited"), line(1, 1, 110, 100, 300, "No anchor here")], None),
    ([line(0, 0, 50, 100, 100, "Рис. 1.5"), line(1, 1, 110, 100, 300, "Схема пере-"), line(2, 1, 50, 111, 250, "дачи данных")], "Схема передачи данных"),
])
def test_layout(spark, lines, want):
    labels = spark.createDataFrame([(1, 1, "1.5"), (1, 2, "1.5")], "b long, page int, label string")
    got = {r.page: r.caption for r in figures.recovered(labels, spark.createDataFrame(lines, LAYOUT), ["b", "page"]).collect()}
    assert got == {1: want, 2: None}


def test_layout_lines(spark):
    xml = '<doc><page width="1" height="2"><flow><block><line xMin="1" yMin="2" xMax="3" yMax="4"><word xMin="1" yMin="2" xMax="2" yMax="4">Figure</word><word xMin="2" yMin="2" xMax="3" yMax="4">1.5</word></line><line xMin="1" yMin="5" xMax="3" yMax="6"></line></block><block><line xMin="7" yMin="2" xMax="9" yMax="4"><word xMin="7" yMin="2" xMax="9" yMax="4">A &amp; b</word></line></block></flow></page><page></page></doc>'
    df = spark.createDataFrame([(1, xml), (2, None), (3, "<torn")], "b long, m string")
    got = [tuple(r) for r in figures.layout_lines(df, ["b"], "m").orderBy("seq").collect()]
    assert got == [(1, 1, 0, 0, 1.0, 2.0, 3.0, 4.0, "Figure 1.5"), (1, 1, 1, 1, 7.0, 2.0, 9.0, 4.0, "A & b")]


def test_pictures(spark):
    docs = [
        (1, 1, "text/a.html", '<img src="../i/x.png" width="7"/><p>Figure 1. First &amp; best</p><p>Figure 9. no</p><svg><path d="M0"/></svg><div><span>Figure 2: </span>by<b> parts</b></div><img src="y.png"><img src="z.SVG"><figcaption>Figure 3.1 Without a sign</figcaption>'),
        (1, 2, "b.html", '<svg><image xlink:href="c.png" width="3" height="4"/></svg>' + " " * 1990 + "<p>Figure 4. Too far</p><img alt='none'><img src=\"q.png\">plain"),
        (1, 3, None, None),
        (2, 1, "c.html", "no pictures <p>Figure 1. at all</p>"),
    ]
    df = spark.createDataFrame(docs, "b long, page int, href string, html string")
    got = [tuple(r[1:]) for r in figures.pictures(df, "b").drop("at").orderBy("index").collect()]
    assert got == [
        (0, 1, "i/x.png", "raster", 7, None, "1", "First & best"), (1, 1, None, "svg-render", None, None, "2", "by parts"), (2, 1, "text/y.png", "raster", None, None, None, None), (3, 1, "text/z.SVG", "svg-render", None, None, "3.1", "Without a sign"),
        (4, 2, "c.png", "raster", 3, 4, None, None), (5, 2, "q.png", "raster", None, None, None, None),
    ]


def plain_sections(entries, n, units):
    kept, out, open_ = [], [], []
    for _, title, level, at in entries:
        if title.strip() and not (kept and (at < kept[-1][2] or at == kept[-1][2] and level <= kept[-1][1])):
            kept.append((title.strip(), level, at))
    for title, level, at in kept:
        while open_ and out[open_[-1]]["level"] >= level:
            out[open_.pop()]["end"] = at
        out.append({"title": title, "level": level, "start": at, "end": n, "parent": open_[-1] if open_ else None})
        open_.append(len(out) - 1)
    for s in out:
        chars = {}
        for a, b, k in units:
            if (c := min(b, s["end"]) - max(a, s["start"])) > 0:
                chars[k] = chars.get(k, 0) + c
        s["kind"] = min(chars, key=lambda k: (-chars[k], sections.KINDS.index(k)), default="body")
    return [(i, *s.values()) for i, s in enumerate(out)]


def test_sections(spark):
    rng = random.Random(6)
    books, units, want = [], [], {}
    for b in range(8):
        n, at, entries, own = 1000, 0, [], []
        for i in range(25):
            at = max(0, at + rng.choice([0, 0, 30, 60, -40]))
            entries.append((i, rng.choice(["One", " \t", "Two  words"]), rng.randint(1, 4), at))
        a = 0
        while a < n:
            z = a + rng.randint(1, 90)
            own.append((a, min(z, n), rng.choice(sections.KINDS)))
            a = z + rng.choice([0, 0, 15])
        books += [(b, *e, n) for e in entries]
        units += [(b, *u) for u in own]
        want[b] = plain_sections([(i, " ".join(t.split()), lv, at) for i, t, lv, at in entries], n, own)
    e = spark.createDataFrame(books, "b long, seq int, title string, level int, char_start int, total int").repartition(3)
    u = spark.createDataFrame(units, "b long, char_start int, char_end int, matter_kind string")
    tree = sections.kinds_of(sections.nested(sections.ordered(e, "b"), "b", "total"), u, "b")
    got = {}
    for r in tree.select("b", "position", "title", "level", "char_start", "char_end", "parent", "matter_kind").orderBy("b", "position").collect():
        got.setdefault(r.b, []).append(tuple(r[1:]))
    assert got == want


def test_placed_sections_from_an_outline(spark):
    text = "Cover\n\fOne\nbody of one\nTwo\nbody\n\fThree\nrest"
    starts = [0, text.index("\f") + 1, text.rindex("\f") + 1, len(text)]
    books = spark.createDataFrame([(1, text), (2, "no sections")], "b long, text string")
    rows = [(1, 0, "One", 1, 2), (1, 1, "Two", 2, 2), (1, 2, "Missing", 2, 3), (1, 3, "Deep", 5, 3), (1, 4, "Page?", 1, 9), (2, 0, "Only", 1, 1)]
    entries = spark.createDataFrame([(b, i, t, lv, starts[p - 1] if p < 4 else None, starts[p] if p < 4 else None, True) for b, i, t, lv, p in rows], "b long, seq int, title string, level int, lo int, hi int, snaps boolean")
    units = spark.createDataFrame([(1, 0, 20, "front"), (1, 20, len(text), "body")], "b long, char_start int, char_end int, matter_kind string")
    got = [tuple(r) for r in sections.book_sections(books, entries, units, "b").select("b", "position", "title", "char_start", "char_end", "parent").orderBy("position").collect()]
    assert got == [(1, 0, "One", starts[1], len(text), None), (1, 1, "Two", text.index("Two"), starts[2], 0), (1, 2, "Missing", starts[2], len(text), 0)]
    two = {"pdf-outline": sections.placed(books, entries, "b"), "chapters": spark.createDataFrame([(2, 0, "Chapter", 1, 3), (1, 0, "x", 1, 3)], "b long, seq int, title string, level int, char_start int")}
    assert {(r.b, r.source) for r in sections.picked(two, "b").collect()} == {(1, "pdf-outline"), (2, "chapters")}


def test_intervals(spark):
    """Points and spans of every length, nested and overlapping, against comparing all."""
    rng = random.Random(2)
    ranges = [(rng.randrange(3), i, a := rng.randrange(2000), a + rng.choice([0, 1, 5, 70, 1000])) for i in range(200)]
    points = [(rng.randrange(4), rng.randrange(-5, 2600)) for _ in range(300)]
    p = spark.createDataFrame(points, "b long, at int")
    s = spark.createDataFrame(ranges, "b long, id int, char_start int, char_end int")
    hits = [(b, at, i) for b, at in points for c, i, lo, hi in ranges if b == c and lo <= at < hi]
    none = [(b, at, None) for b, at in points if not any(b == c and lo <= at < hi for c, _, lo, hi in ranges)]
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0)
    run = lambda **more: sorted((tuple(r) for r in spans.holding(p, s, "b", "at", **more).select("b", "at", "id").collect()), key=key)
    assert run() == sorted(hits + none, key=key) and run(how="inner") == sorted(hits, key=key)
    sec = spark.createDataFrame([(0, f"s{i}", a, b) for i, (a, b) in enumerate([(0, 100), (50, 900), (2500, 2600)])], "b long, name string, char_start int, char_end int")
    u = s.withColumn("kind", F.when(F.col("id") % 3 == 0, "x").otherwise("y"))
    got = {r.name: r.kind for r in spans.majority_kind(sec, u, "b", "name").collect()}
    want = {}
    for name, lo, hi in [("s0", 0, 100), ("s1", 50, 900), ("s2", 2500, 2600)]:
        chars, firsts = {}, {}
        for b, i, a, z in ranges:
            if b == 0 and a < hi and z > lo:
                k = "x" if i % 3 == 0 else "y"
                chars[k] = chars.get(k, 0) + min(z, hi) - max(a, lo)
                firsts[k] = min(firsts.get(k, a), a)
        want[name] = min(chars, key=lambda k: (-chars[k], firsts[k]), default="body")
    assert got == want
