"""Tables of book files, pages with gaps, patterns, budgets, and ranked books, against plain expectations."""

import random

import pytest

from lectern.operators import catalogue, etl, sections, spans, vectors
from lectern.sources import books

OPF = '<package><manifest><item id="a" href="t/a.xhtml"/><item id="b" href="t/b%20c.xhtml"/><item id="n" href="nav.xhtml" properties="nav"/><item id="x" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="x"><itemref idref="b"/><itemref idref="gone"/><itemref idref="a"/></spine></package>'
NAV = '<nav epub:type="toc"><ol><li><a href="t/a.xhtml#s">One</a><ol><li><a href="t/b%20c.xhtml">Two</a></li></ol></li><li><a href="https://x">Out</a></li></ol></nav>'
NCX = '<ncx><navMap><navPoint><navLabel><text>Old</text></navLabel><content src="t/a.xhtml"/></navPoint></navMap></ncx>'


def test_book_files_as_tables(spark):
    c = '<container><rootfile full-path="O/p.opf"/></container>'
    rows = [(1, books.CONTAINER, c), (1, "O/p.opf", OPF), (1, "O/nav.xhtml", NAV), (1, "O/toc.ncx", NCX), (1, "O/t/a.xhtml", "<p>a</p>"), (2, books.CONTAINER, c), (2, "O/p.opf", OPF), (2, "O/nav.xhtml", "<nav></nav>"), (2, "O/toc.ncx", NCX), (3, books.CONTAINER, c), (4, "x", None), (5, books.CONTAINER, "<torn"), (6, books.CONTAINER, None)]
    files = spark.createDataFrame(rows, "book int, path string, content string").repartition(3)
    parts = books.packages(files, "book")
    assert sorted(map(tuple, parts.where("book = 1").collect())) == [(1, "nav", 0, "O/nav.xhtml"), (1, "ncx", 0, "O/toc.ncx"), (1, "spine", 0, "O/t/b c.xhtml"), (1, "spine", 1, "O/t/a.xhtml")]
    assert {r.book for r in parts.collect()} == {1, 2}
    assert [tuple(r) for r in books.spine_documents(files, parts, "book").collect()] == [(1, 2, "O/t/a.xhtml", "<p>a</p>")]
    got = [tuple(r) for r in books.contents_table(files, parts, "book").orderBy("book", "seq").collect()]
    assert got == [(1, "nav", 0, "One", 1, "O/t/a.xhtml", "s"), (1, "nav", 1, "Two", 2, "O/t/b c.xhtml", ""), (2, "ncx", 0, "Old", 1, "O/t/a.xhtml", "")]


def test_sections_from_contents_and_outlines(spark):
    text = "Start\nOne\nbody\n\fTwo here\nmore"
    df = spark.createDataFrame([(1, text), (2, "flat")], "book int, text string")
    toc = spark.createDataFrame([(1, 0, "One", 1, "a", "s"), (1, 1, "Two", 2, "b", ""), (1, 2, "Lost", 1, "z", "")], "book int, seq int, title string, level int, href string, fragment string")
    anchors = spark.createDataFrame([(1, "a", 0), (1, "b", 15)], "book int, href string, start int")
    got = [tuple(r) for r in sections.placed(df, sections.contents_ranges(toc, anchors, df, "book"), "book").orderBy("seq").collect()]
    assert got == [(1, 0, "One", 1, 6), (1, 1, "Two", 2, 15)]
    xml = spark.createDataFrame([(1, "<outline><item page=\"2\">Two here</item><outline><item page=\"9\">Past</item></outline></outline>"), (2, "<outline><item page=\"1\">Flat</item></outline>"), (3, None)], "book int, xml string")
    listed = books.outline_entries(xml, "book", "xml")
    assert sorted((r.book, r.title, r.page, r.level) for r in listed.collect()) == [(1, "Past", 9, 2), (1, "Two here", 2, 1), (2, "Flat", 1, 1)]
    got = [tuple(r) for r in sections.placed(df, sections.outline_ranges(listed, df, "book"), "book").collect()]
    assert got == [(1, 0, "Two here", 1, 16)]


def test_words_of_pages(spark):
    page = '<page width="10" height="20"><word xMin="1" yMin="2" xMax="3" yMax="4">A &amp; b</word></page>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "none")], "page int, m string")
    assert [tuple(r) for r in books.word_table(df, ["page"], "m").collect()] == [(1, 0, 10.0, 20.0, 1.0, 2.0, 3.0, 4.0, "A & b")]


def test_pages_with_gaps_and_overlaps(spark):
    rows = [(1, 0, "ab\f"), (1, 3, "cd"), (1, 7, "late"), (2, 0, "x\fy"), (2, 2, "yz"), (3, 0, "no"), (3, 2, "breaks"), (4, 5, "a\f")]
    df = spark.createDataFrame(rows, "book int, char_start int, body string")
    got = {(r.book, r.char_start): r.page for r in spans.pages(df, "book", "char_start", "body").collect()}
    assert got == {(1, 0): 1, (1, 3): 2, (1, 7): None, (2, 0): 1, (2, 2): None, (3, 0): None, (3, 2): None, (4, 5): None}


def test_patterns_are_read_by_the_engine(spark):
    df = spark.createDataFrame([("Abc",), ("xyz",)], "v string")
    assert [r.value for r in catalogue.facets(df, "v", "^a").collect()] == ["Abc"]
    for bad in ("(", "(?P<n>a)", "[z-a]"):
        with pytest.raises(ValueError):
            catalogue.facets(df, "v", bad)


def test_budgets_are_met_in_few_measurements():
    rng = random.Random(3)
    for even in (True, False):
        text = " ".join("w" * (5 if even or rng.random() < 0.7 else rng.randint(1, 60)) for _ in range(3000))
        seen = []

        def words(s):
            seen.append(len(s))
            return len(s.split())

        found = list(etl.chunks(text, 100, words))
        assert "".join(text[a:e] for a, e in found) == text and all(len(text[a:e].split()) <= 100 for a, e in found)
        assert len(found) <= 75 and len(seen) <= (4 if even else 9) * len(found)
    assert list(etl.chunks("abc", 0, lambda s: len(s))) == [(0, 1), (1, 2), (2, 3)]


def test_ranked_books(spark):
    rows = [(b, b * 10 + i, float((b * 7 + i * 3) % 11), i == 0 or b % 2 == 0) for b in range(6) for i in range(3)]
    df = spark.createDataFrame(rows, "book int, unit int, score double, body boolean")
    best = {}
    for b, u, s, body in rows:
        best[b] = max(best.get(b, (False, -1.0, 0)), (body, s, -u))
    order = sorted(best, key=lambda b: (-best[b][1], b))
    for k in (-1, 0, 1, 3):
        got = [(r.book, r.rank) for r in vectors.library_topk(df, "book", "unit", k, "body").orderBy("rank").collect()]
        assert got == [(b, i + 1) for i, b in enumerate(order[: max(1, k)])]
