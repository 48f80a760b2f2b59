"""Readers of what book files say about their structure: outlines, packages, tables of contents, words on pages.

One tolerant reader of markup stands under all: it gives events in order, and never fails on torn input.
"""

from __future__ import annotations

import html
import posixpath
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class _Events(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, dict]] = []

    def handle_starttag(self, tag, attrs):
        self.found.append(("open", tag, {k: v or "" for k, v in attrs}))

    def handle_startendtag(self, tag, attrs):
        self.found.append(("empty", tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.found.append(("close", tag, {}))

    def handle_data(self, data):
        self.found.append(("text", data, {}))


def events(markup: str) -> Iterator[tuple[str, str, dict]]:
    """(kind, name or text, attributes) of markup in order; kind is open, empty, close or text; names in lower case."""
    reader = _Events()
    # What is torn at the end is left out; self-closing of scripts and styles is no case here.
    reader.feed(markup)
    return iter(reader.found)


def _title(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def outline(xml: str) -> list[tuple[str, int | None, int]]:
    """(title, page, level) of a PDF's outline as the converter prints it; a page below one is none."""
    out, depth, item = [], 0, None
    for kind, name, attrs in events(xml):
        if name == "outline" and kind in ("open", "close"):
            depth = max(0, depth + (1 if kind == "open" else -1))
        elif name == "item" and kind == "open" and depth:
            page = attrs.get("page", "")
            item = (int(page) if page.isdigit() and int(page) >= 1 else None, [])
        elif name == "item" and kind == "close" and item:
            title = " ".join("".join(item[1]).split())
            if title:
                out.append((title, item[0], depth))
            item = None
        elif kind == "text" and item:
            item[1].append(name)
    return out


def resolved(folder: str, href: str) -> str:
    """A relative reference as a path inside the package; steps above its root stay at it."""
    out: list[str] = []
    for part in f"{folder}/{href}".split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def package_path(container: str) -> str | None:
    """Where the container file says that the package file is."""
    return next((a["full-path"] for _, name, a in events(container) if name == "rootfile" and a.get("full-path")), None)


def package(opf: str, path: str) -> dict:
    """spine (paths in reading order), nav and ncx (paths of the tables of contents, or None) of a package file."""
    folder, items, order, ncx_id = posixpath.dirname(path), [], [], None
    for kind, name, a in events(opf):
        if kind not in ("open", "empty"):
            continue
        if name == "item" and a.get("href"):
            items.append((a, resolved(folder, unquote(a["href"]))))
        elif name == "spine":
            ncx_id = a.get("toc")
        elif name == "itemref":
            order.append(a.get("idref"))
    by_id = {a.get("id"): href for a, href in items if a.get("id")}
    nav = next((href for a, href in items if "nav" in a.get("properties", "").split()), None)
    ncx = next((href for a, href in items if (ncx_id and a.get("id") == ncx_id) or a.get("media-type") == "application/x-dtbncx+xml"), None)
    return {"spine": [by_id[i] for i in order if i in by_id], "nav": nav, "ncx": ncx}


def _target(raw: str, folder: str) -> tuple[str, str] | None:
    """(path, fragment) of a link into the book; None for one that leads elsewhere, or stays in its own file."""
    file, _, fragment = raw.partition("#")
    if not file or re.match(r"(?i)[a-z][a-z0-9+.-]*:", file):
        return None
    return resolved(folder, unquote(file)), unquote(fragment)


Entry = tuple[str, int, str, str]


def nav_entries(xhtml: str, path: str) -> list[Entry]:
    """(title, level, path, fragment) of a navigation document's table of contents; its other lists don't count."""
    navs: list[tuple[bool, list[Entry]]] = []
    inside, depth, link = False, 0, None
    for kind, name, a in events(xhtml):
        if name == "nav" and kind == "open":
            kinds = f"{a.get('epub:type', '')} {a.get('type', '')}".split()
            navs.append(("toc" in kinds, []))
            inside, depth = True, 0
        elif name == "nav" and kind == "close":
            inside = False
        elif not inside:
            continue
        elif name == "ol" and kind in ("open", "close"):
            depth = max(0, depth + (1 if kind == "open" else -1))
        elif name == "a" and kind == "open":
            link = (a.get("href", ""), [])
        elif name == "a" and kind == "close" and link:
            title, target = _title(link[1]), _target(link[0], posixpath.dirname(path))
            if title and target:
                navs[-1][1].append((title, max(1, depth), *target))
            link = None
        elif kind == "text" and link:
            link[1].append(name)
    return next((found for toc, found in navs if toc), navs[0][1] if navs else [])


def ncx_entries(xml: str, path: str) -> list[Entry]:
    """(title, level, path, fragment) of the older table of contents."""
    out, inside, depth, label, reading = [], False, 0, None, False
    for kind, name, a in events(xml):
        if name == "navmap":
            inside = kind == "open"
        elif not inside:
            continue
        elif name == "navpoint":
            depth = max(0, depth + (1 if kind == "open" else -1))
            label = [] if kind == "open" else None
        elif name == "navlabel":
            reading = kind == "open"
        elif name == "content" and label:
            target = _target(a.get("src", ""), posixpath.dirname(path))
            if target and _title(label):
                out.append((_title(label), depth, *target))
            label = None
        elif kind == "text" and reading and label is not None:
            label.append(name)
    return out


def contents(nav: list[Entry], ncx: list[Entry]) -> list[Entry]:
    """The newer table of contents, unless it gives nothing."""
    return nav or ncx


def visible_text(page: str) -> str:
    """The text of a document's body without scripts and styles."""
    out, hidden = [], 0
    begun = "<body" not in page.lower()
    for kind, name, _ in events(page):
        if name == "body" and kind == "open":
            begun = True
        elif name in ("script", "style", "head") and kind in ("open", "close"):
            hidden = max(0, hidden + (1 if kind == "open" else -1))
        elif kind == "text" and begun and not hidden:
            out.append(name)
    return " ".join(out)


def page_words(markup: str) -> tuple[float, float, list[tuple[float, float, float, float, str]]] | None:
    """(width, height, words (x0, y0, x1, y1, text)) of the first page of a listing of words with their boxes."""
    size, words, box = None, [], None
    for kind, name, a in events(markup):
        if name == "page" and kind == "open":
            if size:
                break
            size = (float(a.get("width", 0)), float(a.get("height", 0)))
        elif name == "page" and kind == "close":
            break
        elif name == "word" and kind == "open":
            box = tuple(float(a.get(k, 0)) for k in ("xmin", "ymin", "xmax", "ymax"))
        elif kind == "text" and box:
            words.append((*box, html.unescape(name)))
            box = None
    return (*size, words) if size else None


# Tables of many books' files: (book, path, content) rows in, typed rows out.

CONTAINER = "META-INF/container.xml"


def _rows(df: DataFrame, keys: list[str], columns: list[str], fn, schema: str) -> DataFrame:
    """Rows (keys, *fn(columns of a row)) under a schema of what fn gives."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = [(*r[: len(keys)], *x) for r in b[[*keys, *columns]].itertuples(index=False, name=None) for x in fn(*r[len(keys) :])]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, *columns).mapInPandas(run, f"{kinds}, {schema}")


def packages(files: DataFrame, book: str) -> DataFrame:
    """(book, kind, position, href): the spine's documents in reading order, and where the tables of contents (nav, ncx) are.

    A book without a container, or whose container names no file of it, has no rows.
    """
    named = _rows(files.where(F.col("path") == CONTAINER).where("content is not null"), [book], ["content"], lambda x: [(package_path(x),)], "path string")
    found = files.join(named.where("path is not null"), [book, "path"]).where("content is not null")

    def parts(opf: str, path: str):
        p = package(opf, path)
        yield from (("spine", i, href) for i, href in enumerate(p["spine"]))
        yield from ((kind, 0, p[kind]) for kind in ("nav", "ncx") if p[kind])

    return _rows(found, [book], ["content", "path"], parts, "kind string, position int, href string")


def spine_documents(files: DataFrame, parts: DataFrame, book: str) -> DataFrame:
    """(book, page, href, html) of the documents of the spine; page counts from 1, and those that are missing keep theirs."""
    spine = parts.where("kind = 'spine'").select(book, (F.col("position") + 1).alias("page"), "href")
    return spine.join(files.select(book, F.col("path").alias("href"), F.col("content").alias("html")), [book, "href"]).select(book, "page", "href", "html")


def contents_table(files: DataFrame, parts: DataFrame, book: str) -> DataFrame:
    """(book, source, seq, title, level, href, fragment) of each book's table of contents: the navigation document's, unless it gives nothing."""
    listed = parts.where("kind in ('nav', 'ncx')").select(book, "kind", F.col("href").alias("path"))
    rows = listed.join(files, [book, "path"]).where("content is not null")

    def entries(kind: str, markup: str, path: str):
        found = nav_entries(markup, path) if kind == "nav" else ncx_entries(markup, path)
        return [(kind, i, *e) for i, e in enumerate(found)]

    every = _rows(rows, [book], ["kind", "content", "path"], entries, "kind string, seq int, title string, level int, href string, fragment string")
    first = F.min(F.when(F.col("kind") == "nav", 0).otherwise(1)).over(Window.partitionBy(book))
    return every.withColumn("_first", first).where(F.col("_first") == F.when(F.col("kind") == "nav", 0).otherwise(1)).drop("_first").withColumnRenamed("kind", "source")


def outline_entries(df: DataFrame, book: str, xml: str) -> DataFrame:
    """(book, seq, title, page, level) of the outlines that converters print."""
    return _rows(df.where(F.col(xml).isNotNull()), [book], [xml], lambda x: [(i, *e) for i, e in enumerate(outline(x))], "seq int, title string, page int, level int")


def word_table(pages: DataFrame, keys: list[str], markup: str) -> DataFrame:
    """(keys, seq, width, height, x0, y0, x1, y1, text): the words of a page with their boxes."""

    def words(x: str):
        if found := page_words(x):
            yield from ((i, *found[:2], *w) for i, w in enumerate(found[2]))

    return _rows(pages.where(F.col(markup).isNotNull()), keys, [markup], words, "seq int, width double, height double, x0 double, y0 double, x1 double, y1 double, text string")
