"""Queries over what changes: an index kept up by commits and by a stream, phrases, section trees, figures, versioned records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import evaluation, figures, phrases, sections
from lectern.sources import books
from lectern.streaming import pipelines

from .retrieval import QUERY_TERMS
from .tables import scratch_folder, table

_kept: dict[tuple[str, str], phrases.Index] = {}


def incremental(spark, sf_dir) -> phrases.Index:
    """An index of ``documents`` that was built from part of them, some with older texts and some books that are gone, and then brought up to date.

    Built once per session and folder; a folder that was removed is built again.
    """
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _kept or not _kept[at].table.numbers():
        docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
        index = phrases.Index(spark, scratch_folder(spark, "segments"), "doc_id", "doc_id")
        older = docs.where("doc_id % 3 <> 0").withColumn("body", F.when(F.col("doc_id") % 5 == 0, F.concat_ws(" ", F.lit("the older and the"), F.reverse("body"))).otherwise(F.col("body")))
        gone = docs.where("doc_id % 7 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), "body")
        index.commit(older.unionByName(gone))
        index.commit(docs.where("doc_id % 3 = 0"))
        index.commit(docs.where("doc_id % 3 <> 0 and doc_id % 5 = 0"), gone.select("doc_id"))
        index.table.merge(fanout=2)
        _kept[at] = index
    return _kept[at]


def incremental_bm25(spark, sf_dir):
    """Scores by the index that was brought up to date; the SQL scores the documents as they are."""
    scored = incremental(spark, sf_dir).scores(QUERY_TERMS)
    return scored.select("doc_id", F.round("score", 8).alias("score"))


def incremental_totals(spark, sf_dir):
    """Units and tokens that the commits have added up, and live postings."""
    index = incremental(spark, sf_dir)
    at = index.table.snapshot()
    live = index.postings(at).agg(F.count("*").alias("postings"), F.sum("tf").alias("occurrences"))
    return live.select(F.lit(at.facts["units"]).cast("long").alias("units"), F.lit(at.facts["tokens"]).cast("long").alias("tokens"), "postings", "occurrences")


ALL_OF, ANY_OF, NONE_OF = ("the of",), ("and the", "is th*"), ("for the",)


def phrase_search(spark, sf_dir):
    """Documents that hold one phrase, one of two others (a word of one goes on), and not a fourth, by BM25."""
    of = lambda texts: [phrases.Phrase.of(t) for t in texts]
    found = incremental(spark, sf_dir).search(of(ALL_OF), of(ANY_OF), of(NONE_OF))
    return found.select("doc_id", F.round("score", 8).alias("score"))


def phrase_places(spark, sf_dir):
    """Where a phrase that repeats a word stands, in all documents."""
    index = incremental(spark, sf_dir)
    return phrases.hits(index.postings(), "doc_id", [phrases.Phrase.of("the the and")]).select("doc_id", F.col("tf").alias("n"), F.array_join("starts", ",").alias("starts"))


def stream_index(spark, sf_dir):
    """Documents as a stream of book versions, what is there at once as one batch, into an index; each language's share of postings."""
    folder = scratch_folder(spark, "stream")
    books = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), F.lit(2).cast("long").alias("last_modified"))
    older = books.select("doc_id", F.lit("an older text").alias("body"), F.lit(1).cast("long").alias("last_modified"))
    older.where("doc_id % 2 = 0").unionByName(books.where("doc_id % 2 = 1")).write.mode("append").parquet(f"{folder}/in")
    index = phrases.Index(spark, f"{folder}/index", "doc_id", "doc_id")

    def run():
        stream = spark.readStream.schema(books.schema).parquet(f"{folder}/in")
        pipelines.indexed(stream, index, f"{folder}/checkpoint").awaitTermination()

    run()
    # What comes late and older than what is indexed changes nothing.
    older.where("doc_id % 2 = 1").unionByName(books.where("doc_id % 2 = 0")).write.mode("append").parquet(f"{folder}/in")
    run()
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    sums = ("postings", "occurrences", "last_places")
    # A document's sums come first, so no posting is shuffled.
    own = index.postings().groupBy("doc_id").agg(*(x.alias(n) for x, n in zip((F.count("*"), F.sum("tf"), F.sum(F.element_at("positions", -1).cast("long"))), sums)))
    return own.join(docs, "doc_id").groupBy("lang").agg(*(F.sum(n).alias(n) for n in sums))


def _conversation_texts(spark, sf_dir) -> DataFrame:
    """Turns with their place in the conversation's text, one line break behind each."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", (F.length("text") + 1).alias("n"))
    end = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return c.withColumn("char_end", end.cast("int")).withColumn("char_start", (F.col("char_end") - F.col("n")).cast("int"))


def section_tree(spark, sf_dir):
    """Turns as entries of up to four levels, some out of order or at one place, ordered, nested, and with the kind of most of their characters."""
    turns = _conversation_texts(spark, sf_dir)
    level = F.col("turn") % 4 + 1
    start = F.when(F.col("turn") % 5 == 3, F.greatest(F.col("char_start") - 700, F.lit(0))).when(F.col("turn") % 7 == 6, F.lag("char_start").over(Window.partitionBy("conv_id").orderBy("turn"))).otherwise(F.col("char_start"))
    title = F.when(F.col("turn") % 11 == 10, F.lit(" \t")).otherwise(F.concat(F.lit("## "), "role", F.lit("  "), "turn"))
    entries = turns.select("conv_id", F.col("turn").cast("int").alias("seq"), title.alias("title"), level.cast("int").alias("level"), start.cast("int").alias("char_start"))
    total = turns.groupBy("conv_id").agg(F.max("char_end").alias("total"))
    tree = sections.nested(sections.ordered(entries, "conv_id").join(total, "conv_id"), "conv_id", "total")
    kind = F.when(F.col("role") == "user", "front").when(F.col("turn") % 3 == 0, "back_other")
    units = turns.select("conv_id", "char_start", "char_end", kind.alias("matter_kind"))
    return sections.kinds_of(tree, units, "conv_id").select("conv_id", "position", "title", "level", "char_start", "char_end", "parent", "matter_kind")


def figure_match(spark, sf_dir):
    """Captions as lines of conversations, labels that repeat, and an inventory of them in which some captions are cut, changed or missing."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.btrim(F.regexp_replace(F.substring("text", 1, 90), r"(?U)\s+", " ")).alias("t"))
    label = F.concat(F.lit("1"), F.when(F.col("turn") % 2 == 0, "-").otherwise("."), (F.col("turn") % 4).cast("string"))
    line = F.concat(F.lit("Figure "), label, F.when(F.col("turn") % 2 == 0, ". ").otherwise(": "), "t", F.lit(" "))
    texts = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "\n\n").alias("text"))
    caption = F.when(F.col("turn") % 6 == 5, "another caption by far").when(F.col("turn") % 6 == 4, F.lit(None).cast("string")).when(F.col("turn") % 6 == 2, F.substring("t", 1, 12)).otherwise(F.col("t"))
    entries = turns.where("turn % 9 <> 8").select("conv_id", F.col("turn").cast("int").alias("entry"), F.concat(F.lit("1."), (F.col("turn") % 4).cast("string")).alias("label"), caption.alias("caption"), F.lit(1).alias("page"))
    lines = figures.caption_lines(texts, "conv_id", "text", markdown=False)
    return figures.in_order(figures.candidates(entries, lines, "conv_id"), "conv_id").select("conv_id", "entry", "line")


def pictures(spark, sf_dir):
    """Turns as markup documents, each a picture and a block of text that may be its caption."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    safe = F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", " ")
    tag = F.when(F.col("turn") % 2 == 0, "p").otherwise("figcaption")
    image = F.when(F.col("turn") % 3 == 2, '<svg width="5"><image xlink:href="../i/a.svg"/></svg>').otherwise(F.concat(F.lit('<img src="../i/'), "turn", F.lit('.png" width="20" height="30">')))
    html = F.concat(F.lit("<div>"), image, F.lit("<"), tag, F.lit("><b>Figure 2."), (F.col("turn") + 1).cast("string"), F.lit("</b>: "), safe, F.lit("</"), tag, F.lit("></div>"))
    docs = turns.select("conv_id", (F.col("turn") + 1).cast("int").alias("page"), F.lit("text/part.html").alias("href"), html.alias("html"))
    return figures.pictures(docs, "conv_id").select("conv_id", "page", "file", "source", "width", "height", "label", "caption")


FIGURE_TERMS = ("la", "of", "de", "user")


def _scored_figures(spark, sf_dir) -> DataFrame:
    """Captioned pictures of conversations as units; the roles of a conversation's turns name its book."""
    found = pictures(spark, sf_dir).select("conv_id", F.col("page").alias("index"), "caption")
    meta = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("role")), " ").alias("title")).withColumn("lang", F.lit(None).cast("string"))
    return figures.units(found, "conv_id", meta)


def figure_search(spark, sf_dir):
    """The 25 best figures for some words, by their captions and, for half, their books; and where the labels of a judge are among them."""
    units = _scored_figures(spark, sf_dir)
    best = figures.search(units, list(FIGURE_TERMS), 25, {"caption": 1.0, "book_meta": 0.5})
    hits = best.join(units.select("figure", F.col("conv_id").alias("book_id"), "index"), "figure").withColumn("qid", F.lit(1))
    labels = hits.where("rank % 4 = 0").select("qid", "book_id", "index").union(hits.where("rank = 1").select("qid", "book_id", (F.col("index") + 1000).alias("index")))
    labels = labels.withColumn("label_id", F.concat_ws("-", "book_id", "index"))
    judged = evaluation.figures_matched(hits, labels).select("label_id", F.col("rank").alias("label_rank"))
    named = hits.withColumn("label_id", F.concat_ws("-", "book_id", "index"))
    return named.join(judged, "label_id", "full_outer").select("label_id", F.round("score", 8).alias("score"), "rank", "label_rank")


def layout_captions(spark, sf_dir):
    """Parts as pages: a label whose caption stands beside it, below it as a narrow column, or at two labels in two ways."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 4).alias("shape"), F.initcap(F.regexp_replace("p_name", "[^a-z ]", "x")).alias("name"))
    box = lambda seq, block, x0, y0, x1, text: F.struct(*(F.lit(v).cast(t).alias(n) for n, v, t in (("seq", seq, "int"), ("block", block, "int"), ("x0", x0, "double"), ("y0", y0, "double"), ("x1", x1, "double"), ("y1", y0 + 10, "double"))), (text if not isinstance(text, str) else F.lit(text)).alias("text"))
    word = lambda i: F.get(F.split("name", " "), F.lit(i))
    noise = box(0, 0, 300, 5, 420, "Broker")
    beside = F.array(noise, box(1, 1, 50, 100, 100, "Figure 1.5"), box(2, 2, 112, 100, 300, F.concat_ws(" ", word(0), word(1))), box(3, 2, 112, 111, 290, F.concat(F.lit("and "), F.coalesce(word(2), F.lit("more")))), box(4, 3, 50, 300, 300, "Prose goes on."))
    below = F.array(noise, box(1, 1, 50, 100, 100, "Figure 1.5"), box(2, 1, 50, 111, 120, word(0)), box(3, 1, 50, 122, 118, F.coalesce(word(1), F.lit("more"))), box(4, 2, 50, 133, 110, "Next block"))
    twice = F.array(box(0, 0, 50, 50, 100, "Figure 1.5"), box(1, 1, 110, 50, 300, F.concat_ws(" ", F.lit("One"), word(0))), box(2, 2, 50, 100, 100, "Figure 1-5"), box(3, 3, 110, 100, 300, F.concat_ws(" ", F.lit("Other"), word(0))))
    none = F.array(noise, box(1, 1, 50, 100, 100, "Figure 1.5"), box(2, 2, 50, 200, 300, word(0)))
    lines = p.select("p_partkey", F.explode(F.when(F.col("shape") == 0, beside).when(F.col("shape") == 1, below).when(F.col("shape") == 2, twice).otherwise(none)).alias("l")).select("p_partkey", "l.*")
    return figures.recovered(p.select("p_partkey", F.lit("1.5").alias("label")), lines, ["p_partkey"]).select("p_partkey", "caption")


def _book_files(spark, sf_dir) -> DataFrame:
    """Conversations as the files of a book: container, package, a document for each turn, and a table of contents in the newer form, the older, or both.

    Every odd turn's entry stands below the one before and has a fragment; of every seventh conversation the newer table is empty.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    id_ = F.concat(F.lit("t"), F.col("turn").cast("string"))
    href = F.concat(id_, F.lit(".xhtml"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("#f"), "turn")).otherwise(""))
    title = F.concat_ws(" ", "role", "turn")
    link = F.concat(F.lit('<li><a href="../text/'), href, F.lit('">'), title, F.lit(" </a></li>"))
    nav = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("<ol>"), link, F.lit("</ol>"))).otherwise(link)
    point = F.concat(F.lit("<navPoint><navLabel><text>"), title, F.lit('</text></navLabel><content src="text/'), href, F.lit('"/></navPoint>'))
    ncx = F.when(F.col("turn") % 2 == 1, F.concat(F.lit('<navPoint><navLabel><text> </text></navLabel>'), point, F.lit("</navPoint>"))).otherwise(point)
    item, ref = F.concat(F.lit('<item id="'), id_, F.lit('" href="text/'), id_, F.lit('.xhtml" media-type="x"/>')), F.concat(F.lit('<itemref idref="'), id_, F.lit('"/>'))
    made = F.struct("turn", nav.alias("nav"), ncx.alias("ncx"), item.alias("item"), ref.alias("ref"))
    whole = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(made)).alias("t"))
    joined = lambda name: F.array_join(F.transform("t", lambda x: x[name]), "")
    has_nav = F.col("conv_id") % 3 > 0
    nav_item = F.when(has_nav, '<item id="n" href="nav/nav.xhtml" properties="scripted nav"/>').otherwise("")
    opf = F.concat(F.lit("<package><manifest>"), joined("item"), nav_item, F.lit('<item id="x" href="toc.ncx"/></manifest><spine toc="x">'), joined("ref"), F.lit('<itemref idref="gone"/></spine></package>'))
    nav_page = F.concat(F.lit('<nav epub:type="landmarks"><ol><li><a href="../text/t0.xhtml">Start</a></li></ol></nav><nav epub:type="toc"><ol>'), F.when(F.col("conv_id") % 7 == 0, "").otherwise(joined("nav")), F.lit("</ol></nav>"))
    file = lambda path, content: F.struct(F.lit(path).alias("path"), content.alias("content"))
    listed = whole.select("conv_id", F.explode(F.array(file("META-INF/container.xml", F.lit('<container><rootfile full-path="OEBPS/book.opf"/></container>')), file("OEBPS/book.opf", opf), file("OEBPS/nav/nav.xhtml", nav_page), file("OEBPS/toc.ncx", F.concat(F.lit("<ncx><navMap>"), joined("ncx"), F.lit("</navMap></ncx>"))))).alias("f")).select("conv_id", "f.path", "f.content")
    safe = F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", " ")
    pages = c.select("conv_id", F.concat(F.lit("OEBPS/text/t"), "turn", F.lit(".xhtml")).alias("path"), F.concat(F.lit("<html><body><p>"), safe, F.lit("</p></body></html>")).alias("content"))
    return listed.unionByName(pages)


def book_contents(spark, sf_dir):
    """Tables of contents of the files of books, each entry with the place of its document in the spine and the length of that document."""
    files = _book_files(spark, sf_dir)
    parts = books.packages(files, "conv_id")
    spine = books.spine_documents(files, parts, "conv_id").select("conv_id", "href", "page", F.length("html").alias("n"))
    return books.contents_table(files, parts, "conv_id").join(spine, ["conv_id", "href"], "left").select("conv_id", "source", "seq", "title", "level", "href", "fragment", "page", "n")


QUERIES = {f.__name__: f for f in (incremental_bm25, incremental_totals, phrase_search, phrase_places, stream_index, section_tree, figure_match, pictures, layout_captions, book_contents, figure_search)}

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_+#.\-]+')"
_DOCS = f"d AS MATERIALIZED (SELECT doc_id, lang, {_TOKENS} AS t FROM documents), tot AS (SELECT count(*) AS n, avg(len(t)) AS m FROM d)"
_TERM = "sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / m)))"


def _places(words: str) -> str:
    """Where a phrase stands in a list of tokens t; a star makes the last word a prefix."""
    parts = words.removesuffix("*").split(" ")
    tests = [f"t[i + {k}] = '{w}'" for k, w in enumerate(parts)]
    if words.endswith("*"):
        tests[-1] = f"starts_with(t[i + {len(parts) - 1}], '{parts[-1]}')"
    return f"list_filter(range(1, len(t) + 2 - {len(parts)}), lambda i: {' AND '.join(tests)})"


_PHRASES = " UNION ALL ".join(f"SELECT doc_id, '{p}' AS p, len({_places(p)}) AS f FROM d" for p in ALL_OF + ANY_OF + NONE_OF)
_IN = lambda ps: "(" + ", ".join(f"'{p}'" for p in ps) + ")"
_TURNS = "turns AS (SELECT conv_id, turn, role, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e, length(text) + 1 AS n FROM conversations)"

_PICTURES = r"""WITH t AS (SELECT conv_id, turn, 'Figure 2.' || (turn + 1) || ': ' || regexp_replace(coalesce(text, ''), '[<>&]', ' ', 'g') AS whole, regexp_replace(coalesce(text, ''), '[<>&]', ' ', 'g') AS x,
   length('<' || CASE WHEN turn % 2 = 0 THEN 'p' ELSE 'figcaption' END || '><b>Figure 2.' || (turn + 1) || '</b>: ') AS lead FROM conversations),
 s AS (SELECT *, 'Figure 2.' || (turn + 1) || ': ' || substr(x, 1, 2000 - lead) AS seen FROM t),
 n AS (SELECT *, trim(regexp_replace(seen, '\s+', ' ', 'g')) AS line FROM s)
 SELECT conv_id, CAST(turn + 1 AS INT) AS page, CASE WHEN turn % 3 = 2 THEN 'i/a.svg' ELSE 'i/' || turn || '.png' END AS file, CASE WHEN turn % 3 = 2 THEN 'svg-render' ELSE 'raster' END AS source,
  CASE WHEN turn % 3 < 2 THEN 20 END AS width, CASE WHEN turn % 3 < 2 THEN 30 END AS height, CASE WHEN length(line) <= 300 THEN '2.' || (turn + 1) END AS label,
  CASE WHEN length(line) <= 300 THEN trim(substr(line, length('Figure 2.' || (turn + 1) || ':') + 1)) END AS caption FROM n"""

ORACLE_SQL = {
    "incremental_bm25": f"""WITH {_DOCS}, w AS (SELECT doc_id, unnest(t) AS term FROM d), p AS (SELECT doc_id, term, count(*) AS f FROM w WHERE term IN ('tion', 'the', 'and', 'hand', 'thing') GROUP BY ALL),
 q AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM p) SELECT doc_id, round(-{_TERM}, 8) AS score FROM q JOIN d USING (doc_id), tot GROUP BY doc_id""",
    "incremental_totals": f"WITH {_DOCS} SELECT count(*) AS units, CAST(sum(len(t)) AS BIGINT) AS tokens, CAST(sum(len(list_distinct(t))) AS BIGINT) AS postings, CAST(sum(len(t)) AS BIGINT) AS occurrences FROM d",
    "phrase_search": f"""WITH {_DOCS}, h AS (SELECT * FROM ({_PHRASES}) WHERE f > 0), q AS (SELECT *, count(*) OVER (PARTITION BY p) AS df FROM h WHERE p NOT IN {_IN(NONE_OF)})
 SELECT doc_id, round(-{_TERM}, 8) AS score FROM q JOIN d USING (doc_id), tot WHERE doc_id IN (SELECT doc_id FROM h WHERE p IN {_IN(ALL_OF)}) AND doc_id IN (SELECT doc_id FROM h WHERE p IN {_IN(ANY_OF)}) AND doc_id NOT IN (SELECT doc_id FROM h WHERE p IN {_IN(NONE_OF)}) GROUP BY doc_id""",
    "phrase_places": f"WITH {_DOCS}, s AS (SELECT doc_id, list_transform({_places('the the and')}, lambda i: i - 1) AS s FROM d) SELECT doc_id, len(s) AS n, array_to_string(s, ',') AS starts FROM s WHERE len(s) > 0",
    "stream_index": f"""WITH {_DOCS}, w AS (SELECT doc_id, lang, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS i FROM d), p AS (SELECT doc_id, lang, term, count(*) AS f, max(i) AS l FROM w GROUP BY ALL)
 SELECT lang, count(*) AS postings, CAST(sum(f) AS BIGINT) AS occurrences, CAST(sum(l) AS BIGINT) AS last_places FROM p GROUP BY lang""",
    "section_tree": f"""WITH {_TURNS}, raw AS (SELECT conv_id, turn, CASE WHEN turn % 11 = 10 THEN '' ELSE role || ' ' || turn END AS title, turn % 4 + 1 AS level,
   CASE WHEN turn % 5 = 3 THEN greatest(e - n - 700, 0) WHEN turn % 7 = 6 THEN lag(e - n) OVER (PARTITION BY conv_id ORDER BY turn) ELSE e - n END AS s FROM turns),
 named AS (SELECT * FROM raw WHERE title <> ''),
 kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM named a WHERE NOT EXISTS (SELECT 1 FROM named b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND (b.s > a.s OR b.s = a.s AND b.level >= a.level))),
 ends AS (SELECT a.conv_id, a.position, coalesce(min(b.s), (SELECT max(e) FROM turns t WHERE t.conv_id = a.conv_id)) AS z FROM kept a LEFT JOIN kept b ON b.conv_id = a.conv_id AND b.position > a.position AND b.level <= a.level GROUP BY 1, 2),
 ups AS (SELECT a.conv_id, a.position, max(b.position) AS parent FROM kept a LEFT JOIN kept b ON b.conv_id = a.conv_id AND b.position < a.position AND b.level < a.level GROUP BY 1, 2),
 cover AS (SELECT k.conv_id, k.position, CASE WHEN t.role = 'user' THEN 'front' WHEN t.turn % 3 = 0 THEN 'back_other' ELSE 'body' END AS kind, sum(least(t.e, x.z) - greatest(t.e - t.n, k.s)) AS c
   FROM kept k JOIN ends x USING (conv_id, position) JOIN turns t ON t.conv_id = k.conv_id AND t.e - t.n < x.z AND t.e > k.s GROUP BY ALL),
 best AS (SELECT conv_id, position, kind FROM cover WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, position ORDER BY c DESC, CASE kind WHEN 'body' THEN 0 WHEN 'front' THEN 1 ELSE 2 END) = 1)
 SELECT conv_id, CAST(position AS INT) AS position, title, CAST(level AS INT) AS level, CAST(s AS INT) AS char_start, CAST(z AS INT) AS char_end, CAST(parent AS INT) AS parent, coalesce(kind, 'body') AS matter_kind
 FROM kept JOIN ends USING (conv_id, position) JOIN ups USING (conv_id, position) LEFT JOIN best USING (conv_id, position)""",
    "figure_match": r"""WITH RECURSIVE t AS (SELECT conv_id, turn, trim(regexp_replace(substr(text, 1, 90), '\s+', ' ', 'g')) AS t FROM conversations),
 c AS (SELECT conv_id, turn, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line, lower(regexp_replace(t, '[\s\\-]+', '', 'g')) AS own, turn % 4 AS label FROM t),
 e AS (SELECT conv_id, turn, turn % 4 AS label, lower(regexp_replace(CASE turn % 6 WHEN 5 THEN 'another caption by far' WHEN 4 THEN '' WHEN 2 THEN substr(t, 1, 12) ELSE t END, '[\s\\-]+', '', 'g')) AS cap,
   lower(regexp_replace(substr(CASE turn % 6 WHEN 5 THEN 'another caption by far' WHEN 4 THEN '' WHEN 2 THEN trim(substr(t, 1, 12)) ELSE t END, 1, 30), '[\s\\-]+', '', 'g')) AS head,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t WHERE turn % 9 <> 8),
 pairs AS (SELECT e.conv_id, e.k, e.turn AS entry, c.line FROM e JOIN c ON c.conv_id = e.conv_id AND c.label = e.label
   WHERE e.head = '' OR contains(c.own, e.head) OR (length(c.own) >= 12 AND starts_with(e.cap, c.own)) OR (c.own <> '' AND length(c.own) >= 12 AND length(e.cap) >= 12 AND (starts_with(e.cap, c.own) OR starts_with(c.own, e.cap)))),
 walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS cursor, CAST(NULL AS BIGINT) AS line FROM (SELECT DISTINCT conv_id FROM e)
   UNION ALL SELECT w.conv_id, w.k + 1, coalesce(m.line + 1, w.cursor), m.line FROM walk w JOIN e ON e.conv_id = w.conv_id AND e.k = w.k + 1
   LEFT JOIN LATERAL (SELECT min(p.line) AS line FROM pairs p WHERE p.conv_id = w.conv_id AND p.k = w.k + 1 AND p.line >= w.cursor) m ON true)
 SELECT w.conv_id, CAST(e.turn AS INT) AS entry, CAST(w.line AS INT) AS line FROM walk w JOIN e USING (conv_id, k) WHERE w.line IS NOT NULL""",
    "pictures": _PICTURES,
    "layout_captions": """WITH p AS (SELECT p_partkey, p_partkey % 4 AS shape, list_transform(string_split(regexp_replace(p_name, '[^a-z ]', 'x', 'g'), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)) AS w FROM part)
 SELECT p_partkey, CASE shape WHEN 0 THEN w[1] || coalesce(' ' || w[2], '') || ' and ' || coalesce(w[3], 'more') WHEN 1 THEN w[1] || ' ' || coalesce(w[2], 'more') END AS caption FROM p""",
    "book_contents": """WITH s AS (SELECT conv_id, conv_id % 3 > 0 AND conv_id % 7 <> 0 AS nav FROM conversations GROUP BY conv_id),
 c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)
 SELECT conv_id, CASE WHEN nav THEN 'nav' ELSE 'ncx' END AS source, CAST(k AS INT) AS seq, role || ' ' || turn AS title, CAST(CASE WHEN turn % 2 = 1 THEN 2 ELSE 1 END AS INT) AS level, 'OEBPS/text/t' || turn || '.xhtml' AS href,
  CASE WHEN turn % 2 = 1 THEN 'f' || turn ELSE '' END AS fragment, CAST(k + 1 AS INT) AS page, CAST(length(coalesce(text, '')) + 33 AS INT) AS n FROM c JOIN s USING (conv_id)""",
    "figure_search": f"""WITH pics AS ({_PICTURES}), roles AS (SELECT conv_id, string_agg(DISTINCT role, ' ' ORDER BY role) AS title FROM conversations GROUP BY 1),
 u AS (SELECT conv_id, page, {_TOKENS.replace('text', 'caption')} AS c, {_TOKENS.replace('text', 'title')} AS m FROM pics JOIN roles USING (conv_id) WHERE coalesce(caption, '') <> ''),
 tot AS (SELECT count(*) AS n, avg(len(c) + len(m)) AS m FROM u), w AS (SELECT conv_id, page, unnest(c) AS term, 1.0::DOUBLE AS x FROM u UNION ALL SELECT conv_id, page, unnest(m), 0.5 FROM u),
 p AS (SELECT conv_id, page, term, sum(x) AS f FROM w WHERE term IN {FIGURE_TERMS} GROUP BY ALL), q AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM p),
 s AS (SELECT conv_id, page, -{_TERM.replace('len(t) / m', '(len(c) + len(u.m)) / tot.m')} AS score FROM q JOIN u USING (conv_id, page), tot GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9), conv_id || ':' || page) AS rank FROM s QUALIFY rank <= 25)
 SELECT conv_id || '-' || page AS label_id, round(score, 8) AS score, CAST(rank AS INT) AS rank, CAST(CASE WHEN rank % 4 = 0 THEN rank END AS INT) AS label_rank FROM r
 UNION ALL SELECT conv_id || '-' || (page + 1000), NULL, NULL, NULL FROM r WHERE rank = 1""",
}
