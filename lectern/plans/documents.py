"""Queries of the document operators over whole texts of ``documents``, ``pages`` and ``conversations``.

Rules that go through a text in order have no SQL form; their queries return what must hold of the result for
every text, computed from it, beside what SQL can count in the text itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import isbn as isbns
from lectern.functions import text as tx
from lectern.functions import titles
from lectern.operators import audits, etl, index, languages, matter, outlines, spans, stemming, structure
from lectern.operators import snippets as snippet_windows
from lectern.sources import readers

from .tables import spread, table

WHITE = r"[\x20\x09-\x0D]"


def _books(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), "text")


def _spoken(spark, sf_dir) -> DataFrame:
    """(conv_id, text): a conversation as a Markdown text with a heading for each turn."""
    c = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## "), F.coalesce("role", F.lit("nobody")), F.lit(" "), F.col("turn").cast("string"), F.lit("\n> "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), F.lit("\n"))
    turns = c.select("conv_id", "turn", part.alias("part"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "").alias("text"))


def chunk_spans(spark, sf_dir):
    """Of each text with a word: characters in chunks but for white space, whether all fit the budget, stand in order and are what their spans hold."""
    chunks = etl.chunked(_books(spark, sf_dir), "book_id", "text")
    plain = F.length(F.regexp_replace("body", WHITE, ""))
    facts = (F.length("body") <= etl.CHUNK_CHARS) & (F.col("char_end") - F.col("char_start") == F.length("body"))
    return chunks.groupBy("book_id").agg(F.sum(plain).alias("chars"), F.bool_and(facts).alias("fit"), (F.count_distinct("seq") == F.max("seq") + 1).alias("numbered"))


def token_chunks(spark, sf_dir):
    """Chunks by words instead of characters: budgets are kept, whatever the words' length."""
    budget = 60

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for k, t in zip(b["book_id"], b["text"]):
                found = list(etl.chunks(t or "", budget, lambda s: len(s.split())))
                rows.append((k, sum(len(t[a:e].split()) for a, e in found), all(len(t[a:e].split()) <= budget for a, e in found)))
            yield pd.DataFrame(rows, columns=["book_id", "words", "fit"])

    return _books(spark, sf_dir).mapInPandas(run, "book_id long, words long, fit boolean").where("words > 0").select("book_id", "fit")


def content_match(spark, sf_dir):
    """Chunks against their own texts, and for every fifth book against a text with one character more."""
    books = _books(spark, sf_dir)
    chunks = etl.chunked(books, "book_id", "text")
    now = books.withColumn("text", F.when(F.col("book_id") % 5 == 0, F.concat(F.lit("x"), "text")).otherwise(F.col("text")))
    return index.unchanged(chunks, now)


def text_covered(spark, sf_dir):
    chunks = etl.chunked(_books(spark, sf_dir), "book_id", "text")
    return index.covered(chunks).select("book_id", F.col("page_breaks").cast("long").alias("page_breaks"), (F.col("chars") <= F.col("last_end")).alias("inside"))


def normalise(spark, sf_dir):
    """Cleaned texts, and whether their edits lead from the length of the one to that of the other, in order."""
    books = _books(spark, sf_dir).withColumn("text", F.regexp_replace("text", "e e", "e\u00a0\u200be"))
    out = etl.normalised(books, "book_id", "text").join(books.select("book_id", F.length("text").alias("n")), "book_id")
    grown = F.aggregate("edits", F.lit(0), lambda a, e: a + (e["out_end"] - e["out_start"]) - (e["in_end"] - e["in_start"]))
    return out.select("book_id", "text", (F.length("text") == F.col("n") + grown).alias("mapped"))


def markup_rules(spark, sf_dir):
    """Texts with emphasis, escapes, code spans and trailing blanks put in, and taken out again."""
    words = F.regexp_replace("p_name", r"[^a-z ]", "")
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select(F.col("p_partkey").alias("book_id"), F.concat(F.lit("**"), words, F.lit("** and *"), words, F.lit("*, `"), words, F.lit("` 1\\_2  \n\n\n\nend of "), words).alias("text"))
    return etl.normalised(p, "book_id", "text", etl.without_markup).select("book_id", "text")


def offset_map(spark, sf_dir):
    """Whether an encoded map decodes to the edits it came from."""
    books = _books(spark, sf_dir).where("text is not null").withColumn("text", F.regexp_replace("text", "e", "e\u200b"))
    out = etl.normalised(books, "book_id", "text").withColumn("map", spans.encode_offset_map("edits"))
    return out.select("book_id", (spans.decode_offset_map("map") == F.col("edits")).alias("same"), F.size("edits").cast("long").alias("n_edits"))


def page_texts(spark, sf_dir):
    return structure.page_table(_books(spark, sf_dir).withColumn("text", F.translate("text", "\n", "\f")), "book_id", "text")


def chapters(spark, sf_dir):
    return structure.chapter_table(_spoken(spark, sf_dir), "conv_id", "text")


def chapter_numbers(spark, sf_dir):
    """Numbered headings in five forms, and sentences that only look like them."""
    n = F.col("p_partkey") % 90 + 1
    forms = F.array(F.concat(F.lit("Chapter "), n.cast("string"), F.lit(": Things")), F.concat(F.lit("Глава "), n.cast("string"), F.lit(" рассматривает")), F.concat(F.lit("第"), n.cast("string"), F.lit("章")), F.concat(F.lit("Chapter "), n.cast("string"), F.lit(" explores what we saw")), F.concat(F.lit("Kapitel "), n.cast("string")))
    p = table(spark, sf_dir, "part").select("p_partkey", F.get(forms, (F.col("p_partkey") % 5).cast("int")).alias("line"))

    @F.pandas_udf("int")
    def number(lines):
        return lines.map(structure.chapter_number).astype("Int32")

    return p.select("p_partkey", number("line").alias("number"))


def matter_kinds(spark, sf_dir):
    """Passages made of each text by nine recipes: its words as index entries, as citations, under a heading, in front, or the text as it is."""
    shape = F.col("doc_id") % 9
    words = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\p{L}+)"), 1), 1, 40)
    entries = F.array_join(F.transform(words, lambda w, i: F.concat(w, F.lit(", "), (i + 1).cast("string"))), "\n")
    cited = F.array_join(F.transform(F.slice(words, 1, 12), lambda w: F.concat(w, F.lit(" (1999) by"))), "\n")
    few = F.array_join(F.slice(words, 1, 2), "\n")
    body = F.when(shape == 1, entries).when(shape.isin(2, 4), cited).when(shape == 3, F.concat(F.lit("References\n"), cited)).when(shape.isin(5, 6), few).when(shape == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\nAll rights reserved."))).otherwise(F.coalesce("text", F.lit("")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), body.alias("body"), F.when(shape == 0, 0.02).when(shape.isin(1, 2, 6), 0.95).otherwise(0.5).alias("position"), (shape == 5).alias("front"), F.when(shape == 6, "Index").alias("heading"))
    told = matter.with_kind(docs.withColumn("above", titles.matter_titles("heading")), "body", F.col("position"), F.col("front"), "above")
    return told.select("book_id", F.col("matter_kind").alias("kind"), "strong")


def captions(spark, sf_dir):
    """Pages with one captioned figure, one label by itself, and a sentence that refers to a figure."""
    k = F.col("p_partkey")
    page = F.concat(F.lit("Text.\n\nFigure "), (k % 50).cast("string"), F.lit(". The "), F.col("p_name"), F.lit(" of\nsome sort.\n\nFigure "), (k % 50 + 60).cast("string"), F.lit("\n\nas it is shown in the long line of this text, see\nFigure 7. It goes on."))
    p = table(spark, sf_dir, "part").select("p_partkey", page.alias("text"))
    return structure.caption_table(p, ["p_partkey"], "text").select("p_partkey", "label", "caption")


def isbn_extract(spark, sf_dir):
    """ISBNs in texts that name one, one in an advertisement, and numbers that are none."""
    stem = F.concat(F.lit("978"), F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0"))
    digit = F.expr("cast(pmod(10 - pmod(aggregate(transform(sequence(1, 12), i -> cast(substring(stem, i, 1) as int) * if(i % 2 = 1, 1, 3)), 0, (a, v) -> a + v), 10), 10) as string)")
    p = table(spark, sf_dir, "part").select("p_partkey", stem.alias("stem")).withColumn("isbn", F.concat("stem", digit))
    text = F.concat(F.lit("Call 1234567890 now. ISBN-13: "), F.substring("isbn", 1, 3), F.lit("-"), F.substring("isbn", 4, 10), F.lit(".\nAlso: Other Book (218 pages) ISBN: 9780306406157 $45.95"))
    return p.select("p_partkey", F.array_join(isbns.extract_isbns(text), ",").alias("isbns"))


_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувщкызж"


def _scripts_of(text: str, lang: str):
    """German and Spanish texts in Cyrillic letters, the latter with і for i; of French ones the second half."""
    other = F.translate(F.translate(F.lower(text), _LATIN, _CYRILLIC), "и", "і")
    half = (F.length(text) / 2).cast("int")
    return F.when(F.col(lang) == "de", F.translate(F.lower(text), _LATIN, _CYRILLIC)).when(F.col(lang) == "es", other).when(F.col(lang) == "fr", F.concat(F.substring(F.col(text), F.lit(1), half), F.translate(F.lower(F.expr(f"substring({text}, cast(length({text}) / 2 as int) + 1)")), _LATIN, _CYRILLIC))).otherwise(F.col(text))


def language_ids(spark, sf_dir):
    """The language of every text, many of them written in Cyrillic letters, and of its first hundred characters."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), _scripts_of("text", "lang").alias("text"))
    docs = docs.withColumn("head", F.substring("text", 1, 100))
    return docs.select("book_id", etl.detected_language("text").alias("lang"), etl.detected_language("head").alias("head_lang"))


_FORMS = (("walking", "walk"), ("painted", "paint"), ("jumps", "jump"), ("relational", "relat"), ("happiness", "happi"), ("книги", "книг"), ("книгой", "книг"), ("работали", "работа"), ("важностью", "важност"), ("api_v2", "api_v2"), ("camelCase", "camelcase"), ("Ponies", "poni"))


def stem_counts(spark, sf_dir):
    """Stems of a text of word forms, in an order that differs from text to text, and as many stems as words in the texts themselves."""
    n = len(_FORMS)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), "text", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(F.array(*(F.lit(f) for f, _ in _FORMS)), (i * 5 + F.col("doc_id")) % n)).alias("forms"))
    out = docs.select("book_id", stemming.stems(F.array_join("forms", ", "), F.lit(None).cast("string")).alias("f"), stemming.stems("text", F.lit(None).cast("string")).alias("s"))
    return out.select("book_id", F.array_join("f", " ").alias("stems"), F.size("s").cast("long").alias("n"))


def snippets(spark, sf_dir):
    """Windows of 300 characters for a query: the text itself if it is short, else one that holds a query's word if the text has one."""
    cut = snippet_windows.snippet("text", "where does orre meet hehely, and when is inoran", 300)
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("book_id"), "text", cut.alias("w"))
    body = F.when(F.col("w.start") > 0, F.expr("substring(w.text, 2)")).otherwise(F.col("w.text"))
    word = r"(?i)(?<![\p{L}\p{N}_])(orre|hehely|inoran)(?![\p{L}\p{N}_])"
    same = F.expr("substring(text, w.start + 1, 300)") == body
    return docs.select("book_id", F.when(F.length("text") <= 300, F.length(body)).alias("n"), ((F.length(body) >= 200) | (F.length("text") <= 300)).alias("wide"), same.alias("inside"), F.when(F.col("text").rlike(word), body.rlike(r"(?i)(?<![\p{L}\p{N}_])(orr|hehe|inoran)")).alias("hit"))  # other forms of the words count


def html_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(tx.html_text("html")).alias("n"), (tx.html_text("html").rlike("<[a-z/]")).alias("tags"))


def cut_texts(spark, sf_dir):
    cut = tx.cut_at_word("text", 100)
    return _books(spark, sf_dir).select("book_id", (F.length(cut) <= 100).alias("short"), F.col("text").startswith(cut).alias("head"))


def embeddings_of(spark, sf_dir):
    """The built-in embedder's vectors: length one, and their codec's round trip."""
    v = etl.embedded("text")
    out = _books(spark, sf_dir).select("book_id", v.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return out.select("book_id", F.round(norm, 3).alias("norm"), (etl.decode_vector(etl.encode_vector("v")) == F.col("v")).alias("same"))


def file_titles(spark, sf_dir):
    """Titles in the shapes of files, slugs and real titles: which they are, and what to search for."""
    k = F.col("p_partkey")
    name = F.regexp_replace("p_name", "[^a-z]", "")
    forms = F.array(F.concat(name, F.lit("-deep-dive")), F.concat(F.lit("A Book of "), name), F.concat(name, F.lit(" guide.pdf")), F.concat(F.lit("[Press] The "), name), k.cast("string"), F.concat(name, F.lit(" title (1)")))
    p = table(spark, sf_dir, "part").select("p_partkey", F.get(forms, (k % 6).cast("int")).alias("title"))
    return p.select("p_partkey", titles.file_shaped("title", F.array().cast("array<string>")).alias("file"), titles.slug_words("title").alias("words"))


def author_names(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("Last"), k.cast("string"), F.lit(", First"))).when(k % 3 == 1, F.concat(F.lit("Ann Bee, Cee Dee"), k.cast("string"))).otherwise(F.concat(F.lit("Solo"), k.cast("string"), F.lit(";")))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.array(raw, F.lit("ann bee")).alias("a"))
    return c.select("c_custkey", F.array_join(titles.cleaned_authors("a"), "&").alias("names"), titles.authors_fault("a").alias("fault"))


def author_sorts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" Ann  B. "), F.regexp_replace("c_name", "[^A-Za-z]", ""), F.when(F.col("c_custkey") % 2 == 0, " Jr.").otherwise("")).alias("name"))
    return c.select("c_custkey", tx.author_sort("name").alias("sorted"))


def quote_budget(spark, sf_dir):
    """Texts with one quotation of their number's words."""
    k = (F.col("p_partkey") % 40).cast("int")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("So: \u201c"), F.repeat(F.lit("word "), k), F.lit("end\u201d and \u00abzwei Worte\u00bb.")).alias("text"))
    return audits.quote_budget(p, "p_partkey", "text")


def cursor_leak(spark, sf_dir):
    k = F.col("p_partkey")
    hidden = F.translate(F.regexp_replace(F.base64(F.encode(F.concat(F.lit('{"offset":'), k.cast("string"), F.lit(',"id":4,"format":"epub"}')), "utf-8")), "=", ""), "+/", "-_")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" "), F.when(k % 4 == 0, hidden).when(k % 4 == 1, "{{NEXT_CURSOR}}").when(k % 4 == 2, "abcdefghijklmnopqrstuvwxyz").otherwise("plain")).alias("text"))
    return p.select("p_partkey", audits.cursor_leak("text").alias("leak"))


def heading_mirror(spark, sf_dir):
    """Turns' roles and numbers as headings, against those of even turns."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.concat_ws(" ", "role", "turn").alias("h"), "turn")
    return audits.heading_mirror(c, c.where("turn % 2 = 0"), "conv_id", "h").select("conv_id", F.round("share", 6).alias("share"), "ok")


def outline_chapters(spark, sf_dir):
    """Books of twelve pages with five chapters in their outline, behind a cover and inside a part."""
    k = F.col("p_partkey").cast("string")
    pages = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("head\nChapter "), i.cast("string"), F.lit(" of "), k, F.lit("\nwords words"))), "\f")
    item = lambda i, t: F.concat(F.lit(f'<item page="{i}">'), t, F.lit("</item>"))
    inner = F.concat(*(item(i, F.concat(F.lit(f"Chapter {i} of "), k)) for i in (3, 5, 7, 9)))
    xml = F.concat(F.lit("<x><outline>"), item(1, F.lit("Cover")), item(2, F.lit("Part I &amp; more")), F.lit("<outline>"), inner, F.lit("</outline>"), item(11, F.lit("Elsewhere")), F.lit("</outline>"))
    p = spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", pages.alias("text"), xml.alias("xml"))
    return outlines.outline_table(p, "p_partkey", "text", "xml")


def note_lines(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("\t"), "p_name", F.when(k % 3 > 0, F.concat(F.lit("\t"), "p_type", F.lit("\tmore"))).otherwise("")).alias("value"))
    return readers.notes(p)


def image_lines(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 5 == 0, "page num type width").otherwise(F.concat_ws("   ", k, k, F.lit("image 640 480 rgb 3 8 jpeg no 12 0 300 150 33K 3.7%"))).alias("value"))
    return readers.image_listing(p)


_FUNCTIONS = (
    chunk_spans, token_chunks, content_match, text_covered, normalise, markup_rules, offset_map, page_texts, chapters, chapter_numbers, matter_kinds, captions, isbn_extract, language_ids, stem_counts, snippets,
    html_texts, cut_texts, embeddings_of, file_titles, author_names, author_sorts, quote_budget, cursor_leak, heading_mirror, outline_chapters, note_lines, image_lines,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_HAS_WORD = "regexp_matches(text, '[^\\x20\\x09-\\x0D]')"
_PARTS = """c AS (SELECT conv_id, turn, '## ' || coalesce(role, 'nobody') || ' ' || turn AS h, '## ' || coalesce(role, 'nobody') || ' ' || turn || chr(10) || '> ' || regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') || chr(10) AS p FROM conversations)"""
def _language_sql(text: str) -> str:
    """The rule for one column: scripts, then own letters, then function words; long texts by three windows."""
    few = f"CASE WHEN length({text}) <= 120000 THEN {text} ELSE " + " || ' ' || ".join(f"substr({text}, CAST(floor(length({text}) * {p} - 20000) AS BIGINT) + 1, 40000)" for p in (0.25, 0.5, 0.75)) + " END"
    count = lambda pattern: f"len(regexp_extract_all(few, '{pattern}'))"
    words = lambda x: f"len(list_filter(regexp_extract_all(lower(few), '\\p{{L}}+'), lambda w: replace(w, 'ё', 'е') IN ({', '.join(repr(w) for w in sorted(x.words))})))"
    ru, uk = (next(x for x in languages.LANGUAGES if x.id == i) for i in ("ru", "uk"))
    return f"""(SELECT CASE WHEN la = 0 AND cy = 0 THEN NULL WHEN la >= cy THEN 'en' WHEN ru > 0 AND ru >= 3 * uk THEN 'ru' WHEN uk > 0 AND uk >= 3 * ru THEN 'uk' WHEN wr >= wu THEN 'ru' ELSE 'uk' END
 FROM (SELECT {count("\\p{Latin}")} AS la, {count("\\p{Cyrillic}")} AS cy, len(regexp_extract_all(lower(few), '[{ru.letters}]')) AS ru, len(regexp_extract_all(lower(few), '[{uk.letters}]')) AS uk, {words(ru)} AS wr, {words(uk)} AS wu FROM (SELECT {few} AS few)))"""


_LANGUAGES_SQL = f"""WITH d AS (SELECT doc_id, lang, text AS t, translate(lower(text), '{_LATIN}', '{_CYRILLIC}') AS c FROM documents),
 m AS (SELECT doc_id, CASE lang WHEN 'de' THEN c WHEN 'es' THEN replace(c, 'и', 'і') WHEN 'fr' THEN substr(t, 1, CAST(floor(length(t) / 2) AS BIGINT)) || translate(lower(substr(t, CAST(floor(length(t) / 2) AS BIGINT) + 1)), '{_LATIN}', '{_CYRILLIC}') ELSE t END AS text FROM d),
 h AS (SELECT doc_id, text, substr(text, 1, 100) AS head FROM m)
 SELECT doc_id AS book_id, {_language_sql("text")} AS lang, {_language_sql("head")} AS head_lang FROM h"""

ORACLE_SQL = {
    "chunk_spans": f"SELECT doc_id AS book_id, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS chars, true AS fit, true AS numbered FROM documents WHERE {_HAS_WORD}",
    "token_chunks": f"SELECT doc_id AS book_id, true AS fit FROM documents WHERE {_HAS_WORD}",
    "content_match": f"SELECT doc_id AS book_id, doc_id % 5 <> 0 AS same FROM documents WHERE {_HAS_WORD}",
    "text_covered": f"SELECT doc_id AS book_id, CAST(0 AS BIGINT) AS page_breaks, true AS inside FROM documents WHERE {_HAS_WORD}",
    "normalise": "SELECT doc_id AS book_id, text, CASE WHEN text IS NOT NULL THEN true END AS mapped FROM documents",
    "markup_rules": "WITH p AS (SELECT p_partkey, regexp_replace(p_name, '[^a-z ]', '', 'g') AS w FROM part) SELECT p_partkey AS book_id, w || ' and ' || w || ', ' || w || ' 1_2' || chr(10) || chr(10) || 'end of ' || w AS text FROM p",
    "offset_map": "SELECT doc_id AS book_id, true AS same, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS n_edits FROM documents WHERE text IS NOT NULL",
    "page_texts": "SELECT doc_id AS book_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS page, unnest(string_split(text, chr(10))) AS text FROM documents",
    "chapters": f"WITH {_PARTS}, o AS (SELECT *, CAST(sum(length(p)) OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS e FROM c) SELECT conv_id, 'structural' AS source, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS number, substr(h, 4) AS title, CAST(e - length(p) AS INT) AS char_start, e AS char_end FROM o",
    "chapter_numbers": "SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 2, 4) THEN CAST(p_partkey % 90 + 1 AS INT) END AS number FROM part",
    "matter_kinds": r"""WITH w AS (SELECT doc_id, doc_id % 9 AS k, least(len(regexp_extract_all(coalesce(text, ''), '\p{L}+')), 40) AS n FROM documents),
 t AS (SELECT doc_id AS book_id, CASE WHEN k = 0 THEN 'back_other' WHEN k = 1 AND n >= 8 THEN 'back_index' WHEN k = 2 AND n >= 4 OR k = 3 AND least(n, 12) >= greatest(4, 0.3 * (least(n, 12) + 1)) THEN 'back_biblio' WHEN k = 5 THEN 'front' WHEN k = 6 THEN 'back_index' ELSE 'body' END AS kind FROM w)
 SELECT book_id, kind, kind IN ('back_other', 'back_index', 'front') AS strong FROM t""",
    "captions": "SELECT p_partkey, CAST(p_partkey % 50 AS VARCHAR) AS label, 'The ' || p_name || ' of some sort.' AS caption FROM part UNION ALL SELECT p_partkey, CAST(p_partkey % 50 + 60 AS VARCHAR), '' FROM part",
    "isbn_extract": "WITH s AS (SELECT p_partkey, '978' || lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS s FROM part) SELECT p_partkey, CASE WHEN i = '9780306406157' THEN '' ELSE i END AS isbns FROM (SELECT p_partkey, s || CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(s, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS INT) AS i FROM s)",
    "language_ids": _LANGUAGES_SQL,
    "stem_counts": f"SELECT doc_id AS book_id, array_to_string(list_transform(range(0, {len(_FORMS)}), lambda i: [{', '.join(repr(x) for _, x in _FORMS)}][CAST((i * 5 + doc_id) % {len(_FORMS)} AS BIGINT) + 1]), ' ') AS stems, CAST(len(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+')) AS BIGINT) AS n FROM documents",
    "snippets": r"SELECT doc_id AS book_id, CASE WHEN length(text) <= 300 THEN length(text) END AS n, true AS wide, true AS inside, CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(orre|hehely|inoran)($|[^\p{L}\p{N}_])') THEN true END AS hit FROM documents WHERE text IS NOT NULL",
    "html_texts": """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script\\b.*?</script\\s*>', ' ', 'gis'), '<style\\b.*?</style\\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs') AS t FROM pages),
 b AS (SELECT page_id, regexp_replace(regexp_replace(t, '<(br|/p|/h[1-6]|/li|/div)\\b[^>]*>', chr(10), 'gi'), '<[^>]*>', ' ', 'g') AS t FROM a),
 c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&mdash;', '—'), '&ndash;', '–'), '&hellip;', '…'), '&amp;', '&') AS t FROM b),
 d AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \\t\\x0B\\f\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10)) AS t FROM c)
 SELECT page_id, CAST(length(t) AS INT) AS n, regexp_matches(t, '<[a-z/]') AS tags FROM d""",
    "cut_texts": "SELECT doc_id AS book_id, CASE WHEN text IS NOT NULL THEN true END AS short, CASE WHEN text IS NOT NULL THEN true END AS head FROM documents",
    "embeddings_of": "SELECT doc_id AS book_id, 1.0::DOUBLE AS norm, true AS same FROM documents",
    "file_titles": "WITH p AS (SELECT p_partkey, regexp_replace(p_name, '[^a-z]', '', 'g') AS n FROM part) SELECT p_partkey, p_partkey % 6 <> 1 AS file, CASE p_partkey % 6 WHEN 0 THEN n || ' deep dive' WHEN 2 THEN n || ' guide' WHEN 3 THEN 'The ' || n WHEN 5 THEN n || ' title' END AS words FROM p",
    "author_names": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'First Last' || c_custkey || '&ann bee' WHEN 1 THEN 'Ann Bee&Cee Dee' || c_custkey ELSE 'Solo' || c_custkey || '&ann bee' END AS names, CASE c_custkey % 3 WHEN 2 THEN 'semicolon' ELSE 'comma' END AS fault FROM customer",
    "author_sorts": "SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z]', '', 'g') || ', Ann B.' || CASE WHEN c_custkey % 2 = 0 THEN ' Jr.' ELSE '' END AS sorted FROM customer",
    "quote_budget": "SELECT p_partkey, CAST(greatest(p_partkey % 40 + 1, 2) AS INT) AS longest, CAST(p_partkey % 40 + 3 AS INT) AS total, p_partkey % 40 + 1 <= 25 AS ok FROM part",
    "cursor_leak": "SELECT p_partkey, p_partkey % 4 < 2 AS leak FROM part",
    "heading_mirror": "WITH h AS (SELECT conv_id, lower(concat_ws(' ', role, turn)) AS h, turn FROM conversations), s AS (SELECT x.conv_id, avg(CASE WHEN EXISTS (SELECT 1 FROM h y WHERE y.conv_id = x.conv_id AND y.h = x.h AND y.turn % 2 = 0) THEN 1.0::DOUBLE ELSE 0 END) AS s FROM h x GROUP BY 1) SELECT conv_id, round(s, 6) AS share, s <= 0.5 AS ok FROM s",
    "outline_chapters": """WITH p AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k FROM part), g AS (SELECT p_partkey, k, i, 'head' || chr(10) || 'Chapter ' || i || ' of ' || k || chr(10) || 'words words' AS t FROM p, generate_series(1, 12) s(i)),
 o AS (SELECT *, CAST(sum(length(t) + 1) OVER (PARTITION BY p_partkey ORDER BY i) - length(t) - 1 AS INT) AS a, CAST(sum(length(t) + 1) OVER (PARTITION BY p_partkey) - 1 AS INT) AS n FROM g),
 c AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS number, CASE WHEN i = 11 THEN 'Elsewhere' ELSE 'Chapter ' || i || ' of ' || k END AS title, CASE WHEN i = 11 THEN a ELSE a + 5 END AS a, n FROM o WHERE i IN (3, 5, 7, 9, 11))
 SELECT p_partkey, CAST(number AS INT) AS number, title, a AS char_start, coalesce(lead(a) OVER (PARTITION BY p_partkey ORDER BY number), n) AS char_end FROM c""",
    "note_lines": "SELECT p_brand AS field, p_name AS item, p_type || chr(9) || 'more' AS snippet FROM part WHERE p_partkey % 3 > 0",
    "image_lines": "SELECT CAST(p_partkey AS INT) AS page, CAST(p_partkey AS INT) AS number, 'image' AS kind, 640 AS width, 480 AS height, 300 AS x_ppi, 150 AS y_ppi FROM part WHERE p_partkey % 5 <> 0",
}
