"""Queries over what surrounds a catalogue: annotations, logs, raw rows, field comparisons, title forms, second passages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import titles
from lectern.operators import catalogue, fusion, merging, phrases
from lectern.sources import readers

from .tables import scratch_folder, table


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def annotation_rows(spark, sf_dir):
    """Turns as annotations in three shapes: an export's object with warnings around it, a nested list, and a flat one."""
    t = _turns(spark, sf_dir)
    flat = F.to_json(F.array(F.struct(F.col("conv_id").alias("book_id"), F.col("role").alias("type"), "text", F.col("turn").cast("string").alias("timestamp"))))
    nested = F.to_json(F.array(F.struct(F.col("conv_id").alias("book_id"), F.struct(F.col("role").alias("type"), F.col("text").alias("highlighted_text"), F.lit("n").alias("notes"), F.col("turn").cast("string").alias("timestamp")).alias("annotation"))))
    exported = F.concat(F.lit("warning: a {torn line\n"), F.lit('{"version": 1, "annotations": '), flat, F.lit("}\nmore"))
    shape = F.col("turn") % 3
    return readers.annotations(t.select(F.when(shape == 0, exported).when(shape == 1, nested).otherwise(flat).alias("value"))).select("book_id", "kind", F.length("text").alias("n"), "notes", "ts")


def annotation_search(spark, sf_dir):
    """Annotations that hold a phrase, in all conversations."""
    rows = _turns(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("book_id"), "text", F.col("role").alias("note"))
    return phrases.search_rows(rows, "id", ["text", "note"], "de la").select("id", F.round("score", 8).alias("score"))


def call_log(spark, sf_dir):
    """Events as a JSON-lines log with torn lines between: calls of each kind, and their values."""
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    torn = F.when(F.col("event_id") % 10 == 3, F.substring(line, F.lit(1), F.length(line) - 4)).otherwise(line)
    folder = scratch_folder(spark, "log")
    e.select(torn.alias("value")).write.mode("append").text(f"{folder}/log")
    return readers.call_log(spark, f"{folder}/log", "event_id long, event_type string, value double").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def raw_books(spark, sf_dir):
    """Parts as raw catalogue rows: empty text is absent, formats are in lower case, authors are stored in four ways."""
    k = F.col("p_partkey")
    stored = F.when(k % 4 == 0, F.concat(F.lit('["A '), k.cast("string"), F.lit('","B"]'))).when(k % 4 == 1, F.concat(F.lit("Plain "), k.cast("string"))).when(k % 4 == 2, " ").otherwise("[torn")
    raw = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 3 == 0, "  ").otherwise(F.col("p_name")).alias("title"), F.array(F.lit("EPUB"), F.lit("Pdf")).alias("formats"), stored.alias("authors"))
    return catalogue.to_books(raw.withColumn("names", catalogue.decoded_authors("authors"))).select("id", "title", F.array_join("formats", ",").alias("formats"), F.array_join("names", "&").alias("names"))


def field_matches(spark, sf_dir):
    """Dates a day apart or not, numbers in two spellings, name lists as sets, and what a replaced list loses."""
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    a = F.concat(day.cast("string"), F.lit("T23:00:00+00:00"))
    b = F.when(k % 4 == 3, F.lit("never")).otherwise(F.date_add(day, (k % 3).cast("int")).cast("string"))
    x, y = k.cast("string"), F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".0"))).otherwise((k + 1).cast("string"))
    before = F.array(F.lit("Red"), F.lit("blue"), F.col("o_orderstatus"))
    after = F.when(k % 3 == 0, F.array(F.lower("o_orderstatus"), F.lit("BLUE "), F.lit("red"))).otherwise(F.array(F.lit("red"), F.lit("New"), F.col("o_orderstatus")))
    notes = merging.replacement_notes(before, after)
    o = table(spark, sf_dir, "orders").select("o_orderkey", tx.same_day(a, b).alias("same_day"), tx.same_number(x, y).alias("same_number"), merging.list_matches(before, after).alias("same_list"), notes.alias("n"))
    return o.select("o_orderkey", "same_day", "same_number", "same_list", "n.n_dropped", "n.n_added", F.array_join("n.dropped", ",").alias("dropped"), F.array_join("n.recased", ",").alias("recased"))


def identifier_edits(spark, sf_dir):
    """Identifiers of parts after changes that set, add and remove schemes, and tags in known spellings."""
    k = F.col("p_partkey")
    old = F.create_map(F.lit("ISBN"), k.cast("string"), F.lit("doi"), F.lit("d"))
    new = F.create_map(F.lit("Doi"), F.when(k % 2 == 0, F.lit(None).cast("string")).otherwise("e"), F.lit("asin"), F.col("p_brand"))
    tags = merging.resolved_tags(F.array(F.lit("sci-fi"), F.lit("HISTORY"), F.lit("odd")), F.array(F.lit("Sci-Fi")), F.array(F.lit("SCI-FI"), F.lit("History")))
    p = table(spark, sf_dir, "part").select(k.alias("id"), merging.merged_identifiers(old, new).alias("m"), tags.alias("t"))
    return p.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("identifiers"), F.array_join("t", ",").alias("tags"))


def title_forms(spark, sf_dir):
    """Titles of parts as keys, without subtitles, and without the signs of a slug."""
    k = F.col("p_partkey")
    title = F.when(k % 3 == 0, F.concat(F.col("p_name"), F.lit(": A "), F.col("p_brand"))).when(k % 3 == 1, F.regexp_replace("p_name", " ", "-")).otherwise(F.concat(F.initcap("p_name"), F.lit(" (new)")))
    p = table(spark, sf_dir, "part").select(k.alias("id"), title.alias("t"))
    return p.select("id", titles.title_key("t").alias("key"), titles.main_title("t").alias("main"), titles.unslugged("t").alias("plain"))


def second_passages(spark, sf_dir):
    """For each source's best document by length a second one by id, if both are body text; body hits first."""
    d = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("book"), F.col("doc_id").alias("unit"), F.coalesce("n_chars", F.lit(0)).alias("n"), (F.col("doc_id") % 3 > 0).alias("body"))
    top = lambda *order: d.withColumn("rank", F.row_number().over(Window.partitionBy("book").orderBy(*order))).where("rank = 1")
    fused = top(F.col("n").desc(), "unit").drop("rank")
    keyword = top("unit").withColumn("rank", F.row_number().over(Window.orderBy("book")))
    out = fusion.second_candidates(fused, keyword, "book", "unit").withColumn("tier", fusion.tier(F.when(F.col("body"), "body").otherwise("front"), F.col("n") > 2000))
    return out.select("book", "unit", "alt_unit", "tier", F.row_number().over(Window.orderBy(*fusion.body_first("tier", F.col("n").desc(), "unit"))).alias("place"))


def language_list(spark, sf_dir):
    """Languages of what is indexed, absent ones kept, and books whose stems another version made."""
    from lectern.operators import index, stemming

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.when(F.col("doc_id") % 9 > 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 4 == 0, F.lit(stemming.stem_version())).when(F.col("doc_id") % 4 == 1, "en:0").alias("stem_version"))
    stale = index.stale_stems(docs).agg(F.count("*").alias("n"), F.sum("book_id").alias("ids"))
    return index.languages(docs).crossJoin(F.broadcast(stale))  # one row


QUERIES = {f.__name__: f for f in (annotation_rows, annotation_search, call_log, raw_books, field_matches, identifier_edits, title_forms, second_passages, language_list)}

_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}_+#.\-]+')"
ORACLE_SQL = {
    "annotation_rows": "SELECT conv_id AS book_id, role AS kind, CAST(length(coalesce(text, '')) AS INT) AS n, CASE WHEN turn % 3 = 1 THEN 'n' END AS notes, CAST(turn AS VARCHAR) AS ts FROM conversations",
    "annotation_search": f"""WITH d AS (SELECT conv_id || '-' || turn AS id, {_TOKENS.format("coalesce(text, '')")} AS t, {_TOKENS.format('role')} AS r FROM conversations), tot AS (SELECT count(*) AS n, avg(len(t) + len(r)) AS m FROM d),
 h AS (SELECT *, len(list_filter(range(1, len(t)), lambda i: t[i] = 'de' AND t[i + 1] = 'la')) AS f FROM d), q AS (SELECT *, count(*) OVER () AS df FROM h WHERE f > 0)
 SELECT id, round(-CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (len(t) + len(r)) / m)), 8) AS score FROM q, tot""",
    "call_log": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 10 <> 3 GROUP BY 1",
    "raw_books": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS title, 'epub,pdf' AS formats, CASE p_partkey % 4 WHEN 0 THEN 'A ' || p_partkey || '&B' WHEN 1 THEN 'Plain ' || p_partkey WHEN 2 THEN '' ELSE '[torn' END AS names FROM part",
    "field_matches": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN false ELSE o_orderkey % 3 <= 1 END AS same_day, o_orderkey % 2 = 0 AS same_number, o_orderkey % 3 = 0 AS same_list,
 CAST(1 AS INT) AS n_dropped, CAST(1 AS INT) AS n_added, 'blue' AS dropped, CASE WHEN o_orderkey % 3 = 0 THEN 'Red,' || o_orderstatus ELSE 'Red' END AS recased FROM orders""",
    "identifier_edits": "SELECT p_partkey AS id, 'asin:' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ',doi:e' END || ',isbn:' || p_partkey AS identifiers, 'Sci-Fi,History,odd' AS tags FROM part",
    "title_forms": r"""WITH t AS (SELECT p_partkey AS id, p_partkey % 3 AS s, p_name AS n, CASE p_partkey % 3 WHEN 0 THEN p_name || ': A ' || p_brand WHEN 1 THEN replace(p_name, ' ', '-') ELSE p_name || ' (new)' END AS t FROM part)
 SELECT id, nullif(regexp_replace(lower(t), '[^\p{L}\p{N}\p{M}]+', '', 'g'), '') AS key, CASE s WHEN 0 THEN trim(n) WHEN 2 THEN array_to_string(list_transform(string_split(n, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') END AS main,
  CASE s WHEN 0 THEN t WHEN 1 THEN n ELSE array_to_string(list_transform(string_split(n, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') || ' (new)' END AS plain FROM t""",
    "second_passages": """WITH d AS (SELECT source AS book, doc_id AS unit, coalesce(n_chars, 0) AS n, doc_id % 3 > 0 AS body FROM documents WHERE source IS NOT NULL),
 f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY book ORDER BY n DESC, unit) = 1), k AS (SELECT *, row_number() OVER (ORDER BY book) AS rank FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY book ORDER BY unit) = 1)),
 o AS (SELECT f.book, f.unit, CASE WHEN k.rank <= 5 AND k.unit <> f.unit AND k.body AND f.body THEN k.unit END AS alt_unit, CASE WHEN f.body THEN 'body' WHEN f.n > 2000 THEN 'strong' ELSE 'weak' END AS tier, f.n FROM f LEFT JOIN k USING (book))
 SELECT book, unit, alt_unit, tier, CAST(row_number() OVER (ORDER BY CASE WHEN tier <> 'body' THEN 1 ELSE 0 END, n DESC, unit) AS INT) AS place FROM o""",
    "language_list": "SELECT lang, n, ids FROM (SELECT DISTINCT CASE WHEN doc_id % 9 > 0 THEN lang END AS lang FROM documents), (SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents WHERE doc_id % 4 <> 0)",
}
