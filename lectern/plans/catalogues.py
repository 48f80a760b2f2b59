"""Catalogue, curation, merge, audit, evaluation and log queries over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import isbn as isbns
from lectern.operators import audits, catalogue, curation, evaluation, fusion, index, logs, merging, query_lang
from lectern.streaming import pipelines

from .tables import spread, table

NAMED = {"steel": "type:STEEL", "big": 'size:">30" and search:"=steel"', "-hidden": "brand:\"=Brand#11\""}


def _parts(spark, sf_dir) -> tuple[DataFrame, query_lang.Language]:
    parts = table(spark, sf_dir, "part")
    fields = {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice", "id": "p_partkey"}
    return parts, query_lang.Language(parts.schema, fields, ("name", "type"), NAMED, dt.date(2024, 1, 31))


def catalog_search(spark, sf_dir):
    parts, lang = _parts(spark, sf_dir)
    return parts.where(lang.parse('size:">20" and (brand:"~#[12]1$" or price:"<950") and not size:"=25"')).select("p_partkey", "p_size")


def bundle_exclude(spark, sf_dir):
    parts, lang = _parts(spark, sf_dir)
    return parts.where(query_lang.Scope(lang).predicate('size:"<=10"')).select("p_partkey", "p_brand")


def facet_counts(spark, sf_dir):
    return catalogue.facets(table(spark, sf_dir, "part"), "p_brand", "#[1-3]").select("value", "n")


def paging(spark, sf_dir):
    return catalogue.page(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", "p_size", True, 20, 15)


def order_dates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lang = query_lang.Language(orders.schema, {"date": "o_orderdate", "status": "o_orderstatus"}, ("status",), {}, dt.date(2024, 1, 31))
    return orders.where(lang.parse('date:">=1994" and date:"<1995-06"')).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def _books(spark, sf_dir) -> DataFrame:
    """Parts as catalogue rows: works repeat, so groups form."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("Work "), (F.col("p_partkey") % 700).cast("string")).alias("title"),
        F.array(F.concat(F.lit("Author "), (F.col("p_partkey") % 7).cast("string"))).alias("authors"),
        F.array(F.when(F.col("p_partkey") % 3 == 0, "epub").otherwise("pdf")).alias("formats"),
        F.array(F.when(F.col("p_partkey") % 5 == 0, "rus").otherwise("eng")).alias("languages"),
        F.create_map(F.lit("isbn"), F.concat(F.lit("978"), F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0"), (F.col("p_partkey") % 10).cast("string"))).alias("identifiers"),
        F.concat(F.col("p_brand"), F.lit("/"), (F.col("p_partkey") % 10).cast("string")).alias("series"),
        F.col("p_size").cast("double").alias("series_index"),
        F.split("p_type", " ").alias("tags"),
        F.concat((F.lit(1990) + F.col("p_size") % 3).cast("string"), F.lit("-05-01T00:00:00")).alias("pubdate"),
        F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit("House "), (F.col("p_size") % 9).cast("string"))).alias("publisher"),
        F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("On "), F.col("p_brand"))).alias("comments"),
        F.lit(None).cast("string").alias("author_sort"),
        (F.col("p_partkey") % 6).cast("double").alias("rating"),
    )


def dup_identical(spark, sf_dir):
    return curation.identical_members(_books(spark, sf_dir)).groupBy("group").agg(F.min("id").alias("first"), F.count("*").alias("size")).select("first", "size")


def merge_safety(spark, sf_dir):
    """Groups of equal title and authors: verdict on their being one work, and safety."""
    books = _books(spark, sf_dir)
    return curation.scored_groups(curation.identical_members(books), books).select("first", "size", "work_match", F.round("safety", 4).alias("safety"))


def _editions(spark, sf_dir):
    """Works whose titles name their first or second edition in four ways, with accents, asides and capitals, or name none."""
    k = F.col("id")
    n, e = (k % 151).cast("string"), (k % 3 + 1).cast("int")
    suffix, word = F.when(e == 1, "st").otherwise("nd"), F.when(e == 1, "first").otherwise("second")
    form = k % 4
    title = F.when(e == 3, F.concat(F.lit("The Work W"), n)).when(form == 0, F.concat(F.lit("The Work w"), n, F.lit(", "), e.cast("string"), suffix, F.lit(" Edition")))
    title = title.when(form == 1, F.concat(F.lit("WORK W"), n, F.lit(" "), e.cast("string"), F.lit("e [print PDF]"))).when(form == 2, F.concat(F.lit("Wörk w"), n, F.lit(" edition "), e.cast("string")))
    title = title.otherwise(F.concat(F.lit("Work w"), n, F.lit(" - "), word, F.lit(" ed. (2nd printing)")))
    return _books(spark, sf_dir).withColumns({"title": title, "pubdate": F.lit(None).cast("string"), "authors": F.array(F.lit("Ann Writer"))})


def dup_similar(spark, sf_dir):
    books = _editions(spark, sf_dir)
    return curation.similar_members(books).groupBy("group").agg(F.min("id").alias("first"), F.count("*").alias("size")).select("first", "size")


def work_match(spark, sf_dir):
    """Verdicts on sets of books that a caller chose: parts of equal number modulo 604."""
    books = _editions(spark, sf_dir)
    members = books.select((F.col("id") % 604).cast("string").alias("group"), "id")
    return curation.scored_groups(members, books).select("first", "work_match", F.round("safety", 4).alias("safety"))


def keepers(spark, sf_dir):
    books = _books(spark, sf_dir)
    members = curation.identical_members(books)
    first = members.groupBy("group").agg(F.min("id").alias("first"))
    return curation.keepers(members, books).join(first, "group").select("first", "keep")


def _groups(spark, sf_dir):
    """Books of equal number modulo 211 as groups to merge, the least id as target."""
    books = _books(spark, sf_dir).withColumn("group", F.col("id") % 211)
    return books.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy("id")) - 1).withColumn("title", F.when(F.col("place") == 0, "").otherwise(F.col("title")))


def merge_books(spark, sf_dir):
    merged = merging.merge_books(_groups(spark, sf_dir).withColumn("identifiers", F.map_concat("identifiers", F.create_map(F.concat(F.lit("x"), (F.col("id") % 3).cast("string")), F.col("id").cast("string")))), "group", "place")
    ids = F.array_join(F.transform(F.sort_array(F.map_entries("identifiers")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return merged.select("group", "title", F.array_join("authors", "&").alias("authors"), "publisher", "rating", "series", "series_index", F.array_join("tags", "|").alias("tags"), ids.alias("identifiers"), "comments")


def format_plan(spark, sf_dir):
    return merging.format_plan(_groups(spark, sf_dir), "group", "place").groupBy("group", "format", "action").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def series_gaps(spark, sf_dir):
    return curation.series_gaps(_books(spark, sf_dir)).select("series", "anchor", "n_missing", F.size("repeated").cast("long").alias("n_repeated"))


def quality_issues(spark, sf_dir):
    """How many books each rule finds something at."""
    books = _books(spark, sf_dir).withColumns({"title": F.when(F.col("id") % 11 == 0, "untitled").when(F.col("id") % 13 == 0, "some-slug-name").otherwise(F.col("title")), "authors": F.when(F.col("id") % 5 == 0, F.array(F.lit("A, B"))).otherwise(F.col("authors"))})
    return curation.issue_histogram(curation.row_issues(books))


def add_probe(spark, sf_dir):
    """Every 97th book as a new one: which others have its ISBN or are its work."""
    books = spread(_editions(spark, sf_dir))
    out = curation.add_probe(books.where("id % 97 = 0"), books, 5)
    return out.select("new_id", F.array_join("ids", ",").alias("ids"), "reason")


def proposals(spark, sf_dir):
    """Provider hits for every book, whose titles are its own, another one, or where it has none."""
    books = _books(spark, sf_dir).withColumn("title", F.when(F.col("id") % 2 == 0, F.lit("report.pdf")).otherwise(F.col("title")))
    hit = lambda order, place, conf, title: books.select("id", F.lit(order).alias("provider_order"), F.lit(place).alias("place"), F.lit(conf).alias("confidence"), title.alias("title"), F.array(F.lit("Writer, Ann")).alias("authors"), F.lit("Press").alias("publisher"), F.lit("2001-01-01").alias("pubdate"), F.lit("S").alias("series"), F.lit("0306406152").alias("isbn"))
    hits = hit(0, 0, 0.6, F.lit("Low")).where("id % 3 > 0").unionByName(hit(0, 1, 0.95, F.when(F.col("id") % 5 == 0, F.lit("Another Thing Entirely")).otherwise(F.concat("title", F.lit(" revised"))))).where("id % 3 > 0").unionByName(hit(1, 0, 0.99, F.lit("Late")))
    return merging.proposals(books, hits).select("id", "confidence", "mismatch", "title", F.array_join("authors", "&").alias("authors"), "publisher", "pubdate", "series", "isbn")


def isbn_valid(spark, sf_dir):
    return _books(spark, sf_dir).select("id", isbns.is_isbn13(F.col("identifiers")["isbn"]).alias("valid"))


def isbn13(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0").alias("s"))
    ten = p.withColumn("x", F.expr("concat(s, substring('0123456789X', 1 + cast(pmod(11 - pmod(aggregate(transform(sequence(1, 9), i -> cast(substring(s, i, 1) as int) * (11 - i)), 0, (a, v) -> a + v), 11), 11) as int), 1))"))
    return ten.select("p_partkey", isbns.to_isbn13("x").alias("isbn13"))


def tag_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    merged = merging.merged_tags(F.split(F.lower("p_type"), " "), F.array(F.lit("New"), F.lit("STEEL")), F.array(F.lit("Small")))
    return p.select("p_partkey", F.array_join(merged, "|").alias("tags"))


def merge_fill(spark, sf_dir):
    """Customers' segments, the second source's where they are blank."""
    c = table(spark, sf_dir, "customer").withColumn("own", F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")))
    return c.select("c_custkey", merging.fill_missing("own", "c_name").alias("filled"))


def change_preview(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    after = p.withColumn("p_size", F.when(F.col("p_size") > 40, 40).otherwise(F.col("p_size"))).withColumn("p_brand", F.upper("p_brand"))
    return merging.changes(p, after, "p_partkey", ["p_size", "p_brand"]).where("changed").select("p_partkey", "field", "before", "after")


def shingle_overlap(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return audits.overlap(docs.select("doc_id", "text"), bench.select("item_id", F.col("text").alias("source")), "doc_id", "text", "item_id", "source")


def compression(spark, sf_dir):
    """Turns as chapters of their conversation, ten times their characters as what they were made from; the empty ones fail."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.lit(2000).alias("a"), F.length("text").alias("b"))
    return audits.chapter_compression(c, "conv_id", "a", "b").select("conv_id", F.round("ratio", 6).alias("ratio"), "n_below", "ok")


def attribution(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("key"), F.col("html").alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), "text")
    return pages.unionByName(docs).select("key", audits.attribution(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("key").endswith("7"), " ISBN, the author; buy it").otherwise(""))).alias("ok"))


def _judged(spark, sf_dir):
    """Clicks and views of a user as ranked hits: a view is a hit, a purchase's value makes it relevant."""
    e = table(spark, sf_dir, "events")
    hits = e.select(F.col("user_id").alias("qid"), F.col("event_id").alias("item"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")).alias("rank"))
    relevant = e.where(F.col("event_type") == "purchase").select(F.col("user_id").alias("qid"), F.col("event_id").alias("item"))
    return hits, relevant


def ir_metrics(spark, sf_dir):
    hits, relevant = _judged(spark, sf_dir)
    return evaluation.query_metrics(hits, relevant).select("qid", *(F.round(c, 6).alias(c) for c in ("hit1", "recall", "rr", "ndcg")))


def auc(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.round("value", 0).alias("value"), (F.col("event_type") == "click").alias("good"))
    return evaluation.auc(e, "value", "good").select(F.round("auc", 8).alias("auc"))


def kappa(spark, sf_dir):
    return evaluation.kappa(table(spark, sf_dir, "labels"), "quality", "toxic").select(F.round("kappa", 8).alias("kappa"))


def percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(evaluation.percentile_nearest("value", 0.95), 6).alias("p95"), F.round(evaluation.low_median("value"), 6).alias("low_median"), F.round(evaluation.median("value"), 6).alias("median"))


def search_read_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return logs.pairs(e, "user_id", "ts", "event_type", "view", "click", "event_id", 3600).select("search_id", "read_id")


def opened_hits(spark, sf_dir):
    """Views as searches whose hits are the items modulo 20 above theirs, clicks as reads of an item."""
    e = table(spark, sf_dir, "events")
    s = e.where("event_type = 'view'").select(F.col("event_id").alias("search_id"), F.col("user_id").alias("session"), F.col("ts").alias("search_ts"))
    r = e.where("event_type = 'click'").select(F.col("event_id").alias("read_id"), F.col("user_id").alias("session"), F.col("ts").alias("read_ts"), (F.col("event_id") % 20).alias("book_id"))
    hits = s.select("search_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("rank")).withColumn("book_id", (F.col("search_id") + F.col("rank")) % 20)
    return logs.opened_hits(s, r, hits, 86400)


def error_collapse(spark, sf_dir):
    return logs.collapsed(table(spark, sf_dir, "events"), ["event_type", "user_id"], "ts")


def call_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", "event_type")
    return pipelines.windowed_counts(e, "ts", ["event_type"], "1 hour").select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def result_sizes(spark, sf_dir):
    return logs.sizes(table(spark, sf_dir, "events"), "event_type", "value")


def graded_ndcg(spark, sf_dir):
    """Grades 0 to 3 from values, hits in order of ids."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("item"), F.pmod(F.col("event_id") * 7, F.lit(4)).cast("int").alias("grade"))
    hits = e.select("qid", "item", F.row_number().over(Window.partitionBy("qid").orderBy("item")).alias("rank"))
    return evaluation.graded_ndcg(hits, e).select("qid", F.round("ndcg", 8).alias("ndcg"))


def judged_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.pmod(F.col("event_id"), F.lit(5)).cast("int").alias("grade"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rank"))
    m = evaluation.judged_metrics(e.where("rank <= 10"))
    return m.select(*(F.round(c, 8).alias(c) for c in m.columns))


def quartiles(spark, sf_dir):
    out = evaluation.quartile_cuts(table(spark, sf_dir, "events"), "value", "event_type")
    return out.select("event_type", *(F.get("cuts", i).alias(f"q{i + 1}") for i in range(3)))


def back_matter_trap(spark, sf_dir):
    hits, _ = _judged(spark, sf_dir)
    return evaluation.trap(hits.withColumn("body", F.col("item") % 4 == 0)).select("qid", F.col("non_body_above").cast("long").alias("non_body_above"))


def floor_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("value").alias("score"), (F.col("event_type") == "click").alias("good"))
    return evaluation.floor_sweep(rows, [1.0, 5.0, 20.0])


def coverage_split(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3).alias("grade"))
    return evaluation.coverage_split(e, "grade", "event_type").select("event_type", "grade", "n")


def passage_scores(spark, sf_dir):
    """Spans of 400 characters of whole documents as hits; a span near the start and one from the middle as labels."""
    d = table(spark, sf_dir, "documents").withColumn("n", F.length("text")).where("n > 0")
    hits = d.select(F.lit(1).alias("qid"), F.col("doc_id").alias("book_id"), F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / 400).cast("int"))).alias("rank")).withColumns({"char_start": (F.col("rank") - 1) * 400, "char_end": F.col("rank") * 400})
    middle = (F.col("n") / 2).cast("int")
    labels = d.select(F.lit(1).alias("qid"), F.col("doc_id").alias("book_id"), F.explode(F.array(F.struct(F.lit(100).alias("a"), F.lit(500).alias("b")), F.struct(middle.alias("a"), (middle + 50).alias("b")))).alias("s"))
    labels = labels.select("qid", "book_id", F.concat_ws("-", "book_id", "s.a").alias("label_id"), F.col("s.a").alias("char_start"), F.col("s.b").alias("char_end")).dropDuplicates(["label_id"])
    return evaluation.spans_matched(hits, labels).select("label_id", "rank")


def length_breakdown(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("value").alias("length"), F.col("event_id").cast("double").alias("m"))
    return evaluation.by_length(e, "length", "m").select("bucket", "n", F.round("mean", 6).alias("mean"))


def localised(spark, sf_dir):
    """All spans of 300 characters of documents; the label is the whole text with the word there."""
    d = table(spark, sf_dir, "documents").withColumn("n", F.length("text")).where("n > 0")
    span = d.select(F.col("doc_id").alias("qid"), F.col("doc_id").alias("book_id"), "text", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / 300).cast("int"))).alias("rank"))
    hits = span.select("qid", "book_id", "rank", ((F.col("rank") - 1) * 300).alias("char_start"), (F.col("rank") * 300).alias("char_end"), F.expr("substring(text, (rank - 1) * 300 + 1, 300)").alias("body"))
    labels = d.select(F.col("doc_id").alias("qid"), F.col("doc_id").alias("book_id"), F.lit("The").alias("marker"), F.lit(0).alias("char_start"), F.col("n").alias("char_end"))
    return evaluation.localised(hits, labels)


def named_hits(spark, sf_dir):
    """Every order's customer as a hit, and customers of the first half as books."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("book_id"))
    b = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("book_id"), F.col("c_name").alias("title"), F.array("c_mktsegment").alias("authors"))
    return fusion.named(o, b, "book_id").select("o_orderkey", "title", F.array_join("authors", "&").alias("authors"))


def regressions(spark, sf_dir):
    """Users whose best hit of January was a purchase and isn't among all events."""
    hits, relevant = _judged(spark, sf_dir)
    now = evaluation.query_metrics(hits, relevant)
    baseline = now.select("qid", F.when(F.col("qid") % 2 == 0, 1.0).otherwise(0.0).alias("hit1"))
    return evaluation.regressions(now, baseline, ["qid"]).select("qid")


def point_lookup(spark, sf_dir):
    """Customers of every order key's remainder, those that don't exist as nulls."""
    ids = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5000).alias("c_custkey")).distinct()
    return catalogue.lookup(ids, table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")


def resolve_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("u-"), F.col("p_name"), F.col("p_partkey").cast("string")).alias("uuid"))
    refs = p.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.col("uuid")).alias("ref"))
    return catalogue.resolve_ids(refs, p, "ref", "p_partkey", "uuid")


def chosen_format(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(F.when(F.col("p_size") % 3 == 0, "PDF").otherwise("txt"), F.when(F.col("p_size") % 5 == 0, "EPUB").otherwise("xyz")).alias("formats"))
    return p.select("p_partkey", catalogue.preferred_format("formats").alias("format"))


def excluded_count(spark, sf_dir):
    parts, lang = _parts(spark, sf_dir)
    return parts.where(query_lang.Scope(lang).excluded()).agg(F.count("*").alias("n"))


def index_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("book_id")).agg(F.count("*").alias("chunk_count"))
    live = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("book_id"))
    return index.coverage(o, live)


def prune_orphans(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"))
    live = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("book_id"))
    return index.orphans(o, live)


def build_plan(spark, sf_dir):
    """What a build does to each document when the index holds two thirds, some of them stale."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 4).alias("last_modified"))
    have = docs.where("book_id % 3 > 0").select("book_id", F.when(F.col("book_id") % 5 == 0, F.lit(9)).otherwise(F.col("last_modified")).alias("last_modified"), F.xxhash64(F.when(F.col("book_id") % 7 == 0, F.lit("old")).otherwise(F.col("text"))).alias("content"))
    return index.plan(docs, have).select("book_id", "action")


def missing_vectors(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    have = o.groupBy(F.col("o_custkey").alias("book_id")).agg(F.count("*").alias("chunk_count"), F.max(F.when(F.col("o_custkey") % 3 == 0, F.lit(1))).alias("embedded_chunks"))
    return index.missing_vectors(have, o.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("book_id")))


_FUNCTIONS = (
    catalog_search, bundle_exclude, facet_counts, paging, order_dates, dup_identical, dup_similar, merge_safety, work_match, keepers, merge_books, format_plan, series_gaps, quality_issues, add_probe, proposals,
    isbn_valid, isbn13, tag_merge, merge_fill, change_preview, shingle_overlap, compression, attribution, ir_metrics, auc, kappa, percentiles, search_read_pairs, opened_hits, error_collapse, call_rate, result_sizes,
    graded_ndcg, judged_metrics, quartiles, back_matter_trap, floor_sweep, coverage_split, passage_scores, length_breakdown, localised, named_hits, regressions, point_lookup, resolve_ids, chosen_format, excluded_count, index_coverage, prune_orphans, build_plan, missing_vectors,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_GROUPS = "SELECT min(p_partkey) AS first, count(*) AS size FROM part GROUP BY p_partkey % 700, p_partkey % 7 HAVING count(*) > 1"
_CHECK13 = "(10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr({0}, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10"
_ISBN_STEM = "('978' || lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0'))"
_BOOKS = "b AS (SELECT p_partkey AS id, p_partkey % 700 AS g, p_partkey * 7919 % 1000000000 * 10 + p_partkey % 10 AS isbn, p_partkey % 5 = 0 AS rus, p_partkey % 3 = 0 AS epub, 1990 + p_size % 3 AS year, 1 AS edition, 'w' AS work, CASE WHEN p_partkey % 4 > 0 THEN 'House' END AS publisher, CASE WHEN p_partkey % 3 = 1 THEN 'On' END AS comments FROM part)"
_BOOKS_E = "b AS (SELECT p_partkey AS id, p_partkey % 604 AS g, p_partkey * 7919 % 1000000000 * 10 + p_partkey % 10 AS isbn, p_partkey % 5 = 0 AS rus, p_partkey % 3 = 0 AS epub, 1 AS year, CASE WHEN p_partkey % 3 < 2 THEN p_partkey % 3 + 1 END AS edition, p_partkey % 151 AS work FROM part)"
_SCORED = """f AS (SELECT g, max(n) > 1 AS shared FROM (SELECT g, epub, count(*) AS n FROM b GROUP BY ALL) GROUP BY g),
 s AS (SELECT g, min(id) AS first, count(*) AS size, 1.0::DOUBLE - CASE WHEN min(isbn) <> max(isbn) THEN 0.5 ELSE 0 END - CASE WHEN min(shared) THEN 0.2 ELSE 0 END AS s, min(rus) <> max(rus) AS langs,
  CASE WHEN min(work) <> max(work) OR coalesce(min(edition) <> max(edition), false) OR max(year) - min(year) >= 2 THEN 'different' WHEN min(coalesce(edition, 1)) <> max(coalesce(edition, 1)) THEN 'edition?' ELSE 'same' END AS verdict FROM b JOIN f USING (g) GROUP BY g),
 scored AS (SELECT *, round(CASE WHEN verdict = 'same' THEN greatest(0, CASE WHEN langs THEN least(s - 0.3, 0.3) ELSE s END) ELSE least(0.3, greatest(0, CASE WHEN langs THEN least(s - 0.3, 0.3) ELSE s END)) END, 4) AS safety FROM s)"""
_HITS = """hits AS (SELECT user_id AS qid, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
 rel AS (SELECT user_id AS qid, event_id AS item FROM events WHERE event_type = 'purchase'), n AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
 g AS (SELECT qid, min(rank) AS first, sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS near, sum(1.0::DOUBLE / log2(rank + 1)) AS dcg FROM hits JOIN rel USING (qid, item) WHERE rank <= 10 GROUP BY qid)"""
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
ORACLE_SQL = {
    "missing_vectors": "WITH o AS (SELECT o_custkey AS b, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS v FROM orders GROUP BY 1) SELECT b AS book_id FROM o WHERE CASE WHEN b % 3 = 0 THEN 1 ELSE v END < n",
    "build_plan": "WITH d AS (SELECT doc_id AS b, doc_id % 4 AS m, coalesce(text, '') AS t FROM documents) SELECT b AS book_id, CASE WHEN b % 3 = 0 THEN 'replace' WHEN b % 5 <> 0 THEN 'skip' WHEN b % 7 <> 0 THEN 'refresh' ELSE 'replace' END AS action FROM d",
    "excluded_count": "SELECT count(*) AS n FROM part WHERE lower(p_brand) = 'brand#11'",
    "chosen_format": "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'epub' WHEN p_size % 3 = 0 THEN 'pdf' ELSE 'txt' END AS format FROM part",
    "resolve_ids": "SELECT CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'u-' || p_name || p_partkey END AS ref, p_partkey FROM part",
    "point_lookup": "SELECT c_custkey, c_name FROM (SELECT DISTINCT o_orderkey % 5000 AS c_custkey FROM orders) LEFT JOIN customer USING (c_custkey)",
    "length_breakdown": "WITH l AS (SELECT list_sort(list(value)) AS v FROM events), c AS (SELECT v[len(v) // 4 + 1] AS a, v[len(v) * 2 // 4 + 1] AS b, v[len(v) * 3 // 4 + 1] AS c FROM l) SELECT CASE WHEN value >= c THEN 3 WHEN value >= b THEN 2 WHEN value >= a THEN 1 ELSE 0 END AS bucket, count(*) AS n, round(avg(CAST(event_id AS DOUBLE)), 6) AS mean FROM events, c GROUP BY 1",
    "localised": "SELECT doc_id AS qid, CAST(min(k) AS INT) AS rank FROM (SELECT doc_id, text, unnest(range(1, (length(text) + 299) // 300 + 1)) AS k FROM documents) WHERE contains(lower(substr(text, (k - 1) * 300 + 1, 300)), 'the') GROUP BY 1",
    "named_hits": "SELECT o_orderkey, CASE WHEN c_name IS NULL THEN 'book ' || o_custkey % 200 ELSE c_name END AS title, coalesce(c_mktsegment, '') AS authors FROM orders LEFT JOIN customer ON c_custkey = o_custkey % 200 AND c_custkey % 2 = 0",
    "regressions": f"WITH {_HITS} SELECT qid FROM n LEFT JOIN g USING (qid) WHERE qid % 2 = 0 AND coalesce(first, 0) <> 1",
    "passage_scores": "WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0), h AS (SELECT doc_id, k AS rank, (k - 1) * 400 AS a, k * 400 AS b FROM (SELECT doc_id, unnest(range(1, (n + 399) // 400 + 1)) AS k FROM d)), l AS (SELECT DISTINCT doc_id, s, e FROM (SELECT doc_id, 100 AS s, 500 AS e FROM d UNION ALL SELECT doc_id, n // 2, n // 2 + 50 FROM d WHERE n // 2 <> 100)) SELECT l.doc_id || '-' || s AS label_id, CAST(min(rank) AS INT) AS rank FROM h JOIN l USING (doc_id) WHERE least(b, e) - greatest(a, s) > 0 AND least(b, e) - greatest(a, s) >= 0.3::DOUBLE * (e - s) GROUP BY 1",
    "coverage_split": "SELECT event_type, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS grade, count(*) AS n FROM events GROUP BY ALL",
    "floor_sweep": "SELECT floor, CAST(count(*) FILTER (value < floor AND event_type = 'click') AS BIGINT) AS flagged_good, CAST(count(*) FILTER (value < floor AND event_type <> 'click') AS BIGINT) AS flagged_bad FROM events, (VALUES (1.0::DOUBLE), (5.0::DOUBLE), (20.0::DOUBLE)) f(floor) GROUP BY floor",
    "back_matter_trap": f"WITH {_HITS}, f AS (SELECT qid, min(rank) FILTER (item % 4 = 0) AS f FROM hits GROUP BY qid) SELECT qid, CAST(count(*) FILTER (item % 4 <> 0 AND (f IS NULL OR rank < f)) AS BIGINT) AS non_body_above FROM hits JOIN f USING (qid) GROUP BY qid",
    "quartiles": "WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, v[len(v) * 1 // 4 + 1] AS q1, v[len(v) * 2 // 4 + 1] AS q2, v[len(v) * 3 // 4 + 1] AS q3 FROM l",
    "judged_metrics": "WITH e AS (SELECT user_id AS q, event_id % 5 = 2 AS good, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), b AS (SELECT q, min(r) FILTER (good) AS f, count(*) FILTER (good AND r <= 5) AS n FROM e WHERE r <= 10 GROUP BY q) SELECT round(avg(CASE WHEN f <= 1 THEN 1.0::DOUBLE ELSE 0 END), 8) AS hit1, round(avg(CASE WHEN f <= 3 THEN 1.0::DOUBLE ELSE 0 END), 8) AS hit3, round(avg(CASE WHEN f <= 5 THEN 1.0::DOUBLE ELSE 0 END), 8) AS hit5, round(avg(CASE WHEN f IS NULL THEN 1.0::DOUBLE ELSE 0 END), 8) AS total_miss, round(avg(coalesce(1.0::DOUBLE / f, 0)), 8) AS mrr, round(avg(n / 5.0::DOUBLE), 8) AS p5 FROM b",
    "graded_ndcg": "WITH e AS (SELECT user_id AS qid, event_id AS item, event_id * 7 % 4 AS g, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id * 7 % 4 DESC, event_id) AS b FROM events) SELECT qid, round(CASE WHEN sum(CASE WHEN b <= 5 THEN (2.0::DOUBLE ^ g - 1) / log2(b + 1) END) > 0 THEN coalesce(sum(CASE WHEN r <= 5 THEN (2.0::DOUBLE ^ g - 1) / log2(r + 1) END), 0) / sum(CASE WHEN b <= 5 THEN (2.0::DOUBLE ^ g - 1) / log2(b + 1) END) ELSE 0 END, 8) AS ndcg FROM e GROUP BY qid",
    "result_sizes": "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS low_median, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events GROUP BY 1",
    "opened_hits": "WITH s AS (SELECT * FROM events WHERE event_type = 'view'), r AS (SELECT * FROM events WHERE event_type = 'click'), m AS (SELECT s.event_id AS search_id, r.event_id AS read_id, r.ts, k.rank FROM s JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8)) k(rank) ON true JOIN r ON r.user_id = s.user_id AND r.event_id % 20 = (s.event_id + k.rank) % 20 AND r.ts >= s.ts AND r.ts < s.ts + INTERVAL 86400 SECOND) SELECT search_id, arg_min(read_id, (ts, read_id, rank)) AS read_id, arg_min(rank, (ts, read_id, rank)) AS rank FROM m GROUP BY 1",
    "attribution": r"""WITH t AS (SELECT 'p' || page_id AS key, html AS text FROM pages UNION ALL SELECT 'd' || doc_id, text FROM documents), u AS (SELECT key, coalesce(text, '') || CASE WHEN ends_with(key, '7') THEN ' ISBN, the author; buy it' ELSE '' END AS t FROM t)
 SELECT key, regexp_matches(t, '(?i)\bISBN\b|\b97[89][\d\s-]{10,17}\b') AND regexp_matches(t, '(?i)\b(author|by|edition)\b|—\s*[A-ZА-ЯЁ]') AND regexp_matches(t, '(?i)\b(buy|purchase|consider buying|own the book|support the author|acquire)\b') AS ok FROM u""",
    "proposals": """WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'report.pdf' ELSE 'Work ' || p_partkey % 700 END AS title, p_partkey % 4 > 0 AS has_publisher FROM part)
 SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 1 THEN 0.3 ELSE 0.99 END WHEN id % 2 = 1 AND id % 5 = 0 THEN 0.3 ELSE 0.95 END::DOUBLE AS confidence, id % 2 = 1 AND (id % 3 = 0 OR id % 5 = 0) AS mismatch,
  CASE WHEN id % 2 = 0 THEN CASE WHEN id % 3 = 0 THEN 'Late' WHEN id % 5 = 0 THEN 'Another Thing Entirely' ELSE 'report.pdf revised' END END AS title, CAST(NULL AS VARCHAR) AS authors,
  CASE WHEN NOT has_publisher THEN 'Press' END AS publisher, CAST(NULL AS VARCHAR) AS pubdate, CAST(NULL AS VARCHAR) AS series, CAST(NULL AS VARCHAR) AS isbn FROM b""",
    "add_probe": "WITH h AS (SELECT a.p_partkey AS n, b.p_partkey AS i, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS r FROM part a JOIN part b ON a.p_partkey % 151 = b.p_partkey % 151 AND a.p_partkey <> b.p_partkey WHERE a.p_partkey % 97 = 0 AND (a.p_partkey % 3 = 2 OR b.p_partkey % 3 = 2 OR a.p_partkey % 3 = b.p_partkey % 3)) SELECT n AS new_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS ids, 'title' AS reason FROM h WHERE r <= 5 GROUP BY n",
    "quality_issues": f"SELECT 'title' AS check, count(*) AS n FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0 UNION ALL SELECT 'author', count(*) FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'author_sort', count(*) FROM part UNION ALL SELECT 'isbn', count(*) FROM part WHERE {_CHECK13.format(_ISBN_STEM)} <> p_partkey % 10 HAVING count(*) > 0",
    "format_plan": """WITH b AS (SELECT p_partkey AS id, p_partkey % 211 AS g, CASE WHEN p_partkey % 3 = 0 THEN 'epub' ELSE 'pdf' END AS f FROM part),
 r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) AS place, row_number() OVER (PARTITION BY g, f ORDER BY id) AS k FROM b)
 SELECT g AS "group", f AS format, CASE WHEN k = 1 THEN 'moves' ELSE 'dropped' END AS action, count(*) AS n, min(id) AS first FROM r WHERE place > 1 GROUP BY ALL""",
    "merge_books": """WITH b AS (SELECT p_partkey AS id, p_partkey % 211 AS g, row_number() OVER (PARTITION BY p_partkey % 211 ORDER BY p_partkey) - 1 AS place, * FROM part),
 t AS (SELECT g, lower(tag) AS l, min((place, i, tag)) AS x FROM (SELECT g, place, generate_subscripts(string_split(p_type, ' '), 1) AS i, unnest(string_split(p_type, ' ')) AS tag FROM b) GROUP BY ALL),
 tags AS (SELECT g, string_agg(x[3], '|' ORDER BY x[1], x[2]) AS tags FROM t GROUP BY g),
 e AS (SELECT g, place, 'isbn' AS k, '978' || lpad(CAST(id * 7919 % 1000000000 AS VARCHAR), 9, '0') || CAST(id % 10 AS VARCHAR) AS v FROM b UNION ALL SELECT g, place, 'x' || id % 3, CAST(id AS VARCHAR) FROM b),
 ids AS (SELECT g, string_agg(k || ':' || v, ',' ORDER BY k) AS identifiers FROM (SELECT g, k, arg_max(v, CASE WHEN place = 0 THEN 1000000000 ELSE place END) AS v FROM e GROUP BY ALL) GROUP BY g),
 c AS (SELECT g, string_agg(x, chr(10) || chr(10) ORDER BY p) AS comments FROM (SELECT g, 'On ' || p_brand AS x, min(place) AS p FROM b WHERE id % 3 = 1 GROUP BY ALL) GROUP BY g)
 SELECT g AS "group", arg_min('Work ' || id % 700, place) FILTER (place > 0) AS title, arg_min('Author ' || id % 7, place) AS authors, arg_min('House ' || p_size % 9, place) FILTER (id % 4 > 0) AS publisher,
  arg_min(CAST(id % 6 AS DOUBLE), place) FILTER (id % 6 > 0) AS rating, arg_min(p_brand || '/' || id % 10, place) AS series, arg_min(CAST(p_size AS DOUBLE), place) AS series_index, min(tags) AS tags, min(identifiers) AS identifiers, min(comments) AS comments
 FROM b LEFT JOIN tags USING (g) LEFT JOIN ids USING (g) LEFT JOIN c USING (g) GROUP BY g""",
    "keepers": f"WITH {_BOOKS}, c AS (SELECT *, 4 + CASE WHEN publisher IS NULL THEN 0 ELSE 1 END + CASE WHEN comments IS NULL THEN 0 ELSE 1 END + 2 AS n FROM b) SELECT min(id) AS first, arg_min(id, (-n, id)) AS keep FROM c GROUP BY g HAVING count(*) > 1",
    "dup_similar": "WITH b AS (SELECT p_partkey AS id, p_partkey % 151 AS w, p_partkey % 3 AS e FROM part), f AS (SELECT w, arg_min(e, id) FILTER (e < 2) AS home FROM b GROUP BY w) SELECT min(id) AS first, count(*) AS size FROM b JOIN f USING (w) GROUP BY w, CASE WHEN e = 2 THEN coalesce(home, 2) ELSE e END HAVING count(*) > 1",
    "work_match": f"WITH {_BOOKS_E}, {_SCORED} SELECT first, verdict AS work_match, safety FROM scored",
    "catalog_search": "SELECT p_partkey, p_size FROM part WHERE p_size > 20 AND (regexp_matches(p_brand, '(?i)#[12]1$') OR p_retailprice < 950) AND p_size <> 25",
    "bundle_exclude": "SELECT p_partkey, p_brand FROM part WHERE p_size <= 10 AND lower(p_brand) <> 'brand#11'",
    "facet_counts": "SELECT p_brand AS value, count(*) AS n FROM part WHERE regexp_matches(p_brand, '(?i)#[1-3]') GROUP BY 1",
    "paging": "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 15 OFFSET 20",
    "order_dates": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= '1994-01-01' AND CAST(o_orderdate AS DATE) < '1995-06-01' GROUP BY 1",
    "dup_identical": _GROUPS,
    "merge_safety": f"WITH {_BOOKS}, {_SCORED} SELECT first, size, verdict AS work_match, safety FROM scored WHERE size > 1",
    "series_gaps": "WITH b AS (SELECT p_brand || '/' || p_partkey % 10 AS series, p_size AS n, count(*) AS c, min(p_partkey) AS k FROM part GROUP BY ALL), g AS (SELECT series, sum(c) AS m, min(k) AS anchor, max(n) - min(n) + 1 - count(*) AS n_missing, count(*) FILTER (c > 1) AS n_repeated FROM b GROUP BY series) SELECT series, anchor, CAST(n_missing AS BIGINT) AS n_missing, CAST(n_repeated AS BIGINT) AS n_repeated FROM g WHERE m > 1 AND (n_missing > 0 OR n_repeated > 0)",
    "isbn_valid": f"SELECT p_partkey AS id, {_CHECK13.format('s')} = p_partkey % 10 AS valid FROM (SELECT p_partkey, '978' || lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS s FROM part)",
    "isbn13": f"SELECT p_partkey, s || CAST({_CHECK13.format('s')} AS INT) AS isbn13 FROM (SELECT p_partkey, '978' || lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS s FROM part)",
    "tag_merge": "WITH a AS (SELECT p_partkey, list_concat(string_split(lower(p_type), ' '), ['New', 'STEEL']) AS t FROM part), b AS (SELECT p_partkey, t, generate_subscripts(t, 1) AS i FROM a) SELECT p_partkey, coalesce(string_agg(t[i], '|' ORDER BY i) FILTER (list_position(list_transform(t, lambda x: lower(x)), lower(t[i])) = i AND lower(t[i]) <> 'small'), '') AS tags FROM b GROUP BY p_partkey",
    "merge_fill": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE c_name END AS filled FROM customer",
    "change_preview": "SELECT p_partkey, 'p_size' AS field, CAST(p_size AS VARCHAR) AS before, '40' AS after FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, 'p_brand', p_brand, upper(p_brand) FROM part WHERE p_brand <> upper(p_brand)",
    "shingle_overlap": f"WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), ds AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 7) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)), bs AS (SELECT DISTINCT item_id, list_slice(w, i, i + 7) AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b)) SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY ALL",
    "compression": "SELECT conv_id, round(CASE WHEN sum(length(text)) > 0 THEN 2000 * count(*) / CAST(sum(length(text)) AS DOUBLE) ELSE 0 END, 6) AS ratio, CAST(sum(CASE WHEN length(text) > 0 AND 2000.0::DOUBLE / length(text) >= 20 THEN 0 ELSE 1 END) AS BIGINT) AS n_below, 2000 * count(*) / CAST(sum(length(text)) AS DOUBLE) >= 20 AND sum(CASE WHEN length(text) > 0 AND 2000.0::DOUBLE / length(text) >= 20 THEN 0 ELSE 1 END) = 0 AS ok FROM conversations GROUP BY 1",
    "ir_metrics": f"WITH {_HITS} SELECT qid, CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END AS hit1, round(coalesce(near, 0) / least(n, 5)::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 6) AS ndcg FROM n LEFT JOIN g USING (qid)",
    "auc": "WITH e AS (SELECT round(value, 0) AS v, event_type = 'click' AS good FROM events), r AS (SELECT good, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM e), s AS (SELECT sum(rk) FILTER (good) AS s, CAST(count(*) FILTER (good) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT good) AS DOUBLE) AS q FROM r) SELECT round((s - p * (p + 1) / 2) / (p * q), 8) AS auc FROM s",
    "kappa": "WITH t AS (SELECT CAST(count(*) AS DOUBLE) AS t, CAST(sum(CASE WHEN quality = toxic THEN 1 ELSE 0 END) AS DOUBLE) AS same FROM labels), c AS (SELECT sum(x * y) AS c FROM (SELECT quality AS v, count(*) AS x FROM labels GROUP BY 1) JOIN (SELECT toxic AS v, count(*) AS y FROM labels GROUP BY 1) USING (v)) SELECT round((same / t - c / (t * t)) / (1 - c / (t * t)), 8) AS kappa FROM t, c",
    "percentiles": "SELECT event_type, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.5), 6) AS low_median, round(median(value), 6) AS median FROM events GROUP BY 1",
    "search_read_pairs": "SELECT s.event_id AS search_id, arg_min(r.event_id, (r.ts, r.event_id)) AS read_id FROM events s JOIN events r ON s.user_id = r.user_id AND r.event_type = 'click' AND r.ts >= s.ts AND r.ts < s.ts + INTERVAL 3600 SECOND WHERE s.event_type = 'view' GROUP BY 1",
    "error_collapse": "SELECT event_type, user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1, 2",
    "call_rate": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "index_coverage": "WITH i AS (SELECT o_custkey AS book_id, count(*) AS c FROM orders GROUP BY 1), l AS (SELECT c_custkey AS book_id FROM customer WHERE c_acctbal > 0) SELECT (SELECT count(*) FROM i) AS indexed, (SELECT count(*) FROM i JOIN l USING (book_id)) AS indexed_live, (SELECT CAST(sum(c) AS BIGINT) FROM i) AS chunks, (SELECT count(*) FROM l) AS live",
    "prune_orphans": "SELECT DISTINCT o_custkey AS book_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
}
