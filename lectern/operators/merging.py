"""Field-wise merging, tag edits, change previews and metadata proposals, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import isbn as isbns
from lectern.functions import text as tx
from lectern.functions import titles


def merged_tags(existing: Column | str, add: Column, remove: Column) -> Column:
    """(existing and add) without remove, in either case; the existing spelling and order stay."""
    have = F.coalesce(F.col(existing) if isinstance(existing, str) else existing, F.array().cast("array<string>"))
    both = distinct_ignoring_case(F.concat(have, add))
    return F.filter(both, lambda t: ~F.exists(remove, lambda r: F.lower(r) == F.lower(t)))


def distinct_ignoring_case(values: Column) -> Column:
    """The first spelling of each value, in order."""
    lowered = F.transform(values, F.lower)
    return F.filter(values, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)


def tag_changes(existing: Column, merged: Column) -> tuple[Column, Column]:
    """How many tags a merge adds and removes."""
    low = lambda c: F.transform(c, F.lower)
    return F.size(F.array_except(low(merged), low(existing))), F.size(F.array_except(low(existing), low(merged)))


def merged_identifiers(existing: Column, changes: Column) -> Column:
    """Schemes in lower case; a change sets its scheme, a null change removes it, the others stay."""
    low = lambda m: F.transform_keys(m, lambda k, _: F.lower(k))
    old, new = low(F.coalesce(existing, F.create_map().cast("map<string,string>"))), low(changes)
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, F.map_filter(new, lambda _, v: v.isNotNull()))


def fill_missing(target: str, source: str, empty: Column | None = None) -> Column:
    """The target's value unless it is empty."""
    is_empty = empty if empty is not None else F.col(target).isNull() | (F.btrim(F.col(target).cast("string")) == "")
    return F.when(is_empty, F.col(source)).otherwise(F.col(target))


def merge_books(members: DataFrame, group: str, place: str) -> DataFrame:
    """One row per group: its target (place 0) filled from its sources in order.

    Scalars take the first value that isn't empty (the placeholder author and date are), a series comes with its number.  Tags
    are united in order, in either case.  Identifiers of the target win, then later sources.  Comments are joined, each text once.
    Every field is a partial aggregate by group and value, so a group of any size is never gathered.
    """
    filled = lambda c: F.coalesce(F.btrim(F.col(c)) != "", F.lit(False))
    first = lambda c, ok, *more: F.min(F.when(ok, F.struct(F.col(place).alias("at"), F.col(c), *more))).alias(f"_{c}")
    authors = F.filter("authors", lambda a: F.lower(F.btrim(a)) != "unknown")
    named = F.coalesce((F.size("authors") > 1) | (F.size(authors) == 1), F.lit(False))
    scalars = members.groupBy(group).agg(
        first("title", filled("title")), first("authors", named), first("publisher", filled("publisher")), first("rating", F.coalesce(F.col("rating") != 0, F.lit(False))),
        first("pubdate", ~tx.is_empty_date("pubdate")), first("series", filled("series"), F.col("series_index")),
    )
    tag = members.select(group, place, F.posexplode("tags").alias("p", "tag"))
    tags = tag.groupBy(group, F.lower("tag").alias("_t")).agg(F.min(F.struct(place, "p", "tag")).alias("x")).groupBy(group).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["tag"]).alias("tags"))
    entry = members.select(group, place, F.explode("identifiers").alias("scheme", "value")).where("value is not null")
    wins = F.when(F.col(place) == 0, F.lit((1 << 62))).otherwise(F.col(place).cast("long"))
    ids = entry.groupBy(group, "scheme").agg(F.max_by("value", wins).alias("value")).groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("scheme", "value")))).alias("identifiers"))
    said = members.where(F.coalesce(F.col("comments") != "", F.lit(False))).groupBy(group, "comments").agg(F.min(place).alias("at")).groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "comments"))), lambda x: x["comments"]), "\n\n").alias("comments"))
    out = scalars
    for part in (tags, ids, said):
        out = out.join(part, group, "left")
    empty = F.coalesce("tags", F.array().cast("array<string>"))
    kept = F.coalesce("identifiers", F.create_map().cast("map<string,string>"))
    return out.select(group, *(F.col(f"_{c}.{c}").alias(c) for c in ("title", "authors", "publisher", "rating", "pubdate", "series")), F.col("_series.series_index").alias("series_index"), empty.alias("tags"), kept.alias("identifiers"), "comments")


def format_plan(books: DataFrame, group: str, place: str) -> DataFrame:
    """(group, format, id, action) of the sources' formats: one moves if the target lacks it and no source before has it, else it is dropped."""
    held = books.select(group, "id", F.col(place).alias("at"), F.posexplode(F.transform("formats", F.lower)).alias("p", "format"))
    first = F.row_number().over(Window.partitionBy(group, "format").orderBy("at", "p")) == 1
    return held.withColumn("action", F.when(first, "moves").otherwise("dropped")).where("at > 0").select(group, "format", "id", "action")


def merge_custom(values: Column, datatype: Column, multiple: Column) -> Column:
    """A custom column over members (target first): united if it holds several values, joined if comments, else the first filled."""
    flat = distinct_ignoring_case(F.flatten(F.filter(values, lambda v: v.isNotNull())))
    return F.when(multiple, flat).when(datatype == "comments", F.when(F.size(flat) > 0, F.array(F.array_join(flat, "\n\n"))).otherwise(flat)).otherwise(F.slice(flat, 1, 1))


def canonical(column: str, kind: str) -> Column:
    """A value as text in which equal values are equal: maps in order of keys, all empty values null."""
    c = F.col(column)
    text = F.to_json(F.array_sort(F.map_entries(c))) if kind.startswith("map") else F.to_json(c) if kind.startswith(("array", "struct")) else c.cast("string")
    return F.when(text.isin("", "[]", "{}"), None).otherwise(text)


def changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after, changed) of two versions of rows."""
    kinds = dict(before.dtypes)
    side = lambda d: d.select(key, *(canonical(f, kinds[f]).alias(f) for f in fields))
    a, b = side(before).alias("a"), side(after).alias("b")
    both = a.join(b, key)
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("before"), F.col(f"b.{f}").alias("after")) for f in fields)))
    return both.select(key, rows.alias("x")).select(key, "x.*").withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


def landed(intended: DataFrame, before: DataFrame, now: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Outcome of a write by field: landed, unchanged (the old value is still there), or foreign (a third value)."""
    first = changes(before, intended, key, fields).select(key, "field", "before", F.col("after").alias("intended"))
    seen = changes(before, now, key, fields).select(key, "field", F.col("after").alias("now"))
    outcome = F.when(F.col("now").eqNullSafe(F.col("intended")), "landed").when(F.col("now").eqNullSafe(F.col("before")), "unchanged").otherwise("foreign")
    return first.join(seen, [key, "field"]).withColumn("outcome", outcome)


def list_matches(a: Column, b: Column) -> Column:
    """Equal as sets, in either case."""
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.btrim(x)))
    return (F.size(F.array_except(low(a), low(b))) == 0) & (F.size(F.array_except(low(b), low(a))) == 0)


def proposals(books: DataFrame, hits: DataFrame) -> DataFrame:
    """Metadata proposals from provider hits (id, provider_order, place, confidence, title, authors, publisher, pubdate, series, isbn).

    The first provider with any hit is used, its best hit taken, the first of equals.  A title that disagrees with a usable
    one of the book caps the confidence at 0.3.  A field is proposed only if the book lacks it or has a weak value; a
    publisher that is the authors, never.
    """
    first = hits.groupBy("id").agg(F.min("provider_order").alias("provider_order"))
    fields = ("title", "authors", "publisher", "pubdate", "series", "isbn", "confidence")
    best = hits.join(first, ["id", "provider_order"]).groupBy("id").agg(F.max_by(F.struct(*fields), F.struct(F.col("confidence"), (-F.col("place")).alias("p"))).alias("h"))
    none = F.array().cast("array<string>")
    own = F.coalesce("authors", none)
    out = books.join(best, "id").withColumns({"_weak": titles.is_weak_title("title", own), "_names": titles.cleaned_authors(F.coalesce("h.authors", none))})
    agrees = F.col("_weak") | F.coalesce(F.col("h.title") == "", F.lit(True)) | titles.titles_agree("title", "h.title")
    known = lambda c: F.transform(titles.cleaned_authors(c), F.lower)
    publisher_is_author = F.size(F.array_except(known(F.array("h.publisher")), known(F.concat("_names", own)))) == 0
    given = lambda c: F.coalesce(F.col(f"h.{c}") != "", F.lit(False))
    lacks = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    return out.select(
        "id", F.when(agrees, F.col("h.confidence")).otherwise(F.least("h.confidence", F.lit(0.3))).alias("confidence"), (~agrees).alias("mismatch"),
        F.when(given("title") & F.col("_weak"), F.col("h.title")).alias("title"),
        F.when((F.size("_names") > 0) & titles.are_weak_authors(own), F.col("_names")).alias("authors"),
        F.when(given("publisher") & lacks("publisher") & ~publisher_is_author, F.col("h.publisher")).alias("publisher"),
        F.when(given("pubdate") & tx.is_empty_date("pubdate"), F.col("h.pubdate")).alias("pubdate"),
        F.when(given("series") & lacks("series"), F.col("h.series")).alias("series"),
        F.when(given("isbn") & F.coalesce(F.col("identifiers")["isbn"] == "", F.lit(True)), isbns.to_isbn13("h.isbn")).alias("isbn"),
    )


def lookup_key(books: DataFrame) -> DataFrame:
    """(id, by, value): what to look a book up by: its ISBN, else a usable title or the words of its slug."""
    isbn = isbns.to_isbn13(F.col("identifiers")["isbn"])
    title = titles.searchable_title("title", F.coalesce("authors", F.array().cast("array<string>")))
    return books.select("id", F.when(isbn.isNotNull(), "isbn").when(title.isNotNull(), "title").alias("by"), F.coalesce(isbn, title).alias("value"))


def resolved_tags(wanted: Column, known: Column, library: Column) -> Column:
    """Tags in the spelling of the known list, else of the library's, else as given."""
    spelled = lambda t, names: F.get(F.filter(names, lambda n: F.lower(n) == F.lower(t)), 0)
    return F.transform(wanted, lambda t: F.coalesce(spelled(t, known), spelled(t, library), t))


def replacement_notes(before: Column, after: Column, most: int = 5) -> Column:
    """What a replaced list loses and gains: counts, the first few names dropped, and names that change their case only."""
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    old = F.coalesce(before, F.array().cast("array<string>"))
    new = F.coalesce(after, F.array().cast("array<string>"))
    dropped = F.filter(old, lambda x: ~F.array_contains(low(new), F.lower(x)))
    recased = F.filter(old, lambda x: F.array_contains(low(new), F.lower(x)) & ~F.array_contains(new, x))
    added = F.size(F.array_except(low(new), low(old)))
    return F.struct(F.size(dropped).alias("n_dropped"), added.alias("n_added"), F.slice(dropped, 1, most).alias("dropped"), recased.alias("recased"))
