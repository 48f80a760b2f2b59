"""Duplicate groups, merge safety, and quality rules of catalogue rows.

Rows have id, title, authors, and as far as a rule needs them: identifiers (map),
formats, languages, tags (arrays), series, series_index, pubdate, publisher,
comments, author_sort.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import isbn as isbns
from lectern.functions import text as tx
from lectern.functions import titles


_SIGNALS = ("subtitle", "edition", "title_year", "pub_year")


def work_keys(books: DataFrame) -> DataFrame:
    """Adds ``work`` (null if the title can't be compared) and the signals subtitle, edition, title_year and pub_year."""
    if {"work", *_SIGNALS} <= set(books.columns):
        return books  # who needs them twice may keep them
    parts = books.withColumn("_w", titles.work_parts("title", F.coalesce("authors", F.array().cast("array<string>"))))
    return parts.withColumns({"work": F.col("_w.key"), **{c: F.col(f"_w.{c}") for c in _SIGNALS[:3]}, "pub_year": tx.pub_year("pubdate")}).drop("_w")


def compatible(a: dict, b: dict) -> bool:
    """Whether no signal speaks against one edition: an unknown one never does, publication years must be under two apart."""
    apart = any(a[c] is not None and b[c] is not None and a[c] != b[c] for c in _SIGNALS[:3])
    return not apart and (a["pub_year"] is None or b["pub_year"] is None or abs(a["pub_year"] - b["pub_year"]) < 2)


def identical_members(books: DataFrame) -> DataFrame:
    """(group, id) of books that share title and authors with another one."""
    keyed = books.select("id", tx.identical_key("title", "authors").alias("group"))
    several = keyed.groupBy("group").agg(F.count("*").alias("_n")).where("_n > 1").select("group")
    return keyed.join(several, "group").select("group", "id")


def similar_members(books: DataFrame) -> DataFrame:
    """(group, id) of books of one work that no signal tells apart.

    Greedy: the books with most signals come first, in order of ids within them, and each joins the first
    cluster whose members all fit.  Where a book goes follows from its signals, as books of equal signals fit each
    other, so only the distinct signals of a work come together, never all its books.
    """
    keyed = work_keys(books).where("work is not null").select("id", "work", *_SIGNALS)
    distinct = keyed.groupBy("work", *_SIGNALS).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    shared = distinct.withColumn("_all", F.sum("n").over(Window.partitionBy("work"))).where("_all > 1").drop("_all")

    def clusters(rows: pd.DataFrame) -> pd.DataFrame:
        found = rows.astype(object).where(rows.notna(), None).to_dict("records")
        found.sort(key=lambda r: (-sum(r[c] is not None for c in _SIGNALS), r["first"]))
        homes: list[list[dict]] = []
        for r in found:
            home = next((i for i, h in enumerate(homes) if all(compatible(r, o) for o in h)), len(homes))
            if home == len(homes):
                homes.append([])
            homes[home].append(r)
            r["part"] = home
        size = [sum(r["n"] for r in h) for h in homes]
        return pd.DataFrame([r for r in found if size[r["part"]] > 1], columns=["work", *_SIGNALS, "part"])

    parts = shared.groupBy("work").applyInPandas(clusters, "work string, subtitle string, edition int, title_year int, pub_year int, part int")
    placed = keyed.alias("a").join(parts.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("work", *_SIGNALS)])
    return placed.select(F.concat_ws("\u0001", "a.work", F.col("b.part").cast("string")).alias("group"), "a.id")


def scored_groups(members: DataFrame, books: DataFrame) -> DataFrame:
    """(group, first, size, n_isbn, n_lang, shared_format, work_match, safety) of groups (group, id), least safe and largest first.

    work_match is the worst verdict on two members: same, edition? (one names a later edition), or different.
    Safety starts at 1; more than one ISBN takes 0.5, a format held twice 0.2; more than one language takes 0.3 and
    caps it at 0.3, and so does a verdict other than same.  Counts, least and greatest values only.
    """
    m = members.join(work_keys(books), "id")
    low = lambda c: F.nullif(F.lower(F.btrim(c)), F.lit(""))
    spoken = F.filter(F.transform(F.coalesce("languages", F.array().cast("array<string>")), F.lower), lambda x: x != "")
    held = m.select("group", "id", F.explode(F.array_distinct(F.transform("formats", F.lower))).alias("f")).groupBy("group", "f").agg(F.count("*").alias("n")).groupBy("group").agg((F.max("n") > 1).alias("shared_format"))
    differ = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    isbn = low(F.col("identifiers")["isbn"])
    apart = (F.count("work") < F.count("*")) | differ("work") | differ("subtitle") | differ("edition") | differ("title_year") | F.coalesce(F.max("pub_year") - F.min("pub_year") >= 2, F.lit(False))
    later = differ(F.coalesce("edition", F.lit(1)))
    facts = m.groupBy("group").agg(
        F.min("id").alias("first"), F.count("*").alias("size"), differ(isbn).alias("several_isbns"),
        F.coalesce(F.min(F.array_min(spoken)) != F.max(F.array_max(spoken)), F.lit(False)).alias("several_languages"),
        F.when((F.count("*") > 1) & apart, "different").when(later, "edition?").otherwise("same").alias("work_match"),
    ).join(held, "group", "left")
    shared = F.coalesce("shared_format", F.lit(False))
    score = 1.0 - F.when(F.col("several_isbns"), 0.5).otherwise(0.0) - F.when(shared, 0.2).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.when(F.col("several_languages"), F.least(score - 0.3, F.lit(0.3))).otherwise(score))
    safety = F.when(F.col("work_match") == "same", score).otherwise(F.least(score, F.lit(0.3)))
    return facts.withColumns({"shared_format": shared, "safety": safety})


def group_order() -> list[Column]:
    return [F.col("safety"), F.col("size").desc(), F.col("group")]


def completeness() -> Column:
    """Formats and identifiers of a book, and one for each other field that isn't empty."""
    text = [F.when(F.coalesce(F.col(c) != "", F.lit(False)), 1).otherwise(0) for c in ("author_sort", "series", "publisher", "pubdate", "comments")]
    lists = [F.when(F.coalesce(F.size(c) > 0, F.lit(False)), 1).otherwise(0) for c in ("tags", "languages")]
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return sum([*text, *lists], size("formats") + size("identifiers"))


def keepers(members: DataFrame, books: DataFrame, place: str = "id") -> DataFrame:
    """(group, keep): each group's most complete book, the first by ``place`` on a tie."""
    return members.join(books, "id").groupBy("group").agg(F.max_by("id", F.struct(completeness().alias("c"), (-F.col(place)).alias("p"))).alias("keep"))


def compared(books: DataFrame, fields: list[str]) -> DataFrame:
    """(field, values by id, same): fields of books side by side; all empty values are equal."""
    text = lambda c: F.when(F.col(c).cast("string").isin("", "[]", "{}"), None).otherwise(F.col(c).cast("string"))
    long = books.select("id", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), text(c).alias("value")) for c in fields))).alias("x")).select("id", "x.*")
    return long.groupBy("field").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", "value")))).alias("values"), (F.size(F.collect_set(F.coalesce("value", F.lit("\u0000")))) == 1).alias("same"))


CHECKS = ("author", "title", "isbn", "author_sort", "pubdate")


def row_issues(books: DataFrame) -> DataFrame:
    """(id, check, detail) of the rules that look at one book."""
    names = F.coalesce("authors", F.array().cast("array<string>"))
    isbn = F.col("identifiers")["isbn"]
    expected = F.array_join(F.transform(names, tx.author_sort), " & ")
    found = {
        "author": F.when(F.size(names) == 0, "no author").otherwise(titles.authors_fault(names)),
        "title": F.when(titles.is_placeholder("title"), "placeholder").when(titles.file_shaped("title", names), "file name"),
        "isbn": F.when(isbn.isNotNull() & ~isbns.is_isbn(isbn), "invalid"),
        "author_sort": F.when((F.size(names) > 0) & (F.coalesce("author_sort", F.lit("")) != expected), "differs"),
        "pubdate": F.when(tx.is_empty_date("pubdate"), "empty"),
    }
    every = F.array(*(F.struct(F.lit(k).alias("check"), v.alias("detail")) for k, v in found.items()))
    return books.select("id", F.explode(F.filter(every, lambda x: x["detail"].isNotNull())).alias("x")).select("id", "x.*")


def series_gaps(books: DataFrame, series: str = "series", index: str = "series_index", key: str = "id") -> DataFrame:
    """(series, anchor, missing, n_missing, repeated): runs (lo, hi) of whole numbers missing between a series' ends, and numbers held twice.

    Two members at least.  Gaps come from neighbours in order, so their size costs nothing.
    """
    whole = F.when(F.col(index) == F.floor(index), F.col(index).cast("long"))
    numbers = books.where(F.col(series).isNotNull()).groupBy(series, whole.alias("n")).agg(F.count("*").alias("c"), F.min(key).alias("k"))
    after = F.lead("n").over(Window.partitionBy(series).orderBy(F.col("n").asc_nulls_last()))
    gaps = numbers.withColumn("gap", F.when(after > F.col("n") + 1, F.struct((F.col("n") + 1).alias("lo"), (after - 1).alias("hi"))))
    by = gaps.groupBy(series).agg(
        F.sum("c").alias("members"), F.min("k").alias("anchor"), F.sort_array(F.collect_list("gap")).alias("missing"), F.coalesce(F.sum(F.col("gap.hi") - F.col("gap.lo") + 1), F.lit(0)).alias("n_missing"),
        F.sort_array(F.collect_list(F.when((F.col("c") > 1) & F.col("n").isNotNull(), F.col("n")))).alias("repeated"),
    )
    return by.where("members > 1 and (n_missing > 0 or size(repeated) > 0)").drop("members")


def issue_histogram(issues: DataFrame) -> DataFrame:
    return issues.groupBy("check").agg(F.count("*").alias("n"))


def add_probe(new: DataFrame, books: DataFrame, most: int = 10) -> DataFrame:
    """(new_id, ids, reason): other books with a new one's ISBN or of its work, the first few by id; reason is isbn or title.

    A title without spaces is read as a slug.  Where either side lacks authors, titles alone are compared, without publication years.
    """
    side = lambda d, key: work_keys(d.withColumn("title", titles.unslugged("title"))).select(F.col("id").alias(key), F.split_part("work", F.lit("|"), F.lit(1)).alias("main"), F.split_part("work", F.lit("|"), F.lit(2)).alias("by"), *_SIGNALS, isbns.to_isbn13(F.col("identifiers")["isbn"]).alias("isbn13"))
    a, b = side(new, "new_id"), side(books, "id")
    signals = [F.col(f"a.{c}").isNull() | F.col(f"b.{c}").isNull() | (F.col(f"a.{c}") == F.col(f"b.{c}")) for c in _SIGNALS[:3]]
    years = F.col("a.pub_year").isNull() | F.col("b.pub_year").isNull() | (F.abs(F.col("a.pub_year") - F.col("b.pub_year")) < 2)
    unknown = (F.col("a.by") == "") | (F.col("b.by") == "")
    fits = F.lit(True)
    for s in signals:
        fits = fits & s
    # Books of equal signals fit the same new ones, so only distinct signals are compared, each with its first few ids; a new book may be one of them itself.
    sign = ["main", "by", *_SIGNALS]
    first = F.row_number().over(Window.partitionBy(*sign).orderBy("id"))
    few = b.where("main <> ''").select(*sign, "id").withColumn("_r", first).where(F.col("_r") <= most + 1).groupBy(*sign).agg(F.collect_list("id").alias("ids"))
    asked = a.where("main <> ''").select(*sign).distinct()
    fitting = asked.alias("a").join(few.alias("b"), (F.col("a.main") == F.col("b.main")) & fits & (unknown | ((F.col("a.by") == F.col("b.by")) & years)))
    held = fitting.groupBy(*(F.col(f"a.{c}").alias(c) for c in sign)).agg(F.slice(F.array_sort(F.flatten(F.collect_list("b.ids"))), 1, most + 1).alias("ids"))
    alike = [F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}")) for c in sign]
    same = a.alias("n").join(held.alias("h"), alike).select("n.new_id", F.explode("h.ids").alias("id"))
    isbn = Window.partitionBy("isbn13").orderBy("id")
    by_isbn = b.where("isbn13 is not null").select("id", "isbn13").withColumn("_r", F.row_number().over(isbn)).where(F.col("_r") <= most + 1).drop("_r")
    hits = a.join(by_isbn, "isbn13").select("new_id", "id", F.lit(1).alias("by_isbn")).union(same.select("new_id", "id", F.lit(0)))
    hits = hits.where("new_id <> id").groupBy("new_id", "id").agg(F.max("by_isbn").alias("by_isbn"))
    ranked = hits.withColumns({"r": F.row_number().over(Window.partitionBy("new_id").orderBy("id")), "any_isbn": F.max("by_isbn").over(Window.partitionBy("new_id"))}).where(F.col("r") <= most)
    return ranked.groupBy("new_id").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.when(F.max("any_isbn") == 1, "isbn").otherwise("title").alias("reason"))


def skipped_match(added: DataFrame, books: DataFrame) -> DataFrame:
    """(new_id, id): the one book whose title equals that of a skipped addition but for case, accents and signs; none if several do."""
    hits = added.select(F.col("id").alias("new_id"), titles.title_key("title").alias("k")).join(books.select("id", titles.title_key("title").alias("k")), "k")
    return hits.groupBy("new_id").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("new_id", "id")
