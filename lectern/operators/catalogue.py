"""Catalogue scans: sorted pages, facets, counts, lookups, saved searches."""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, key: str, sort: str, descending: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page in a total order: the sort column, then the key."""
    first = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_first()
    return df.orderBy(first, key).offset(offset).limit(limit)


def checked_pattern(spark, pattern: str) -> str:
    """A user's pattern as it is; ValueError if the engine that will run it can't read it, before a job starts."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        spark._jvm.java.util.regex.Pattern.compile(f"(?i){pattern}")
    except (Py4JJavaError, PySparkException) as e:
        raise ValueError(f"not a pattern: {pattern}") from e
    return pattern


def facets(df: DataFrame, column: str, pattern: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """(value, n) of a scalar or array column, most frequent first; ``pattern`` keeps the values that match, in either case."""
    if pattern is not None:
        if len(pattern) > 200:
            raise ValueError("a pattern has more than 200 characters")
        checked_pattern(df.sparkSession, pattern)
    values = F.explode(column) if df.schema[column].dataType.typeName() == "array" else F.col(column)
    out = df.select(values.alias("value")).where(F.col("value").isNotNull())
    if pattern is not None:
        out = out.where(F.col("value").rlike(f"(?i){pattern}"))
    out = out.groupBy("value").agg(F.count("*").alias("n"))
    return out if limit is None else out.orderBy(F.col("n").desc(), "value").offset(offset).limit(limit)


def lookup(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows by id; an id without a row stays, with nulls."""
    return ids.join(rows, key, "left")


def resolve_ids(refs: DataFrame, rows: DataFrame, ref: str, key: str, uuid: str) -> DataFrame:
    """Numeric references pass, others are looked up as uuids."""
    byuuid = rows.select(F.col(uuid).alias("_uuid"), F.col(key).alias("_found"))
    return refs.join(byuuid, F.col(ref) == F.col("_uuid"), "left").withColumn(key, F.coalesce(F.col(ref).try_cast("long"), "_found")).drop("_uuid", "_found")


def selection(df: DataFrame, key: str, ids: list[int] | None = None, predicate: Column | None = None, most: int = 2000) -> tuple[DataFrame, int, bool]:
    """(rows, how many there were, whether they were capped); ids win over the predicate and keep their order, which column ``place`` holds."""
    if ids is not None:
        places = df.sparkSession.createDataFrame(list({i: (i, n) for n, i in reversed(list(enumerate(ids)))}.values()), f"_id {df.schema[key].dataType.simpleString()}, place int")
        chosen = df.join(places, F.col(key) == F.col("_id")).drop("_id")
        total = chosen.count()
        return chosen.orderBy("place").limit(most), total, total > most
    chosen = df if predicate is None else df.where(predicate)
    total = chosen.count()
    return (chosen.orderBy(key).limit(most) if total > most else chosen), total, total > most


# Other words for a category.
CATEGORY_NAMES = {"author": "authors", "tag": "tags", "language": "languages"}


def category_of(name: str, categories: list[str]) -> str | None:
    """The category that a name means, in either case, by itself or by another word for it."""
    low = {c.lower(): c for c in categories}
    n = name.strip().lower()
    return low.get(n) or low.get(CATEGORY_NAMES.get(n, ""))


def has_column_filter(query: str) -> bool:
    """Whether a full-text query holds a column filter, word: or {a b}:, outside quotes; std::vector is none."""
    bare = re.sub(r'"[^"]*"', " ", query)
    return bool(re.search(r"(?:^|[\s(])(?:\w+|\{[^}]*\})\s*:(?!:)", bare))


def content_cursor(offset: int, book: int, fmt: str) -> str:
    """A position in a book's text, bound to the book and its format."""
    text = json.dumps({"offset": offset, "id": book, "format": fmt}, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def read_content_cursor(text: str, book: int | None = None) -> tuple[int, int, str]:
    """(offset, book, format) of a position; an error for anything else, or another book's."""
    try:
        data = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        offset, own, fmt = int(data["offset"]), int(data["id"]), str(data["format"])
    except Exception as e:
        raise ValueError("not a position in a book") from e
    if offset < 0 or book is not None and own != book:
        raise ValueError("the position belongs to another book")
    return offset, own, fmt


def decoded_authors(raw: str) -> Column:
    """Authors stored as a JSON list; other text is one author by itself."""
    parsed = F.from_json(raw, "array<string>")
    return F.when(F.coalesce(F.btrim(raw) == "", F.lit(True)), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.when(F.col(raw).startswith("["), None).otherwise(F.array(raw)), F.array(raw)))


def libraries(df: DataFrame, library: str = "library_id") -> DataFrame:
    return df.groupBy(library).agg(F.count("*").alias("books")).orderBy(library)


def removed(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, what would go) of a removal by ids."""
    return df.join(ids.select(key).distinct(), key, "left_anti"), df.join(ids.select(key).distinct(), key, "left_semi")


def to_books(raw: DataFrame) -> DataFrame:
    """Raw catalogue rows with formats in lower case and empty text as absent."""
    text = [f.name for f in raw.schema.fields if f.dataType.typeName() == "string"]
    out = raw.withColumns({c: F.when(F.btrim(c) != "", F.col(c)) for c in text})
    return out.withColumn("formats", F.transform("formats", F.lower)) if "formats" in raw.columns else out


# From most to least suitable for text extraction.
FORMATS = ("epub", "md", "markdown", "pdf", "txt", "txtz", "text", "azw3", "mobi", "docx", "odt", "htmlz", "fb2", "rtf")


def preferred_format(formats: str, wanted: str | None = None) -> Column:
    """The wanted format if it is there, else the most suitable one; null if none is known."""
    known = F.array(*map(F.lit, [*([wanted.lower()] if wanted else []), *FORMATS]))
    have = F.transform(formats, F.lower)
    return F.get(F.array_intersect(known, have), 0)


def cursor(offset: int, binding: dict) -> str:
    """An opaque paging position that only continues the query it came from."""
    text = json.dumps({"v": 2, "offset": offset, "bind": binding}, sort_keys=True, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def read_cursor(text: str, binding: dict) -> int:
    try:
        data = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        offset = int(data["offset"])
    except Exception as e:
        raise ValueError("not a cursor") from e
    if data.get("v") != 2 or data.get("bind") != binding or offset < 0:
        raise ValueError("the cursor belongs to another query")
    return offset


def limit_of(value: int | None, default: int, most: int) -> int:
    return default if value is None or value < 1 else min(value, most)


def save_bundle(bundles: DataFrame, action: str, name: str, expression: str | None = None) -> DataFrame:
    """Named searches after a create, update or delete; virtual libraries can't change."""
    there = bundles.where(F.col("name") == name).limit(1).collect()
    if there and there[0]["kind"] == "virtual_library":
        raise ValueError(f"{name!r} is read-only")
    if (action == "create") == bool(there):
        raise ValueError(f"{name!r} {'exists' if there else 'does not exist'}")
    rest = bundles.where(F.col("name") != name)
    if action == "delete":
        return rest
    new = bundles.sparkSession.createDataFrame([(name, expression, "saved_search")], "name string, expression string, kind string")
    return rest.select("name", "expression", "kind").unionByName(new)
