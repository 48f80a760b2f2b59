"""Index build and upkeep over Parquet tables: skip, refresh, replace, prune, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import etl, keyword, stemming, structure

VERSION = 1


def plan(books: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """Each book with what a build does to it: skip (fresh), refresh (metadata only), or replace."""
    i = index.select("book_id", F.col("last_modified").alias("_at"), F.col("content").alias("_content"))
    fresh = F.col("_at").eqNullSafe(F.col("last_modified")) & F.col("_at").isNotNull()
    action = F.when(F.lit(force) | F.col("_content").isNull(), "replace").when(fresh, "skip").when(F.col("_content") == F.col("content"), "refresh").otherwise("replace")
    return books.withColumn("content", F.xxhash64("text")).join(i, "book_id", "left").withColumn("action", action).drop("_at", "_content")


def build(books: DataFrame, folder: str, budget: int = etl.CHUNK_CHARS, embed: bool = False) -> dict[str, DataFrame]:
    """Chunks with matter kinds, postings, sections and book rows of (book_id, title, text, last_modified), written below a folder.

    ``embed`` adds the vectors of the built-in embedder.  A book whose text can't be read structured gives no sections, but its chunks.
    """
    spark = books.sparkSession
    at = lambda name: f"{folder}/{name}"
    heads = books.select("book_id", "title", "last_modified", F.xxhash64("text").alias("content"), etl.detected_language("text").alias("lang"))
    placed = structure.placed_chunks(books, "book_id", "text", budget)
    meta = heads.select("book_id", F.coalesce("title", F.lit("")).alias("_title"), "lang")
    rows = placed.join(meta, "book_id").withColumns({
        "chunk_id": F.xxhash64("book_id", "seq"),
        "body_stem": F.array_join(stemming.stems("body", "lang"), " "),
        "book_meta": F.array_join(stemming.stems("_title", "lang"), " "),
    }).drop("_title")
    rows.write.mode("overwrite").parquet(at("chunks"))
    stored = spark.read.schema(rows.schema).parquet(at("chunks"))
    found = keyword.stored(stored, "chunk_id", ["body_stem", "body", "book_meta"], folder)
    structure.chapter_table(books, "book_id", "text").write.mode("overwrite").parquet(at("sections"))
    counts = stored.groupBy("book_id").agg(F.count("*").alias("chunk_count"))
    heads.join(counts, "book_id", "left").fillna(0, ["chunk_count"]).withColumn("stem_version", F.lit(stemming.stem_version())).write.mode("overwrite").parquet(at("books"))
    if embed:
        stored.select("chunk_id", "book_id", etl.embedded("body").alias("vector")).write.mode("overwrite").parquet(at("vectors"))
    spark.createDataFrame([("version", str(VERSION))], "key string, value string").coalesce(1).write.mode("overwrite").parquet(at("meta"))
    return {n: spark.read.parquet(at(n)) for n in ("chunks", "sections", "books", *(["vectors"] if embed else []))} | {"postings": found.postings}


def check_version(spark: SparkSession, folder: str) -> None:
    found = {r.key: r.value for r in spark.read.parquet(f"{folder}/meta").collect()}
    if found.get("version") != str(VERSION):
        raise ValueError(f"the index has version {found.get('version')}, this engine {VERSION}; build it again")


def replaced(table: DataFrame, rows: DataFrame, key: str = "book_id") -> DataFrame:
    """A table with all rows of some books exchanged."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def refreshed(index: DataFrame, books: DataFrame, columns: list[str]) -> DataFrame:
    """Index rows with new metadata where there is any."""
    new = books.select("book_id", *(F.col(c).alias(f"_{c}") for c in columns))
    return index.join(new, "book_id", "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in index.columns))


def unchanged(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, same): whether every chunk is still what the text has at its span, with nothing but white space between and behind.

    Chunks come to their text as spans with the SHA-256 of their bodies, one row a book.
    """
    span = F.struct("char_start", "char_end", F.unhex(F.sha2("body", 256)).alias("sum"))
    spans = chunks.groupBy("book_id").agg(F.sort_array(F.collect_list(span)).alias("_s"))
    j = books.select("book_id", "text").join(spans, "book_id")
    blank = lambda a, b: F.trim(F.regexp_replace(F.substring("text", a + 1, F.greatest(b - a, F.lit(0))), r"\s+", "")) == ""
    before = lambda i: F.when(i > 0, F.get("_s", i - 1)["char_end"]).otherwise(0)
    held = lambda x: F.unhex(F.sha2(F.substring("text", x["char_start"] + 1, x["char_end"] - x["char_start"]), 256)) == x["sum"]
    each = F.transform("_s", lambda x, i: held(x) & (before(i) <= x["char_start"]) & blank(before(i), x["char_start"]))
    last = F.element_at("_s", -1)["char_end"]
    return j.select("book_id", (F.forall(each, lambda x: x) & blank(last, F.length("text"))).alias("same"))


def stale_stems(index: DataFrame) -> DataFrame:
    """Books whose stems were made by another version of the packs, or nobody knows which."""
    return index.where(~F.col("stem_version").eqNullSafe(F.lit(stemming.stem_version()))).select("book_id")


def languages(index: DataFrame) -> DataFrame:
    """Distinct languages of the books; that of a book without one is null."""
    return index.select("lang").distinct()


def covered(chunks: DataFrame) -> DataFrame:
    """(book_id, chars, page_breaks, last_end): characters in chunks, form feeds among them, and where the last chunk ends."""
    breaks = F.length("body") - F.length(F.replace("body", F.lit("\f"), F.lit("")))
    return chunks.groupBy("book_id").agg(F.sum(F.col("char_end") - F.col("char_start")).alias("chars"), F.sum(breaks).alias("page_breaks"), F.max("char_end").alias("last_end"))


def orphans(index: DataFrame, live: DataFrame) -> DataFrame:
    """Indexed ids that are no longer live; refuses an empty list of live ids."""
    if live.isEmpty():
        raise ValueError("no live books: nothing is pruned")
    return index.select("book_id").distinct().join(live.select("book_id"), "book_id", "left_anti")


def coverage(index: DataFrame, live: DataFrame) -> DataFrame:
    """One row: live books, indexed ones, those still live, chunks, and books without a language."""
    i = index.join(live.select("book_id").withColumn("_live", F.lit(1)), "book_id", "left")
    facts = i.agg(F.count("*").alias("indexed"), F.sum(F.coalesce("_live", F.lit(0))).alias("indexed_live"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))
    return facts.join(live.agg(F.count("*").alias("live")))


def missing_vectors(index: DataFrame, vectors: DataFrame) -> DataFrame:
    """Books with fewer vectors than chunks; a stored count wins over counting."""
    counted = vectors.groupBy("book_id").agg(F.count("*").alias("_n"))
    return index.join(counted, "book_id", "left").where(F.coalesce("embedded_chunks", "_n", F.lit(0)) < F.col("chunk_count")).select("book_id")


def record_done(done: DataFrame, folder: str) -> None:
    """Appends the ids of finished books (book_id) to a build's progress."""
    done.select("book_id").write.mode("append").parquet(folder)


def remaining(books: DataFrame, folder: str) -> DataFrame:
    """Books that a build which was broken off has not finished; all of them if it never began."""
    from pyspark.errors import AnalysisException

    try:
        done = books.sparkSession.read.schema(books.select("book_id").schema).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return books
    return books.join(done.distinct(), "book_id", "left_anti")


def guarded(index: DataFrame, rows: DataFrame, embedded: str = "embedded_chunks") -> DataFrame:
    """New rows of a build without vectors, but for books whose index has vectors already: those are preserved."""
    kept = index.where(F.coalesce(embedded, F.lit(0)) > 0).select("book_id")
    return rows.join(kept, "book_id", "left_anti")
