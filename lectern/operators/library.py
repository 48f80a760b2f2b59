"""A library's index that follows its books: what is fresh stays, metadata is refreshed, changed texts are indexed anew.

Tables in segments: books, chunks, postings (with positions), sections, vectors.  An update looks at
each book's stamp and text, works on what differs, and commits that as one segment; readers of the snapshot before are not disturbed.
A book whose stamp alone differs gets a new row in ``books``; its chunks and postings stay where they are.  A chunk is cut once,
with what its book's row gives it, and written once, into its segment; what is made of chunks reads them there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import etl, index, keyword, phrases, sections, stemming, structure
from .segments import GRAVES, Segment, Snapshot, Table

COLUMNS = ("body_stem", "body", "book_meta")


@dataclass(frozen=True)
class Update:
    """The snapshot after an update, and (book_id, action): skip, refresh, replace or preserve."""

    snapshot: Snapshot
    plan: DataFrame


class Library:
    """Books (book_id, title, text, last_modified, and whatever else comes) and their index below a folder."""

    def __init__(self, spark: SparkSession, folder: str, budget: int = etl.CHUNK_CHARS):
        self.spark, self.budget = spark, budget
        self.table = Table(spark, folder, "book_id", {"postings": ("term", "col")})

    def read(self, name: str, at: Snapshot | None = None) -> DataFrame:
        """Postings are stored by a chunk's book and place, which are small where its id is not."""
        rows = self.table.read(name, at)
        return rows.select(F.xxhash64("book_id", "seq").alias("chunk_id"), *(c for c in rows.columns if c != "seq")) if name == "postings" else rows

    def plan(self, books: DataFrame, embed: bool = False, force: bool = False) -> DataFrame:
        """(book_id, action) of each book.

        A book whose stamp is known is skipped, but not by a build with vectors while it lacks some.  One whose text still is what its chunks
        hold is refreshed.  A build without vectors never replaces a book that has them: it is preserved.
        """
        at = self.table.snapshot()
        if not at.segments:
            return books.select("book_id", F.lit("replace").alias("action"))
        known = self.read("books", at).select("book_id", "last_modified", "content", "embedded_chunks", "chunk_count")
        lacks = F.lit(embed) & (F.col("embedded_chunks") < F.col("chunk_count"))
        first = index.plan(books, known.drop("embedded_chunks", "chunk_count"), force).select("book_id", "action")
        with_vectors = first.join(known.select("book_id", "embedded_chunks", "chunk_count"), "book_id", "left")
        action = F.when(F.coalesce(lacks, F.lit(False)), "replace").otherwise(F.col("action"))
        stale = F.lit(not embed) & (action == "replace") & (F.coalesce("embedded_chunks", F.lit(0)) > 0)
        told = self._staged(with_vectors.select("book_id", F.when(stale, "preserve").otherwise(action).alias("action")), at, "told")
        # Equal hashes are a hint; the spans decide.
        some = told.where("action = 'refresh'").select("book_id")
        n = some.count()
        same = index.unchanged(self._only(self.read("chunks", at), some, n), self._only(books, some, n))
        guarded = told.join(same, "book_id", "left")
        return guarded.select("book_id", F.when((F.col("action") == "refresh") & ~F.coalesce("same", F.lit(False)), "replace").otherwise(F.col("action")).alias("action"))

    def update(self, books: DataFrame, embed: bool = False, force: bool = False, removed: DataFrame | None = None, batch: tuple[str, int] | None = None) -> Update:
        """Brings the index up to date with some books; those in ``removed`` (book_id) go."""
        base = self.table.snapshot()
        plan = self._staged(self.plan(books, embed, force), base, "plan")
        n = {r.action: r["count"] for r in plan.groupBy("action").count().collect()}
        of = lambda action: plan.where(F.col("action") == action).select("book_id")
        texts = self._only(books, of("replace"), n.get("replace", 0)) if base.segments else books.where("book_id is not null")
        named = self._staged(self._named(books, of("refresh"), n["refresh"], base), base, "refreshed") if n.get("refresh") else None
        snapshot = self.table.commit(self._tables(texts, named, embed, base), removed, self._facts, base, batch, named.where("not _renamed") if named else None)
        fs, path = self.table._at(f"incoming/{base.number + 1}/refreshed")
        fs.delete(path, True)
        return Update(snapshot, plan)

    @staticmethod
    def _only(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
        """Rows of some books; few ids go to the rows, so that texts stay where they are."""
        return rows.join(F.broadcast(ids) if n <= GRAVES else ids, "book_id", "left_semi")

    def _staged(self, df: DataFrame, base: Snapshot, name: str) -> DataFrame:
        """Written once, as several tables of a commit are made from it."""
        path = f"{self.table.folder}/incoming/{base.number + 1}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _tables(self, books: DataFrame, named: DataFrame | None, embed: bool, base: Snapshot) -> dict[str, DataFrame | Callable]:
        """What is made of texts, with the rows of refreshed books; all but chunks is made of the chunks written."""
        heads = books.select("book_id", F.coalesce("title", F.lit("")).alias("title"), "last_modified", F.xxhash64("text").alias("content"), etl.detected_language("text").alias("lang"), F.length("text").alias("chars"))
        texts = books.select("book_id", F.coalesce("title", F.lit("")).alias("title"), etl.detected_language("text").alias("lang"), "text")
        placed = structure.placed_chunks(texts, "book_id", "text", self.budget, ["title", "lang"], {"body_stem": "body", "book_meta": "title"})
        chunks = placed.drop("title", "lang").withColumn("chunk_id", F.xxhash64("book_id", "seq"))
        entries = structure.chapter_table(books, "book_id", "text").select("book_id", F.row_number().over(Window.partitionBy("book_id").orderBy("char_start")).alias("seq"), "title", F.lit(1).alias("level"), "char_start")
        tree = sections.nested(sections.ordered(entries, "book_id").join(heads.select("book_id", "chars"), "book_id"), "book_id", "chars").drop("seq", "chars")
        renamed = named.where("_renamed").drop("_renamed") if named else None
        some = renamed is not None and not renamed.isEmpty()
        kept = self._refreshed(renamed, base) if some else {}
        more = lambda name, df: df.unionByName(kept[name]) if name in kept else df

        def rows(written) -> DataFrame:
            counts = written("chunks").groupBy("book_id").agg(F.count("*").alias("chunk_count"))
            made = heads.join(counts, "book_id", "left").fillna(0, ["chunk_count"]).withColumns({"embedded_chunks": F.col("chunk_count") if embed else F.lit(0).cast("long"), "stem_version": F.lit(stemming.stem_version())})
            return made.unionByName(named.drop("_renamed")) if named else made

        def vectors(written) -> DataFrame:
            made = written("chunks").join(renamed.select("book_id"), "book_id", "left_anti") if some else written("chunks")
            made = made.select("chunk_id", "book_id", etl.embedded("body").alias("vector"))
            return more("vectors", made if embed else made.limit(0))

        return {
            "books": rows,
            "chunks": more("chunks", chunks),
            "sections": lambda written: more("sections", sections.kinds_of(tree, written("chunks"), "book_id")),
            "vectors": vectors,
            "postings": lambda written: phrases.postings(written("chunks"), "seq", COLUMNS, ["book_id"]),
        }

    @staticmethod
    def _stemmed(chunks: DataFrame) -> DataFrame:
        return chunks.withColumn("book_meta", F.array_join(stemming.stems("title", "lang"), " ")).drop("title", "lang")

    def _named(self, books: DataFrame, ids: DataFrame, n: int, at: Snapshot) -> DataFrame:
        """The stored rows of books with their new titles and stamps, and whether the title is another one (``_renamed``)."""
        old = self.read("books", at)
        new = self._only(books.select("book_id", F.coalesce("title", F.lit("")).alias("_t"), F.col("last_modified").alias("_m")), ids, n)
        rows = old.join(new, "book_id")
        return rows.select(*(F.col({"title": "_t", "last_modified": "_m"}.get(c, c)).alias(c) for c in old.columns), (F.col("title") != F.col("_t")).alias("_renamed"))

    def _refreshed(self, renamed: DataFrame, at: Snapshot) -> dict[str, DataFrame]:
        """The stored rows of books under their new titles; texts are not cut, stemmed or embedded again."""
        old = {k: self.read(k, at).join(renamed.select("book_id"), "book_id", "left_semi") for k in ("chunks", "sections", "vectors")}
        chunks = self._stemmed(old["chunks"].drop("book_meta").join(renamed.select("book_id", "title", "lang"), "book_id"))
        return old | {"chunks": chunks.select(*old["chunks"].columns)}

    def _facts(self, base: Snapshot, segment: Segment | None, touched: DataFrame) -> dict[str, int]:
        """Chunks and their tokens, by what the touched books had and have."""
        def counted(postings: DataFrame, chunks: DataFrame) -> tuple[int, int]:
            return chunks.count(), postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]

        gone = counted(*(self.read(k, base).join(touched, "book_id", "left_semi") for k in ("postings", "chunks"))) if base.segments else (0, 0)
        new = counted(*(self.spark.read.parquet(f"{self.table.folder}/segments/{segment.name}/{k}") for k in ("postings", "chunks"))) if segment else (0, 0)
        return {"units": base.facts.get("units", 0) - gone[0] + new[0], "tokens": base.facts.get("tokens", 0) - gone[1] + new[1]}

    def prune(self, live: DataFrame) -> Snapshot:
        """Removes the books that are no longer there; refuses an empty list of live ones."""
        return self.table.commit(removed=index.orphans(self.read("books"), live), facts=self._facts)

    def scores(self, terms, weights: dict[str, float] | None = None) -> DataFrame:
        """(chunk_id, score) by BM25 over stems, words and titles."""
        at = self.table.snapshot()
        n = at.facts.get("units", 0)
        return keyword.bm25(self.read("postings", at), "chunk_id", terms, n, at.facts.get("tokens", 0) / n if n else 0.0, weights)
