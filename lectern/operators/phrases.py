"""Positional postings, phrases, and an index of them that is kept up by segments.

``postings`` adds to a keyword index where in a column each term stands.  A phrase is found
where its words' lists, each shifted by the word's place, have positions in common; it
then counts as one term for BM25.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keyword
from .segments import Segment, Snapshot, Table


@dataclass(frozen=True)
class Phrase:
    """Words in order, or one word; with ``prefix`` the last one may go on."""

    words: tuple[str, ...]
    prefix: bool = False

    @classmethod
    def of(cls, text: str) -> Phrase:
        """The words of a text as the index cuts them; a star at the end makes the last a prefix."""
        import regex

        prefix = text.rstrip().endswith("*")
        return cls(tuple(regex.findall(keyword.TOKEN, text.rstrip().rstrip("*").lower())), prefix)

    @property
    def name(self) -> str:
        return " ".join(self.words) + ("*" if self.prefix else "")


def postings(df: DataFrame, unit: str, columns: Sequence[str], carry: Sequence[str] = (), token: str = keyword.TOKEN) -> DataFrame:
    """(unit, carry, col, term, tf, len, positions): places count from 0 in each column; len counts the tokens of all columns."""
    found = keyword.counted(df, [unit, *carry], columns, token, True)
    return found.select(unit, *carry, "col", "term", "len", "positions", "tf")


def _less(n: int):
    return lambda x: x - n


def hits(index: DataFrame, unit: str, phrases: Sequence[Phrase]) -> DataFrame:
    """(unit, col, term, tf, len, starts): where each phrase stands, by column; ``term`` is the phrase's name."""
    sought = [p for p in dict.fromkeys(phrases) if p.words]
    if not sought:
        return index.limit(0).select(unit, "col", "term", "tf", "len", F.col("positions").alias("starts"))
    # The lists that some phrase needs: of a word, or of all words that begin with one.
    needs = list(dict.fromkeys((w, p.prefix and i == len(p.words) - 1) for p in sought for i, w in enumerate(p.words)))
    is_one = lambda w, prefix: F.col("term").startswith(w) if prefix else F.col("term") == w
    wanted = F.col("term").isin(*(w for w, prefix in needs if not prefix))
    for n in (n for n in needs if n[1]):
        wanted = wanted | is_one(*n)
    at = {n: f"_{i}" for i, n in enumerate(needs)}
    lists = [(F.flatten(F.collect_list(F.when(is_one(*n), F.col("positions")))) if n[1] else F.first(F.when(is_one(*n), F.col("positions")), ignorenulls=True)).alias(at[n]) for n in needs]
    # One pass and one shuffle for all phrases.
    by_unit = index.where(wanted).groupBy(unit, "col").agg(F.max("len").alias("len"), *lists)

    def starts(p: Phrase):
        shifted = [F.transform(at[w, p.prefix and i == len(p.words) - 1], _less(i)) for i, w in enumerate(p.words)]
        out = shifted[0]
        for s in shifted[1:]:
            out = F.array_intersect(out, s)
        return F.sort_array(out)

    each = F.array(*(F.struct(F.lit(p.name).alias("term"), starts(p).alias("starts")) for p in sought))
    rows = by_unit.select(unit, "col", "len", F.explode(F.filter(each, lambda x: F.size(x["starts"]) > 0)).alias("p"))
    return rows.select(unit, "col", "p.term", F.size("p.starts").cast("long").alias("tf"), "len", "p.starts")


def matching(found: DataFrame, unit: str, all_of: Sequence[Phrase] = (), any_of: Sequence[Phrase] = (), none_of: Sequence[Phrase] = ()) -> DataFrame:
    """Units that hold all, at least one, and none of some phrases, from their hits."""
    has = lambda p: F.max(F.col("term") == p.name)
    conditions = [F.coalesce(has(p), F.lit(False)) for p in all_of] + [~F.coalesce(has(p), F.lit(False)) for p in none_of]
    if any_of:
        conditions.append(F.coalesce(F.max(F.col("term").isin(*(p.name for p in any_of))), F.lit(False)))
    kept = conditions[0]
    for c in conditions[1:]:
        kept = kept & c
    # ``len`` is read too, so that this and the ranking share one shuffle of the hits.
    return found.groupBy(unit).agg(kept.alias("_k"), F.max("len").alias("_n")).where("_k and _n is not null").select(unit)


def ranked(found: DataFrame, unit: str, phrases: Sequence[Phrase], total: int, mean_len: float, weights: dict[str, float] | None = None) -> DataFrame:
    """(unit, score) by BM25, each phrase as one term."""
    return keyword.bm25(found, unit, list(dict.fromkeys(p.name for p in phrases)), total, mean_len, weights)


class Index:
    """Positional postings of units that belong to books; a commit touches the books it names only.

    Tables: ``units`` (unit, book, len and what else comes), ``postings``.
    """

    def __init__(self, spark: SparkSession, folder: str, unit: str = "chunk_id", book: str = "book_id", columns: Sequence[str] = ("body",)):
        self.unit, self.book, self.columns = unit, book, list(columns)
        self.table = Table(spark, folder, book, {"postings": ("term", "col")})

    def commit(self, rows: DataFrame | None = None, removed: DataFrame | None = None, batch: tuple[str, int] | None = None) -> Snapshot:
        """Replaces all units of the books in ``rows`` and removes those of the books in ``removed``.

        A book in ``rows`` is replaced as a whole, so all its units must come; one that has no text left goes in ``removed``.
        """
        tables = None
        if rows is not None:
            size = sum((F.size(keyword.terms_of(c)) for c in self.columns[1:]), F.size(keyword.terms_of(self.columns[0])))
            tables = {"units": rows.withColumn("len", size.cast("long")), "postings": postings(rows, self.unit, self.columns, [] if self.book == self.unit else [self.book])}

        def facts(base: Snapshot, segment: Segment | None, touched: DataFrame) -> dict[str, int]:
            """Units and tokens: what was, less what the touched books had, and what they have now."""
            counted = lambda df: df.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
            gone = counted(self.table.read("units", base).join(touched, self.book, "left_semi")) if base.segments else (0, 0)
            new = counted(self.table.spark.read.parquet(f"{self.table.folder}/segments/{segment.name}/units")) if segment else (0, 0)
            return {"units": base.facts.get("units", 0) - gone[0] + new[0], "tokens": base.facts.get("tokens", 0) - gone[1] + new[1]}

        return self.table.commit(tables, removed, facts, batch=batch)

    def postings(self, at: Snapshot | None = None) -> DataFrame:
        return self.table.read("postings", at)

    def totals(self, at: Snapshot | None = None) -> tuple[int, float]:
        """Units, and their mean number of tokens."""
        facts = (at or self.table.snapshot()).facts
        n = facts.get("units", 0)
        return n, facts.get("tokens", 0) / n if n else 0.0

    def scores(self, terms: Sequence[str | keyword.Term], weights: dict[str, float] | None = None) -> DataFrame:
        at = self.table.snapshot()
        return keyword.bm25(self.postings(at), self.unit, terms, *self.totals(at), weights)

    def search(self, all_of: Sequence[Phrase] = (), any_of: Sequence[Phrase] = (), none_of: Sequence[Phrase] = (), weights: dict[str, float] | None = None) -> DataFrame:
        """(unit, score) of units that hold all, any and none of some phrases; those sought rank them."""
        at = self.table.snapshot()
        sought = [*all_of, *any_of]
        if not sought:
            raise ValueError("a search needs a phrase to look for")
        found = hits(self.postings(at), self.unit, [*sought, *none_of])
        return ranked(found, self.unit, sought, *self.totals(at), weights).join(matching(found, self.unit, all_of, any_of, none_of), self.unit, "left_semi")


WHOLE = "*"


def search_rows(rows: DataFrame, unit: str, columns: Sequence[str], query: str, book: str = "book_id", in_book: int | None = None) -> DataFrame:
    """Annotations or notes that hold a query's words in a row, best first by ``score``; ``*`` lists all of one book.

    Null scores mark a listing, whose order is the source's.
    """
    some = rows if in_book is None else rows.where(F.col(book) == in_book)
    if query.strip() == WHOLE:
        if in_book is None:
            raise ValueError("* lists what one book has; name the book or give a word")
        return some.withColumn("score", F.lit(None).cast("double"))
    phrase = Phrase.of(query)
    if not phrase.words:
        return some.limit(0).withColumn("score", F.lit(None).cast("double"))
    listed = postings(some, unit, columns)
    n = some.select(sum((F.size(keyword.terms_of(c)) for c in columns[1:]), F.size(keyword.terms_of(columns[0]))).alias("n"))
    total = n.agg(F.count("*").alias("t"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("m")).first()
    weights = dict.fromkeys(columns, 1.0)
    return some.join(ranked(hits(listed, unit, [phrase]), unit, [phrase], total.t, total.m, weights), unit)
