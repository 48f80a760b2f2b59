"""Merging ranked lists, rerank admission, tiers and confidence."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, POOL, RERANK_PAIRS, SECOND_BOOKS = 60, 50, 30, 5
COSINE_FLOOR, RERANK_FLOOR = 0.78, 0.3


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rank from 1 of a list that is already cut to its pool."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rrf(lists: Sequence[DataFrame], keys: Sequence[str], weights: Sequence[float] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (keys, rank) lists: sum of w / (k + rank); a list of weight 0 adds nothing."""
    weights = weights or [1.0] * len(lists)
    parts = [d.select(*keys, (F.lit(float(w)) / (k + F.col("rank"))).alias("_part")) for d, w in zip(lists, weights) if w]
    if not parts:
        return lists[0].select(*keys).limit(0).withColumn("fused", F.lit(0.0))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(*keys).agg(F.sum("_part").alias("fused"))


def hybrid(vector: DataFrame, keyword: DataFrame, keys: Sequence[str], k: int, pool: int = POOL, weights: Sequence[float] = (1.0, 1.0), rrf_k: int = RRF_K) -> DataFrame:
    """Both halves (keys, score, rank) fused: fused score, both ranks, cosine where known, and where a hit comes from. Each half is read once."""
    v, w = vector.where(F.col("rank") <= pool), keyword.where(F.col("rank") <= pool)
    both = v.select(*keys, F.col("rank").alias("vector_rank"), F.col("score").alias("cosine")).join(w.select(*keys, F.col("rank").alias("keyword_rank")), list(keys), "full_outer")
    term = lambda c, weight: F.coalesce(F.lit(float(weight)) / (rrf_k + F.col(c)), F.lit(0.0))
    counted = [(c, x) for c, x in zip(("vector_rank", "keyword_rank"), weights) if x]
    there = F.lit(False)
    for c, _ in counted:
        there = there | F.col(c).isNotNull()
    source = F.when(F.col("vector_rank").isNull(), "keyword").when(F.col("keyword_rank").isNull(), "vector").otherwise("both")
    fused = sum((term(c, x) for c, x in counted), F.lit(0.0))
    return both.where(there).withColumns({"fused": fused, "found_by": source}).orderBy(F.col("fused").desc(), *keys).limit(max(k, 0))


def second_candidates(fused: DataFrame, keyword: DataFrame, book: str, unit: str, books: int = SECOND_BOOKS) -> DataFrame:
    """A second passage for a book: the keyword half's, if that ranks the book in its first few, differs, and both are body text."""
    alt = keyword.where(F.col("rank") <= books).select(book, F.col(unit).alias("alt_unit"), F.col("body").alias("_alt_body"))
    out = fused.join(alt, book, "left")
    take = (F.col("alt_unit") != F.col(unit)) & F.col("_alt_body") & F.col("body")
    return out.withColumn("alt_unit", F.when(take, F.col("alt_unit"))).drop("_alt_body")


def admitted(candidates: DataFrame, pairs: str, order: Sequence[Column | str], limit: int = RERANK_PAIRS) -> DataFrame:
    """The prefix whose pairs fit the rerank budget; it ends at the first row that doesn't fit."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return candidates.withColumn("_used", F.sum(pairs).over(w)).where(F.col("_used") <= limit).drop("_used")


def logistic(x: float) -> float:
    """The logistic function of any logit; exp only ever takes what is not positive."""
    e = math.exp(-abs(x))
    return 1 / (1 + e) if x >= 0 else e / (1 + e)


def reranked(pool: DataFrame, scorer: Callable[[str, list[str]], list[float]] | None, query: str, k: int, keys: Sequence[str], limit: int = RERANK_PAIRS, weak_after_body: bool = True, tolerant: bool = False) -> DataFrame:
    """The k first hits of a fused pool (keys, fused, text, alt_text, tier) after a reranker, with rerank, other_rerank, used_alt and place.

    ``scorer`` gives logits of a query and passages; each pair is scored by itself, whatever stands beside it, and becomes a
    score from 0 to 1.  Hits of tier strong take no part unless all are strong.  Of the others, in fused order, as many
    take part as their passages fit the limit.  A second passage wins only if it scores strictly higher.  The tail keeps
    the fused order, weak hits follow body hits, strong ones come last.  Without a scorer body hits come first in fused
    order, as with ``tolerant`` where a pair's score fails, for then no score counts.  A pool has at most some
    dozens of rows, so windows over all of it are meant.
    """
    by_fused = [F.col("fused").desc(), *keys]
    all_rows = Window.partitionBy()
    if scorer is None:
        out = pool.withColumns({"rerank": F.lit(None).cast("double"), "other_rerank": F.lit(None).cast("double"), "used_alt": F.lit(False), "_band": (F.col("tier") != "body").cast("int")})
        order = [F.col("_band"), *by_fused]
    else:
        strong = (F.col("tier") == "strong") & (F.max((F.col("tier") != "strong").cast("int")).over(all_rows) == 1)
        pairs = F.when(F.col("alt_text").isNull(), 1).otherwise(2)
        used = F.sum(F.when(F.col("_strong"), 0).otherwise(pairs)).over(Window.orderBy(*by_fused).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        marked = pool.withColumn("_strong", strong).withColumn("_used", used)
        # Sums only grow, so those within the limit are a prefix.
        marked = marked.withColumn("_in", ~F.col("_strong") & (F.col("_used") <= limit))

        @F.pandas_udf("double")
        def scored(text: pd.Series, wanted: pd.Series) -> pd.Series:
            def one(t: str) -> float | None:
                try:
                    return logistic(float(scorer(query, [t])[0]))
                except Exception:  # noqa: BLE001
                    if not tolerant:
                        raise
                    return None

            return pd.Series([one(t) if w and t is not None else None for t, w in zip(text, wanted)], dtype="float64")

        s = marked.withColumns({"_main": scored("text", "_in"), "_alt": scored("alt_text", "_in")})
        if tolerant:
            missing = lambda t, x: F.col("_in") & F.col(t).isNotNull() & F.coalesce(F.col(x).isNull() | F.isnan(x), F.lit(True))
            failed = F.max((missing("text", "_main") | missing("alt_text", "_alt")).cast("int")).over(all_rows) == 1
            s = s.withColumn("_failed", failed).withColumns({c: F.when(~F.col("_failed"), F.col(c)) for c in ("_main", "_alt")})
            s = s.withColumns({"_strong": F.when(F.col("_failed"), F.col("tier") == "strong").otherwise(F.col("_strong")), "_in": F.col("_in") & ~F.col("_failed")})
        alt = F.coalesce(F.col("_alt") > F.col("_main"), F.lit(False))
        band = F.when(F.col("_strong"), 2).when(F.lit(weak_after_body) & (F.col("tier") != "body"), 1).otherwise(0)
        if tolerant:
            band = F.when(F.col("_failed"), (F.col("tier") != "body").cast("int")).otherwise(band)
        out = s.withColumns({"used_alt": alt, "rerank": F.when(alt, F.col("_alt")).otherwise(F.col("_main")), "other_rerank": F.when(alt, F.col("_main")).otherwise(F.col("_alt")), "_band": band})
        order = [F.col("_band"), (~F.col("_in")).cast("int"), F.col("rerank").desc_nulls_last(), *(F.when(F.col("_in"), F.col(c)) for c in keys), *by_fused]
    placed = out.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") <= k)
    return placed.drop("_band", "_strong", "_used", "_in", "_main", "_alt", "_failed")


def adaptive_pairs(vector: DataFrame, keyword: DataFrame, keys: Sequence[str], top: int = 3, pairs: int = 10) -> DataFrame:
    """One row: the rerank budget, smaller when both halves share their first rows."""
    shared = vector.where(F.col("rank") <= top).join(keyword.where(F.col("rank") <= top), list(keys), "left_semi").agg(F.count("*").alias("n"))
    return shared.select(F.when(F.col("n") >= top, pairs).otherwise(RERANK_PAIRS).alias("pairs"))


def tier(kind: Column, strong: Column) -> Column:
    """body, weak or strong matter; unknown kinds are body."""
    return F.when(F.coalesce(kind, F.lit("body")) == "body", "body").when(strong, "strong").otherwise("weak")


def low_confidence(hits: DataFrame, text: bool = True) -> DataFrame:
    """One row: whether the best cosine or the best rerank score, body rows first, is below its floor."""
    best = lambda c: F.coalesce(F.max(F.when(F.col("body"), F.col(c))), F.max(c))
    out = hits.agg(best("cosine").alias("max_cosine"), best("rerank").alias("max_rerank"))
    low = F.coalesce(F.col("max_rerank") < RERANK_FLOOR, F.lit(False))
    return out.withColumn("low_confidence", low | F.coalesce(F.col("max_cosine") < COSINE_FLOOR, F.lit(False)) if text else low)


def surviving(hits: DataFrame, live: DataFrame, book: str, trusted: bool = True) -> DataFrame:
    """Hits whose book is still there; an untrusted answer drops nothing."""
    return hits.join(live.select(book), book, "left_semi") if trusted else hits


def body_first(tier_column: str, *order: Column | str) -> list[Column]:
    """An order in which body hits come first and all else keeps its place."""
    return [(F.col(tier_column) != "body").cast("int"), *(F.col(c) if isinstance(c, str) else c for c in order)]


def named(hits: DataFrame, books: DataFrame, book: str) -> DataFrame:
    """Hits with their book's title and authors; a book that is not there is named by its id."""
    out = hits.join(books.select(book, "title", "authors"), book, "left")
    return out.withColumns({"title": F.coalesce("title", F.concat(F.lit("book "), F.col(book).cast("string"))), "authors": F.coalesce("authors", F.array().cast("array<string>"))})


# What a search says when it can't do all that was asked.
NO_VECTORS, SHORT_QUERY, NO_RERANK = "no vectors yet: keyword search only", "a query of under three characters finds little by meaning", "not reranked: fused order"


def effective_mode(mode: str, n_vectors: int, query: str) -> tuple[str, list[str]]:
    """What a search can run as, and its notes: hybrid without vectors is keyword search; vector search without them is an error."""
    if mode == "vector" and not n_vectors:
        raise ValueError("the index has no vectors")
    notes = [SHORT_QUERY] if mode != "keyword" and len(query.strip()) < 3 else []
    return ("keyword", [NO_VECTORS, *notes]) if mode == "hybrid" and not n_vectors else (mode, notes)


def reranked_or_fused(pool: DataFrame, scorer: Callable[[str, list[str]], list[float]] | None, query: str, k: int, keys: Sequence[str], enabled: bool = True, **options) -> tuple[DataFrame, list[str]]:
    """A reranked list, or the fused order with a note if reranking is switched off, missing, or fails on a first pair.

    A scorer that fails later, on an executor, leaves the fused order too; ``rerank`` is then null throughout.
    """
    if scorer is not None and enabled:
        try:
            scorer(query, [query])
            return reranked(pool, scorer, query, k, keys, tolerant=True, **options), []
        except Exception as e:  # noqa: BLE001  a search never fails for want of a reranker
            return reranked(pool, None, query, k, keys), [f"{NO_RERANK} ({e})"]
    return reranked(pool, None, query, k, keys), [NO_RERANK] if scorer is not None else []
