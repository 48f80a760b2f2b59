"""Exact vector search: cosine of unit vectors, summed in double in element order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(column: str, query: Sequence[float]) -> Column:
    """Dot product with a literal query; the query is a constant of the plan, so scoring is one map over the scan."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(column, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


def l2_normalize(column: str) -> Column:
    """Unit vector; the zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when(norm > 0, F.transform(column, lambda v: (v / norm).cast("float"))).otherwise(F.col(column))


def to_stored(column: str, dim: int) -> Column:
    """Truncated to ``dim`` and renormalised."""
    head = F.slice(column, 1, dim)
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when(norm > 0, F.transform(head, lambda v: (v / norm).cast("float"))).otherwise(head)


def vector_topk(rows: DataFrame, query: Sequence[float], k: int, unit: str, vector: str = "vector", allow: Column | None = None, order: Sequence[str] = ()) -> DataFrame:
    """The k best rows by score, then by ``order`` and ``unit``; ``allow`` restricts before ranking. A k below 0 is 0."""
    if allow is not None:
        rows = rows.where(allow)
    scored = rows.withColumn("score", dot(vector, query))
    return scored.orderBy(F.col("score").desc(), *order, unit).limit(max(k, 0))


def best_per_book(scored: DataFrame, book: str, unit: str, body: Column | None = None) -> DataFrame:
    """Each book's best row: a body row if it has one, then score, then least unit. One partial aggregate, no sort."""
    is_body = (F.lit(True) if body is None else body).cast("int")
    carried = [c for c in scored.columns if c != book]
    rank = F.struct(is_body.alias("_body"), F.col("score").alias("_score"), (-F.col(unit)).alias("_unit"))
    return scored.groupBy(book).agg(F.max_by(F.struct(*carried), rank).alias("_best")).select(book, *(F.col(f"_best.{c}").alias(c) for c in carried))


def library_topk(scored: DataFrame, book: str, unit: str, k: int, body: str | None = None) -> DataFrame:
    """Each book's best row with its rank from 1, until k books with a body row are reached; a k below one still gives one book."""
    from pyspark.sql import Window

    rows = scored if body else scored.withColumn("_is_body", F.lit(True))
    order = [F.col("score").desc(), F.col(book)]
    kept = body_quota(best_per_book(rows, book, unit, F.col(body or "_is_body")), max(1, k), body or "_is_body", order)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("_is_body")


def body_quota(ranked: DataFrame, k: int, body: str, order: Sequence[Column]) -> DataFrame:
    """Rows in order until k body rows are reached; other rows between them stay."""
    from pyspark.sql import Window

    top = ranked.withColumn("_body", F.coalesce(F.col(body).cast("int"), F.lit(0)))
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return top.withColumn("_seen", F.coalesce(F.sum("_body").over(before), F.lit(0))).where(F.col("_seen") < k).drop("_body", "_seen")
