"""Keyword index and BM25 ranking.

``postings`` is the index: (unit, col, term, tf, len).  ``stored`` writes it in runs sorted by
term, so a search reads the pages of its few terms only.  A query is planned on the
driver from its own words and their document frequencies, never from a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stemming

K1, B = 1.2, 0.75
WEIGHTS = {"body_stem": 1.0, "body": 1.0, "book_meta": 0.5}
STEMMED = ("body_stem", "book_meta")
PRUNE_SHARE, CHUNK_POOL, POOL_FACTOR = 0.5, 200, 20
# What the index keeps together as one token, so c++, node.js and api_v2 stay whole.
TOKEN = r"[\p{L}\p{N}\p{M}_+#.\-]+"


def terms_of(column: str, token: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(f"({token})"), 1)


# Tokens that one run of postings is made from: what a task holds at a time.
RUN_TOKENS = 1 << 21


def _run(batches: list, rows: int, columns: Sequence[str], keys: Sequence[str], target, places: bool):
    """The postings of some units as batches sorted by term and unit, one for each column."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    whole = pa.Table.from_batches(batches).combine_chunks()
    lists = [(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c) for c in (whole.column(f"_t{i}") for i in range(len(columns)))]
    sizes = [pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in lists]
    length = sum(sizes)
    for name, terms, size in zip(columns, lists, sizes):
        known = terms.flatten().dictionary_encode()
        if not len(known):
            continue
        codes, names = known.indices.to_numpy(), known.dictionary
        by_name = np.empty(len(names), np.int64)
        by_name[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        starts = np.cumsum(size) - size
        key = by_name[codes] * rows + np.repeat(np.arange(rows), size)
        order = np.argsort(key, kind="stable")  # so places stay in order
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(first, len(key))
        unit = key[first] % rows
        made = {k: whole.column(k).take(pa.array(unit)).combine_chunks() for k in keys}
        made |= {"col": pa.array([name]).take(pa.array(np.zeros(len(first), np.int32))), "term": names.take(pa.array(codes[order[first]])), "len": pa.array(length[unit]), "tf": pa.array(np.diff(ends))}
        if places:
            at = (order - np.repeat(starts, size)[order]).astype(np.int32)
            made["positions"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at))
        arrays = [made[f.name].chunk(0) if isinstance(made[f.name], pa.ChunkedArray) else made[f.name] for f in target]
        yield pa.RecordBatch.from_arrays([x if x.type == f.type else x.cast(f.type) for x, f in zip(arrays, target)], schema=target)


def counted(df: DataFrame, keys: Sequence[str], columns: Sequence[str], token: str, places: bool) -> DataFrame:
    """(keys, col, term, len, tf, positions) of units, one a row: all terms of a unit are in its row, so nothing is shuffled.

    A task makes its rows in runs of about RUN_TOKENS tokens, each sorted by column, term and unit; so a table of them that is
    written as it is tells a search by the bounds of its row groups and pages which few hold a term.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    listed = df.select(*keys, *(terms_of(c, token).alias(f"_t{i}") for i, c in enumerate(columns)))
    more = [T.StructField("positions", T.ArrayType(T.IntegerType(), False))] if places else []
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("col", T.StringType()), T.StructField("term", T.StringType()), T.StructField("len", T.IntegerType()), T.StructField("tf", T.LongType()), *more])
    names = list(columns)

    def run(batches):
        import pyarrow.compute as pc

        target = to_arrow_schema(schema)
        held, rows, tokens = [], 0, 0
        for batch in batches:
            at = 0
            ends = sum(pc.list_value_length(batch.column(f"_t{i}")).to_numpy(zero_copy_only=False).astype("int64") for i in range(len(names))).cumsum() if batch.num_rows else []
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                stop = min(max(at + 1, int(ends.searchsorted(before + RUN_TOKENS - tokens, "right"))), batch.num_rows)
                held.append(batch.slice(at, stop - at))
                rows, tokens, at = rows + stop - at, tokens + int(ends[stop - 1]) - before, stop
                if tokens >= RUN_TOKENS or at < batch.num_rows:
                    yield from _run(held, rows, names, keys, target, places)
                    held, rows, tokens = [], 0, 0
        if held:
            yield from _run(held, rows, names, keys, target, places)

    return listed.mapInArrow(run, schema)


def postings(df: DataFrame, unit: str, columns: Sequence[str], token: str = TOKEN) -> DataFrame:
    """(unit, col, term, tf, len): terms in lower case by column; len counts the tokens of all columns of the unit."""
    return counted(df, [unit], columns, token, False).select(unit, "col", "term", "len", "tf")


@dataclass(frozen=True)
class Index:
    """Stored postings, the number of units, and the mean of their tokens."""

    postings: DataFrame
    unit: str
    total: int
    mean_len: float

    def frequencies(self, terms: Iterable[str], column: str = "body_stem") -> dict[str, int]:
        """Units that hold each of a query's terms."""
        some = self.postings.where(F.col("term").isin(*set(terms)) & (F.col("col") == column))
        return {r.term: r.df for r in some.groupBy("term").agg(F.count("*").alias("df")).collect()}


def stored(df: DataFrame, unit: str, columns: Sequence[str], folder: str, token: str = TOKEN) -> Index:
    """Writes the postings, in runs sorted by term, and how many units and tokens there are; units without a token count too."""
    spark = df.sparkSession
    rows = postings(df, unit, columns, token)
    rows.write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{folder}/postings")
    tokens = spark.read.schema(rows.schema).parquet(f"{folder}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"))
    facts = df.agg(F.count("*").alias("total")).crossJoin(F.broadcast(tokens))  # one row each
    facts.select("total", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("mean_len")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")
    return opened(spark, unit, folder, rows.schema)


def opened(spark, unit: str, folder: str, schema=None) -> Index:
    reader = spark.read if schema is None else spark.read.schema(schema)
    t = spark.read.parquet(f"{folder}/totals").first()
    return Index(reader.parquet(f"{folder}/postings"), unit, t.total, t.mean_len)


def term_stats(index: DataFrame, unit: str) -> DataFrame:
    """Units that hold each term, by column."""
    return index.groupBy("col", "term").agg(F.count("*").alias("df"))


@dataclass(frozen=True)
class Term:
    """A term to search, and the columns it may be found in; None for all."""

    text: str
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Plan:
    """Terms to search, each once, and those left out with the reason: duplicate or too-common."""

    terms: tuple[Term, ...]
    dropped: tuple[tuple[str, str], ...] = ()


def identifiers(query: str) -> list[str]:
    """Raw tokens that hold one of + # . - and a letter or digit, in lower case, without points at the end."""
    tokens = (t.rstrip(".").lower() for t in regex.findall(TOKEN, query))
    return list(dict.fromkeys(t for t in tokens if re.search(r"[+#.\-]", t) and regex.search(r"[\p{L}\p{N}]", t)))


def match_terms(query: str, languages: frozenset[str | None] | None = None) -> Plan:
    """The plan without statistics: all stems, then each identifier as it is and with a point behind, all columns."""
    stems = [s for word in stemming.query_words(query, languages) for s in word.stems]
    forms = [f for t in identifiers(query) for f in (t, f"{t}.")]
    return Plan(tuple(Term(t) for t in dict.fromkeys([*stems, *forms])))


def plan_query(query: str, df: dict[str, int], total: int, languages: frozenset[str | None] | None = None, share: float = PRUNE_SHARE) -> Plan:
    """Distinct stems but those in more than ``share`` of all units, searched in the stemmed columns; identifier forms in all.

    Kept are words in double quotes, a lone stem, and the rarest if all would go.  An identifier goes if all its stems went.
    """
    spans = [(m.start(1), m.end(1)) for m in re.finditer(r'"([^"]*)"', query)]
    words = [(s, any(a <= w.start and w.end <= b for a, b in spans) and i == 0) for w in stemming.query_words(query, languages) for i, s in enumerate(w.stems)]
    stems = list(dict.fromkeys(s for s, _ in words))
    quoted = {s for s, inside in words if inside}
    common = {s for s in stems if s not in quoted and df.get(s, 0) > share * total} if len(stems) > 1 and total > 0 else set()
    if stems and len(common) == len(stems):
        common.remove(min(stems, key=lambda s: df.get(s, 0)))
    dropped, seen = [], set()
    for s, _ in words:
        if s in seen:
            dropped.append((s, "duplicate"))
        elif s in common:
            dropped.append((s, "too-common"))
        seen.add(s)
    forms = []
    for t in identifiers(query):
        own = [s for w in stemming.query_words(t, languages) for s in w.stems]
        if own and all(s in common for s in own):
            dropped.append((t, "too-common"))
        else:
            forms += [Term(t), Term(f"{t}.")]
    return Plan((*(Term(s, STEMMED) for s in stems if s not in common), *forms), tuple(dropped))


def bm25(index: DataFrame, unit: str, terms: Sequence[str | Term], total: int, mean_len: float, weights: dict[str, float] | None = None) -> DataFrame:
    """(unit, score): negative, least best; the weight of a term in half of the units or more is 1e-6, as common terms must not reward absence.

    ``total`` units with ``mean_len`` tokens on the average, over all columns, as ``len`` of a posting is.
    """
    weights = weights or WEIGHTS
    wanted = [t if isinstance(t, Term) else Term(t) for t in terms]
    weight = F.coalesce(*(F.when(F.col("col") == c, F.lit(float(w))) for c, w in weights.items()), F.lit(0.0))
    here = F.lit(False)
    for columns in dict.fromkeys(t.columns for t in wanted):
        mine = F.col("term").isin(*dict.fromkeys(t.text for t in wanted if t.columns == columns))
        here = here | (mine if columns is None else mine & F.col("col").isin(*columns))
    hits = index.where(F.col("term").isin(*dict.fromkeys(t.text for t in wanted)) & here & F.col("col").isin(*weights))
    by_unit = hits.groupBy(unit, "term").agg(F.sum(weight * F.col("tf")).alias("tfw"), F.max("len").alias("len"))
    df = by_unit.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
    norm = F.lit(K1) * (1 - B + B * F.col("len") / float(mean_len or 1.0))
    term_score = idf * F.col("tfw") * (K1 + 1) / (F.col("tfw") + norm)
    # As many rows, and values a unit, as the query has terms; summed in order of size, so equal units score alike.
    parts = F.sort_array(F.collect_list(term_score))
    return by_unit.join(F.broadcast(df), "term").groupBy(unit).agg(parts.alias("_p")).select(unit, (-F.aggregate("_p", F.lit(0.0), lambda a, x: a + x)).alias("score"))


def by_score(*then: str) -> list[Column]:
    """Best first; scores equal to nine digits tie."""
    return [F.round("score", 9), *(F.col(c) for c in then)]


def search(index: Index, terms: Sequence[str | Term], k: int, allow: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Top k by BM25, then unit; ``allow`` (units) restricts before ranking."""
    scored = bm25(index.postings, index.unit, terms, index.total, index.mean_len, weights)
    if allow is not None:
        scored = scored.join(allow, index.unit, "left_semi")
    return scored.orderBy(*by_score(index.unit)).limit(max(k, 0))


def best_passages(index: Index, passages: DataFrame, terms: Sequence[str | Term], k: int, allow: DataFrame | None = None) -> DataFrame:
    """Each book's best passage by BM25 among the best max(20 k, 200) passages: a body passage if one is there; k body books, others between them stay.

    ``passages`` has the index's unit, book_id and body (boolean).  A k below one still gives one book.
    """
    from pyspark.sql import Window

    from .vectors import best_per_book, body_quota

    scored = bm25(index.postings, index.unit, terms, index.total, index.mean_len).join(passages, index.unit)
    if allow is not None:
        scored = scored.join(allow, "book_id", "left_semi")
    pool = scored.withColumn("score", F.round("score", 9)).orderBy("score", "book_id", index.unit).limit(max(k * POOL_FACTOR, CHUNK_POOL))
    best = best_per_book(pool.withColumn("score", -F.col("score")), "book_id", index.unit, F.col("body")).withColumn("score", -F.col("score"))
    order = [F.col("score"), F.col("book_id"), F.col(index.unit)]
    return body_quota(best, max(1, k), "body", order).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
