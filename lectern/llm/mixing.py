"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

All documents of a source have the same expected number of copies, its target
over its size.  Within a source the documents stand in a fixed order: by size
class, then by a hash slot, then by id, size, a hash of the row and its columns in order.  The prefix sum of expected copies up to
a document is therefore its rank in that order times the rate; with one offset
per source, drawn from the seed and the source's name, a document is emitted once
for each integer that its prefix interval crosses.  Ordering by size class keeps a source's taken
words near its target.

Ranks never need a source in one task: strata (source, size class, slot) are
counted with partial aggregation, their running totals are summed over the few
thousand strata of a source, and only the rank inside a stratum sorts documents.
A source that holds a third of all rows spreads over all its strata.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; null ids and repeated rows are rows like any other (rows equal in
all columns differ in rank, so may differ in copies; as a multiset the result is
fixed, however the rows are partitioned); a source of size 0 has target 0 and gives no
copies; extra columns stay, but in ``mixed`` an input column of an output's name gives
way to it (``emitted`` keeps all); names starting ``_m_`` are reserved; an empty table
gives an empty result.  Targets are worked out over sources in one task: one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import persisted, shared_dir

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
SLOTS = 256


def size_of(text: str) -> Column:
    """Words of a text: maximal runs of characters other than 0x20 and 0x09-0x0D."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT) -> DataFrame:
    """(source, source_size, target) of each source, from (source, source_size).

    Filling to a common level: a source is capped at twice its size if its level
    of saturation, 2 * size / weight, is below the level that the rest then reach.
    Integer sums and one division, so any engine gives the same double.
    """
    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sizes.withColumn("_m_w", F.element_at(F.array(*map(F.lit, weights)), (place % n + 1).cast("int")).cast("long"))
    order = Window.orderBy((2 * F.col("source_size") / F.col("_m_w")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = weighted.withColumns({
        "_m_rest": share_percent * F.sum("source_size").over(whole) - 200 * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "_m_weights": F.sum("_m_w").over(after),
    })
    # The first source, in order of saturation, that the common level leaves below its cap; it and all after share what is left.
    open_ = F.col("_m_w") * F.col("_m_rest") <= 200 * F.col("source_size") * F.col("_m_weights")
    first = F.min(F.when(open_, F.struct((2 * F.col("source_size") / F.col("_m_w")).alias("a"), F.col("source").isNull().alias("b"), F.col("source").alias("c"), F.col("_m_rest").alias("rest"), F.col("_m_weights").alias("weights")))).over(whole)
    level = filled.withColumn("_m_first", first).withColumn("_m_free", F.sum(open_.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) > 0)
    share = (F.col("_m_w") * F.col("_m_first.rest")).cast("double") / (100 * F.col("_m_first.weights")).cast("double")
    return level.select("source", "source_size", F.when(F.col("_m_free"), share).otherwise((2 * F.col("source_size")).cast("double")).alias("target"))


def _offset(seed: int) -> Column:
    """One offset per source in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))), F.lit(1 << 20)) / float(1 << 20)


def _sortable(c: Column, kind: T.DataType) -> Column:
    """A column in a form that sorts, equal only for equal values: maps as their entries in order, variants as text."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(_sortable(e["key"], kind.keyType).alias("k"), _sortable(e["value"], kind.valueType).alias("v")))
        return F.sort_array(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _sortable(x, kind.elementType)) if _unsorted(kind) else c
    if isinstance(kind, T.StructType) and _unsorted(kind):
        parts = F.struct(*(_sortable(c[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)))
        return F.when(c.isNotNull(), parts)
    return F.to_json(c) if isinstance(kind, T.VariantType) else c


def _unsorted(kind: T.DataType) -> bool:
    """Whether a type holds a map or a variant."""
    return any(word in kind.simpleString() for word in ("map<", "variant"))


OUTPUTS = ("size", "source_size", "target", "copies")


def _drawn(df: DataFrame, seed: int, text: str, weights: Sequence[int], share_percent: int, prune: bool) -> DataFrame:
    """The input's rows (doc_id and source only, if ``prune``) with the four outputs under reserved names.

    The strata's counts, and with ``prune`` the sizes, are written to the shared folder, so texts are not split again.
    """
    folder = shared_dir(df.sparkSession, "mix")
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    sized = df.withColumns({"_m_size": size_of(text), "_m_row": F.xxhash64(*(hashed if not prune else ["doc_id", text]))})
    if prune:
        sized = persisted(sized.select("doc_id", "source", "_m_size", "_m_row"), folder, "sizes")
    # Eight size classes per doubling.
    sized = sized.withColumns({"_m_class": F.floor(8 * F.log2(F.col("_m_size") + 1.0)).cast("int"), "_m_slot": F.pmod(F.xxhash64("doc_id", "_m_row"), F.lit(SLOTS)).cast("int")})
    keys = ["source", "_m_class", "_m_slot"]
    strata = persisted(sized.groupBy(*keys).agg(F.count("*").alias("_m_n"), F.sum("_m_size").alias("_m_words")), folder, "strata")
    per_source = targets(strata.groupBy("source").agg(F.sum("_m_words").alias("source_size")), weights, share_percent)
    running = Window.partitionBy("source").orderBy("_m_class", "_m_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = strata.withColumn("_m_before", F.coalesce(F.sum("_m_n").over(running), F.lit(0)))
    known = starts.alias("a").join(per_source.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    known = known.select(*(F.col(f"a.{k}").alias(f"_m_k{i}") for i, k in enumerate(keys)), "_m_before", F.col("source_size").alias("_m_source_size"), F.col("target").alias("_m_target"))
    # The columns themselves decide at last: the hash takes no notice of which column a null stands in, nor of maps.
    last = [] if prune else [_sortable(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    ranked = sized.withColumn("_m_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "_m_size", "_m_row", *last)) - 1)
    # Null-safe on all keys: no filter on a derived column is inferred, so no text is split for one.
    out = ranked.join(known, [ranked[k].eqNullSafe(known[f"_m_k{i}"]) for i, k in enumerate(keys)])
    rate = F.when(F.col("_m_source_size") > 0, F.col("_m_target") / F.col("_m_source_size")).otherwise(0.0)
    rank = F.col("_m_before") + F.col("_m_rank")
    copies = F.floor((rank + 1) * rate + _offset(seed)) - F.floor(rank * rate + _offset(seed))
    # The rate is 2 at most; two doubles rounded apart must not make it a third copy.
    return out.withColumn("_m_copies", F.least(copies, F.lit(2)).cast("long"))


def mixed(df: DataFrame, seed: int = 0, text: str = "text", weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, prune: bool = False) -> DataFrame:
    """The input's rows with size, source_size, target and copies (long).

    ``prune`` returns doc_id, source and these four only: sizes are then measured once, and no text is shuffled.
    """
    kept = ["doc_id", "source"] if prune else [c for c in df.columns if c.lower() not in OUTPUTS]
    return _drawn(df, seed, text, weights, share_percent, prune).select(*kept, *(F.col(f"_m_{c}").alias(c) for c in OUTPUTS))


def emitted(df: DataFrame, seed: int = 0, text: str = "text", weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT) -> DataFrame:
    """The mix itself: each row as often as it has copies, in the input's columns."""
    drawn = _drawn(df, seed, text, weights, share_percent, False).where("_m_copies > 0")
    return drawn.withColumn("_m_copy", F.explode(F.array_repeat(F.lit(1), F.col("_m_copies").cast("int")))).select(*df.columns)
