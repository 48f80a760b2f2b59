"""Call-log analytics: pairing searches with the reads they led to, sizes, repeated errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_SECONDS = 180


def pairs(calls: DataFrame, session: str, ts: str, kind: str, search: str, read: str, key: str, window: int = WINDOW_SECONDS) -> DataFrame:
    """Each search with the first read of its session that follows within ``window`` seconds, the end excluded.

    One window over a session's calls in order: no join, so a busy session costs what it holds, and partial sorts spill.
    """
    reads = F.when(F.col(kind) == read, F.struct(F.col(ts).alias("read_ts"), F.col(key).alias("read_id")))
    later = Window.partitionBy(session).orderBy(F.col(ts), (F.col(kind) == read).cast("int"), F.col(key)).rowsBetween(1, Window.unboundedFollowing)
    out = calls.where(F.col(kind).isin(search, read)).withColumn("_next", F.first(reads, ignorenulls=True).over(later)).where(F.col(kind) == search)
    near = F.col("_next.read_ts") < F.col(ts) + F.make_dt_interval(secs=F.lit(window))
    return out.where(near).select(F.col(key).alias("search_id"), F.col(session).alias("session"), F.col(ts).alias("search_ts"), F.col("_next.read_id").alias("read_id"), F.col("_next.read_ts").alias("read_ts"))


def opened_hits(searches: DataFrame, reads: DataFrame, hits: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """(search_id, read_id, rank) of each search with the first read in its session and window that opens one of its hits.

    ``searches`` (search_id, session, search_ts), ``reads`` (read_id, session, read_ts, book_id), ``hits`` (search_id, book_id,
    rank).  Hits and reads of one book in a session stand in order of time, and each hit sees the next read: no search
    meets all reads, however busy its session is.
    """
    none = lambda kind: F.lit(None).cast(kind)
    h = searches.join(hits, "search_id").select("session", "book_id", F.col("search_ts").alias("_at"), F.lit(1).alias("_side"), F.struct("search_id", "rank").alias("_hit"), none(reads.select(F.struct("read_ts", "read_id")).schema[0].dataType).alias("_read"))
    r = reads.select("session", "book_id", F.col("read_ts").alias("_at"), F.lit(2).alias("_side"), none(h.schema["_hit"].dataType).alias("_hit"), F.struct("read_ts", "read_id").alias("_read"))
    later = Window.partitionBy("session", "book_id").orderBy("_at", "_side", "_read").rowsBetween(1, Window.unboundedFollowing)
    seen = h.unionByName(r).withColumn("_next", F.first("_read", ignorenulls=True).over(later)).where("_side = 1")
    near = F.col("_next.read_ts") < F.col("_at") + F.make_dt_interval(secs=F.lit(window))
    first = F.min(F.struct(F.col("_next.read_ts"), F.col("_next.read_id"), F.col("_hit.rank").alias("rank")))
    return seen.where(near).groupBy(F.col("_hit.search_id").alias("search_id")).agg(first.alias("f")).select("search_id", F.col("f.read_id").alias("read_id"), F.col("f.rank").alias("rank"))


def collapsed(errors: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Repeats folded to the newest, with their number."""
    return errors.groupBy(*keys).agg(F.count("*").alias("n"), F.max(ts).alias("last")).orderBy(F.col("last").desc(), *keys)


def sizes(calls: DataFrame, group: str, size: str) -> DataFrame:
    """Low median, 95th percentile by nearest rank, and maximum."""
    from .evaluation import low_median, percentile_nearest

    return calls.groupBy(group).agg(F.count("*").alias("n"), low_median(size).alias("low_median"), percentile_nearest(size, 0.95).alias("p95"), F.max(size).alias("max"))
