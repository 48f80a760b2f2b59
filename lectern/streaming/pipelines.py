"""Structured Streaming counterparts: upserts of documents, pairing of calls, windowed counts, freshness state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import phrases


def upserts(stream: DataFrame, folder: str, checkpoint: str, key: str = "book_id", version: str = "last_modified", shards: int = 16) -> StreamingQuery:
    """Keeps the newest version of each row in a table of ``shards`` partitions; a batch rewrites the shards it touches."""

    def apply(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        newest = Window.partitionBy(key).orderBy(F.col(version).desc())
        new = batch.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
        try:
            old = spark.read.parquet(folder).join(F.broadcast(new.select("shard").distinct()), "shard", "left_semi")
            new = new.unionByName(old.select(*new.columns))
        except Exception as e:  # noqa: BLE001  the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        last = new.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
        staged = f"{folder}_staged"
        last.write.mode("overwrite").parquet(staged)
        spark.read.schema(last.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed(stream: DataFrame, index: phrases.Index, checkpoint: str, to_units: Callable[[DataFrame], DataFrame] = lambda books: books, version: str = "last_modified", deleted: str | None = None, name: str = "books") -> StreamingQuery:
    """Keeps an index in step with a stream of book versions, one row each; ``to_units`` makes a batch's books into units.

    A batch writes one segment of its changed books and merges segments of like size; what did not change is not
    touched.  The newest version of a book counts, also against what is indexed already, so late rows change nothing.  A batch that
    is repeated after a failure is in already and changes nothing.  Units must keep the ``version`` column.
    """

    def apply(batch: DataFrame, number: int) -> None:
        table = index.table
        spark = batch.sparkSession
        newest = Window.partitionBy(index.book).orderBy(F.col(version).desc_nulls_last())
        rows = batch.where(F.col(index.book).isNotNull()).withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
        at = table.snapshot()
        if at.batches.get(name, -1) >= number:
            return
        if at.segments:
            known = table.read("units", at).groupBy(F.col(index.book).alias("_book")).agg(F.max(version).alias("_known"))
            rows = rows.join(known, F.col(index.book) == F.col("_book"), "left").where(F.col("_known").isNull() | (F.col("_known") <= F.col(version))).drop("_book", "_known")
        staged = f"{table.folder}/incoming/{name}-{number}"
        rows.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(rows.schema).parquet(staged)
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        index.commit(to_units(rows.where(~gone)), rows.where(gone).select(index.book), batch=(name, number))
        table.merge()
        fs, path = table._at(f"incoming/{name}-{number}")
        fs.delete(path, True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def paired_calls(searches: DataFrame, reads: DataFrame, seconds: int = 180, late: str = "10 minutes") -> DataFrame:
    """Stream-stream join of (search_id, session, search_ts) and (read_id, session, read_ts) within the window, its end excluded."""
    s = searches.withWatermark("search_ts", late)
    r = reads.withWatermark("read_ts", late).withColumnRenamed("session", "_session")
    on = (F.col("session") == F.col("_session")) & (F.col("read_ts") >= F.col("search_ts")) & (F.col("read_ts") < F.col("search_ts") + F.make_dt_interval(secs=F.lit(seconds)))
    return s.join(r, on).drop("_session")


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by tumbling or sliding window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, ts: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))


def freshness(stream: DataFrame, key: str = "book_id", stamp: str = "last_modified", forget_after: int | None = None) -> DataFrame:
    """(key, stamp, stale) for each batch of changes: whether the key was seen before with an older stamp.

    Rows without a stamp say nothing.  A key that is not heard of for ``forget_after`` seconds is forgotten, so the state of a stream
    that never ends stays bounded; a query with such a timeout goes on by itself, so a run over what is there (availableNow) has none.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else None
        stamps = [x for b in batches for x in b[stamp].tolist() if x is not None]
        if not stamps:
            return
        newest = max(stamps)
        last = newest if seen is None else max(newest, seen)
        state.update((last,))
        if forget_after is not None:
            state.setTimeoutDuration(forget_after * 1000)
        yield pd.DataFrame({key: [k[0]], stamp: [last], "stale": [seen is not None and newest > seen]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {stamp} string, stale boolean", f"{stamp} string", "update", "NoTimeout" if forget_after is None else "ProcessingTimeTimeout")


RECENT = 20


def recent_errors(stream: DataFrame, process: str, keys: list[str], ts: str, most: int = RECENT) -> DataFrame:
    """(process, place, keys, n, first, last) after each batch: a process's last ``most`` different errors, the newest at place 1.

    An error that comes again moves to the front and counts up; the one that has not come for longest goes when there
    are too many, and counts from one if it comes again.  So the state is ``most`` entries a process.  The
    session needs a state store that keeps columns (``spark.sql.streaming.stateStore.providerClass``: RocksDB).
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    entry = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long", f"first {kinds[ts]}", f"last {kinds[ts]}"])

    class Ring(StatefulProcessor):
        def init(self, handle) -> None:
            self.ring = handle.getListState("ring", entry)

        def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
            ring = {tuple(e[: len(keys)]): tuple(e[len(keys) :]) for e in self.ring.get()} if self.ring.exists() else {}
            came = pd.concat(list(rows)).sort_values([ts, *keys], kind="stable")
            for *k, at in came[[*keys, ts]].itertuples(index=False, name=None):
                n, first, _ = ring.pop(tuple(k), (0, at, at))
                ring[tuple(k)] = (n + 1, first, at)  # the newest comes last
                if len(ring) > most:
                    del ring[next(iter(ring))]
            self.ring.put([(*k, *v) for k, v in ring.items()])
            out = [(key[0], i + 1, *k, *v) for i, (k, v) in enumerate(reversed(ring.items()))]
            yield pd.DataFrame(out, columns=[process, "place", *keys, "n", "first", "last"])

        def close(self) -> None:
            pass

    schema = f"{process} {kinds[process]}, place int, {entry}"
    return stream.select(process, *keys, ts).groupBy(process).transformWithStateInPandas(Ring(), schema, "Update", "None")
