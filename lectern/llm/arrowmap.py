"""Helpers around mapInArrow and the folder that the driver and all executors share."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a folder below the warehouse serves local sessions without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lectern"
    folder = f"{root.rstrip('/')}/lectern-{name}-{uuid.uuid4().hex[:12]}"
    if (made := _scratch.get()) is not None:
        made.append(folder)
    return folder


_scratch: ContextVar[list | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Removes, at the end, the shared folders made within."""
    folders: list[str] = []
    token = _scratch.set(folders)
    try:
        yield
    finally:
        _scratch.reset(token)
        for folder in folders:
            discard(spark, folder, [""])


def discard(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Removes tables of a shared folder that nothing reads any more."""
    jvm = spark._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}" if name else folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard_others(spark: SparkSession, folder: str, kept: list[str]) -> None:
    """Removes all tables of a shared folder but some."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    discard(spark, folder, [name for s in fs.listStatus(path) if (name := s.getPath().getName()) not in kept])


def persisted(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a table into a shared folder and reads it back, which cuts the lineage and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(run):
    """A function of batches that gives what it has used back to the system at the end of a task, as workers live on."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return wrapped


def _trim() -> None:
    """glibc keeps what is freed amid its heap; where there is no such call, nothing is done."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow of a function from one batch to dicts of column arrays."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = StructType.fromDDL(schema)

    def run(batches):
        target = to_arrow_schema(parsed)
        for batch in batches:
            for out in fn(batch):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else out[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(tidy(run), parsed)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of a stream that is sorted by ``key``; a group may span batches."""
    rest: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is None:
            if rest is not None and rest.num_rows:
                yield from _cut(rest, key)
            return
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        keys = rest.column(key).to_numpy()
        if len(keys) and keys[0] != keys[-1]:
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
            yield from _cut(rest.slice(0, last), key)
            rest = rest.slice(last)


def _cut(table: pa.Table, key: str) -> Iterator[pa.Table]:
    table = table.combine_chunks()
    keys = table.column(key).to_numpy()
    at = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    for a, b in zip(at[:-1], at[1:]):
        yield table.slice(int(a), int(b - a))


def remainder(column: str, n: int):
    """crc32 of an id written as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(0))


def binary_rows(column: pa.Array | pa.ChunkedArray, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def carried(df: DataFrame, carry: list[str], outputs: str) -> tuple[list[str], str]:
    """The carried columns but those that an output's name replaces, and the schema of both."""
    from pyspark.sql.types import StructType

    made = {f.name.lower() for f in StructType.fromDDL(outputs).fields}
    kept = [c for c in dict.fromkeys(carry) if c.lower() not in made]
    return kept, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), outputs])


def least_hashed(df: DataFrame, max_rows: int, seed: int, *keys: str) -> DataFrame:
    """The ``max_rows`` rows of least hash of the keys, with that hash as ``_order``; ties go by the keys in order.

    The keys should tell rows apart: of rows that share one all or none are under a bound.  A count gives a bound
    of the hash that about twice as many rows are under, and another sees whether enough are, so the sort sees these
    only, however many partitions there are.  Where repeated rows leave too few, the bound rises until there are enough.
    """
    order = F.xxhash64(F.lit(seed), *keys)
    n = df.select(keys[0]).count()
    share = (2 * max_rows + 100) / max(n, 1)
    while share < 1:
        under = df.where(order < int(-(1 << 63) + share * (1 << 64)))
        if under.select(keys[0]).count() >= max_rows:
            return under.withColumn("_order", order).orderBy("_order", *keys).limit(max_rows)
        share *= 8
    return df.withColumn("_order", order).orderBy("_order", *keys).limit(max_rows)
