"""Exact k-means on integer vectors, with triangle-inequality bounds that spare distances.

Components become integers floor(SCALE * x), so distances, sums and centroids are exact
and any partitioning gives the same clusters.  Each vector carries an upper bound of the
distance to its centroid and a lower bound of that to every centroid.  A round moves the
bounds by what the centroids moved; a centroid is looked at only if the upper bound reaches
the vector's lower bound for it and half its distance from the vector's own centroid, and
the vector not at all if it does not reach half the distance of any other.  Bounds are
rounded outwards and both tests are strict, so a centroid as near as the own one is never
passed over and ties go to the smaller number.  Squared distances that decide are integers.

A round is one map over the vectors' table with their bounds, which is written to the shared folder (the
one before it goes); each task adds one row of its clusters' counts and sums, so what is
shuffled and sent to the driver has k * (components + 1) numbers.  No round after one that
moves no centroid changes anything, so rounds end there.

Defined results: vectors that are null, of another length, or that hold null or non-finite
components take no part; rows of null id are clustered, but give no starting centroid while rows with an id are left;
repeated rows count as often as they occur; fewer rows than k give as many clusters; empty clusters keep their
centroid; other columns are ignored; an empty table gives no rows.  An
integer beyond 2**27 raises ArithmeticError, as squared distances must fit 64 bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .arrowmap import discard, persisted, shared_dir, tidy

K, ROUNDS, SCALE, DIM = 8, 10, 1024, 64
LARGEST = 1 << 27
_OUT, _IN = 1 + 2.0**-50, 1 - 2.0**-50


def above(x: np.ndarray) -> np.ndarray:
    """Not less than the value that floating point has rounded to x >= 0."""
    return x * _OUT


def below(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) * _IN


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles."""
    y = np.floor(scale * x)
    if y.size and np.abs(y).max() >= LARGEST:
        raise ArithmeticError(f"a component times {scale} is beyond {LARGEST}")
    return y.astype(np.int64)


def squares(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one centroid (or to a centroid each)."""
    d = x.astype(np.int64) - center
    if d.size and np.abs(d).max() < 1 << 23:  # in doubles, all sums stay below 2**53 up to 128 components
        if d.shape[1] <= 128:
            d = d.astype(np.float64)
            return np.einsum("ij,ij->i", d, d).astype(np.int64)
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Centers:
    """Integer centroids; how far each has moved since the bounds were made; half the distances between them."""

    at: np.ndarray
    moved: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray, before: np.ndarray | None = None) -> Centers:
        moved = above(np.sqrt(squares(at, before).astype(np.float64))) if before is not None else np.zeros(len(at))
        half = np.stack([below(np.sqrt(squares(at, c).astype(np.float64))) / 2 for c in at])
        np.fill_diagonal(half, np.inf)
        return cls(at, moved, half)


def first(x: np.ndarray, centers: Centers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, upper, lower) from all distances."""
    d2 = np.stack([squares(x, c) for c in centers.at], 1) if len(x) else np.zeros((0, len(centers.at)), np.int64)
    own = d2.argmin(1)
    d = np.sqrt(d2.astype(np.float64))
    return own, above(d[np.arange(len(x)), own]), below(d)


def step(x: np.ndarray, centers: Centers, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Moves vectors to their nearest centroids in place; the number of distances that this took."""
    np.copyto(upper, above(upper + above(centers.moved)[own]))
    np.copyto(lower, below(lower - centers.moved))
    live = np.flatnonzero(upper >= centers.half.min(1)[own])
    best = np.full(len(x), -1, np.int64)  # exact where the upper bound is tight
    taken = 0
    for c in range(len(centers.at)):
        open_ = lambda rows: rows[(own[rows] != c) & (upper[rows] >= lower[rows, c]) & (upper[rows] >= centers.half[own[rows], c])]
        rows = open_(live)
        loose = rows[best[rows] < 0]
        if len(loose):
            best[loose] = squares(x[loose], centers.at[own[loose]])
            d = np.sqrt(best[loose].astype(np.float64))
            upper[loose], lower[loose, own[loose]] = above(d), below(d)
            taken += len(loose)
            rows = open_(rows)
        if not len(rows):
            continue
        d2 = squares(x[rows], centers.at[c])
        taken += len(rows)
        d = np.sqrt(d2.astype(np.float64))
        lower[rows, c] = below(d)
        nearer = (d2 < best[rows]) | (d2 == best[rows]) & (c < own[rows])
        rows, d2, d = rows[nearer], d2[nearer], d[nearer]
        own[rows], best[rows], upper[rows] = c, d2, above(d)
    return taken


def sums(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """[k, 1 + components]: vectors of each cluster and their sum."""
    return np.array([[np.count_nonzero(own == c), *x[own == c].sum(0)] for c in range(k)], np.int64)


def _rows(a: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    a = np.ascontiguousarray(a)
    width = a.dtype.itemsize * a.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(len(a) + 1, dtype=np.int32) * width), pa.py_buffer(a.tobytes())])


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def takes_part(vector: str, dim: int = DIM) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def starts(df: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE, prefix: str = "3:") -> np.ndarray:
    """Integer vectors of the k rows of least sha256 of prefix and id, in that order; ties go by vector."""
    kept = df.where(takes_part(vector, dim)).select(F.sha2(F.concat(F.lit(prefix), F.col(key).cast("string")), 256).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    rows = kept.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return integers(np.array([r.v for r in rows], np.float64).reshape(-1, dim), scale)


def _moved(totals: DataFrame, at: np.ndarray) -> np.ndarray:
    """Centroids after an update: floor(sum / count) by component; empty clusters stay."""
    width = at.shape[1] + 1
    summed = totals.select(F.posexplode("totals").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
    flat = {r.i: r.n for r in summed}
    new = at.copy()
    for c in range(len(at)):
        if n := flat.get(c * width, 0):
            new[c] = [flat[c * width + 1 + j] // n for j in range(at.shape[1])]
    return new


def clusters(df: DataFrame, k: int = K, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE, at: np.ndarray | None = None) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector after ``rounds`` updates from ``at`` (or ``starts``)."""
    spark, folder = df.sparkSession, shared_dir(df.sparkSession, "centroids")
    at = starts(df, k, key, vector, dim, scale) if at is None else np.asarray(at, np.int64)
    k, id_type = len(at), df.schema[key].dataType.simpleString()
    named = f"`{key}` {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not k:
        return spark.createDataFrame([], named)
    state = StructType.fromDDL(f"id {id_type}, x binary, own int, upper double, lower binary, totals array<long>")

    def mapped(source: DataFrame, read, centers: Centers) -> DataFrame:
        """One assignment: ``read`` gives ids, vectors and, but for the first time, bounds of a batch."""
        target = to_arrow_schema(state)

        def run(batches):
            totals = np.zeros((k, dim + 1), np.int64)
            for batch in batches:
                ids, x, bounds = read(batch)
                if not len(x):
                    continue
                own, upper, lower = first(x, centers) if bounds is None else bounds
                if bounds is not None:
                    step(x, centers, own, upper, lower)
                totals += sums(x, own, k)
                columns = [ids.cast(target.field("id").type), _rows(x.astype(np.int32)), pa.array(own, pa.int32()), pa.array(upper), _rows(lower), pa.nulls(len(x), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema=target)
            last = [[None], [None], [None], [None], [None], [totals.ravel().tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(last, target)], schema=target)

        return source.mapInArrow(tidy(run), state)

    def raw(batch: pa.RecordBatch):
        flat = batch.column(1).flatten()
        return batch.column(0), integers(np.asarray(flat).reshape(-1, dim), scale), None

    def stored(batch: pa.RecordBatch):
        own, upper = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().copy()
        return batch.column(0), _matrix(batch.column(1), np.int32, dim).astype(np.int64), (own, upper, _matrix(batch.column(4), np.float64, k).copy())

    columns = ["id", "x", "own", "upper", "lower"]
    kept = df.where(takes_part(vector, dim)).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    table, n = persisted(mapped(kept, raw, Centers.of(at)), folder, "round-0"), 0
    centers = Centers.of(at)
    for n in range(1, rounds + 1):
        new = _moved(table.where("totals is not null").select("totals"), centers.at)
        if (new == centers.at).all():
            n -= 1
            break
        centers = Centers.of(new, centers.at)
        table = persisted(mapped(table.where("x is not null").select(*columns), stored, centers), folder, f"round-{n}")
        discard(spark, folder, [f"round-{n - 1}"])

    def distances(batches):
        for batch in batches:
            own = batch.column(2).to_numpy()
            d2 = squares(_matrix(batch.column(1), np.int32, dim), centers.at[own])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d2)], names=["id", "cluster", "distance"])

    measured = persisted(table.where("x is not null").select(*columns).mapInArrow(tidy(distances), f"id {id_type}, cluster int, distance long"), folder, "assigned")
    discard(spark, folder, [f"round-{n}"])
    inertia = {r.cluster: r.s for r in measured.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = sum(inertia.values())
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.at.tolist()]
    about = spark.createDataFrame([(c, s, whole, shas[c]) for c, s in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return measured.join(F.broadcast(about), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
