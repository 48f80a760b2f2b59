"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length one and cut in two halves; each half has its own
codebook of CODES centroids, fitted by k-means on a bounded sample
(``sample_rows``).  Every vector is indexed under its pair of centroids.  A query
walks the pairs by the sum of its squared distances to the two centroids, with a
heap, until the pairs it has seen hold SHARE of all distinct vectors, and all entries
of these cells are reranked by exact cosine on the original vectors, in double
precision.  The cells seen are those within the sum at which the walk stopped, so
a query carries that one number to the entries, which lie in blocks by their
left centroid; a block out of reach doesn't get the query.

SHARE is a share, not a count, because vectors without clusters leave no other
way to a recall of 0.9 at any size: see the README for recall against it.

Equal vectors are one entry with its TOP + 1 least ids (more can't be among the
nearest), collapsed inside each batch before they are shuffled.  A block of more
than BLOCK_ROWS entries is dealt over several tasks, as are its queries beyond
BLOCK_QUERIES; the driver sees one count per cell.

Defined results: vectors that are null, of the wrong length, zero, or that hold
null or non-finite components take no part, neither as queries nor as
candidates; rows with a null id take no part; equal scores go to the lesser id;
rows that repeat an id and its vector count once; other columns are ignored; an
empty table gives no rows, a single vector no neighbours.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .arrowmap import discard_others, least_hashed, map_batches, persisted, shared_dir, sorted_groups, tidy

CODES, SHARE = 128, 0.35
TOP = 5
BLOCK_ROWS, BLOCK_QUERIES = 4096, 4096
SAMPLE_ROWS = 20_000


def valid_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """[rows, dim] doubles of the vectors that take part, and their places in the column."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(lengths == dim)
    if not len(at):
        return np.zeros((0, dim)), at
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    x = np.asarray(flat.fill_null(np.nan)).reshape(-1, dim)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return x[ok], at[ok]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _content(x: np.ndarray) -> np.ndarray:
    bits = (x + 0.0).view(np.uint64)
    return tb.mix64((tb.mix64(bits) * (tb.seeds(x.shape[1], 0xE1) | np.uint64(1))).sum(1)).view(np.int64)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _squares(x, centers).argmin(1)
        for j in range(len(centers)):
            part = x[own == j]
            centers[j] = part.mean(0) if len(part) else x[rng.integers(len(x))]
    return centers


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)


@dataclass
class Codebooks:
    left: np.ndarray
    right: np.ndarray

    @property
    def dim(self) -> int:
        return self.left.shape[1] + self.right.shape[1]

    def distances(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.left.shape[1]
        return _squares(u[:, :half], self.left), _squares(u[:, half:], self.right)

    def cells(self, u: np.ndarray) -> np.ndarray:
        a, b = self.distances(u)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def reach(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, wanted: int) -> float:
        """Walks cells by the sum of both distances until they hold ``wanted`` entries; the last cell's sum."""
        i_order, j_order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, sizes = a[i_order].tolist(), b[j_order].tolist(), sizes.reshape(len(a), len(b))[i_order][:, j_order].tolist()
        # Row i is open from its first cell on; its next cell enters the heap when the one before leaves it.
        heap, held, last = [(a[0] + b[0], 0, 0)], 0, -np.inf
        while heap and held < wanted:
            last, i, j = heapq.heappop(heap)
            held += sizes[i][j]
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return last


def fit(df: DataFrame, vector: str, key: str, codes: int = CODES, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> Codebooks | None:
    """Codebooks from at most ``sample_rows`` vectors, those of least hash of id and vector; None if no vector takes part."""
    rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(vector).alias("v"), F.col(key).alias("k"))
    table = least_hashed(rows, sample_rows, 5, "k", "v").select("v").toArrow()
    column = table.column("v").combine_chunks()
    lengths = np.asarray(column.value_lengths()) if len(column) else np.zeros(0, int)
    if not (lengths > 0).any():
        return None
    dim = int(np.bincount(lengths[lengths > 0]).argmax())
    x, _ = valid_rows(column, dim)
    if not len(x):
        return None
    u, half = unit(x), (dim + 1) // 2
    left = kmeans(u[:, :half], min(codes, len(u)), seed)
    right = kmeans(u[:, half:], min(codes, len(u)), seed + 1) if dim > half else np.zeros((1, 0))
    return Codebooks(left, right)


def _collapsed(ids: np.ndarray, content: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``top`` least ids of each content."""
    order = np.lexsort((ids, content))
    c = content[order]
    first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    rank = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
    return order[rank < top], rank[rank < top]


def nearest(df: DataFrame, queries: str, vector: str = "embedding", key: str = "vec_id", top: int = TOP, share: float = SHARE, books: Codebooks | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows of each row for which the SQL condition ``queries`` holds."""
    spark = df.sparkSession
    rows = df.select(F.col(vector).alias("v"), F.col(key).cast("long").alias("id"), F.coalesce(F.expr(queries), F.lit(False)).alias("q")).where("v is not null and id is not null")
    books = books or fit(df, vector, key)
    schema = "query_id long, rank int, vec_id long, score double"
    if books is None:
        return spark.createDataFrame([], schema)
    folder, dim, keep = shared_dir(spark, "ann"), books.dim, top + 1

    def index(batch: pa.RecordBatch):
        x, at = valid_rows(batch.column(0), dim)
        if not len(x):
            return
        ids, q = batch.column(1).to_numpy()[at], np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)[at]
        content, cell = _content(x), books.cells(unit(x))
        least, _ = _collapsed(ids, content, keep)
        asked = np.flatnonzero(q)
        use = np.concatenate((least, asked))
        yield {"content": content[use], "cell": cell[use], "id": ids[use], "query": np.arange(len(use)) >= len(least), "vector": [r.tobytes() for r in x[use]]}

    entries = persisted(map_batches(rows.select("v", "id", "q"), index, "content long, cell int, id long, query boolean, vector binary"), folder, "entries")
    # One entry per distinct vector; a group holds a few ids for each batch that saw it, and is cut before it is gathered.
    by_content = Window.partitionBy("content", "part").orderBy("id")
    few = entries.where("not query").select("content", "cell", "id", "vector").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(32)))
    few = few.withColumn("r", F.row_number().over(by_content)).where(F.col("r") <= keep)
    merged = few.groupBy("content").agg(F.slice(F.sort_array(F.collect_set("id")), 1, keep).alias("ids"), F.first("cell").alias("cell"), F.first("vector").alias("vector"))
    stored = persisted(merged, folder, "stored")
    sizes = np.zeros(len(books.left) * len(books.right), np.int64)
    for r in stored.groupBy("cell").count().collect():
        sizes[r[0]] = r[1]
    wanted, n_right = max(int(np.ceil(share * sizes.sum())), 50 * top), len(books.right)

    asked = entries.where("query").groupBy("content").agg(F.first("vector").alias("vector"))

    def visit(batch: pa.RecordBatch):
        x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, dim)
        if not len(x):
            return
        a, b = books.distances(unit(x))
        reach = np.array([books.reach(a[k], b[k], sizes, wanted) for k in range(len(x))])
        which, left = np.nonzero((a + b.min(1)[:, None] <= reach[:, None]) & (sizes.reshape(-1, n_right).sum(1) > 0))
        yield {"content": batch.column(0).to_numpy()[which], "left": left.astype(np.int32), "reach": reach[which], "vector": batch.column(1).take(pa.array(which))}

    visits = persisted(map_batches(asked.select("content", "vector"), visit, "content long, left int, reach double, vector binary"), folder, "visits")
    asks = np.zeros(len(books.left), np.int64)
    for r in visits.groupBy("left").count().collect():
        asks[r[0]] = r[1]
    row_parts, query_parts = (np.maximum(1, -(-n // most)) for n, most in ((sizes.reshape(-1, n_right).sum(1), BLOCK_ROWS), (asks, BLOCK_QUERIES)))
    split = F.broadcast(spark.createDataFrame(pa.table({"left": pa.array(np.arange(len(asks)), pa.int32()), "rows": pa.array(row_parts), "queries": pa.array(query_parts)})))  # CODES rows
    part = lambda parts: F.pmod(F.xxhash64("content"), F.col(parts)).cast("long")
    spread = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    block = F.xxhash64("left", "i", "j").alias("block")
    no = lambda kind: F.lit(None).cast(kind)
    right = stored.withColumn("left", F.floor(F.col("cell") / n_right).cast("int")).join(split, "left").withColumn("i", part("rows")).withColumn("j", spread("queries"))
    right = right.select(block, F.lit(1).alias("side"), "content", "vector", "ids", "cell", no("double").alias("reach"))
    left = visits.join(split, "left").withColumn("j", part("queries")).withColumn("i", spread("rows"))
    left = left.select(block, F.lit(0).alias("side"), "content", "vector", no("array<long>").alias("ids"), no("int").alias("cell"), "reach")

    def rerank(table: pa.Table):
        side = table.column("side").to_numpy()
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(-1, dim)
        q, c = x[side == 0], x[side == 1]
        if not len(q) or not len(c):
            return {}
        entry = table.filter(pa.array(side == 1))
        ids, cell = entry.column("ids").to_pylist(), entry.column("cell").to_numpy()
        names, reach = table.column("content").to_numpy()[side == 0], table.filter(pa.array(side == 0)).column("reach").to_numpy()
        norms, own = np.sqrt((c * c).sum(1)), np.sqrt((q * q).sum(1))
        u = unit(q)
        rough = u @ unit(c).T
        a, b = books.distances(u)
        rough[a[:, cell // n_right] + b[:, cell % n_right] > reach[:, None] + 1e-12] = -2.0
        out: dict[str, list] = {"content": [], "id": [], "score": []}
        for k in range(len(q)):
            # All entries within rounding of the place that could still matter are scored exactly.
            edge = np.partition(rough[k], -keep)[-keep] - 1e-9 if len(c) > keep else -1.5
            near = np.flatnonzero(rough[k] >= max(edge, -1.5))
            exact = (c[near] * q[k]).sum(1) / (norms[near] * own[k])
            found = sorted(((-s, i) for s, n in zip(exact.tolist(), near.tolist()) for i in ids[n]))[:keep]
            out["content"] += [names[k]] * len(found)
            out["id"] += [i for _, i in found]
            out["score"] += [-s for s, _ in found]
        return out

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL("content long, id long, score double")

    def run(batches):
        target = to_arrow_schema(parsed)
        for table in sorted_groups(batches, "block"):
            if (out := rerank(table)) and out["id"]:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scored = left.union(right).repartition(n, "block").sortWithinPartitions("block").mapInArrow(tidy(run), parsed)
    ranked = Window.partitionBy("content").orderBy(F.col("score").desc(), "id")
    best = persisted(scored.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= keep).groupBy("content").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("found")), folder, "best")
    asked_ids = persisted(entries.where("query").select(F.col("id").alias("query_id"), "content").distinct(), folder, "asked")
    discard_others(spark, folder, ["best", "asked"])
    ids = asked_ids.join(best, "content")
    own = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, top)
    return ids.select("query_id", F.posexplode(own).alias("p", "f")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score"))
