"""Exact hard negatives by dual-tree search over inner products.

Components become integers floor(SCALE * x); a row's score for an anchor is their integer
inner product.  An anchor's positives are the POSITIVES rows of its label that score most; a
positive's negatives are the NEGATIVES rows of other labels that score most within
LOW to HIGH percent of the positive's score.

Both searches are the same dual-tree search.  A tree's node knows a ball around its rows and the range of
their labels, so two nodes give an interval that holds the inner products of all pairs
across them.  A pair of nodes goes if the interval misses what every anchor below still
accepts, or if no labels fit; only pairs of leaves are scored, exactly.  What an anchor
accepts begins at the scores that a bounded sample (SAMPLE_ROWS rows) shows to be reached, and
rises as rows are found.

The trees' tops (CELLS cells) are planes fitted to the sample at the driver, with balls and labels
of all rows; they decide which anchors meet which cell.  A cell is dealt over blocks of
at most about BLOCK_ROWS candidates and BLOCK_ANCHORS anchors, and each task grows the trees' lower
parts over its block.  An anchor's few best rows of a block meet those of other blocks in a
window whose limit Spark applies before the shuffle too.  The driver sees one row per cell.

Defined results: rows with a null id, label or vector, or with null or non-finite
components take no part; vectors of different lengths compare as if the shorter went on
with zeros; equal scores go to the smaller id; rows that repeat are rows of their own (an
anchor's own row alone is not its positive); a positive whose score is negative has no negatives, as its range is
empty; other columns are ignored; an empty table gives no rows.  An integer beyond 2**27 or a
product that might pass 64 bits raises ArithmeticError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .arrowmap import discard, least_hashed, persisted, shared_dir, sorted_groups, tidy
from .centroids import integers

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
SCALE, CELLS, SAMPLE_ROWS = 256, 64, 10_000
BLOCK_ROWS, BLOCK_ANCHORS = 16_384, 2_048
LEAF, ANCHOR_LEAF = 256, 32
NOTHING = -(1 << 62)


def direction(x: np.ndarray) -> np.ndarray:
    """Between two rows that are far apart: the farthest from the mean, and the farthest from that."""
    far = lambda p: x[((x - p) ** 2).sum(1).argmax()]
    a = far(x.mean(0))
    return far(a) - a


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a and c, given as doubles."""
    m = min(a.shape[1], c.shape[1])
    most = float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0)) * m
    if most < 2.0**53:
        return (a[:, :m] @ c[:, :m].T).astype(np.int64)
    if most < 2.0**63:
        return a[:, :m].astype(np.int64) @ c[:, :m].T.astype(np.int64)
    raise ArithmeticError("an inner product might pass 64 bits")


def intervals(ca: np.ndarray, ra: np.ndarray, cc: np.ndarray, rc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of inner products across pairs of balls (row i of both sides), rounded outwards."""
    na, nc = np.sqrt((ca * ca).sum(1)), np.sqrt((cc * cc).sum(1))
    m = min(ca.shape[1], cc.shape[1])
    mid, wide = (ca[:, :m] * cc[:, :m]).sum(1), na * rc + nc * ra + ra * rc
    wide += 1e-9 * (1 + (na + ra) * (nc + rc))
    return mid - wide, mid + wide


@dataclass
class Tree:
    """Nodes as arrays; rows are permuted so that a node's are ``lo`` to ``hi``.  Children are -1 at leaves."""

    order: np.ndarray
    x: np.ndarray
    labels: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    least: np.ndarray
    most: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def over(cls, x: np.ndarray, labels: np.ndarray, leaf: int) -> Tree:
        """Splits by label first, at the change of labels nearest to the middle, then by the middle of a direction."""
        order = np.argsort(labels, kind="stable")
        nodes: list[list] = []
        todo = [(0, len(x), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            rows = order[lo:hi]
            part, own = x[rows], labels[rows]
            center = part.mean(0)
            nodes.append([center, np.sqrt(((part - center) ** 2).sum(1).max()) * (1 + 1e-12), own[0], own[-1], lo, hi, -1, -1])
            if parent >= 0:
                nodes[parent][6 + side] = len(nodes) - 1
            if hi - lo <= leaf:
                continue
            if own[0] != own[-1]:
                change = np.flatnonzero(own[1:] != own[:-1]) + 1
                cut = int(change[np.abs(change - (hi - lo) // 2).argmin()])
            else:
                cut = (hi - lo) // 2
                order[lo:hi] = rows[np.argsort(part @ direction(part), kind="stable")]
            me = len(nodes) - 1
            todo += [(lo, lo + cut, me, 0), (lo + cut, hi, me, 1)]
        columns = [np.array(c) for c in zip(*nodes)]
        return cls(order, x[order], labels[order], *columns)

    def reduced(self, of: np.ndarray, how) -> np.ndarray:
        """``how`` (a ufunc) over each node's rows of ``of``, given in the tree's order."""
        out = np.empty((len(self.lo), *of.shape[1:]), of.dtype)
        for i in range(len(self.lo) - 1, -1, -1):  # children follow their parents
            l, r = self.left[i], self.right[i]
            out[i] = how.reduce(of[self.lo[i] : self.hi[i]], axis=0) if l < 0 else how(out[l], out[r])
        return out


def leaf_pairs(a: Tree, c: Tree, same_label: bool, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, int, float, float]]:
    """Pairs of leaves that may hold wanted pairs of rows, by falling upper bound, with their intervals.

    ``least`` and ``most`` say, by anchor row in the tree's order, which scores it accepts at all.
    """
    lows, highs = a.reduced(least, np.minimum), a.reduced(most, np.maximum)
    i, j, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(i):
        apart = (a.most[i] < c.least[j]) | (c.most[j] < a.least[i])
        alike = (a.least[i] == a.most[i]) & (c.least[j] == c.most[j]) & (a.least[i] == c.least[j])
        lower, upper = intervals(a.center[i], a.radius[i], c.center[j], c.radius[j])
        open_ = (upper >= lows[i]) & (lower <= highs[i]) & ~(apart if same_label else alike)
        i, j, lower, upper = i[open_], j[open_], lower[open_], upper[open_]
        ends = (a.left[i] < 0) & (c.left[j] < 0)
        found.append(np.array([i[ends], j[ends], lower[ends], upper[ends]]))
        i, j = i[~ends], j[~ends]
        down = (a.left[i] >= 0) & ((c.left[j] < 0) | (a.hi[i] - a.lo[i] >= c.hi[j] - c.lo[j]))
        i1, j1, i2, j2 = i[down], j[down], i[~down], j[~down]
        i = np.concatenate([a.left[i1], a.right[i1], i2, i2])
        j = np.concatenate([j1, j1, c.left[j2], c.right[j2]])
    found = np.concatenate(found, 1)
    for k in np.argsort(-found[3], kind="stable"):
        yield int(found[0, k]), int(found[1, k]), found[2, k], found[3, k]


def search(a: Tree, c: Tree, rows_a: np.ndarray, rows_c: np.ndarray, ids: np.ndarray, same_label: bool, low: np.ndarray, high: np.ndarray, top: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """{(anchor, slot): up to ``top`` (-score, id) in order}; all arrays but ``ids`` and ``rows_c`` are in the anchors' given order.

    ``low`` and ``high`` ([anchors, slots]) are the scores that each slot accepts; ``low`` rises as rows are found.
    """
    low, high, rows_a, ids, rows_c = low[a.order].copy(), high[a.order], rows_a[a.order], ids[c.order], rows_c[c.order]
    best: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, j, lower, upper in leaf_pairs(a, c, same_label, low.min(1), high.max(1)):
        lo, hi = a.lo[i], a.hi[i]
        at, of = slice(lo, hi), slice(c.lo[j], c.hi[j])
        if not ((low[at] <= upper) & (high[at] >= lower)).any():
            continue
        scores = products(a.x[at], c.x[of])
        alike = a.labels[at, None] == c.labels[None, of]
        fits = alike & (rows_a[at, None] != rows_c[None, of]) if same_label else ~alike
        for s in range(low.shape[1]):
            hits = fits & (scores >= low[at, s, None]) & (scores <= high[at, s, None])
            for r in np.flatnonzero(hits.any(1)):
                h = np.flatnonzero(hits[r])
                near = scores[r, h]
                if len(h) > 4 * top:  # what can't be among the top goes before it is sorted
                    h, near = (v[near >= np.partition(near, -top)[-top]] for v in (h, near))
                key = (int(a.order[lo + r]), s)
                mine = sorted([*best.get(key, []), *zip((-near).tolist(), ids[of][h].tolist())])[:top]
                best[key] = mine
                if len(mine) == top:
                    low[lo + r, s] = max(low[lo + r, s], -mine[-1][0])
    return best


@dataclass
class Cells:
    """The trees' tops: planes of a complete binary tree, and a ball and the labels of each cell."""

    normals: np.ndarray
    cuts: np.ndarray
    centers: np.ndarray
    radius: np.ndarray | None = None
    labels: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, cells: int) -> Cells:
        normals, cuts, parts = [], [], [x]
        while len(parts) < cells:
            halves = []
            for part in parts:
                way = direction(part) if len(part) else np.zeros(x.shape[1])
                along = part @ way
                cut = float(np.median(along)) if len(part) else 0.0
                normals.append(way), cuts.append(cut)
                halves += [part[along < cut], part[along >= cut]]
            parts = halves
        return cls(np.array(normals).reshape(-1, x.shape[1]), np.array(cuts), np.array([p.mean(0) if len(p) else x.mean(0) for p in parts]))

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range((len(self.cuts) + 1).bit_length() - 1):
            right = (x * self.normals[node]).sum(1) >= self.cuts[node]
            node = 2 * node + 1 + right
        return node - len(self.cuts)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int32) for b in column.to_pylist()]


def _by_length(vectors: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and doubles of vectors whose lengths round up to one power of two, filled with zeros to the longest of them."""
    sizes = np.array([len(v) for v in vectors])
    kind = np.ceil(np.log2(np.maximum(sizes, 1)))
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        width = int(sizes[at].max())
        if (sizes[at] == width).all():
            yield at, np.concatenate([vectors[p] for p in at]).reshape(len(at), width).astype(np.float64)
        else:
            yield at, np.stack([np.pad(vectors[p], (0, width - len(vectors[p]))) for p in at]).astype(np.float64)


def _fitted(vectors: list[np.ndarray], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``dim`` components, filled with zeros, and the whole vectors' squared lengths."""
    x, squares = np.zeros((len(vectors), dim)), np.zeros(len(vectors))
    for at, part in _by_length(vectors) if vectors else ():
        m = min(dim, part.shape[1])
        x[at, :m], squares[at] = part[:, :m], (part * part).sum(1)
    return x, squares


def _seeds(x: list[np.ndarray], fits, sample: list[np.ndarray], low: np.ndarray, high: np.ndarray, top: int) -> np.ndarray:
    """``low``, raised to the ``top``-th best score within low and high that the sample shows.

    ``fits`` says, of some places in x, which rows of the sample may be found: [places, sample].
    """
    low = low.copy()
    for at, a in _by_length(x):
        for lo in range(0, len(at), 256):
            rows = at[lo : lo + 256]
            scores = np.full((len(rows), len(sample)), NOTHING, np.int64)
            for of, c in _by_length(sample):
                scores[:, of] = products(a[lo : lo + 256], c)
            scores[~fits(rows)] = NOTHING
            for s in range(low.shape[1]):
                found = np.where((scores >= low[rows, s, None]) & (scores <= high[rows, s, None]), scores, NOTHING)
                if found.shape[1] >= top:
                    low[rows, s] = np.maximum(low[rows, s], np.partition(found, -top, axis=1)[:, -top])
    return low


def _arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow of a function from an iterator of batches to dicts of columns."""
    parsed = StructType.fromDDL(schema)

    def run(batches):
        target = to_arrow_schema(parsed)
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([v if isinstance(v := out[f.name], pa.Array) and v.type == f.type else pa.array(v, f.type) for f in target], schema=target)

    return df.mapInArrow(tidy(run), parsed)


def mined(df: DataFrame, anchors: str, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that meet the SQL condition ``anchors``."""
    spark, folder = df.sparkSession, shared_dir(df.sparkSession, "negatives")
    named = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    asked = F.coalesce(F.expr(anchors), F.lit(False)).alias("anchor")
    valid = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False)))
    valid = valid.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"), asked)

    # A bounded sample: planes of the trees' tops, and scores that are reached for certain.
    drawn = least_hashed(valid, sample_rows, 23, "id", "label", "v").select("id", "label", "v").collect()
    if not drawn:
        return spark.createDataFrame([], named)
    sample = [integers(np.array(r.v, np.float64), scale).astype(np.int32) for r in drawn]
    sample_ids, sample_labels = (np.array([r[i] for r in drawn], np.int64) for i in (0, 1))
    dim = max(1, int(np.bincount([len(v) for v in sample]).argmax()))
    tops = Cells.fit(_fitted(sample, dim)[0], cells)
    n_cells = len(tops.centers)

    def placed(batches):
        for batch in batches:
            flat, ends = np.asarray(batch.column(2).flatten()), np.cumsum(np.asarray(batch.column(2).value_lengths()))
            vectors = np.split(integers(flat, scale).astype(np.int32), ends[:-1])
            if not len(vectors) or not batch.num_rows:
                continue
            x, squares = _fitted(vectors, dim)
            cell = tops.of(x)
            c = tops.centers[cell]
            far = np.sqrt(np.maximum(squares - 2 * (x * c).sum(1) + (c * c).sum(1), 0)) * (1 + 1e-9) + 1e-6 * np.sqrt(squares)
            yield {"id": batch.column(0), "label": batch.column(1), "anchor": batch.column(3), "x": [v.tobytes() for v in vectors], "cell": cell, "far": far}

    rows = _arrow(valid, placed, "id long, label long, anchor boolean, x binary, cell int, far double")
    rows = persisted(rows.withColumn("row", F.monotonically_increasing_id()), folder, "rows")
    sizes = {r.cell: r for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.min("label").alias("least"), F.max("label").alias("most")).collect()}
    tops.radius = np.array([sizes[c].far if c in sizes else 0.0 for c in range(n_cells)])
    tops.labels = np.array([(sizes[c].least, sizes[c].most) if c in sizes else (0, -1) for c in range(n_cells)])
    held = np.array([sizes[c].n if c in sizes else 0 for c in range(n_cells)])

    # One slot for the positives: everything of the label, from the sample's score on.
    def seeded(batches):
        for batch in batches:
            x, labels, ids = _vectors(batch.column(3)), batch.column(2).to_numpy(), batch.column(1).to_numpy()
            fits = lambda at: (labels[at, None] == sample_labels) & (ids[at, None] != sample_ids)  # noqa: B023, E731
            low_ = _seeds(x, fits, sample, np.full((len(x), 1), NOTHING), np.full((len(x), 1), -NOTHING), positives)
            yield {"row": batch.column(0), "id": batch.column(1), "label": batch.column(2), "x": batch.column(3), "cell": batch.column(4), "far": batch.column(5), "low": low_.tolist(), "high": [[-NOTHING]] * len(x)}

    slots = "row long, id long, label long, x binary, cell int, far double, low array<long>, high array<long>"
    chosen = persisted(_arrow(rows.where("anchor").select("row", "id", "label", "x", "cell", "far"), seeded, slots), folder, "anchors")

    def searched(asking: DataFrame, same_label: bool, top: int, name: str) -> DataFrame:
        """(row, slot, score, id): the anchors' best rows, of all blocks together."""
        nodes = asking.groupBy("cell").agg(F.max("far").alias("far"), F.min(F.array_min("low")).alias("low"), F.max(F.array_max("high")).alias("high"), F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).collect()
        meets, of = np.zeros((n_cells, n_cells), bool), np.flatnonzero(held)
        for r in nodes:  # pairs of cells: whole groups of anchors go at once
            c = np.repeat(tops.centers[r.cell][None], len(of), 0)
            lower, upper = intervals(c, np.full(len(of), r.far), tops.centers[of], tops.radius[of])
            labels = tops.labels[of]
            fits = (labels[:, 0] <= r.most) & (labels[:, 1] >= r.least) if same_label else ~((labels[:, 0] == labels[:, 1]) & (labels[:, 0] == r.least) & (r.least == r.most))
            meets[r.cell, of] = (upper >= r.low) & (lower <= r.high) & fits

        def visit(batches):
            for batch in batches:
                x, squares = _fitted(_vectors(batch.column(2)), dim)
                low_, high_ = (np.array([f(v) for v in batch.column(k).to_pylist()]) for f, k in ((min, 4), (max, 5)))
                norm = np.sqrt(squares)[:, None]
                mid, wide = x @ tops.centers.T, norm * tops.radius + 1e-9 * (1 + norm * (np.sqrt((tops.centers**2).sum(1)) + tops.radius))
                go = meets[batch.column(3).to_numpy()] & (mid + wide >= low_[:, None]) & (mid - wide <= high_[:, None])
                at, cell = np.nonzero(go)
                take = pa.array(at)
                yield {"cell": cell, "row": batch.column(0).take(take), "label": batch.column(1).take(take), "x": batch.column(2).take(take), "low": batch.column(4).take(take), "high": batch.column(5).take(take)}

        visits = persisted(_arrow(asking.select("row", "label", "x", "cell", "low", "high"), visit, "cell int, row long, label long, x binary, low array<long>, high array<long>"), folder, f"{name}-visits")
        asks = {r[0]: r[1] for r in visits.groupBy("cell").count().collect()}
        parts = [(c, max(1, -(-int(held[c]) // block_rows)), max(1, -(-asks[c] // block_anchors))) for c in sorted(asks)]
        split = F.broadcast(spark.createDataFrame(parts, "cell int, rows long, asks long"))  # one row per cell
        part = lambda n: F.pmod(F.xxhash64("row"), F.col(n))
        spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        block, none = F.xxhash64("cell", "i", "j").alias("block"), F.lit(None).cast("array<long>")
        theirs = rows.join(split, "cell").withColumn("i", part("rows")).withColumn("j", spread("asks")).select(block, F.lit(1).alias("side"), "row", "id", "label", "x", none.alias("low"), none.alias("high"))
        ours = visits.join(split, "cell").withColumn("j", part("asks")).withColumn("i", spread("rows")).select(block, F.lit(0).alias("side"), "row", F.lit(0).cast("long").alias("id"), "label", "x", "low", "high")

        def scored(batches):
            for table in sorted_groups(batches, "block"):
                side = table.column("side").to_numpy()
                a, c = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
                if not len(a) or not len(c):
                    continue
                xa, xc = (_vectors(t.column("x")) for t in (a, c))
                low_, high_ = (np.array(a.column(k).to_pylist(), np.int64) for k in ("low", "high"))
                out: dict[str, list] = {"row": [], "slot": [], "score": [], "id": []}
                candidates = [(of, Tree.over(x, c.column("label").to_numpy()[of], LEAF)) for of, x in _by_length(xc)]
                row_a, row_c, ids = a.column("row").to_numpy(), c.column("row").to_numpy(), c.column("id").to_numpy()
                for at, x in _by_length(xa):
                    tree = Tree.over(x, a.column("label").to_numpy()[at], ANCHOR_LEAF)
                    for of, other in candidates:
                        for (r, s), found in search(tree, other, row_a[at], row_c[of], ids[of], same_label, low_[at], high_[at], top).items():
                            out["row"] += [row_a[at[r]]] * len(found)
                            out["slot"] += [s] * len(found)
                            out["score"] += [-v for v, _ in found]
                            out["id"] += [i for _, i in found]
                if out["row"]:
                    yield out

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        hits = _arrow(theirs.union(ours).repartition(n, "block").sortWithinPartitions("block"), scored, "row long, slot int, score long, id long")
        order = Window.partitionBy("row", "slot").orderBy(F.col("score").desc(), "id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    first = searched(chosen, True, positives, "a").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))  # ``positives`` at most
    known = persisted(chosen.select("row", F.col("id").alias("anchor_id"), "label", "x", "cell", "far").join(first, "row"), folder, "positives")

    # A slot for each positive (a score of -1 stands for none): other labels' scores within its range, from the sample's
    # score on; an empty range accepts nothing.
    def ranged(batches):
        for batch in batches:
            x, labels = _vectors(batch.column(2)), batch.column(1).to_numpy()
            scores = batch.column(5).to_pylist()
            p = np.array([[*s, *[-1] * (positives - len(s))] for s in scores], np.int64).reshape(len(scores), positives)
            least, greatest = -(-low * p // 100), high * p // 100
            least[greatest < least], greatest[greatest < least] = -NOTHING, NOTHING
            least = _seeds(x, lambda at: labels[at, None] != sample_labels, sample, least, greatest, negatives)
            yield {"row": batch.column(0), "label": batch.column(1), "x": batch.column(2), "cell": batch.column(3), "far": batch.column(4), "low": least.tolist(), "high": greatest.tolist()}

    asking = _arrow(known.select("row", "label", "x", "cell", "far", F.col("p.score").alias("scores")), ranged, "row long, label long, x binary, cell int, far double, low array<long>, high array<long>")
    asking = persisted(asking, folder, "ranges")
    found = searched(asking, False, negatives, "b")
    flat = known.select("row", "anchor_id", F.posexplode("p").alias("slot", "f")).select("row", "anchor_id", "slot", F.col("f.id").alias("positive_id"), F.col("f.score").alias("positive_score"))
    result = flat.join(found.select("row", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["row", "slot"])
    result = persisted(result.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), folder, "found")
    discard(spark, folder, ["rows", "anchors", "a-visits", "positives", "ranges", "b-visits"])
    return result
