"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds the hashes of its distinct 5-word shingles.  Documents of
equal sets are one text: the join sees one representative of each, and copies
get its class at the end.

The join works on trees.  A node of a tree is a path of (coordinate, minwise
token) choices; a document goes to the child of each coordinate that a node's
own hash chooses, so documents meet where they agree on the tokens.  ROOTS
independent trees open with one coordinate each.

* A node of at most LEAF texts is compared exhaustively in one task, on sketches
  (SKETCH minwise tokens of 8 bits) and set sizes; the clusters of alike texts become
  cells, whose pairs are confirmed on the full sets.  A pair that meets in several
  roots of at most LEAF goes to the first of them only, so full sets travel about
  once.  A larger root settles nothing for the trees after it.
* First, all roots of at most LEAF are compared, and in PIVOT_TREES trees the larger ones link
  their texts to PIVOTS of them, in slices of about SLICE.  The links' components become labels.
* Then each larger root recurses.  A node of one label has nothing left to find and
  goes.  A node of which at most LEAF texts lie outside its commonest label compares those
  with each other and with all slices of the rest, which is all that is open in it: so large groups
  of near copies end, whole.  Any other branches by BRANCH coordinates.
* What is still large after DEPTH levels is compared block against block, whole.

Recall: a pair at similarity s has one root in common with probability s per tree.  A common root of at most LEAF
compares it; a larger one passes it on with probability 8/9 at least at 0.75 (1.5 children in common at each level).
So the trees miss a pair at 0.75 with probability (1/3)^12, 2e-6 at most.  The sketch test (SURE of all places agree)
misses one at 0.75 with probability 2e-7.  What is compared is decided on the full sets.
These hold sets of 64-bit word hashes: polynomials modulo 2^64, which texts made for the purpose can make collide.

The driver sees counts only; links, labels and sets stay in tables of the shared
folder.  A task holds the sets of one cell: LEAF texts at most, usually a few.

Defined results: null and blank texts have the empty set and link with nothing
(n_shingles 0); a text of fewer than five words is one shingle; rows with a null
id take no part (component null, kept); rows that share an id count as one
document; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .arrowmap import binary_rows, discard_others, map_batches, persisted, shared_dir, sorted_groups, tidy
from .components import components

K = 5
ROOTS, BRANCH, SKETCH = 12, 2, 128
LEAF, SLICE, DEPTH = 1024, 512, 6
PIVOTS, PIVOT_TREES = 4, 4
PERCENT, SURE = 75, 0.546
BROADCAST_ROWS = 300_000
_GATHER, BLOCK = 1 << 21, 1 << 18


def shingle_sets(block: tb.Block) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each row, and their number."""
    lowered = tb.LOWER[block.data]
    s, e, counts = tb.words(tb.Block(block.lo, block.hi, lowered, block.starts, block.ends, block.valid))
    hashes, per_row = tb.windows(tb.span_hashes(lowered, s, e), counts, K, True)
    cuts = np.concatenate(([0], np.cumsum(per_row)))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = np.sort(hashes[a:b])
        if b - a > 1:
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        out.append(part)
    return out, np.array([len(x) for x in out], np.int64)


def _content(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """A signed 64-bit identity of each set's content."""
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tb.mix64(flat + np.uint64(0xA5A5)))))
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    return tb.mix64((total[cuts[1:]] - total[cuts[:-1]]) ^ sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def minwise(sets: list[np.ndarray], sizes: np.ndarray, n: int) -> np.ndarray:
    """[rows, n] minwise tokens; rows of empty sets are zero."""
    out = np.zeros((len(sets), n), np.uint64)
    rows = np.flatnonzero(sizes)
    if len(rows):
        flat = np.concatenate([sets[r] for r in rows])
        at = np.cumsum(sizes[rows]) - sizes[rows]
        for j, a in enumerate(tb.seeds(n, 0x317) | np.uint64(1)):
            out[rows, j] = np.minimum.reduceat(flat * a, at)
    return tb.mix64(out)


def _sketches(df: DataFrame, text: str, key: str) -> DataFrame:
    def run(batch: pa.RecordBatch):
        for block in tb.blocks(batch.column(1), BLOCK):
            sets, sizes = shingle_sets(block)
            tokens = minwise(sets, sizes, ROOTS + SKETCH)
            used = sizes > 0
            roots = tb.mix64(tokens[:, :ROOTS] + np.arange(1, ROOTS + 1, dtype=np.uint64)).view(np.int64)
            yield {
                key: batch.column(0).slice(block.lo, block.hi - block.lo),
                "n_shingles": sizes,
                "content": _content(sets, sizes),
                "roots": [r if u else None for r, u in zip(roots, used)],
                "sketch": [t.astype(np.uint8).tobytes() if u else None for t, u in zip(tokens[:, ROOTS:], used)],
            }

    return map_batches(df.select(key, text), run, f"{key} long, n_shingles long, content long, roots array<long>, sketch binary")


def _components(n: int, edges) -> np.ndarray:
    """The least row of each row's component; ``edges`` gives (row, rows)."""
    comp = np.arange(n)
    for i, js in edges:
        old = np.unique(np.append(comp[js], comp[i]))
        if len(old) > 1:
            comp[np.isin(comp, old)] = old[0]
    return comp


def _shared(ids: np.ndarray, cuts: np.ndarray, marked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many marked ids each of some rows holds."""
    sizes = cuts[rows + 1] - cuts[rows]
    out, lo, total = np.zeros(len(rows), np.int64), 0, np.cumsum(sizes)
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _GATHER, "right")))
        flat = np.concatenate([ids[cuts[r] : cuts[r + 1]] for r in rows[lo:hi]])
        out[lo:hi] = np.add.reduceat(marked[flat], np.cumsum(sizes[lo:hi]) - sizes[lo:hi], dtype=np.int64)
        lo = hi
    return out


def confirmed(sets: list[np.ndarray], labels: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """(label, least label) stars of the components that similar pairs of rows join: pairs within side -1, or of side 0 with side 1.

    Pairs of one label, or of labels that earlier pairs joined, are not compared.
    """
    n = np.array([len(x) for x in sets])
    order = np.lexsort((labels, n))
    sets, labels, side, n = [sets[r] for r in order], labels[order], side[order], n[order]
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate(([0], np.cumsum(n)))
    marked = np.zeros(ids.max() + 1, bool)
    names, at = np.unique(labels, return_inverse=True)
    comp = np.arange(len(names))
    wanted = {-1: -1, 0: 1, 1: 0}
    for i in range(len(n) - 1):
        # Sorted by size: rows after the last that may still reach the threshold cannot.
        hi = int(np.searchsorted(n, 100 * n[i] // PERCENT, "right"))
        js = np.arange(i + 1, hi)
        js = js[(side[js] == wanted[int(side[i])]) & (comp[at[js]] != comp[at[i]])]
        if not len(js):
            continue
        marked[ids[cuts[i] : cuts[i + 1]]] = True
        both = _shared(ids, cuts, marked, js)
        marked[ids[cuts[i] : cuts[i + 1]]] = False
        js = js[100 * both >= PERCENT * (n[i] + n[js] - both)]
        if len(js):
            old = np.unique(np.append(comp[at[js]], comp[at[i]]))
            comp[np.isin(comp, old)] = old[0]
    return [(int(names[r]), int(names[comp[r]])) for r in np.flatnonzero(comp != np.arange(len(names)))]


def _grouped(df: DataFrame, fn, schema: str, by: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)

    def run(batches):
        target = to_arrow_schema(parsed)
        for table in sorted_groups(batches, by):
            out = fn(table)
            if out and len(next(iter(out.values()))):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, by).sortWithinPartitions(by).mapInArrow(tidy(run), parsed)


_VERIFY = "cell long, content long, doc_id long, label long, side int"


def _matrix(column, dtype) -> np.ndarray:
    return np.stack(binary_rows(column, dtype))


def _picked(table: pa.Table, rows: np.ndarray, cell, side) -> dict:
    out = {c: table.column(c).to_numpy()[rows] for c in ("content", "doc_id", "label")}
    return out | {"cell": cell, "side": side}


def _clusters(members: DataFrame) -> DataFrame:
    """Cells of the alike texts of nodes of at most LEAF texts, by (node, tree, content, doc_id, label, n_shingles, roots, wide, sketch).

    Texts are alike that differ in label, can reach the threshold by size, agree in SURE of the sketch, and have
    no common root among those of earlier trees that were compared whole.  Bit t of ``wide`` says that the root
    in tree t has more than LEAF texts, so was not.  Tree -1 stands for nodes below the roots.
    """

    def fn(table: pa.Table):
        size, labels, tree = table.column("n_shingles").to_numpy(), table.column("label").to_numpy(), int(table.column("tree")[0].as_py())
        order = np.argsort(size, kind="stable")
        size, labels, sketch = size[order], labels[order], _matrix(table.column("sketch"), np.uint8)[order]
        if tree > 0:
            roots = np.array(table.column("roots").to_pylist(), np.int64)[order, :tree]
            wide = (table.column("wide").to_numpy()[order, None] >> np.arange(tree) & 1).astype(bool)

        def edges():
            for i in range(len(size) - 1):
                hi = int(np.searchsorted(size, 100 * size[i] // PERCENT, "right"))
                js = i + 1 + np.flatnonzero(labels[i + 1 : hi] != labels[i])
                if len(js) and tree > 0:
                    js = js[((roots[js] != roots[i]) | wide[i]).all(1)]
                if len(js):
                    js = js[np.count_nonzero(sketch[js] == sketch[i], axis=1) >= SURE * SKETCH]
                if len(js):
                    yield i, js

        comp = _components(len(size), edges())
        used = np.bincount(comp, minlength=len(comp))[comp] > 1
        node = table.column("node").to_numpy()[:1].view(np.uint64)
        first = table.column("content").to_numpy()[order][comp[used]].view(np.uint64)
        cell = tb.mix64(tb.mix64(node ^ np.uint64(0x51)) + tb.mix64(first)).view(np.int64)
        return _picked(table, order[used], cell, np.full(len(cell), -1, np.int32))

    return _grouped(members, fn, _VERIFY, "node")


def _facing(cells: DataFrame) -> DataFrame:
    """The rows of side 0 and side 1 of a cell that are alike and differ in label."""

    def fn(table: pa.Table):
        side, labels, size = (table.column(c).to_numpy() for c in ("side", "label", "n_shingles"))
        sketch = _matrix(table.column("sketch"), np.uint8)
        one, good = np.flatnonzero(side == 1), np.zeros(len(side), bool)
        if not len(one):
            return None
        for i in np.flatnonzero(side == 0):
            js = one[(labels[one] != labels[i]) & (100 * np.minimum(size[one], size[i]) >= PERCENT * np.maximum(size[one], size[i]))]
            js = js[np.count_nonzero(sketch[js] == sketch[i], axis=1) >= SURE * SKETCH]
            good[js] = True
            good[i] = len(js) > 0
        rows = np.flatnonzero(good)
        return _picked(table, rows, table.column("cell").to_numpy()[rows], side[rows])

    return _grouped(cells, fn, _VERIFY, "cell")


def _whole_sets(texts: DataFrame) -> DataFrame:
    """(content, set) of texts; a task gives each content once."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for block in tb.blocks(batch.column(0), BLOCK):
                sets, n = shingle_sets(block)
                content = _content(sets, n)
                new = [r for r, c in enumerate(content.tolist()) if not (c in seen or seen.add(c))]
                if new:
                    yield pa.RecordBatch.from_pydict({"content": content[new], "set": pa.array([sets[r].tobytes() for r in new], pa.binary())})

    return texts.select("text").mapInArrow(tidy(run), "content long, `set` binary")


def _links(rows: DataFrame) -> DataFrame:
    """Links (a, b) of labels, confirmed on full sets, from (cell, content, label, side, set)."""

    def fn(table: pa.Table):
        # A text that several tasks have found stands here several times.
        _, once = np.unique(np.stack((table.column("content").to_numpy(), table.column("side").to_numpy().astype(np.int64))), axis=1, return_index=True)
        labels, side = table.column("label").to_numpy()[once], table.column("side").to_numpy()[once]
        if len(np.unique(labels)) < 2:
            return None
        stars = confirmed(binary_rows(table.column("set").take(once), np.uint64), labels, side)
        return {"a": [a for a, _ in stars], "b": [b for _, b in stars]}

    return _grouped(rows, fn, "a long, b long", "cell")


class _Join:
    """The tables that both phases share."""

    def __init__(self, texts: DataFrame, folder: str):
        self.texts, self.folder = texts, folder
        sketched = persisted(_sketches(texts, "text", "doc_id"), folder, "sketches")
        self.rows = sketched.select("doc_id", "n_shingles", "content")
        # One row per text, that of the least id; copies agree on its tokens.
        least = F.min(F.struct("doc_id", "n_shingles", "roots", "sketch")).alias("m")
        self.plain = persisted(sketched.where("doc_id is not null and n_shingles > 0").groupBy("content").agg(least).select("content", "m.*"), folder, "texts")
        every = self.plain.select("content", F.posexplode("roots").alias("tree", "node"))
        several = every.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        self.roots = persisted(every.join(several, "node").select("node", "content", "tree", "size"), folder, "roots")

    def small_roots(self) -> DataFrame:
        bit = F.expr("shiftleft(1, tree)")
        wide = self.roots.where(F.col("size") > LEAF).groupBy("content").agg(F.bit_or(bit).alias("wide"))
        tokens = self.plain.join(wide, "content", "left").withColumns({"label": F.col("doc_id"), "wide": F.coalesce("wide", F.lit(0))})
        return _clusters(self.roots.where(F.col("size") <= LEAF).drop("size").join(tokens, "content"))

    def large_roots(self) -> DataFrame:
        """(node, tree, size, content, doc_id, n_shingles, sketch)"""
        return self.roots.where(F.col("size") > LEAF).join(self.plain.drop("roots"), "content")

    def links(self, verify: DataFrame, name: str) -> DataFrame | None:
        """Confirms the pairs of all cells; None if there are no links."""
        verify = persisted(verify, self.folder, f"verify-{name}")
        few = verify.count() <= BROADCAST_ROWS
        hint = F.broadcast if few else lambda df: df
        some = self.texts.join(hint(verify.select("doc_id").distinct()), "doc_id", "left_semi")
        rows = _whole_sets(some).join(hint(verify.drop("doc_id")), "content")
        links = persisted(_links(rows).distinct(), self.folder, f"links-{name}")
        return None if links.isEmpty() else links


def _pivot_cells(big: DataFrame) -> DataFrame:
    """A node's texts in slices, each with the node's pivots: the texts with the least hash in each of PIVOTS classes."""
    ordered = big.withColumns({"order": F.xxhash64("node", "content"), "label": F.col("doc_id")})
    least = [F.min(F.when(F.pmod(F.col("order"), F.lit(PIVOTS)) == r, F.col("order"))) for r in range(PIVOTS)]
    picked = ordered.groupBy("node").agg(F.array_compact(F.array(*least)).alias("orders")).select("node", F.explode("orders").alias("order"))
    slices = F.ceil(F.col("size") / SLICE).cast("int")
    return _two_sides(ordered, ordered.join(picked, ["node", "order"]), slices)


def _two_sides(zero: DataFrame, one: DataFrame, slices) -> DataFrame:
    """(cell, side, content, doc_id, label, n_shingles, sketch): rows of ``zero`` in one slice each, those of ``one`` in all slices of their node."""
    cols = ["content", "doc_id", "label", "n_shingles", "sketch"]
    dealt = zero.select(F.xxhash64("node", F.pmod(F.xxhash64(F.lit(7), "content"), slices).cast("int")).alias("cell"), F.lit(0).alias("side"), *cols)
    copied = one.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    return dealt.unionByName(copied.select(F.xxhash64("node", "slice").alias("cell"), F.lit(1).alias("side"), *cols))


def _block_cells(big: DataFrame) -> DataFrame:
    """Each pair of blocks of about SLICE texts of a node meets in one cell."""
    cols = ["content", "doc_id", "label", "n_shingles", "sketch"]
    blocks = F.ceil(F.col("size") / SLICE).cast("int")
    rows = big.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "content"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cell = F.xxhash64(F.lit(3), "node", F.least("block", "other"), F.greatest("block", "other")).alias("cell")
    one = rows.where("block <= other").select(cell, F.lit(0).alias("side"), *cols)
    return one.unionByName(rows.where("block >= other").select(cell, F.lit(1).alias("side"), *cols))


_LEVEL = "node long, content long, doc_id long, label long, n_shingles long, sketch binary"


def _children(rows: DataFrame) -> DataFrame:
    """One level on: a node's own hash chooses BRANCH coordinates of the sketch."""

    def run(batch: pa.RecordBatch):
        if not batch.num_rows:
            return
        node = batch.column(0).to_numpy().view(np.uint64)
        sketches = _matrix(batch.column(5), np.uint8).astype(np.uint64)
        draw = tb.mix64(node[:, None] + np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.argpartition(draw, BRANCH, axis=1)[:, :BRANCH]
        token = np.take_along_axis(sketches, at, 1)
        child = tb.mix64(tb.mix64(node[:, None] ^ (at.astype(np.uint64) + np.uint64(1) << np.uint64(20))) ^ token).view(np.int64)
        for b in range(BRANCH):
            yield {"node": child[:, b]} | {c: batch.column(i + 1) for i, c in enumerate(("content", "doc_id", "label", "n_shingles", "sketch"))}

    return map_batches(rows.select("node", "content", "doc_id", "label", "n_shingles", "sketch"), run, _LEVEL)


def _recursed(level: DataFrame, folder: str) -> DataFrame | None:
    """Cells to confirm of all nodes below (and of) large labelled roots; None if there are none."""
    small, facing = [], []
    for depth in range(DEPTH + 1):
        counts = level.groupBy("node", "label").agg(F.count("*").alias("n"))
        mixed = counts.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("top")).where("size > top.n")
        here = persisted(level.join(mixed.select("node", "size", F.col("top.n").alias("most"), F.col("top.label").alias("main")), "node"), folder, f"level-{depth}")
        kind = F.when(F.col("size") <= LEAF, 0).when(F.col("size") - F.col("most") <= LEAF, 1).otherwise(2)
        here = here.withColumn("kind", kind)
        kinds = {r.kind for r in here.select("kind").distinct().collect()}
        if 0 in kinds:
            small.append(here.where("kind = 0"))
        if 1 in kinds:
            rest, main = here.where("kind = 1 and label <> main"), here.where("kind = 1 and label = main")
            small.append(rest)
            facing.append(_two_sides(main, rest, F.ceil(F.col("most") / SLICE).cast("int")))
        if 2 not in kinds:
            break
        if depth == DEPTH:
            facing.append(_block_cells(here.where("kind = 2")))
        else:
            level = _children(here.where("kind = 2"))
    parts = []
    if small:
        members = functools.reduce(DataFrame.unionByName, [x.select("node", "content", "doc_id", "label", "n_shingles", "sketch") for x in small])
        parts.append(_clusters(members.withColumn("tree", F.lit(-1))))
    if facing:
        parts.append(_facing(functools.reduce(DataFrame.unionByName, facing)))
    return functools.reduce(DataFrame.unionByName, parts) if parts else None


def classes(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row."""
    folder = shared_dir(df.sparkSession, "near")
    join = _Join(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), folder)
    verify, large = join.small_roots(), not join.roots.where(F.col("size") > LEAF).isEmpty()
    if large:
        verify = verify.unionByName(_facing(_pivot_cells(join.large_roots().where(F.col("tree") < PIVOT_TREES))))
    own = join.plain.select("content", "doc_id").withColumnRenamed("doc_id", "label")
    links = join.links(verify, "first")
    if links is not None:
        own = _relabelled(own, links, folder, "first")
    if large:
        level = join.large_roots().join(own, "content").select("node", "content", "doc_id", "label", "n_shingles", "sketch")
        verify = _recursed(level, folder)
        links = None if verify is None else join.links(verify, "second")
        if links is not None:
            own = _relabelled(own, links, folder, "second")
    labels = persisted(own, folder, "labels")
    discard_others(df.sparkSession, folder, ["sketches", "labels"])
    found = join.rows.join(labels, "content", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id")))
    return found.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _relabelled(own: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """(content, label) with the labels that links join set to the least of them."""
    moved = components(links, folder, f"cc-{name}").where("v <> root").select(F.col("v").alias("label"), "root")
    return own.join(moved, "label", "left").select("content", F.coalesce("root", "label").alias("label"))
