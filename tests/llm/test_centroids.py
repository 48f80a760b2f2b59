"""Clusters against a plain k-means on Python integers."""

import hashlib

import numpy as np
import pytest

from lectern.llm import centroids as ce


def plain(rows, k=8, rounds=10, scale=1024, dim=64):
    """[(id, cluster, distance)], inertia by cluster, sha256 by cluster; rows: (id, vector)."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    at = [list(v) for _, v in order[:k]]
    x = np.array([v for _, v in kept], dtype=object).reshape(-1, dim)

    def assign():
        d = np.stack([((x - np.array(c, dtype=object)) ** 2).sum(1) for c in at], 1).astype(np.int64)
        own = d.argmin(1)
        return own, d[np.arange(len(x)), own]

    for _ in range(rounds if kept else 0):
        own, _ = assign()
        at = [[int(s) // int((own == c).sum()) for s in x[own == c].sum(0)] if (own == c).any() else at[c] for c in range(len(at))]
    if not kept:
        return []
    own, d = assign()
    inertia = [int(d[own == c].sum()) for c in range(len(at))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, int(c), int(v), inertia[c], int(d.sum()), sha[c]) for (i, _), c, v in zip(kept, own, d)), key=repr)


def vectors(n=400, dim=64, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.3, (11, dim))
    return [(i, (middle[i % 11] + rng.normal(0, 0.05 + 0.2 * (i % 3 == 0), dim)).astype(np.float32).tolist()) for i in range(n)]


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return sorted(map(tuple, ce.clusters(df, **more).collect()), key=repr)


def test_equal_to_plain(spark):
    rows = vectors()
    bad = list(rows[0][1])
    rows += [(1000, None), (1001, rows[1][1][:63]), (1002, [*bad[:63], None]), (1003, [*bad[:63], float("nan")]), (1004, [*bad[:63], float("-inf")]), (None, rows[3][1]), (7, rows[7][1]), (7, rows[8][1]), (1005, [])]
    got = run(spark, rows)
    assert got == plain(rows) and len(got) == 403


def test_ties_and_few_rows(spark):
    """Whole numbers on a line: many vectors are equally near to two centroids."""
    rows = [(i, [float(i % 13) / 1024, 0.0]) for i in range(90)]
    for k, n in ((8, 90), (8, 5), (1, 20), (3, 0)):
        assert run(spark, rows[:n], k=k, dim=2) == plain(rows[:n], k=k, dim=2)
    same = [(i, [0.5, 0.5]) for i in range(20)]
    assert run(spark, same, dim=2) == plain(same, dim=2)


def test_other_columns_and_doubles(spark):
    rows = [(i, v, 3, "x") for i, v in vectors(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, id string")
    assert sorted(map(tuple, ce.clusters(df).collect()), key=repr) == plain([r[:2] for r in rows])


def test_beyond_range(spark):
    from pyspark.errors import PythonException

    with pytest.raises((ArithmeticError, PythonException)):
        run(spark, [(i, [1e30] * 64) for i in range(3)])


def test_bounds_hold_and_spare_distances():
    """After each step the bounds hold for true distances, the assignment is exact, and most distances are spared."""
    rng = np.random.default_rng(2)
    middle = rng.integers(-900, 900, (8, 16))
    x = middle[np.arange(4000) % 8] + rng.integers(-60, 60, (4000, 16))
    at = x[rng.permutation(4000)[:8]]
    centers = ce.Centers.of(at)
    own, upper, lower = ce.first(x, centers)
    taken = 0
    for _ in range(12):
        totals = ce.sums(x, own, 8)
        new = np.array([t[1:] // t[0] if t[0] else c for t, c in zip(totals, centers.at)])
        centers = ce.Centers.of(new, centers.at)
        taken += ce.step(x, centers, own, upper, lower)
        d2 = ((x[:, None] - new) ** 2).sum(2)
        d = np.sqrt(d2.astype(np.longdouble))
        assert (own == d2.argmin(1)).all() and (upper >= d[np.arange(4000), own]).all() and (lower <= d).all()
    assert taken < 0.4 * 12 * 8 * 4000


def test_largest_integers_are_exact():
    a = np.array([[ce.LARGEST - 1] * 64, [1 - ce.LARGEST] * 64])
    assert ce.squares(a, a[0]).tolist() == [0, 64 * (2 * (ce.LARGEST - 1)) ** 2]
