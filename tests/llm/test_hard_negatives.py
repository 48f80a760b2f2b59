"""Mined negatives against comparing all pairs."""

import numpy as np
import pytest

from lectern.llm import hard_negatives as hn


def plain(rows, anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    """Sorted result rows; rows: (id, vector, label)."""
    kept = [(i, np.floor(scale * np.array(v, np.float64)).astype(np.int64), l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v, l) in enumerate(kept):
        if not anchor(i):
            continue
        scored = [(-int(v[: min(len(v), len(w))] @ w[: min(len(v), len(w))]), j, m) for b, (j, w, m) in enumerate(kept) if b != a]
        for p, j, _ in sorted(s[:2] + (0,) for s in scored if s[2] == l)[:positives]:
            found = sorted(s[:2] for s in scored if s[2] != l and low * -p <= 100 * -s[0] <= high * -p)
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(found[:negatives])]
    return sorted(out)


def vectors(n, dim, seed, clusters=0, labels=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.2, (n, dim))
    if clusters:
        x = 0.15 * x + rng.normal(0, 0.3, (clusters, dim))[np.arange(n) % clusters]
    return [(i, v.astype(np.float32).tolist(), int(rng.integers(labels))) for i, v in enumerate(x)]


def run(spark, rows, every=10, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return sorted(map(tuple, hn.mined(df, f"vec_id % {every} = 0", **more).collect()))


@pytest.mark.parametrize("clusters", [0, 25])
def test_equal_to_plain(spark, clusters):
    rows = vectors(900, 12, 3, clusters)
    v = rows[0][1]
    rows += [(10, v, 2), (10, v, 2), (20, v, 3), (None, v, 1), (990, None, 1), (980, v, None), (970, [*v[:11], None], 1), (960, [*v[:11], float("nan")], 1), (950, [float("inf"), *v[1:]], 2)]
    rows += [(1000, v[:5], 1), (1010, [*v, 0.5, -0.25], 1), (1020, [], 2), (1030, [0.0] * 12, 0), *[(2000 + i, v, i % 3) for i in range(60)]]
    got = run(spark, rows, sample_rows=100, block_rows=90, block_anchors=20, cells=8)
    assert got == plain(rows, lambda i: i % 10 == 0) and len(got) > 200


def test_defaults_many_labels_and_negative_scores(spark):
    rows = [(i, v, i) for i, v, _ in vectors(150, 8, 4)]
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0) == []
    rows = [(i, v, l // 3) for i, v, l in vectors(300, 1, 6)] + [(301, [1e5], 1)]
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_none_and_few(spark):
    assert run(spark, []) == []
    assert run(spark, [(10, [0.5, 0.5], 1)]) == []
    few = [(10, [0.5, 0.5], 1), (11, [0.5, 0.4], 1), (12, [0.3, 0.3], 2), (13, [0.5, 0.5], 2)]
    assert run(spark, few) == plain(few, lambda i: i == 10)


def test_other_columns(spark):
    rows = [(i, v, l, i, "x") for i, v, l in vectors(120, 6, 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, row long, id string")
    assert sorted(map(tuple, hn.mined(df, "vec_id % 10 = 0").collect())) == plain([r[:3] for r in rows], lambda i: i % 10 == 0)


def test_intervals_hold_and_prune():
    """Leaf pairs left out hold no wanted pair; on clustered rows few pairs are left."""
    rng = np.random.default_rng(1)
    rows = vectors(3000, 16, 2, clusters=12, labels=4)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    labels = np.array([l for *_, l in rows])
    some = rng.permutation(3000)[:300]
    a, c = hn.Tree.over(x[some], labels[some], 4), hn.Tree.over(x, labels, 8)
    scores = a.x @ c.x.T
    alike = a.labels[:, None] == c.labels
    for same in (True, False):
        least = np.sort(np.where(alike == same, scores, -1e18), 1)[:, -5].astype(np.int64)
        seen, n = np.zeros(scores.shape, bool), 0
        for i, j, lower, upper in hn.leaf_pairs(a, c, same, least, np.full(300, 1 << 60)):
            part = (slice(a.lo[i], a.hi[i]), slice(c.lo[j], c.hi[j]))
            seen[part] = True
            n += 1
            assert (scores[part] >= lower).all() and (scores[part] <= upper).all()
        assert seen[(alike == same) & (scores >= least[:, None])].all()
        assert n < (0.5 * 0.25 if same else 0.5 * 0.75) * (a.left < 0).sum() * (c.left < 0).sum()  # labels alone leave a quarter, or three


def test_products_are_exact_or_refused():
    a, big = np.full((1, 64), float((1 << 27) - 1)), np.full((1, 4096), float((1 << 27) - 1))
    assert hn.products(a, a).tolist() == [[64 * ((1 << 27) - 1) ** 2]]
    with pytest.raises(ArithmeticError):
        hn.products(big, big)
