import random

import pytest

from lectern.llm import near_dup as nd

from .helpers import near_components


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    docs, passage = [], [word() for _ in range(40)]
    for family in range(8):
        base = [word() for _ in range(rng.choice([3, 6, 30, 200]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            text = list(base)
            for _ in range(int(rng.random() * len(text) * 0.05)):
                text[rng.randrange(len(text))] = word()
            if family % 3 == 0:
                text += passage
            docs.append((len(docs), " ".join(text)))
    docs += [(len(docs), ""), (len(docs) + 1, None), (len(docs) + 2, docs[0][1].upper()), (len(docs) + 3, " \n\t")]
    return docs


def check(spark, docs):
    rows = nd.classes(spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, content string")).collect()
    assert len(rows) == len(docs)
    want, sizes = near_components(docs)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id)


def test_brute_force(spark):
    check(spark, corpus(1))


def test_large_nodes_branch_and_compare_in_blocks(spark, monkeypatch):
    """Tiny leaves and little depth: pivots, children and the last blocks all take part."""
    monkeypatch.setattr(nd, "LEAF", 6)
    monkeypatch.setattr(nd, "SLICE", 4)
    monkeypatch.setattr(nd, "DEPTH", 1)
    check(spark, corpus(2))


@pytest.mark.parametrize("depth", [0, 6])
def test_a_large_group_of_near_copies_ends(spark, monkeypatch, depth):
    """Most texts of a large root get one label; the few others meet them in slices, or blocks."""
    monkeypatch.setattr(nd, "LEAF", 20)
    monkeypatch.setattr(nd, "SLICE", 8)
    monkeypatch.setattr(nd, "DEPTH", depth)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            text[rng.randrange(120)] = f"x{rng.random()}"
        docs.append((i, " ".join(text)))
    check(spark, docs)


def test_very_long_texts(spark):
    long = [f"w{i * 7919 % 100003}" for i in range(150_000)]
    check(spark, [(5, " ".join(long)), (3, " ".join(long[:140_000])), (9, " ".join(long[:90_000])), (1, "a b c")])


def test_nulls_and_empty(spark):
    check(spark, [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (2, "A B C D E F"), (7, None)])
    assert nd.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("same,union,linked", [(3, 4, True), (74, 100, False), (75, 100, True)])
def test_threshold(same, union, linked):
    import numpy as np

    a = np.arange(union, dtype=np.uint64)
    found = nd.confirmed([a, a[:same]], np.array([7, 3]), np.array([-1, -1]))
    assert found == ([(7, 3)] if linked else [])


def test_confirmed_sides():
    import numpy as np

    a, b = np.arange(100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64)
    sets, labels = [a, b, np.arange(200, 300, dtype=np.uint64)], np.array([1, 2, 3])
    assert nd.confirmed(sets, labels, np.array([0, 1, 1])) == [(2, 1)]
    assert nd.confirmed(sets, labels, np.array([1, 1, 0])) == []
    assert nd.confirmed(sets, np.array([5, 5, 3]), np.array([-1, -1, -1])) == []


def test_pairs_that_first_meet_in_a_hot_root(spark):
    """The passage that all texts share makes a root of over LEAF texts in tree 0; the pairs' later roots are small."""
    passage, docs = [f"p2946w{i}" for i in range(60)], []
    for pair in range(150):
        both = [f"b{pair}x{i}" for i in range(240)]
        docs += [(2 * pair + k, " ".join(passage + both + [f"v{pair}c{k}x{i}" for i in range(46)])) for k in (0, 1)]
    check(spark, docs)
