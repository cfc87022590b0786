"""Hard negatives against brute force, and the tree's ranges against plain distances."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, row string, score int"


def plain(rows, positives=5, negatives=3, low=50, high=95, every=50):
    usable = [(i, y, [math.floor(256 * c) for c in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for at, (i, y, q) in enumerate(usable):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, z) for k, (j, z, v) in enumerate(usable) if k != at)
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            inside = [x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(inside)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "clash", 1) for i, v, y in rows], SCHEMA).repartition(5)


def clustered(n, seed=1, width=12, centres=30):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    return [(k, [round(float(c), 4) for c in middle[k % centres] + 0.15 * rng.normal(size=width)], int(rng.integers(0, 4))) for k in range(n)]


@pytest.mark.parametrize("leaf,block,group", [(2048, 8192, 4096), (40, 30, 7)])
def test_equals_brute_force(spark, monkeypatch, leaf, block, group):
    """Also with many leaves of several blocks, where one vector repeats often."""
    for name, x in (("LEAF_ROWS", leaf), ("BLOCK_ROWS", block), ("BLOCK_ANCHORS", group), ("RUN", 3)):
        monkeypatch.setattr(hn, name, x)
    rows = clustered(700)
    rows += [(700 + k, rows[50][1], k % 3) for k in range(120)] + [(5000, None, 1), (5050, [1.0] * 11 + [float("nan")], 1), (5100, [1.0] * 11 + [None], 1), (5150, rows[3][1], None), (None, rows[3][1], 1), (5200, [0.0] * 12, 1)]
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.integers(-(10**6), 10**6, size=6)], k % 3) for k in range(150)]
    assert sorted(tuple(r) for r in hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()) == plain(rows)


def test_few_rows(spark):
    of = lambda rows: sorted(tuple(r) for r in hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0).collect())
    assert of([]) == [] and of([(0, [1.0, 2.0], 1)]) == []
    same = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (2, [0.7, 0.7], 2), (3, [0.7, 0.7], 2), (4, [1.0, 1.0], 2)]
    assert of(same) == plain(same) != []


def test_the_tree_leaves_out_only_what_lies_outside():
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.normal(size=(40, 8))[rng.integers(0, 40, size=3000)] + 0.1 * rng.normal(size=(3000, 8))))
    tree = hn.Tree(x[:1000], float((x * x).sum(axis=1).max()), 0.02)

    def seen(node, d, child):
        for j in np.unique(child).tolist():
            tree.low[node][:, j] = np.minimum(tree.low[node][:, j], d[child == j].min(axis=0))
            tree.high[node][:, j] = np.maximum(tree.high[node][:, j], d[child == j].max(axis=0))

    leaf = tree.place(x, seen)
    q = x[:60]
    s = q @ x.T
    high = np.sort(s, axis=1)[:, [-2, -200]]
    low = np.sort(s, axis=1)[:, [-4, -230]]
    who, where = tree.meets(q, low, high)
    met = set(zip(who.tolist(), where.tolist(), strict=True))
    for i in range(60):
        inside = ((s[i][:, None] >= low[i]) & (s[i][:, None] <= high[i])).any(axis=1)
        assert {(i, k) for k in leaf[inside].tolist()} <= met
    assert len(met) < 0.7 * 60 * tree.n_leaves
