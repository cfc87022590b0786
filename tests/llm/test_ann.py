import numpy as np
from pyspark.sql import functions as F

from tracemill.llm import ann


def brute(ids, m, is_query, k):
    out = {}
    for q in np.flatnonzero(is_query(ids)):
        s = (m * m[q]).sum(axis=1)
        other = np.flatnonzero(ids != ids[q])
        top = other[np.lexsort((ids[other], -s[other]))][:k]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in top]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def recall(got, want):
    return np.mean([len({x for x, _ in got[q]} & {x for x, _ in want[q]}) / len(want[q]) for q in want])


def test_hilbert_walks_through_every_cell():
    n, bits = 3, 3
    grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * n)).reshape(n, -1)
    key = ann.hilbert(grid, bits)
    assert sorted(key) == list(range(1 << bits * n))
    walk = grid[:, np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def test_query_recall(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    want, got = brute(ids, m, lambda i: i % 20 == 0, 20), found(ann.op8_nearest(spark, small))
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q, hits in got.items():
        for i, s in hits:
            assert abs(s - m[ids == q][0] @ m[ids == i][0]) < 1e-12


def test_structured_data_narrow_windows_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    m = centres[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 16))
    m[:900] = m[0]
    m = m.astype(np.float32).astype(float)
    ids = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, m, strict=True)], "vec_id long, embedding array<float>, vector string").repartition(4)
    want, got = brute(ids, m, lambda i: i % 20 == 0, 10), found(ann.nearest(df, F.col("vec_id") % 20 == 0, k=10))
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    hot = [q for q in want if (m[ids == q][0] == m[0]).all()]
    assert hot and np.mean([got[q] == want[q] for q in hot]) > 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [1.0]), (1, [2.0, 1.0]), (2, [-1.0, 3.0]), (None, [1.0, 1.0]), (3, [None, 1.0]), (4, [2.0, 5.0]), (4, [2.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(ann.nearest(df, F.col("vec_id") % 20 == 0)) == {0: [(1, 2.0), (4, 2.0), (2, -1.0)]}
    twice = df.filter("vec_id in (0, 1, 4)").unionByName(df.filter("vec_id = 0"))
    assert found(ann.nearest(twice, F.col("vec_id") % 20 == 0)) == {0: [(1, 2.0), (4, 2.0)]}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.nearest(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).collect() == []


def shares(index, reach):
    """Of the table, the mean share that a query's windows hold, per curve and all together."""
    rows = index.places.collect()
    places = {(r.curve, r.vec_id): r.place for r in rows}
    n, curves = index.n_rows, sorted({r.curve for r in rows})
    own, together = [], []
    for q in sorted({r.vec_id for r in rows if r.asks})[:40]:
        seen = [{r.vec_id for r in rows if r.curve == c and abs(r.place - places[c, q]) <= reach} for c in curves]
        own += [len(x) / n for x in seen]
        together.append(len(set().union(*seen)) / n)
    return len(curves), np.mean(own), np.mean(together)


def test_clusters_are_found_in_narrow_windows_of_several_curves(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 32))
    m = centres[rng.integers(0, 60, 4000)] + 0.2 * rng.normal(size=(4000, 32))
    ids = rng.permutation(4000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    index = ann.Index(df, F.col("vec_id") % 20 == 0)
    reach = index.fit_reach(20, ann.TARGET)
    curves, own, together = shares(index, reach)
    print("curves", curves, "reach", reach, "share of a curve", own, "scored", together)
    assert curves == ann.CURVES and together < 0.3
    assert recall(found(index.search(20, reach)), brute(ids, m, lambda i: i % 20 == 0, 20)) >= 0.9


def test_the_given_table_uses_every_curve(spark, medium):
    rows = spark.read.parquet(f"{medium}/embeddings.parquet").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    index = ann.Index(spark.read.parquet(f"{medium}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
    reach = index.fit_reach(20, ann.TARGET)
    curves, own, together = shares(index, reach)
    print("curves", curves, "reach", reach, "share of a curve", own, "scored", together)
    assert curves == ann.CURVES and own < 0.75
    assert recall(found(index.search(20, reach)), brute(ids, m, lambda i: i % 20 == 0, 20)) >= 0.9


def test_wide_vectors_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_BYTES", 512 * 8 * 40)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 512))
    m[:150] = m[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got, want = found(ann.nearest(df, F.col("vec_id") % 20 == 0, k=5)), brute(np.arange(300), m, lambda i: i % 20 == 0, 5)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
