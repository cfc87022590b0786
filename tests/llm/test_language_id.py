"""Language identification: held-out accuracy, forward-backward against all paths, slopes against differences."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import language_id as li


@pytest.fixture(scope="module")
def field(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    return li.fit(docs.filter(~li.held_out(F.col("doc_id"))))


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = li.op12_language_id(spark, small)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == docs.count()
    both = out.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    assert both.n > 200 and both.a >= 0.98 and 0 <= both.lo <= both.hi <= 1


@pytest.mark.parametrize("block", [1, 2, 5])
def test_forward_backward_equals_all_paths(monkeypatch, block):
    monkeypatch.setattr(li, "BLOCK", block)
    rng = np.random.default_rng(block)
    width, bounds = 3, np.array([0, 5, 5, 6, 12])
    score, move, begin = 2 * rng.normal(size=(12, width)), rng.normal(size=(width, width)), rng.normal(size=width)
    got = li.marginals(score, bounds, move, begin)
    for a, z in itertools.pairwise(bounds.tolist()):
        want = np.zeros((z - a, width))
        for path in itertools.product(range(width), repeat=z - a):
            if path:
                w = np.exp(begin[path[0]] + sum(score[a + i, k] for i, k in enumerate(path)) + sum(move[i, j] for i, j in itertools.pairwise(path)))
                want[np.arange(z - a), path] += w
        assert np.allclose(got[a:z], want / np.maximum(want.sum(axis=1, keepdims=True), 1e-300))


def test_slopes_equal_differences():
    rng = np.random.default_rng(4)
    score, move, begin = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    at, y = np.array([[0, 1, 2, 1], [3, 4, -1, -1], [5, -1, -1, -1]]), np.array([[0, 1, 1, 2], [2, 0, -1, -1], [1, -1, -1, -1]])
    _, *slopes = li._chains(score, at, y, move, begin)
    for x, slope in zip((score, move, begin), slopes, strict=True):
        for i in np.ndindex(x.shape):
            x[i] += 1e-6
            up = li._chains(score, at, y, move, begin)[0]
            x[i] -= 2e-6
            down = li._chains(score, at, y, move, begin)[0]
            x[i] += 1e-6
            assert abs((up - down) / 2e-6 - slope[i]) < 1e-6


def test_code_switched_words(spark, small, field):
    """Two halves of different languages are told apart word by word."""
    docs = spark.read.parquet(f"{small}/documents.parquet").filter(li.held_out(F.col("doc_id"))).filter(F.length("text") > 400)
    half = {r.lang: " ".join(r.text.split()[:30]) for r in docs.select("lang", "text").collect()}
    a, b = sorted(half)[:2]
    said = li.label_words(field, [half[a] + " " + half[b]])[0]
    n = len(li.label_words(field, [half[a]])[0])
    assert np.mean([x == a for _, x, _ in said[:n]]) > 0.85 and np.mean([x == b for _, x, _ in said[n:]]) > 0.85


def test_odd_texts(spark, field):
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "the of and the " * 20_000), (5, "ª"), (6, "x" * 300_000), (6, "the"), (None, "the"), (7, "日本語"), (8, "😀 …")]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, lang_pred string, score string")
    out = li.predict(df, field)
    assert out.columns == ["doc_id", "lang_pred", "score"]
    got = out.collect()
    said = {(r.doc_id, i): r for i, r in enumerate(got)}
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3, 8))
    assert all(by_id[i].lang_pred in field.languages and 0 < by_id[i].score <= 1 for i in (4, 5, 6, 7)) and said
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert li.fit(none) is None and li.predict(none, field).count() == 0
    assert [tuple(r) for r in li.predict(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string"), None).collect()] == [(1, "und", 0.0)]
