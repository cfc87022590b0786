"""Collocations against plain counts, and the automata against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from tracemill.llm import collocations as co


def plain(docs, least, most, longest, inside):
    n, f = Counter(), Counter()
    for text, lang in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {x: c for x, c in f.items() if c >= least and len(x[1]) > 1}
    gone = {(lang, p[i:j]) for (lang, p), c in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * c >= inside * f[lang, p[i:j]]}
    rows = {}
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, m, -s) for lang, some in rows.items() for i, (s, a, p, x, y, m) in enumerate(sorted(some)[:most]))


def some_texts(n, seed=3):
    rng = random.Random(seed)
    words = ["The", "of", "été", "日本", "New", "York", "x", "a" * 70, "la", "Ä", "in", "the"]
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choices(words, weights=[len(words) - i for i in range(len(words))], k=rng.randint(0, 9))) for _ in range(rng.randint(0, 4))]
        out.append((rng.choice([". ", ",", "\n", "\x0b", " \t "]).join(parts), rng.choice(["en", "fr", None])))
    return out


@pytest.mark.parametrize("inside,span,run", [(100, 1 << 19, 1 << 19), (60, 40, 50)])
def test_equals_plain_counts(spark, monkeypatch, inside, span, run):
    """Also with many small ranges and hot phrases that divide them."""
    monkeypatch.setattr(co, "SPAN", span)
    docs = [*some_texts(400), (None, "en"), ("", None), ("  ", "de"), *[("One two three four five six.", "en")] * 7]
    df = spark.createDataFrame([Row(doc_id=i, text=t, lang=x, phrase="clash", score=1) for i, (t, x) in enumerate(docs)], "doc_id long, text string, lang string, phrase string, score int").repartition(5)
    got = co.collocations(df, least=6, most=25, longest=5, inside=inside)
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, 6, 25, 5, inside)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_without_frequent_phrases(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert co.collocations(empty).collect() == []
    assert co.collocations(spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")).collect() == []


def test_a_word_that_is_most_of_a_long_text(spark):
    df = spark.createDataFrame([("go " * 200_000, "en")], "text string, lang string")
    assert [(r.phrase, r.a, r.l, r.r, r.n) for r in co.collocations(df).collect()][:1] == [("go go", 199_999, 200_000, 200_000, 200_000)]


@pytest.mark.parametrize("k", [1, 2, 5])
def test_transducers(k):
    rng = np.random.default_rng(k)
    table = {}
    for row in rng.integers(0, 7, size=(3000, k)):
        table[tuple(row.tolist())] = table.get(tuple(row.tolist()), 0) + int(rng.integers(1, 9))
    keys = np.array(sorted(table), dtype=np.uint64).reshape(-1, k)
    counts = np.array([table[tuple(x)] for x in keys.tolist()])
    builder = co.Builder(k)
    for at in range(0, len(keys), 97):
        builder.add(keys[at : at + 97], counts[at : at + 97])
    made = co.Transducer.load(builder.finish().dump())
    rows, found = made.phrases()
    assert (rows == keys).all() and (found == counts).all()
    asked = np.concatenate([keys, rng.integers(0, 9, size=(500, k)).astype(np.uint64)])
    assert made.find(asked).tolist() == [table.get(tuple(x), -1) for x in asked.tolist()]
    rows, sums = co.united([made.dump(), co.built(keys[::2], counts[::2]).dump(), made.dump()])
    assert dict(zip(map(tuple, rows.tolist()), sums.tolist(), strict=True)) == {x: c * (3 if i % 2 == 0 else 2) for i, (x, c) in enumerate(sorted(table.items()))}


def test_equal_continuations_are_one_state():
    rows = np.array([[a, b, c] for a in range(50) for b in range(10) for c in range(10)], dtype=np.uint64)
    made = co.built(rows, np.full(len(rows), 4))
    assert [len(x[0]) for x in made.levels] == [1, 1, 1] and [len(x[1]) for x in made.levels] == [50, 10, 10]
