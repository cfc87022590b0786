import re

import numpy as np

from tracemill.llm import quality


def test_em_recovers_the_labellers():
    rng = np.random.default_rng(0)
    n, share = 40_000, 0.2
    bad = rng.random(n) < share
    hit = np.array([0.9, 0.3, 0.5, 0.2, 0.6, 0.4, 0.3, 0.7])
    false = np.array([0.01, 0.02, 0.05, 0.01, 0.1, 0.02, 0.2, 0.03])
    v = (rng.random((n, 8)) < np.where(bad[:, None], hit, false)).astype(int)
    v[rng.random((n, 8)) < 0.3] = 2
    patterns, counts = np.unique(quality.pattern_of(v), return_counts=True)
    got, rates, post = quality.fit_labellers(patterns, counts)
    assert abs(got - share) < 0.03
    assert np.abs(rates[:, 0] - hit).max() < 0.1 and np.abs(rates[:, 1] - false).max() < 0.03
    said = post[np.searchsorted(patterns, quality.pattern_of(v))] > 0.5
    assert (said == bad).mean() > 0.93


def test_against_labels(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality")
    rows = quality.op2_quality(spark, small).join(labels, "doc_id").collect()
    assert docs.count() == quality.op2_quality(spark, small).count()
    bad = np.array([r.quality == 0 for r in rows])
    kept = np.array([r.kept for r in rows])
    print("clean documents dropped", (~kept & ~bad).sum(), "of", (~bad).sum(), "bad documents kept", (kept & bad).sum(), "of", bad.sum())
    assert (~kept & ~bad).sum() <= 0.01 * (~bad).sum()
    assert (kept & bad).mean() < 0.05


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "word", 1.0), (3, "word", 1.0), (None, "x " * 100_000, 2.0)], "doc_id long, text string, score double")
    model = quality.fit(df)
    rows = quality.score(df, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality.drop_bad(df, model).columns == df.columns
    kept = {r.doc_id for r in rows if r.kept}
    assert {r.doc_id for r in quality.drop_bad(df, model).collect()} == kept
    empty = df.limit(0)
    assert quality.fit(empty) is None and quality.score(empty, None).collect() == [] and quality.drop_bad(empty, None).collect() == []


def plain_figures(text):
    """(number of words, figures) of a text by loops."""
    data = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    symbols, upper = sum(c in b"#$%&*@^~|<>{}[]=\\+_" for c in data), sum(65 <= c <= 90 for c in data)
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    n, div = len(words), lambda a, b: a / max(b, 1)
    lines = [x for x in data.split(b"\n") if x]
    out = [
        div(symbols, len(data) + 1),
        div(upper, sum(map(letter, data))),
        div(sum(len(w) == 1 and not letter(w[0]) and not 48 <= w[0] <= 57 for w in words), n),
        div(sum(w[-1] == 33 for w in words), n),
        div(sum(a == b for a, b in zip(words, words[1:])), n),
        1 - len(set(words)) / max(n, 1) ** 0.8,
        1 - div(sum(w[-1] in b".?!,;:" for w in words), n),
        1 - (len(set(lines)) / len(lines) if lines else 1),
    ]
    return n, out


def plain_features(text):
    from tracemill.llm.common import mix, range_hashes

    hashed = lambda b: int(range_hashes(np.frombuffer(b, dtype=np.uint8), np.array([0]), np.array([len(b)]))[0])
    mixed = lambda x: int(mix(np.array([x % 2**64], dtype=np.uint64))[0])
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
    shapes = []
    for w in words:
        s = bytes(quality._SHAPE[c] for c in w)
        shapes.append(hashed(bytes(c for i, c in enumerate(s) if i == 0 or c != s[i - 1])))
    n, counts = len(words), {}
    for i, w in enumerate(words):
        before = shapes[i - 1] if i else 0
        repeat = (i > 0 and words[i - 1] == w) + 2 * (i > 1 and words[i - 2] == w)
        for k, f in enumerate((shapes[i], mixed(shapes[i] + 3 * before), repeat, min(len(w), 20))):
            slot = mixed(f + k * 1_000_003) % quality.DIMENSIONS
            counts[k, slot] = counts.get((k, slot), 0) + 1
    out = np.zeros(quality.DIMENSIONS)
    for (_, slot), c in counts.items():
        out[slot] += np.sqrt(c / n)
    return out * n / (n + 4)


def plain_em(patterns, counts, rounds=200):
    """Expectation-maximisation, pattern by pattern."""
    said = [[p // 3**j % 3 for j in range(8)] for p in patterns]
    post = [0.98 if 1 in v else 0.02 for v in said]
    for _ in range(rounds):
        share = min(max(sum(c * p for c, p in zip(counts, post)) / sum(counts), 1e-4), 0.5)
        rates = []
        for j in range(8):
            ones, told = [0.3 * 5, 0.02 * 5], [5.0, 5.0]
            for v, c, p in zip(said, counts, post):
                for k, w in enumerate((p, 1 - p)):
                    ones[k] += c * w * (v[j] == 1)
                    told[k] += c * w * (v[j] != 2)
            hit = min(max(ones[0] / told[0], 0.02), 0.999)
            rates.append((hit, min(max(ones[1] / told[1], 1e-5), 0.5), hit * 0.8))
        rates = [(a, min(b, most)) for a, b, most in rates]
        new = []
        for v in said:
            z = np.log(share / (1 - share))
            for x, (a, b) in zip(v, rates):
                z += np.log(a / b) if x == 1 else np.log((1 - a) / (1 - b)) if x == 0 else 0
            new.append(1 / (1 + np.exp(-z)))
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-9
        if done:
            break
        post = new
    return share, post


def test_scores_are_those_of_a_plain_scorer(spark, tiny):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{tiny}/documents.parquet").collect() if len(r.text or "") < 6000]
    rows += [(-1, ""), (-2, "one"), (-3, "A A A B B !\n\nA A A B B !\nç é # $"), (-4, "long " * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(df)
    told = {}
    for _, t in rows:
        n, fig = plain_figures(t)
        v = [2 if n < least else 1 if x > hi else 0 if x < lo else 2 for x, (hi, lo), least in zip(fig, quality.BOUNDS, quality.LEAST_WORDS)]
        told.setdefault(sum(x * 3**j for j, x in enumerate(v)), []).append(t)
    patterns = sorted(told)
    assert patterns == model.patterns.tolist()
    share, post = plain_em(patterns, [len(told[p]) for p in patterns])
    assert abs(share - model.share) < 1e-6 and np.abs(np.array(post) - model.posterior).max() < 1e-5
    of_text = {t: 1 - p for k, p in zip(patterns, post) for t in told[k]}
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    for doc_id, t in rows:
        z = plain_features(t) @ model.weights[:-1] + model.weights[-1]
        assert abs(got[doc_id].score - 1 / (1 + np.exp(z))) < 1e-4 and abs(got[doc_id].labellers_score - of_text[t]) < 1e-5


def test_the_linear_model_is_at_its_minimum():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(800, 60))).astype(np.float32)
    y = (x @ rng.normal(size=60) + rng.normal(size=800) > 0).astype(float)
    w = quality.fit_linear(x, y)
    whole = np.hstack([x, np.ones((800, 1))])
    for _ in range(20_000):  # plain descent from there leads nowhere lower
        p = 1 / (1 + np.exp(-whole @ w))
        w = w - 0.02 * (whole.T @ (p - y) / 800 + 2e-4 * np.append(w[:-1], 0))
    loss = lambda w: quality._loss(whole.astype(np.float32), y, w.astype(np.float32), 2e-4)[0]
    assert loss(quality.fit_linear(x, y)) < loss(w) + 1e-4
