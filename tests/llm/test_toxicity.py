import itertools
import random
import zlib

import numpy as np

from tracemill.llm import toxicity as tox


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(terms, word):
    best = None
    for i, (t, stem) in enumerate(terms):
        near = min(distance(t, word[:k]) for k in range(len(word) + 1)) if stem else distance(t, word)
        if near == 0 or (near == 1 and len(t) >= tox.LEAST_FUZZY):
            best = min(best or (9, 9), (near, i))
    return -1 if best is None else 2 * best[1] + best[0]


def test_automaton_is_the_edit_distance():
    rng = random.Random(1)
    terms = [(b"abcab", False), (b"abcb", True), (b"ccaab", True), (b"bbb", False), (b"bbbbbb", False), ("née-é".encode(), False)]
    auto = tox.Automaton(terms)
    words = [bytes(w) for n in range(7) for w in itertools.product(b"abc", repeat=n)]
    words += [bytes(rng.choice(b"abcx") for _ in range(rng.randint(7, 12))) for _ in range(500)] + ["née-é".encode(), "nee-é".encode(), "néé-é".encode()]
    data = np.frombuffer(b"".join(words) + b" ", dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    assert auto.walk(data, at[:-1], at[1:]).tolist() == [brute(terms, w) for w in words]


def test_quotation_counts_less():
    auto = tox.Automaton([(b"rotter", False)])
    w = np.array([3.0, 2.0, 0, 0])
    plain, quoted, marks, wrong, none = tox.features([b"you rotter you", b'he said "rotter" to me', "he said « Rotter! » to me".encode(), b"such a rottter, this", b""], auto, w)
    assert plain[0] > 0 and quoted[0] == marks[0] == 0 and quoted[2] > 0 and marks[2] > 0
    assert plain[3] > quoted[3] and wrong[1] > 0 and wrong[0] == 0 and not none.any()


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable")) + 1.0
    for s in np.unique(score):
        order[score == s] = order[score == s].mean()
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_labels(spark, medium):
    got = tox.op10_toxicity(spark, medium)
    assert got.count() == spark.read.parquet(f"{medium}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{medium}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    score, label = np.array([r.score for r in held]), np.array([r.toxic for r in held])
    print("held out", len(held), "auc", auc(score, label), "accuracy", ((score >= 0.5) == label).mean())
    assert auc(score, label) > 0.95 and ((score >= 0.5) == label).mean() > 0.97


def test_edges(spark):
    rows = [(i, f"fine words number {i}", 0) for i in range(60)] + [(100 + i, f"what a blitherer you are {i}", 1) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tox.fit(df)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "blitherer", "x"), (3, "blitherer", "x"), (None, "a bliterer " * 3000, "x"), (5, "ordinary text", "x")], "doc_id long, text string, score string")
    got = {(r.doc_id, round(r.score, 6)) for r in tox.score(odd, model).collect()}
    by = dict(got)
    assert len(got) == 5 and by[3] > 0.5 and by[None] > 0.5 and max(by[1], by[2], by[5]) < 0.5 and by[1] == by[2]
    assert tox.score(odd.limit(0), model).collect() == []
    assert not tox.fit(df.limit(0)).terms and all(r.score < 0.5 for r in tox.score(odd, tox.fit(df.limit(0))).collect())


def test_states_that_are_forgotten_change_nothing(monkeypatch):
    rng = random.Random(4)
    terms = [(bytes(rng.choice(b"abcde") for _ in range(rng.randint(3, 30))), rng.random() < 0.4) for _ in range(400)]
    words = [bytes(rng.choice(b"abcdex") for _ in range(rng.randint(1, 9))) for _ in range(800)] + [t + b"x" * rng.randint(0, 2) for t, _ in terms] + [b"ab" * 4000]
    data = np.frombuffer(b"".join(words) + b" ", dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    auto = tox.Automaton(terms)
    want = auto.walk(data, at[:-1], at[1:])
    monkeypatch.setattr(tox, "KEPT_STATES", 10)
    for k in range(0, len(words), 90):
        part = slice(k, k + 90)
        assert auto.walk(data, at[:-1][part], at[1:][part]).tolist() == want[part].tolist()
    assert want[:200].tolist() == [brute(terms, w) for w in words[:200]]


MARKS = [chr(c) for c in (0x22, 0xAB, 0xBB, *range(0x2018, 0x2020), 0x2039, 0x203A)]


def plain_score(model, text):
    """The score by loops over the characters and words of a text."""
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    is_word = lambda c: (c.isascii() and (c.islower() or c.isdigit())) or (ord(c) >= 0xC0 and not 0x2000 <= ord(c) <= 0x207F)
    words, begin = [], None
    for i, c in enumerate(text + " "):
        if is_word(c) and begin is None:
            begin = i
        elif not is_word(c) and begin is not None:
            words.append((begin, i))
            begin = None
    terms = [(t.encode(), s) for t, s in model.terms]
    known = {}
    for a, b in words:
        if text[a:b] not in known:
            known[text[a:b]] = brute(terms, text[a:b].encode())
    codes = [known[text[a:b]] for a, b in words]
    hits = [i for i, c in enumerate(codes) if c >= 0]
    exact = wrong = inside = total = near = sure = 0.0
    largest = 0.0
    for i in hits:
        lo, hi = max(0, i - tox.WINDOW), min(len(words) - 1, i + tox.WINDOW)
        left, right = 0 if lo == 0 else words[lo][0], len(text) if hi == len(words) - 1 else words[hi][1]
        quoted = any(c in MARKS for c in text[left : words[i][0]]) and any(c in MARKS for c in text[words[i][1] : right])
        value = model.weights[codes[i]]
        inside, exact, wrong = inside + quoted, exact + (not quoted and codes[i] % 2 == 0), wrong + (not quoted and codes[i] % 2 == 1)
        total += value * (0.25 if quoted else 1)
        largest = max(largest, value * (0.25 if quoted else 1))
        near += np.log1p(sum(lo <= j <= hi for j in hits) - 1) * (not quoted and value > 0)
        sure += value > 0
    x = [np.log1p(exact), np.log1p(wrong), np.log1p(inside), np.sign(total) * np.log1p(abs(total)), largest, np.log1p(near), np.log1p(100 * sure / max(len(words), 1)), np.log1p(len({codes[i] // 2 for i in hits}))]
    return 1 / (1 + np.exp(-(np.dot(x, model.linear[:-1]) + model.linear[-1])))


def test_scores_are_those_of_a_plain_scorer(spark):
    rng = random.Random(6)
    terms = [("blitherer", False), ("rott", True), ("née", False), ("abc", False), ("scoundrelly-nothing"[:12], True)]
    model = tox.Model(terms)
    model.weights = np.array([3.0, 1.5, 2.0, 1.0, -0.5, 0.0, 1.0, 0.2, 2.5, 2.0, 0.0, 0.0])
    model.linear = np.array([1.1, 0.7, 0.3, 0.9, 0.4, 0.6, 0.2, 0.5, -3.0])
    bits = ["blitherer", "Bliterer", "rotten", "ROTTER", "rot", "née", "nee", "abc", "abd", "scoundrelly", "fine", "words", "here", '"', "« ", " »", "“", "”", "\u2019", ".", "!", "7", "中文", "\n"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", "", ", "]) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", None, "rotten " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in tox.score(df, model).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - plain_score(model, t)) < 1e-9, t


def test_number_of_terms_follows_the_held_out_loss(spark):
    rng = random.Random(2)
    slurs = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(120)]
    rows = [(i, "plain words and " + (rng.choice(slurs) + " more" if i % 4 == 0 else "nothing else"), int(i % 4 == 0)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tox.fit(df)
    assert len(model.terms) > 80
    scored = {r.doc_id: r.score for r in tox.score(df, model).collect()}
    assert np.mean([(scored[i] >= 0.5) == y for i, _, y in rows]) > 0.99


def test_null_ids_are_not_held_out(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (3, "b"), (5, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 0), (5, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = {r.doc_id: r for r in tox.op10_toxicity(spark, str(tmp_path)).collect()}
    assert len(rows) == 3 and rows[None].held_out is False and rows[None].score is not None
