import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tracemill.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=4, threshold=85):
    sets = [shingles(t, k) for _, t in rows]
    union = jaccard.Union(len(rows))
    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in index[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= threshold * (len(s) + len(sets[j]) - both):
                union.join(i, j)
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        r = union.find(i)
        if doc_id is not None:
            first[r] = min(first.get(r, doc_id), doc_id)
    return sorted(((d, len(s), first.get(union.find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("threshold", [80, 85])
def test_similar_sets_share_a_signature(threshold):
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        room = (100 - threshold) * 2 * n // (100 + threshold)
        gone, come = int(rng.integers(0, room + 1)), int(rng.integers(0, room + 1))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, come).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= threshold * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert np.intersect1d(jaccard.signatures(a, threshold), jaccard.signatures(b, threshold)).size, (len(a), len(b))


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 3000))).astype(np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, len(a))) :], rng.integers(0, 2**63, int(rng.integers(0, 900))).astype(np.uint64)]))
        x, y = jaccard.folded([np.frombuffer(jaccard.sketch_of(s), dtype=np.uint64) for s in (a, b)])
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def family(rng, vocab, n_words, copies, most):
    base = [rng.choice(vocab) for _ in range(n_words)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 2)] = [rng.choice(vocab)] * rng.randint(0, 2)
        yield " ".join(w)


def rows_of(seed=9):
    rng = random.Random(seed)
    vocab = [f"W{k}" for k in range(5000)]
    texts = [t for n in (6, 12, 30, 80, 200) for _ in range(6) for t in family(rng, vocab, n, 8, max(1, n // 25))]
    texts += ["", None, "one", "ONE", "two words", "Two  words", "a b c", "a b c d", " \n"] + ["same text of five words"] * 30
    ids = rng.sample(range(10**9), len(texts))
    return [(i, t) for i, t in zip(ids, texts, strict=True)] + [(None, texts[0]), (None, "nobody knows this at all"), (ids[0], texts[0])]


@pytest.mark.parametrize("unit", [1024, 3])
def test_planted_families(spark, monkeypatch, unit):
    monkeypatch.setattr(jaccard, "UNIT", unit)
    monkeypatch.setattr(jaccard, "GROUP_UNIT", unit)
    monkeypatch.setattr(jaccard, "UNIT_SHINGLES", 100 * unit)
    monkeypatch.setattr(jaccard, "BLOCK_ENTRIES", 500)
    monkeypatch.setattr(jaccard, "BUCKET_ENTRIES", 2000)
    rows = rows_of()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, cluster string").repartition(5)
    assert result(jaccard.similar_documents(df)) == brute(rows)


def test_large_group_holds_each_node_once(spark):
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(4):  # chains: only neighbours are plausible
        s = rng.integers(0, 2**63, 200).astype(np.uint64)
        for _ in range(30):
            s = np.concatenate([s[12:], rng.integers(0, 2**63, 12).astype(np.uint64)])
            sets.append(np.unique(s))
    names = jaccard.names_of(sets)
    own = np.sort(names)
    body = jaccard.pack(np.full(len(own), 77, dtype=np.uint64), own, np.arange(len(own), dtype=np.uint32))
    groups = jaccard._bucket_groups(10)((None,), pa.table({"body": pa.array([body], pa.binary())}))
    assert sorted(groups["node"].to_pylist()) == own.tolist() and set(groups["blocks"].to_pylist()) == {12}
    rows = [(int(n), len(s), bytearray(jaccard.sketch_of(s))) for n, s in zip(names, sets, strict=True)]
    classes = spark.createDataFrame(rows, "node long, size long, sketch binary")
    table = spark.createDataFrame([tuple(r.values()) for r in groups.to_pylist()], "gid long, block int, blocks int, node long")
    links = jaccard._candidate_links(table, classes, 85, 10)
    got = {r.node: r.root for r in jaccard.components(links).collect()}
    union = jaccard.Union(len(sets))
    wide = jaccard.folded([np.frombuffer(jaccard.sketch_of(s), dtype=np.uint64) for s in sets])
    for i, j in itertools.combinations(range(len(sets)), 2):
        if np.bitwise_count(wide[i] ^ wide[j]).sum() * 185 <= 15 * (len(sets[i]) + len(sets[j])):
            union.join(i, j)
    roots = union.roots()
    assert len(set(roots.tolist())) == 4
    assert got == {int(names[i]): int(min(names[roots == roots[i]])) for i in range(len(sets))}


def test_other_size_and_threshold(spark):
    rows = rows_of(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard.similar_documents(df, words=5, threshold=80)) == brute(rows, 5, 80)


def test_query(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert result(jaccard.op9_jaccard_join(spark, tiny)) == brute(rows)


def test_empty(spark):
    assert jaccard.similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    union = {}
    find = lambda x: x if union.setdefault(x, x) == x else find(union[x])
    for a, b in edges:
        a, b = find(a), find(b)
        union[max(a, b)] = min(a, b)
    want = {x: find(x) for x in itertools.chain(*((a, b) for a, b in edges if a != b))}
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_words_that_a_polynomial_hash_confuses(spark):
    from test_bpe import thue_morse

    rows = [(k, thue_morse(n, letters)) for k, (n, letters) in enumerate((n, x) for n in (1024, 2048, 4096) for x in ("ab", "ba"))]
    rows += [(10 + i, " ".join(f"{t}{k}" for k in range(30))) for i, t in enumerate((thue_morse(1024), thue_morse(1024, "ba")))]
    assert result(jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_sets_with_one_name_are_told_apart(spark):
    rows = rows_of(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard.similar_documents(df, name_bits=5)) == brute(rows)


def test_unrelated_sets_share_no_signature():
    rng = np.random.default_rng(4)
    for size in (7, 13, 20, 40):
        sets = [np.unique(rng.integers(0, 2**63, size).astype(np.uint64)) for _ in range(20_000)]
        sig, of = jaccard.signatures_of(sets, 85)
        sig, of = jaccard._pairs(sig, of)
        assert np.unique(sig, return_counts=True)[1].max() <= 6, size


def test_drop_similar_decides_by_row(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a), (5, a + " x"), (5, b), (7, b + " y"), (7, b + " z"), (None, a + " w"), (None, "nobody has this"), (9, "twice the same row"), (9, "twice the same row"), (2, None), (2, None), (3, "")]
    df = spark.createDataFrame([(i, t, k, "m") for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int, _mark string")
    got = jaccard.drop_similar(df)
    assert got.columns == df.columns
    kept = sorted(r.row for r in got.collect())
    assert kept in ([0, 2, 6, 7, 9, 10, 11], [0, 2, 6, 8, 9, 10, 11])
    assert jaccard.drop_similar(df.limit(0)).collect() == []


def test_very_long_text(spark):
    rng = random.Random(3)
    long = " ".join(f"v{rng.randrange(5000)}" for _ in range(300_000))
    rows = [(1, long), (2, long + " more"), (3, "word " * 200_000), (4, "short text of five words")]
    assert result(jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
