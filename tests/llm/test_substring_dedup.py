import hashlib
import random
import re

import numpy as np

from tracemill.llm import substring_dedup as sub

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    place = lambda i: (i is None, i or 0)
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            g, p = tuple(w[k : k + window]), (place(i), k)
            first[g] = min(first.get(g, p), p)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (place(i), k):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def digest(rows):
    out = []
    for r in rows:
        kept = " ".join(WORD.findall(r.row.text or ""))
        out.append((r.row.doc_id, r.n_words, r.n_removed, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in sub.op6_substring_dedup(spark, tiny).collect()), key=str) == brute(rows)


def test_planted(spark, monkeypatch):
    monkeypatch.setattr(sub, "BUCKET_ENTRIES", 200)
    monkeypatch.setattr(sub, "BLOCK_WINDOWS", 300)
    rng = random.Random(7)
    vocab = [f"w{k}é" for k in range(3000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [some(n) for n in (20, 21, 19, 60, 400)]
    rows = []
    for i in range(120):
        words = some(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            p, at = rng.choice(passages), rng.randint(0, len(words))
            words[at:at] = p
        rows.append((rng.randint(0, 10**12), rng.choice([" ", "\n", "\t  "]).join(words)))
    rows += [(5, "x " * 100), (6, "x " * 45), (7, None), (8, ""), (9, "one"), (None, rows[0][1]), (rows[3][0], rows[3][1]), (-4, rows[3][1])]
    df = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, n_words int, rest string, _key int").repartition(6)
    got = sub.remove_repeats(df, batches=4)
    assert digest(got.collect()) == brute(rows)
    assert got.select("row.*").columns == df.columns
    assert got.filter("row.doc_id = 7").first().row.text is None


def test_null_and_repeated_ids(spark):
    word = lambda name, n: [f"{name}{k}" for k in range(n)]
    p = word("p", 20)
    rows = [
        (None, word("a", 40) + p),  # its repeat starts past the end of the next row
        (None, word("b", 25)),
        (None, word("q", 21)),
        (None, word("q", 21)),  # the same passage at the same start
        (4, p + ["tail"]),
        (5, word("r", 22) + word("c", 30)),  # one id, two texts
        (5, word("r", 22) + word("d", 3)),
        (6, word("e", 2) + p),  # a row given twice
        (6, word("e", 2) + p),
    ]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").coalesce(1)
    for some in (df, df.repartition(7)):
        got = sorted(((r.row.doc_id or 0, r.row.text.split(), r.n_words, r.n_removed) for r in sub.remove_repeats(some).collect()), key=str)
        first, second = (30, 3) if some is df or (5, word("d", 3), 25, 22) in got else (3, 30)
        names = {30: "c", 3: "d"}
        want = [(0, word("a", 40), 60, 20), (0, word("b", 25), 25, 0), (0, word("q", 21), 21, 0), (0, [], 21, 21), (4, p + ["tail"], 21, 0), (6, word("e", 2), 22, 20), (6, word("e", 2), 22, 20)]
        want += [(5, word("r", 22) + word(names[first], first), 22 + first, 0), (5, word(names[second], second), 22 + second, 22)]
        assert got == sorted(want, key=str)


def test_empty(spark):
    assert sub.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_layout_is_kept(spark):
    a = " ".join(f"p{k}" for k in range(20))
    rows = [(1, a), (2, f"  Head\n\nline  one\n{a}\n tail \n")]
    got = {r.row.doc_id: r.row.text for r in sub.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == a and got[2].split() == ["Head", "line", "one", "tail"] and "Head\n\nline  one\n" in got[2]


def test_blocks_round_trip():
    a = np.sort(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64))
    b = np.array([-5, 3, 2**62], dtype=np.int64)
    c = np.arange(7, dtype=np.uint32)
    for x, y in zip(sub.unpack(sub.pack(a, b, c, a[:0])), (a, b, c, a[:0]), strict=True):
        assert np.array_equal(x, y) and x.dtype == y.dtype


def test_words_that_a_polynomial_hash_confuses(spark):
    from test_bpe import thue_morse

    tail = [f"t{k}" for k in range(30)]
    for n in (1024, 2048, 4096):
        rows = [(1, " ".join([thue_morse(n), *tail])), (2, " ".join([thue_morse(n, "ba"), *tail]))]
        got = {r.row.doc_id: (r.n_words, r.n_removed) for r in sub.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {1: (31, 0), 2: (31, 30)}


def test_fingerprints_are_spread_evenly_over_buckets():
    import pyarrow as pa

    rng = random.Random(9)
    text = " ".join(f"u{rng.randrange(10**6)}" for _ in range(120_000))
    found = {}
    for b in sub._print_blocks(16, 20)(iter([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])])):
        for k, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found[k] = found.get(k, 0) + len(sub.unpack(body)[0])
    assert len(found) == 16 and max(found.values()) < 1.3 * min(found.values())
