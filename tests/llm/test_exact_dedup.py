import hashlib
from collections import defaultdict

from tracemill.llm.exact_dedup import drop_exact, group_exact, op3_exact_dedup

SCHEMA = "doc_id long, text string, kept string, _key int"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            out.append((i, best, len(ids), i == best and not seen, hashlib.sha256(text.encode()).hexdigest()))
            seen |= i == best
    return sorted(out, key=str)


ROWS = [(1, "a", "x", 1), (2, "a", None, 2), (3, None, "y", 3), (4, "", "z", 4), (5, "b" * 300_000, "w", 5), (6, "a", "q", 6),
        (6, "a", "q", 6), (None, "a", "n", 0), (None, "solo", "n", 0), (7, " a", "q", 6), (8, "é", "q", 6)]


def test_groups_match_brute_force(spark):
    got = [tuple(r) for r in group_exact(spark.createDataFrame(ROWS, SCHEMA)).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert group_exact(empty).collect() == [] and drop_exact(empty).collect() == []


def test_drop_keeps_one_row_a_text_with_all_columns(spark):
    got = drop_exact(spark.createDataFrame(ROWS, SCHEMA))
    assert got.columns == ["doc_id", "text", "kept", "_key"]
    rows = {(r.text or ""): r.doc_id for r in got.collect()}
    assert got.count() == len(rows) and rows["a"] == 6 and rows[""] == 4 and rows["solo"] is None


def test_real_table(spark, tiny):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op3_exact_dedup(spark, tiny).collect()), key=str) == brute(docs)


def test_ranges_of_digests_give_the_same_groups(spark):
    rows = [(i, f"text {i % 90 if i % 3 else i}", None, None) for i in range(500)] + ROWS
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in group_exact(df, most_bits=1 << 11).collect()), key=str) == brute(rows)
    assert group_exact(df.limit(0), most_bits=1 << 11).collect() == []
