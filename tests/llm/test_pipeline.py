import os
import subprocess
import sys
from pathlib import Path
import re
from collections import defaultdict

import public_tokenizers as P
from test_jaccard import brute as near_brute
from test_packing import check
from tokenizers import Tokenizer

import corpus_pipeline as pipe

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passages(rows, window=20):
    """What stays of each text, and whether it had any word left or nothing was cut."""
    first = {}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, (i, k)), (i, k))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i, k):
                gone.update(range(k, k + window))
        if not gone or len(gone) < len(w):
            out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_stages_against_brute_force(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept, results = docs, {}
    for name, stage in pipe.STAGES:
        out = stage(spark, kept, tiny)
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        before, kept = kept, spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        results[name] = {r.doc_id: r.text for r in kept.collect()} if name != "packing" else kept.collect()
        if name != "packing":
            assert kept.columns == docs.columns and dict(kept.dtypes) == dict(before.dtypes)
    everything = {r.doc_id: r.text for r in docs.collect()}
    assert set(results["quality"]) <= set(everything) and len(results["quality"]) > 0.7 * len(everything)
    best = defaultdict(int)
    for i, t in results["quality"].items():
        best[t or ""] = max(best[t or ""], i)
    assert set(results["exact copies"]) == set(best.values())
    near = near_brute(list(results["exact copies"].items()), 5, 80)
    assert set(results["near copies"]) == {i for i, _, c in near if i == c}
    cut = passages(list(results["near copies"].items()))
    assert {i: WORD.findall(t or "") for i, t in results["passages"].items()} == cut
    for r in kept.sparkSession.read.parquet(str(tmp_path / "passages")).collect():
        assert r.n_chars == len(r.text)
    check(results["packing"], results["passages"])


def test_run(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for _, stage in pipe.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, tiny).collect(), docs.schema)
    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(hf.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = defaultdict(int)
    for r in pipe.run(spark, tiny).collect():
        got[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want


def test_clashing_columns(spark, tiny):
    some = spark.read.parquet(f"{tiny}/documents.parquet").limit(40)
    odd = some.selectExpr("*", "1 as row", "'x' as _row", "'y' as _mark", "2 as n_words", "true as kept", "3 as node", "'z' as starts")
    for _, stage in pipe.STAGES[:-1]:
        assert sorted(map(tuple, stage(spark, odd, tiny).collect()), key=str) == sorted(map(tuple, stage(spark, some, tiny).collect()), key=str)


def test_null_texts_and_empty_tables(spark, tiny):
    docs = spark.createDataFrame([(1, None, "en", None, 0), (2, "", "en", "s", 0), (3, "some words here", None, "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for _, stage in pipe.STAGES[:-1]:
            out = stage(spark, some, tiny)
            assert out.columns == docs.columns
            assert out.count() <= some.count()


def test_repeated_ids_lose_no_unrelated_row(spark, tiny):
    a, b = " ".join(f"a{k}" for k in range(80)), " ".join(f"b{k}" for k in range(80))
    rows = [(1, a), (5, a + " x"), (5, b), (7, "c " + b + " y"), (7, "d " + b + " z"), (None, a + " w"), (8, "long " * 150_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id, r.text[:2]) for r in pipe.near_stage(spark, docs, tiny).collect())
    assert kept == [(1, "a0"), (5, "b0"), (8, "lo")]


def test_stages_leave_the_tables_of_other_work_alone(spark, tiny):
    from tracemill.llm import exact_dedup

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    mine = exact_dedup.group_exact(docs)
    pipe.exact_stage(spark, docs, tiny).count()
    pipe.near_stage(spark, docs.limit(5), tiny).count()
    assert mine.count() == docs.count()


def test_two_runs_keep_both_results(spark, tiny):
    a = pipe.run(spark, tiny)
    b = pipe.run(spark, tiny)
    n = b.count()
    assert a.count() == n > 0


SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import corpus_pipeline
from tracemill.functions import features
from tracemill.operators.transitions import transitions
from tracemill.sources.eventlog import events_log
spark = SparkSession.builder.master("local[4]").config("spark.checkpoint.dir", sys.argv[2]).config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
assert corpus_pipeline.run(spark, sys.argv[3]).count() and features.amount_quartile(transitions(events_log(spark, sys.argv[3]))).count()
spark.stop()
"""


def test_nothing_stays_in_the_shared_folder(tmp_path, tiny):
    root = Path(__file__).resolve().parents[2]
    subprocess.run([sys.executable, "-c", SCRIPT, str(root), f"file://{tmp_path}", tiny], check=True, timeout=600, env=os.environ | {"PYTHONPATH": str(root)})
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
