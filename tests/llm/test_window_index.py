import random

import pytest
from test_substring_dedup import brute, digest

from tracemill.llm import substring_dedup as sub
from tracemill.llm import window_index as wi

SCHEMA = "doc_id long, text string, note string"


def corpus(n=120, seed=3):
    """Passages that documents share, some within one, short and empty texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [[rng.choice(words) for _ in range(rng.choice((19, 20, 21, 60)))] for _ in range(12)]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice((0, 3, 19, 20, 90)))]
        for _ in range(rng.choice((0, 1, 2, 3))):
            k = rng.randrange(len(text) + 1)
            text[k:k] = rng.choice(shared)
        out.append((i, " ".join(text), "x"))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: r[0])


def test_batches_equal_one_call_and_brute_force(spark, tmp_path, monkeypatch):
    """Opened anew for each batch; the texts of earlier batches are deleted, and buckets double under way."""
    monkeypatch.setattr(wi, "BUCKET_ENTRIES", 900)
    docs = corpus()
    got = []
    for k in range(6):
        batch = docs[20 * k : 20 * k + 20]
        path = f"{tmp_path}/batch{k}"
        spark.createDataFrame(batch, SCHEMA).repartition(3).write.parquet(path)
        out = wi.remove_known(wi.WindowIndex(spark, f"{tmp_path}/index"), spark.read.schema(SCHEMA).parquet(path))
        assert out.select("row.*").columns == ["doc_id", "text", "note"]
        got += out.collect()
        for f in (tmp_path / f"batch{k}").iterdir():
            f.unlink()
    pairs = [(i, t) for i, t, _ in docs]
    assert by_id(digest(got)) == by_id(brute(pairs))
    whole = sub.remove_repeats(spark.createDataFrame(docs, SCHEMA)).collect()
    assert by_id(digest(got)) == by_id(digest(whole))
    assert sum(r.n_removed for r in got) > 500
    runs = wi.WindowIndex(spark, f"{tmp_path}/index").runs()
    assert runs[0].first == 0 and runs[-1].last == 5 and len(runs) < 6 and len({r.buckets for r in runs} | {1}) > 1


def test_nulls_repeated_rows_and_nothing(spark, tmp_path):
    index = wi.WindowIndex(spark, f"{tmp_path}/index")
    long = " ".join(f"a{i}" for i in range(30))
    assert wi.remove_known(index, spark.createDataFrame([], SCHEMA)).count() == 0
    first = wi.remove_known(index, spark.createDataFrame([(None, long, "n"), (7, long, "a"), (8, None, "b"), (9, "", "c"), (7, long, "a")], SCHEMA)).collect()
    assert sorted((r.row.note, r.n_words, r.n_removed, r.row.text is None) for r in first) == [("a", 30, 0, False), ("a", 30, 30, False), ("b", 0, 0, True), ("c", 0, 0, False), ("n", 30, 30, False)]
    again = wi.remove_known(index, spark.createDataFrame([(1, long + " b", "d")], SCHEMA)).collect()
    assert [(r.n_words, r.n_removed, r.row.text) for r in again] == [(31, 30, "b")]


def test_uncommitted_and_covered_runs_do_not_count(spark, tmp_path):
    index = wi.WindowIndex(spark, f"{tmp_path}/index")
    text = " ".join(f"a{i}" for i in range(25))
    wi.remove_known(index, spark.createDataFrame([(1, text, "")], SCHEMA)).count()
    (folder,) = (p for p in (tmp_path / "index" / "window=20").iterdir())
    (folder.parent / "00000001-00000001-1").mkdir()  # a job that failed
    assert [(r.first, r.last) for r in index.runs()] == [(0, 0)]
    second = wi.remove_known(index, spark.createDataFrame([(2, text, "")], SCHEMA)).collect()
    assert [r.n_removed for r in second] == [25] and index.runs()[-1].last == 1
    assert index.size(index.runs()[0]) == 6


def test_an_index_of_other_windows_is_refused(spark, tmp_path):
    wi.WindowIndex(spark, f"{tmp_path}/index")
    with pytest.raises(ValueError, match="other windows"):
        wi.WindowIndex(spark, f"{tmp_path}/index", 30)
