import hashlib
import io
import zipfile

import pytest

from tracemill.llm import warc
from tracemill.llm.common import scratch_path

BIG = "<p>" + "word " * 50 + "</p>"


def brute(rows):
    first = {}
    for page_id, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 100 and page_id is not None:
            first[b] = min(first.get(b, page_id), page_id)
    out, used = [], set()
    for page_id, _, html in rows:
        b = (html or "").encode()
        again = len(b) >= 100 and (page_id != first.get(b) or b in used)
        used |= {b} if page_id == first.get(b) else set()
        out.append((page_id, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first.get(b) if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(3, "http://a/x y", BIG), (1, "http://b", BIG), (2, None, None), (4, "u", "short"), (5, "u", "short"), (6, "é", "é" * 99), (6, "é", "é" * 99),
            (7, "l", "z" * 3_000_000), (None, "n", BIG), (8, "a\nb", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as copy")
    records = warc.read_archives(warc.write_archives(df, scratch_path(spark, "t")))
    got = sorted((tuple(r) for r in warc.resolve_revisits(records).collect()), key=str)
    assert got == brute(rows)
    assert {bytes(r.payload).decode() for r in records.collect()} >= {BIG, "short", "z" * 3_000_000}


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.resolve_revisits(warc.read_archives(warc.write_archives(df, scratch_path(spark, "t")))).collect() == []


def test_query(spark, tiny):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in warc.op5_warc(spark, tiny).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("limit", [None, 10])
def test_directories_with_and_without_zip64(monkeypatch, limit):
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    out = io.BytesIO()
    out.write(b"something before")
    with zipfile.ZipFile(out, "a", zipfile.ZIP_STORED) as z:
        for name, body in (("a.txt", b"first body"), ("indexes/é", b"x" * 500)):
            z.writestr(name, body)
        z.comment = b"a comment PK"
    data = out.getvalue()
    found = warc.members(io.BytesIO(data), len(data))
    assert {k: data[a : a + n] for k, (a, n) in found.items()} == {"a.txt": b"first body", "indexes/é": b"x" * 500}
    if limit:
        assert b"PK\x06\x06" in data


def test_broken_packages_are_errors():
    with pytest.raises(ValueError, match="end record"):
        warc.members(io.BytesIO(b"no zip at all" * 5), 65)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"y" * 1000)
    with pytest.raises(ValueError, match="compressed"):
        warc.members(io.BytesIO(out.getvalue()), len(out.getvalue()))


def test_reading_is_dealt_out_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 20_000)
    import random

    rng = random.Random(2)
    rows = [(i, f"u{i}", "".join(rng.choice("abcdefghijklmnop") for _ in range(3000))) for i in range(2000)]
    records = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch_path(spark, "t")))
    assert records.rdd.getNumPartitions() >= 8 and records.count() == 2000


def test_ranges_are_bounded():
    lines = [{"length": n} for n in [10] * 600 + [warc.RANGE_BYTES * 2, 5, warc.RANGE_BYTES - 5, 1]]
    parts = list(warc._runs(lines))
    assert [x for p in parts for x in p] == lines and [len(p) for p in parts] == [256, 256, 88, 1, 2, 1]


def test_rows_without_id_revisit_each_other(spark, tmp_path):
    body = "x" * 200
    df = spark.createDataFrame([(None, "b", body), (None, "a", body), (None, "a", body), (None, "c", "short"), (None, "c", "short")], "page_id long, url string, html string")
    records = warc.read_archives(warc.write_archives(df, str(tmp_path.as_uri()))).collect()
    long_ones = [r for r in records if r.url in ("a", "b")]
    assert sorted((r.record_type, r.url) for r in long_ones) == [("response", "a"), ("revisit", "a"), ("revisit", "b")]
    first = next(r.record_id for r in long_ones if r.record_type == "response")
    assert {r.refers_to_id for r in long_ones if r.record_type == "revisit"} == {first}
    assert [r.record_type for r in records if r.url == "c"] == ["response"] * 2
    out = warc.resolve_revisits(warc.read_archives(warc.write_archives(df, str((tmp_path / "again").as_uri())))).collect()
    assert sorted((r.record_type, r.payload_bytes) for r in out if r.payload_bytes > 100) == [("response", 200), ("revisit", 200), ("revisit", 200)]
