from datetime import timedelta

from pyspark.sql import functions as F

from tracemill.operators.transitions import transitions
from tracemill.sources.eventlog import canonical, events_log
from tracemill.streaming.streams import settled_transitions, streaming_transitions, windowed_bottlenecks


def test_stream_gives_the_transitions_of_the_table(spark, tiny, tmp_path):
    log = events_log(spark, tiny)
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = streaming_transitions(stream).writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select case_id, src, tgt, wait_s from moves where not late")
    want = transitions(log).select("case_id", "src", "tgt", "wait_s")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_windowed_stream_equals_the_table(spark, tiny, tmp_path):
    trans = transitions(events_log(spark, tiny)).select("timestamp", "src", "tgt", "wait_s")
    late = trans.agg(F.max("timestamp").alias("t")).select((F.col("t") + F.expr("interval 60 days")).alias("timestamp"), F.lit("z").alias("src"), F.lit("z").alias("tgt"), F.lit(0.0).alias("wait_s"))
    trans.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(trans.schema).parquet(str(tmp_path / "in"))
    q = windowed_bottlenecks(stream).writeStream.format("memory").queryName("slow").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    late.write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select start, src, tgt, round(mean_s, 6) as m, n from slow")
    want = windowed_bottlenecks(trans).select("start", "src", "tgt", F.round("mean_s", 6).alias("m"), "n")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


KEYS = ("case_id", "src", "tgt", "wait_s", "timestamp", "event_seq")


def _stream(spark, batches, where, name, **how):
    """The changes that a stream makes of these tables, one micro-batch each."""
    place = where / "in"
    first, changes, q = True, None, None
    for df in batches:
        df.coalesce(1).write.mode("append").parquet(str(place))
        if first:
            changes = streaming_transitions(spark.readStream.schema(df.schema).parquet(str(place)), **how)
            q = changes.writeStream.format("memory").queryName(name).option("checkpointLocation", str(where / "ck")).outputMode("append").start()
            first = False
        q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_events_in_any_order_within_the_watermark_give_the_transitions_of_the_table(spark, tiny, tmp_path):
    log = events_log(spark, tiny)
    lot = F.pmod(F.xxhash64("event_seq"), F.lit(4))
    got = _stream(spark, [log.filter(lot == k) for k in range(4)], tmp_path, "shuffled", watermark="400 days", idle=timedelta(days=400))
    assert not got.filter("change = -1").isEmpty() and got.filter("late").isEmpty()
    want = transitions(log).select(*KEYS)
    settled = settled_transitions(got).select(*KEYS)
    assert settled.count() == want.count() and settled.exceptAll(want).isEmpty()


def test_a_late_event_splits_an_edge_and_an_older_one_is_lost(spark, tmp_path):
    day = lambda d, seq, task, case="c": (case, task, f"2026-01-{d:02d} 00:00:00", "r", 1.0, seq)
    make = lambda *e: canonical(spark.createDataFrame(list(e), "case_id string, task_name string, timestamp string, resource string, amount double, event_seq long"))
    got = _stream(spark, [make(day(1, 0, "A"), day(5, 2, "C")), make(day(3, 1, "B")), make(day(25, 0, "X", "z")), make(day(2, 9, "Y")), make(day(26, 3, "D"))], tmp_path, "split", watermark="10 days")
    assert sorted((r.src, r.tgt, r.change) for r in got.filter("not late").collect()) == [("A", "B", 1), ("A", "C", -1), ("A", "C", 1), ("B", "C", 1), ("C", "D", 1)]
    assert sorted((r.src, r.tgt) for r in settled_transitions(got).collect()) == [("A", "B"), ("B", "C"), ("C", "D")]


def test_an_idle_case_is_forgotten(spark, tmp_path):
    day = lambda month, case, task: (case, task, f"2026-{month:02d}-01 00:00:00", "r", 1.0, month)
    make = lambda *e: canonical(spark.createDataFrame(list(e), "case_id string, task_name string, timestamp string, resource string, amount double, event_seq long"))
    batches = [make(day(1, "c", "A")), make(day(6, "z", "X")), make(day(7, "c", "B"), day(7, "z", "Y"))]
    got = _stream(spark, batches, tmp_path, "idle", watermark="1 days", idle=timedelta(days=60))
    assert [(r.case_id, r.src, r.tgt) for r in got.collect()] == [("z", "X", "Y")]


def test_a_stream_goes_on_with_a_batch_log(spark, tiny, tmp_path):
    log = events_log(spark, tiny)
    early = log.filter(F.pmod(F.xxhash64("event_seq"), F.lit(3)) > 0)
    rest = log.join(early.select("event_seq"), "event_seq", "left_anti").select(*log.columns)
    got = _stream(spark, [rest], tmp_path, "goes_on", watermark="400 days", idle=timedelta(days=400), initial=early)
    begun = transitions(early).select(*KEYS, F.lit(1).alias("change"), F.lit(False).alias("late"))
    settled = settled_transitions(begun.unionByName(got.select(*KEYS, "change", "late"))).select(*KEYS)
    want = transitions(log).select(*KEYS)
    assert settled.count() == want.count() and settled.exceptAll(want).isEmpty()
