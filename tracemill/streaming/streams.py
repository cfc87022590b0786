"""Incremental mining of event streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tracemill.operators.transitions import mean_wait
from tracemill.sources.eventlog import in_case

_CHANGE = "case_id string, src string, tgt string, wait_s double, time_us long, event_seq long, change int, late boolean"
_EVENT = "time_us long, event_seq long, task_name string, settled boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Edges(StatefulProcessor):
    """One case: its events that the watermark hasn't passed, in order, and the last one that it has.

    An event goes to its place among them; the edge that it splits is taken back. `settled` marks an event before which nothing can go any more.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle):
        self.handle = handle
        self.events = handle.getListState("events", _EVENT)

    def handleInitialState(self, key, initialState, timerValues):
        self._keep(sorted((e["time_us"], e["event_seq"], e["task_name"], e["settled"]) for e in initialState.events), None)

    def handleInputRows(self, key, rows, timerValues):
        held = sorted(tuple(e) for e in self.events.get())
        floor = held[0][:2] if held and held[0][3] else None
        came = sorted((r.time_us, r.event_seq, r.task_name) for r in rows)
        placed = sorted([(*e, False) for e in held] + [(*e, False, True) for e in came if floor is None or e[:2] >= floor])
        out = [Row(case_id=key[0], src=None, tgt=e[2], wait_s=None, time_us=e[0], event_seq=e[1], change=0, late=True) for e in came if floor is not None and e[:2] < floor]
        change = lambda a, b, by: Row(case_id=key[0], src=a[2], tgt=b[2], wait_s=(b[0] - a[0]) / 1e6, time_us=a[0], event_seq=a[1], change=by, late=False)
        old = None
        for k, e in enumerate(placed):
            before = placed[k - 1] if k else None
            if not e[4]:
                if old is not None and before is not old:
                    out.append(change(old, e, -1))
                old = e
            if before is not None and (e[4] or before[4]):
                out.append(change(before, e, 1))
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        first = max((k for k, e in enumerate(placed) if e[0] <= passed), default=0)
        if placed:
            events = [e[:4] for e in placed[first:]]
            if placed[first][0] <= passed or first:
                events[0] = (*events[0][:3], True)
            self._keep(events, held[-1] if held else None)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = max((tuple(e) for e in self.events.get()), default=None)
        if held is None or self._until(held) <= timerValues.getCurrentWatermarkInMs():
            self.events.clear()
        return iter([])

    def close(self):
        pass

    def _until(self, event) -> int:
        return event[0] // 1000 + self.idle_ms + 1

    def _keep(self, events, last):
        """The case's state, and one timer: when its newest event is `idle` behind the watermark."""
        self.events.put(events)
        if last is None or self._until(last) != self._until(events[-1]):
            if last is not None:
                self.handle.deleteTimer(self._until(last))
            self.handle.registerTimer(self._until(events[-1]))


def _begun(log: DataFrame, watermark: str) -> DataFrame:
    """(case_id, events): of a batch log's cases the events that a later one may still precede, and the one before them."""
    w = in_case()
    newest = log.agg((F.max("timestamp") - F.expr(f"interval {watermark}")).alias("_cut"))
    at = log.withColumn("_then", F.lead("timestamp").over(w)).withColumn("_k", F.row_number().over(w)).crossJoin(F.broadcast(newest))  # one row
    held = at.filter(F.col("_then").isNull() | (F.col("_then") > F.col("_cut")))
    event = F.struct(F.unix_micros("timestamp").alias("time_us"), "event_seq", "task_name", ((F.col("_k") > 1) & (F.col("timestamp") <= F.col("_cut"))).alias("settled"))
    return held.groupBy("case_id").agg(F.sort_array(F.collect_list(event)).alias("events"))


def streaming_transitions(stream: DataFrame, watermark: str = "7 days", idle: timedelta = timedelta(days=30), initial: DataFrame | None = None) -> DataFrame:
    """Transitions of a canonical log that arrives as a stream, as changes: (case_id, src, tgt, wait_s, timestamp, event_seq, change, late).

    `change` 1 adds a transition and -1 takes one back, when an event arrives between the two that made it; `settled_transitions` nets them. Events in any
    order within the watermark give the transitions of the table. Spark drops events older than the watermark; what still comes before a case's
    settled part is shown with `late` and change 0. State is a list of a case's events within the watermark and one before; a case
    is forgotten when the watermark is `idle` past its last event. `initial` is a batch log whose cases the stream goes on with: its own
    transitions are not repeated. `timestamp` and `event_seq` of a transition are its source event's.

    The state is kept in RocksDB: the session's state store provider is set to it, as the operator needs it.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    marked = stream.withWatermark("timestamp", watermark).withColumn("time_us", F.unix_micros("timestamp"))
    begun = _begun(initial, watermark).groupBy("case_id") if initial is not None else None
    out = marked.groupBy("case_id").transformWithState(_Edges(int(idle.total_seconds() * 1000)), _CHANGE, "append", "eventTime", begun)
    return out.select("case_id", "src", "tgt", "wait_s", F.timestamp_micros("time_us").alias("timestamp"), "event_seq", "change", "late")


def settled_transitions(changes: DataFrame) -> DataFrame:
    """The transitions that stand after all changes of a table that `streaming_transitions` filled."""
    keys = ["case_id", "src", "tgt", "wait_s", "timestamp", "event_seq"]
    return changes.filter("not late").groupBy(*keys).agg(F.sum("change").alias("_c")).filter(F.col("_c") > 0).select(*keys, F.lit(False).alias("late"))


def windowed_bottlenecks(trans: DataFrame, window: str = "1 day", slide: str | None = None, watermark: str = "7 days") -> DataFrame:
    """Mean wait and count per transition and time window; works on a stream (append mode) and on a table alike."""
    if trans.isStreaming:
        trans = trans.withWatermark("timestamp", watermark)
    cut = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    out = trans.groupBy(cut.alias("window"), "src", "tgt").agg(mean_wait().alias("mean_s"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "src", "tgt", "mean_s", "n")
