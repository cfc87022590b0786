"""Relations between neighbouring events: transitions, event graphs, prefixes, adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.features import label_encode, stitched, with_next
from tracemill.sources.eventlog import in_case


def transitions(log: DataFrame, spread: bool = False) -> DataFrame:
    """One row per pair of consecutive events: the one shuffle that the analysis operators share.

    Whatever is made from transitions works on logs with giant cases if they are made with `spread` (see `with_next`).

    case_id, src, tgt, wait_s, wait_h, and resource, amount, timestamp, event_seq, dow, hod of the source event.
    """
    out = with_next(log, spread).filter(F.col("next_task").isNotNull())
    return out.select(
        "case_id", F.col("task_name").alias("src"), F.col("next_task").alias("tgt"), F.col("dt_seconds").alias("wait_s"), (F.col("dt_seconds") / 3600).alias("wait_h"),
        "resource", "amount", "timestamp", "event_seq", F.weekday("timestamp").alias("dow"), F.hour("timestamp").alias("hod"),
    )


def mean_wait(seconds: str = "wait_s"):
    """Mean of waits in seconds, added up in whole microseconds: the same number in whatever order the rows come. The sum is a decimal, as that of long waits leaves 64 bits."""
    return F.sum(F.round(F.col(seconds) * 1e6).cast("long").cast("decimal(20,0)")).cast("double") / F.count(seconds) / 1e6


def indexed(log: DataFrame, spread: bool = False) -> DataFrame:
    if spread:
        return stitched(log).withColumn("idx", F.col("_before").cast("int")).drop("_before", "_next")
    return log.withColumn("idx", F.row_number().over(in_case()) - 1)


def event_graph_edges(log: DataFrame, causal: bool = True, spread: bool = False) -> DataFrame:
    """(case_id, src_idx, dst_idx): each event to the next; both ways unless causal. `spread` as in `with_next`."""
    at = stitched(log).withColumn("idx", F.col("_before").cast("int")) if spread else indexed(log).withColumn("_next", F.lead("idx").over(in_case()))
    out = at.filter("_next is not null").select("case_id", F.col("idx").alias("src_idx"), (F.col("idx") + 1).alias("dst_idx"))
    return out if causal else out.unionByName(out.select("case_id", F.col("dst_idx").alias("src_idx"), F.col("src_idx").alias("dst_idx")))


def event_graph_nodes(features: DataFrame) -> DataFrame:
    """(case_id, idx, features, y, dt) of a table that `create_features` made."""
    columns = [c for c in features.columns if c.startswith("feat_")]
    return indexed(features).select("case_id", "idx", F.array(*columns).alias("features"), F.col("next_task").alias("y"), F.col("dt_log").alias("dt"))


def case_modal_label(log: DataFrame) -> DataFrame:
    """Each case's most frequent next task, the smallest of equals."""
    return with_next(log).filter("next_task is not null").groupBy("case_id").agg(F.mode("next_task", True).alias("label"))


def prefixes(log: DataFrame, max_len: int | None = None, continuous: list[str] = ()) -> DataFrame:
    """Each proper prefix of a case with its next task: case_id, k, tasks, resources, [vectors], label, dt (of the last event).

    `max_len` keeps the last so many events of a prefix, which bounds the rows of very long cases.
    """
    back = Window.unboundedPreceding if max_len is None else 1 - max_len
    w, held = in_case(), in_case().rowsBetween(back, 0)
    out = with_next(log).withColumn("k", F.row_number().over(w)).withColumn("tasks", F.collect_list("task_name").over(held)).withColumn("resources", F.collect_list(F.coalesce("resource", F.lit("nan"))).over(held))
    if continuous:
        out = out.withColumn("vectors", F.collect_list(F.array(*continuous)).over(held))
    return out.filter("next_task is not null").select("case_id", "k", "tasks", "resources", *(["vectors"] if continuous else []), F.col("next_task").alias("label"), F.col("dt_log").alias("dt"))


def pad_prefixes(df: DataFrame, names: DataFrame, max_len: int | None = None, resources: DataFrame | None = None) -> DataFrame:
    """Prefixes as ids from 1 (`padded`, and `padded_resources` if that dictionary is given), padded with 0 on the right.

    They are as long as the longest prefix, or as max_len, which keeps a longer prefix's last events. Vectors, if there
    are any, are padded with vectors of 0.0 (`padded_vectors`). `length` counts the events that are there.
    """
    if max_len is None:
        width = df.agg(F.coalesce(F.max(F.size("tasks")), F.lit(0)).alias("width"))
        out = df.crossJoin(F.broadcast(width))  # one row
    else:
        out = df.withColumn("width", F.lit(max_len))
    held = F.least(F.size("tasks"), F.col("width"))
    last = lambda c: F.slice(c, F.greatest(F.size("tasks") - F.col("width") + 1, F.lit(1)), held)
    fill = lambda c, x: F.concat(c, F.array_repeat(x, F.col("width") - held))
    for column, to, table in (("tasks", "padded", names), ("resources", "padded_resources", resources)):
        if table is not None:
            ids = table.agg(F.map_from_entries(F.collect_list(F.struct("name", "id"))).alias("ids"))  # as many entries as there are names
            out = out.crossJoin(F.broadcast(ids)).withColumn(to, fill(F.transform(last(column), lambda t: F.element_at("ids", t) + 1), F.lit(0))).drop("ids")
    if "vectors" in df.columns:
        zero = F.transform(F.element_at("vectors", 1), lambda x: F.lit(0.0))
        out = out.withColumn("padded_vectors", fill(last("vectors"), zero))
    return out.withColumn("length", held).drop("width")


def encoded_prefixes(log: DataFrame, names: DataFrame, max_len: int, resources: DataFrame | None = None, continuous: list[str] = ()) -> DataFrame:
    """What `pad_prefixes(prefixes(log), names, max_len, …)` gives, at a cost that doesn't grow with the length of cases.

    Names become ids on the event rows, by joins that see the dictionaries' sizes, and a prefix holds its last `max_len` events alone.
    """
    ids = label_encode(log, "task_name", "_task", names)
    if resources is not None:
        ids = label_encode(ids, "resource", "_resource", resources)
    w, last = in_case(), in_case().rowsBetween(1 - max_len, 0)
    held = lambda c: F.collect_list(c).over(last)
    length = F.least(F.row_number().over(w), F.lit(max_len))
    fill = lambda c, x: F.concat(c, F.array_repeat(x, F.lit(max_len) - F.col("length")))
    out = with_next(ids).withColumn("k", F.row_number().over(w)).withColumn("length", length).withColumn("_ids", held(F.coalesce(F.col("_task") + 1, F.lit(0))))
    if resources is not None:
        out = out.withColumn("_who", held(F.coalesce(F.col("_resource") + 1, F.lit(0))))
    if continuous:
        out = out.withColumn("_vectors", held(F.array(*continuous)))
    more = [fill(F.col("_who"), F.lit(0)).alias("padded_resources")] if resources is not None else []
    more += [fill(F.col("_vectors"), F.array(*(F.lit(0.0) for _ in continuous))).alias("padded_vectors")] if continuous else []
    return out.filter("next_task is not null").select("case_id", "k", fill(F.col("_ids"), F.lit(0)).alias("padded"), *more, "length", F.col("next_task").alias("label"), F.col("dt_log").alias("dt"))


def shuffle_samples(df: DataFrame, seed: int = 42) -> DataFrame:
    return df.orderBy(F.md5(F.concat_ws(":", "case_id", F.col("k").cast("string"), F.lit(str(seed)))), "case_id", "k")


def task_adjacency(trans: DataFrame) -> DataFrame:
    """(src, tgt, weight): how often tgt follows src."""
    return trans.groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("weight"))


def start_activities(log: DataFrame) -> DataFrame:
    first = log.groupBy("case_id").agg(F.min_by("task_name", F.struct("timestamp", "event_seq")).alias("task_name"))
    return first.groupBy("task_name").agg(F.count(F.lit(1)).alias("n"))


def end_activities(log: DataFrame) -> DataFrame:
    last = log.groupBy("case_id").agg(F.max_by("task_name", F.struct("timestamp", "event_seq")).alias("task_name"))
    return last.groupBy("task_name").agg(F.count(F.lit(1)).alias("n"))
