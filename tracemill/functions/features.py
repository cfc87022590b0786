"""Encodings, features, weights and splits of event logs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.sources.eventlog import in_case
from tracemill.sources.scratch import exact_quantiles, in_ranges, numbered

#: The vector that is scaled; the cyclic values stand beside it and are never scaled.
FEATURES = ["task_id", "resource_id", "amount", "day_of_week", "hour_of_day"]
CYCLIC = ["dow_sin", "dow_cos", "hod_sin", "hod_cos"]


def calendar(log: DataFrame) -> DataFrame:
    """day_of_week (Monday 0) and hour_of_day."""
    return log.withColumn("day_of_week", F.weekday("timestamp")).withColumn("hour_of_day", F.hour("timestamp"))


def cyclic(log: DataFrame) -> DataFrame:
    for name, unit, length in (("dow", "day_of_week", 7), ("hod", "hour_of_day", 24)):
        turn = F.col(unit) * (2 * math.pi / length)
        log = log.withColumn(f"{name}_sin", F.sin(turn)).withColumn(f"{name}_cos", F.cos(turn))
    return log


def label_dictionary(log: DataFrame, column: str) -> DataFrame:
    """(id, name): rank of each distinct name, from 0, by ranges of names."""
    names = log.select(F.coalesce(F.col(column), F.lit("nan")).alias("name")).distinct()
    return numbered(names, F.col("name"), name="id").select(F.col("id").cast("int").alias("id"), "name")


def label_encode(log: DataFrame, column: str, to: str, names: DataFrame | None = None) -> DataFrame:
    names = (names or label_dictionary(log, column)).select(F.col("id").alias(to), F.col("name").alias("_name"))
    return log.join(names, F.coalesce(F.col(column), F.lit("nan")) == F.col("_name"), "left").drop("_name")


def label_decode(df: DataFrame, column: str, to: str, names: DataFrame) -> DataFrame:
    """Ids back to names; an id that the dictionary lacks shows as text."""
    names = names.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    return df.join(names, df[column] == F.col("_id"), "left").withColumn(to, F.coalesce("_name", F.col(column).cast("string"))).drop("_id", "_name")


def with_next(log: DataFrame, spread: bool = False) -> DataFrame:
    """next_task, dt_seconds to it, and dt_log (of waits clipped at 0); null on a case's last event.

    `spread` is for logs in which one case may hold a large share of all events: see `stitched`. Otherwise a case is the work of one task.
    """
    if spread:
        out = stitched(log).withColumn("next_task", F.col("_next.task_name")).withColumn("_then", F.col("_next.timestamp")).drop("_next", "_before")
    else:
        w = in_case()
        out = log.withColumn("next_task", F.lead("task_name").over(w)).withColumn("_then", F.lead("timestamp").over(w))
    dt = (F.unix_micros("_then") - F.unix_micros("timestamp")) / 1e6
    return out.withColumn("dt_seconds", dt).withColumn("dt_log", F.log1p(F.greatest("dt_seconds", F.lit(0.0)))).drop("_then")


def stitched(log: DataFrame) -> DataFrame:
    """`log` with _next (task_name, timestamp of the next event of the case) and _before (events of the case before this one), a case being cut
    into ranges of time as its size asks for.

    Events are dealt into ranges of (case_id, timestamp, event_seq), so a giant case fills many ranges and small ones share one. Windows
    look inside of a case's range alone; what links the ranges is a table of one row per case and range.
    """
    parts = in_ranges(log, "case_id", "timestamp", "event_seq")
    key = ["case_id", "_part"]
    inside = Window.partitionBy(*key).orderBy("timestamp", "event_seq")
    ends = parts.groupBy(*key).agg(F.min_by(F.struct("task_name", "timestamp"), F.struct("timestamp", "event_seq")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    ranges = Window.partitionBy("case_id").orderBy("_part")  # the ranges of a case
    links = ends.select(*key, F.lead("_first").over(ranges).alias("_after"), (F.sum("_n").over(ranges) - F.col("_n")).alias("_earlier"))
    links = links.filter(F.col("_after").isNotNull() | (F.col("_earlier") > 0))  # of cases that lie in several ranges
    out = parts.withColumn("_next", F.lead(F.struct("task_name", "timestamp")).over(inside)).withColumn("_k", F.row_number().over(inside) - 1)
    out = out.join(links, key, "left").withColumn("_next", F.coalesce("_next", "_after")).withColumn("_before", F.coalesce("_earlier", F.lit(0).cast("long")) + F.col("_k"))
    return out.drop("_part", "_k", "_after", "_earlier")


def drop_terminal(log: DataFrame) -> DataFrame:
    return log.filter(F.col("next_task").isNotNull())


def encode_log(log: DataFrame, spread: bool = False) -> DataFrame:
    """Ids, next task, waiting time and calendar features, without each case's last event. Ids come from the full log; `spread` as in `with_next`."""
    tasks = label_dictionary(log, "task_name")
    out = label_encode(log, "task_name", "task_id", tasks)
    out = drop_terminal(with_next(label_encode(out, "resource", "resource_id"), spread))
    return cyclic(calendar(label_encode(out, "next_task", "next_id", tasks)))


def l2_normalize(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """feat_*: each row divided by its length; an all-zero row stays zero."""
    value = [F.col(c).cast("double") for c in columns]
    length = F.sqrt(sum((v * v for v in value[1:]), value[0] * value[0]))
    return df.select("*", *(F.when(length == 0, v).otherwise(v / length).alias(f"feat_{c}") for c, v in zip(columns, value, strict=True)))


def fit_minmax(train: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """One row: lo_* and hi_* of each column."""
    return train.agg(*(f(c).alias(f"{name}_{c}") for c in columns for name, f in (("lo", F.min), ("hi", F.max))))


def apply_minmax(df: DataFrame, params: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """feat_*: scaled by the fitted range; a constant column gives 0. Other rows than the fitted ones may leave [0, 1]."""
    both = df.crossJoin(F.broadcast(params))  # one row
    span = lambda c: F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 1.0).otherwise(F.col(f"hi_{c}") - F.col(f"lo_{c}"))
    out = both.select("*", *(((F.col(c) - F.col(f"lo_{c}")) / span(c)).alias(f"feat_{c}") for c in columns))
    return out.drop(*params.columns)


def create_features(log: DataFrame) -> DataFrame:
    """The encoded log with feat_* of FEATURES, scaled row by row, and the cyclic values as they are."""
    return l2_normalize(encode_log(log))


def class_weights(df: DataFrame, label: str, names: DataFrame) -> DataFrame:
    """(id, name, weight): n / (classes present * rows of the class); 1 for absent classes or if one class alone is present."""
    counts = df.groupBy(F.col(label).alias("id")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    out = names.join(counts, "id", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("id", "name", F.when(F.col("c").isNull() | (F.col("k") < 2), 1.0).otherwise(F.col("n") / (F.col("k") * F.col("c"))).alias("weight"))


def split_cases(log: DataFrame, mode: str = "case", val_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """`log` with split "train" or "val"; whole cases go together.

    "case": cases in order of md5(case_id:seed); "temporal": the cases that start last are validation. At least one case is.
    Only the cases' keys are ranked: hashes by their first digits, of which one table counts the cases, and times by ranges.
    """
    if not 0 < val_frac < 1:
        raise ValueError("val_frac must lie between 0 and 1")
    if mode not in ("case", "temporal"):
        raise ValueError(f"Unknown split mode {mode}")
    if mode == "case":
        cases = log.select("case_id").distinct().withColumn("k", F.md5(F.concat("case_id", F.lit(f":{seed}"))))
        val = _first_hashes(cases, val_frac)
    else:
        cases = numbered(log.groupBy("case_id").agg(F.min("timestamp").alias("k")), F.col("k").desc(), F.col("case_id").desc())
        n = cases.agg(_share_of(F.count(F.lit(1)), val_frac).alias("n_val"))
        val = cases.crossJoin(F.broadcast(n)).filter(F.col("n") < F.col("n_val"))  # one row
    return log.join(val.select("case_id", F.lit("val").alias("split")), "case_id", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def _share_of(n, val_frac: float):
    return F.greatest(F.lit(1), F.bround(n * F.lit(val_frac)).cast("long"))


def _first_hashes(cases: DataFrame, val_frac: float) -> DataFrame:
    """The share of `cases` (case_id, k) that comes first by (k, case_id), k an md5: whole groups of equal first digits, and part of one group."""
    grouped = cases.withColumn("g", F.conv(F.substring("k", 1, 3), 16, 10).cast("int"))
    table = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("c")).agg(F.sort_array(F.collect_list(F.struct("g", "c"))).alias("t"))  # 4096 entries at most
    table = table.withColumn("n_val", _share_of(F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["c"]), val_frac))
    begin = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("int").alias("cut"))
    step = lambda a, x: F.when(a["cut"].isNotNull(), a).when(a["before"] + x["c"] >= F.col("n_val"), F.struct(a["before"].alias("before"), x["g"].alias("cut"))).otherwise(F.struct((a["before"] + x["c"]).alias("before"), a["cut"].alias("cut")))
    cut = table.withColumn("a", F.aggregate("t", begin, step)).select("n_val", "a.before", "a.cut")
    some = grouped.crossJoin(F.broadcast(cut)).filter(F.col("g") <= F.col("cut"))  # one row
    rank = F.row_number().over(Window.partitionBy("g").orderBy("k", "case_id"))
    return some.withColumn("r", rank).filter((F.col("g") < F.col("cut")) | (F.col("r") <= F.col("n_val") - F.col("before")))


def amount_quartile(df: DataFrame) -> DataFrame:
    """amount_bucket: Q1 … Q4 by quartile edges over all rows (upper edges included), "all" if edges coincide, "nan" for null."""
    edges = exact_quantiles(df, "amount", [0.0, 0.25, 0.5, 0.75, 1.0]).withColumnRenamed("quantiles", "q")
    q = lambda k: F.col("q")[k]
    same = (q(0) == q(1)) | (q(1) == q(2)) | (q(2) == q(3)) | (q(3) == q(4))
    bucket = F.when(F.col("amount").isNull(), "nan").when(same, "all").when(F.col("amount") <= q(1), "Q1").when(F.col("amount") <= q(2), "Q2").when(F.col("amount") <= q(3), "Q3").otherwise("Q4")
    return df.crossJoin(F.broadcast(edges)).withColumn("amount_bucket", bucket).drop("q")  # one row
