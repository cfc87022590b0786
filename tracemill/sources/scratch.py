"""Cutting the lineage of long iterations in the folder that all executors share, and numbering rows in order without one task for all."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_local: list[str] = []
_folders: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (`spark.checkpoint.dir`).

    Only in local mode, where the setting may be missing, a temporary folder stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="tracemill-"))
    return _local[0]


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one. The file system deletes it when the driver's JVM ends, whether or not the session was stopped before."""
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    if key not in _folders:
        path = f"{key[1]}/tracemill/{uuid.uuid4().hex}"
        where, store = _store(spark, path)
        store.mkdirs(where)
        store.deleteOnExit(where)
        _folders[key] = path
    return _folders[key]


def place(spark: SparkSession, label: str) -> str:
    """A new path in the application's folder."""
    return f"{folder(spark)}/{uuid.uuid4().hex}-{label}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete what nothing reads any more."""
    where, store = _store(spark, path)
    store.delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage ends there."""
    path = place(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """`df` cut into ranges of `order`, with the number of each row's range as _part; rows of equal `order` are in one range."""
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, *order: Column, name: str = "n") -> DataFrame:
    """`df` with each row's place in `order` from 0, as `name`.

    Rows are dealt into ranges, counted per range, and ranked inside of their range, so no task sees them all.
    """
    parts = in_ranges(df, *order)
    before = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).orderBy("_part").collect()  # a row per partition
    total, starts = 0, []
    for r in before:
        starts.append((r["_part"], total))
        total += r["_n"]
    starts = df.sparkSession.createDataFrame(starts, "_part int, _before long")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(starts, "_part").withColumn(name, F.col("_before") + rank - 1).drop("_part", "_before")


def exact_quantiles(df: DataFrame, column: str, qs: list[float], by: tuple[str, ...] = (), accuracy: int = 50_000) -> DataFrame:
    """(by, quantiles): of each key the interpolated quantiles of a numeric column, nulls left out; without keys one row (null for no values).

    Two passes, both aggregates, each stored: a sketch depends on the order in which rows come, so a second one would have other brackets than the
    values were counted by. A sketch brackets each wanted place between two values, by twice the error that it allows on either side.
    Then values inside of a bracket are counted one by one and all others per gap between brackets, before the shuffle, so a key leaves its distinct
    values within about 4 / `accuracy` of its rows for each quantile, and running sums of counts, bracket by bracket, find the places. Should a place lie deep in a gap, the job fails. NaN is above all numbers.
    """
    key = list(by)
    values = df.filter(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_v"))
    margin = 2 / accuracy
    sides = [x for q in qs for x in (max(q - margin, 0.0), min(q + margin, 1.0))]
    number = F.when(F.isnan("_v"), F.lit(float("inf"))).otherwise(F.col("_v"))  # the sketch knows no NaN
    found = values.groupBy(*key).agg(F.percentile_approx(number, sides, accuracy).alias("_at"), F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    low = lambda k: F.col("_min") if sides[2 * k] == 0 else F.col("_at")[2 * k]
    high = lambda k: F.col("_max") if sides[2 * k + 1] == 1 else F.when(F.col("_at")[2 * k + 1] == float("inf"), F.lit(float("nan"))).otherwise(F.col("_at")[2 * k + 1])
    brackets = cut(found.select(*key, "_n", *(x for k in range(len(qs)) for x in (low(k).alias(f"_l{k}"), high(k).alias(f"_h{k}")))))
    placed = values.join(brackets, key) if key else values.crossJoin(F.broadcast(brackets))  # one row
    inside = reduce(Column.__or__, (F.col("_v").between(F.col(f"_l{k}"), F.col(f"_h{k}")) for k in range(len(qs))), F.lit(False))
    below = F.array_max(F.array(F.lit(None).cast("double"), *(F.when(F.col(f"_h{k}") < F.col("_v"), F.col(f"_h{k}")) for k in range(len(qs)))))
    passed = sum((F.when(F.col(f"_h{k}") < F.col("_v"), 1).otherwise(0) for k in range(len(qs))), F.lit(0))
    counts = placed.select(*key, "_n", "_v", F.when(inside, F.col("_v")).otherwise(below).alias("_x"), (~inside).alias("_gap"), (passed - F.when(inside, 0).otherwise(1)).alias("_part"))
    counts = counts.groupBy(*key, "_part", "_x", "_gap").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last"), F.first("_n").alias("_n"))
    counts = cut(counts)
    whole = counts.groupBy(*key, "_part").agg(F.sum("_c").alias("_s")).groupBy(*key).agg(F.collect_list(F.struct("_part", "_s")).alias("_all"))  # a bracket and the gap after it each
    counts = counts.join(whole, key) if key else counts.crossJoin(F.broadcast(whole))  # one row
    before = F.aggregate(F.filter("_all", lambda x: x["_part"] < F.col("_part")), F.lit(0).cast("long"), lambda a, x: a + x["_s"])
    held = F.sum("_c").over(Window.partitionBy(*key, "_part").orderBy("_x", "_gap").rowsBetween(Window.unboundedPreceding, 0))
    upto = counts.withColumn("_upto", before + held)
    place = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    at = lambda rank: F.min_by(F.struct("_first", "_last", "_gap", "_upto", "_c"), F.when(F.col("_upto") > rank, F.col("_upto")))
    row = upto.groupBy(*key).agg(*(x for k, q in enumerate(qs) for x in (at(F.floor(place(q))).alias(f"_lo{k}"), at(F.ceil(place(q))).alias(f"_hi{k}"))), F.max("_n").alias("_n"))

    def value(q, k):
        """Between the values at both places; a gap tells its first and its last value alone."""

        def held(c, rank):
            r = F.col(c)
            return F.when(~r["_gap"] | (r["_upto"] - r["_c"] == rank), r["_first"]).when(r["_upto"] - 1 == rank, r["_last"]).when(r.isNotNull(), F.raise_error("a quantile lies outside of its bracket").cast("double"))

        lo, part = held(f"_lo{k}", F.floor(place(q))), place(q) - F.floor(place(q))
        return F.when(part == 0, lo).otherwise(lo + (held(f"_hi{k}", F.ceil(place(q))) - lo) * part)

    return row.select(*key, F.array(*(value(q, k) for k, q in enumerate(qs))).alias("quantiles"))
