"""Comparing runs: tables of metrics (run_id, stage, metric_path, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.sources.scratch import cut


def flatten_metrics(df: DataFrame, keys: tuple[str, ...] = ("run_id", "stage")) -> DataFrame:
    """Nested numeric fields as rows (keys, metric_path, value, whole), paths joined by dots; lists, booleans and text are skipped. `whole`: of a whole-number type."""

    def leaves(schema: T.StructType, path: tuple[str, ...] = ()):
        for f in schema.fields:
            if not path and f.name in keys:
                continue
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            elif isinstance(f.dataType, T.NumericType):
                yield (*path, f.name), isinstance(f.dataType, T.IntegralType)

    found = [F.struct(F.lit(".".join(p)).alias("metric_path"), F.col(".".join(f"`{x}`" for x in p)).cast("double").alias("value"), F.lit(whole).alias("whole")) for p, whole in leaves(df.schema)]
    if not found:
        return df.select(*keys, F.lit("").alias("metric_path"), F.lit(0.0).alias("value"), F.lit(False).alias("whole")).limit(0)
    return df.select(*keys, F.explode(F.array(*found)).alias("m")).select(*keys, "m.metric_path", "m.value", "m.whole").filter("value is not null")


def flatten_documents(df: DataFrame, column: str = "doc", keys: tuple[str, ...] = ("run_id", "stage")) -> DataFrame:
    """What `flatten_metrics` gives, from JSON text whose keys nobody declared: (keys, metric_path, keys_path, value, whole).

    Each level of nesting is opened for all documents at once, so a document needs no schema and documents may differ; names of tasks
    may be keys, whatever characters they hold. metric_path joins the keys by dots, keys_path is the list of them. Lists, booleans,
    text, nulls and text that isn't JSON are skipped, as is a number by itself. `whole`: a whole number of 64 bits.
    """
    level = df.select(*keys, F.array().cast("array<string>").alias("keys_path"), F.expr(f"try_parse_json(`{column}`)").alias("_v"))
    level = level.filter(_kind("_v").startswith("OBJECT"))
    out = []
    while not (level := cut(level)).isEmpty():  # as many rounds as the documents are deep
        inner = level.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        inner = inner.select(*keys, F.concat("keys_path", F.array("key")).alias("keys_path"), F.col("value").alias("_v"))
        kind = _kind("_v")
        whole = kind == "BIGINT"
        found = inner.filter(whole | kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"))
        out.append(found.select(*keys, F.array_join("keys_path", ".").alias("metric_path"), "keys_path", F.variant_get("_v", "$", "double").alias("value"), whole.alias("whole")))
        level = inner.filter(kind.startswith("OBJECT"))
    if not out:
        return level.select(*keys, F.lit("").alias("metric_path"), "keys_path", F.lit(0.0).alias("value"), F.lit(False).alias("whole"))
    return reduce(DataFrame.unionByName, out)


def _kind(column: str):
    return F.schema_of_variant(column)


def flatten_values(df: DataFrame, keys: tuple[str, ...] = ("run_id", "stage")) -> DataFrame:
    """What `flatten_metrics` skips, as rows (keys, metric_path, kind, text): lists by their length, booleans and text by what they say."""

    def leaves(schema: T.StructType, path: tuple[str, ...] = ()):
        for f in schema.fields:
            if not path and f.name in keys:
                continue
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            elif isinstance(f.dataType, T.ArrayType):
                yield (*path, f.name), "list", lambda c: F.size(c).cast("string")
            elif isinstance(f.dataType, T.BooleanType | T.StringType):
                yield (*path, f.name), "boolean" if isinstance(f.dataType, T.BooleanType) else "text", lambda c: c.cast("string")

    found = []
    for p, kind, show in leaves(df.schema):
        value = F.col(".".join(f"`{x}`" for x in p))
        found.append(F.struct(F.lit(".".join(p)).alias("metric_path"), F.lit(kind).alias("kind"), F.when(value.isNotNull(), show(value)).alias("text")))
    if not found:
        return df.select(*keys, *(F.lit("").alias(c) for c in ("metric_path", "kind", "text"))).limit(0)
    return df.select(*keys, F.explode(F.array(*found)).alias("m")).select(*keys, "m.metric_path", "m.kind", "m.text").filter("text is not null")


def diff_values(a: DataFrame, b: DataFrame) -> DataFrame:
    """(stage, metric_path, status, a, b) of what differs between two tables that `flatten_values` made: list lengths, booleans, text."""
    left = a.select("stage", "metric_path", F.col("text").alias("a"), F.col("kind").alias("_a"))
    right = b.select("stage", "metric_path", F.col("text").alias("b"), F.col("kind").alias("_b"))
    out = left.join(right, ["stage", "metric_path"], "full")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when((F.col("a") != F.col("b")) | (F.col("_a") != F.col("_b")), "changed")
    return out.withColumn("status", status).filter("status is not null").select("stage", "metric_path", "status", "a", "b")


def stages_of_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """(stage, status) of the stages that one run alone has a document of."""
    left = a.select("stage").distinct().withColumn("a", F.lit(True))
    right = b.select("stage").distinct().withColumn("b", F.lit(True))
    return left.join(right, "stage", "full").filter("a is null or b is null").select("stage", F.when(F.col("a").isNull(), "added").otherwise("removed").alias("status"))


def diff_runs(a: DataFrame, b: DataFrame, threshold: float = 1e-9) -> DataFrame:
    """(stage, metric_path, status, a, b, delta, percent) of the numbers that differ: added, removed, changed. `diff_values` tells of other leaves."""
    left = a.select("stage", "metric_path", F.col("value").alias("a"))
    right = b.select("stage", "metric_path", F.col("value").alias("b"))
    out = left.join(right, ["stage", "metric_path"], "full")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.abs(F.col("b") - F.col("a")) > threshold, "changed")
    out = out.withColumn("status", status).filter("status is not null").withColumn("delta", F.col("b") - F.col("a"))
    return out.withColumn("percent", F.when(F.col("a") != 0, 100 * F.col("delta") / F.abs("a")))


def diff_clusters(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tasks whose cluster differs, or that one run lacks."""
    out = a.select("task", F.col("cluster").alias("a")).join(b.select("task", F.col("cluster").alias("b")), "task", "full")
    return out.filter(~F.col("a").eqNullSafe(F.col("b")))


def seed_variance(runs: DataFrame) -> DataFrame:
    """Of metrics that every run has: mean, sample deviation (0 for one run), extremes, number of runs, and the runs' values in their order."""
    count = runs.agg(F.count_distinct("run_id").alias("runs"))
    out = runs.groupBy("stage", "metric_path").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count_distinct("run_id").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("run_id", "value"))), lambda x: x["value"]).alias("values"))  # a value a run
    return out.crossJoin(F.broadcast(count)).filter(F.col("n") == F.col("runs")).drop("runs")  # one row


def leaderboard(runs: DataFrame, metrics: list[tuple[str, str]]) -> DataFrame:
    """One row per run, a column "stage.path" per (stage, metric path), null where a run lacks it."""
    of = lambda stage, m: F.max(F.when((F.col("stage") == stage) & (F.col("metric_path") == m), F.col("value")))
    return runs.groupBy("run_id").agg(*(of(stage, m).alias(f"{stage}.{m}") for stage, m in metrics))


def drift_check(actual: DataFrame, pinned: DataFrame, tolerance: float = 0.10, whole_tolerance: float = 5) -> DataFrame:
    """(metric_path, actual, pinned, drift, ok); a pinned metric that is missing isn't ok.

    Metrics of a whole-number type (`whole`, as `flatten_metrics` says) may drift by `whole_tolerance`, others by `tolerance`. `pinned`
    may hold a tolerance of its own for a metric; null leaves it to these.
    """
    own = F.when(F.col("whole"), F.lit(float(whole_tolerance))).otherwise(F.lit(tolerance)) if "whole" in pinned.columns else F.lit(tolerance)
    own = F.coalesce(F.col("tolerance"), own) if "tolerance" in pinned.columns else own
    out = pinned.select("metric_path", F.col("value").alias("pinned"), own.alias("allowed")).join(actual.select("metric_path", F.col("value").alias("actual")), "metric_path", "left")
    out = out.withColumn("drift", F.abs(F.col("actual") - F.col("pinned")))
    return out.select("metric_path", "actual", "pinned", "drift", F.coalesce(F.col("drift") <= F.col("allowed"), F.lit(False)).alias("ok"))
