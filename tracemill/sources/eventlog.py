"""Reading, normalising and writing event logs.

The canonical log has case_id STRING, task_name STRING, timestamp TIMESTAMP, resource STRING,
amount DOUBLE and event_seq LONG, which orders events of equal time inside a case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Accepted column names per canonical name, the first one present wins.
ALIASES = {
    "case_id": ["case:concept:name", "case:id"],
    "task_name": ["concept:name"],
    "timestamp": ["time:timestamp"],
    "resource": ["org:resource"],
    "amount": ["case:Amount"],
}
REQUIRED = ["case_id", "task_name", "timestamp", "resource", "amount"]
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd"]
_ATTRIBUTE = "ARRAY<STRUCT<_key: STRING, _value: STRING>>"
XES_SCHEMA = f"string {_ATTRIBUTE}, float {_ATTRIBUTE}, int {_ATTRIBUTE}, event ARRAY<STRUCT<string: {_ATTRIBUTE}, date: {_ATTRIBUTE}, float: {_ATTRIBUTE}, int: {_ATTRIBUTE}>>"


def normalize_columns(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Rename the first alias present to the canonical name; other aliases go, all of them if the canonical name is there."""
    for name, others in aliases.items():
        present = [c for c in others if c in df.columns]
        if name not in df.columns and present:
            df = df.withColumnRenamed(present[0], name)
            present = present[1:]
        df = df.drop(*present)
    return df


def require_columns(df: DataFrame, columns: list[str] = REQUIRED) -> DataFrame:
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"Missing column {c}; found {', '.join(df.columns)}")
    return df


def parsed(column):
    """A timestamp from text in any of TIME_FORMATS, else null; zoneless text is taken in the session's zone (UTC)."""
    return F.coalesce(F.try_to_timestamp(column), *(F.try_to_timestamp(column, F.lit(f)) for f in TIME_FORMATS))


def parse_timestamps(df: DataFrame) -> DataFrame:
    """Text timestamps become TIMESTAMP; rows whose timestamp can't be read are dropped (count them with `rejected`)."""
    kind = dict(df.dtypes)["timestamp"]
    value = parsed(F.col("timestamp")) if kind == "string" else F.col("timestamp").cast("timestamp")
    return df.withColumn("timestamp", value).filter(F.col("timestamp").isNotNull())


def rejected(df: DataFrame) -> DataFrame:
    """One row: how many rows `parse_timestamps` keeps and drops."""
    ok = parsed(F.col("timestamp").cast("string")).isNotNull()
    return df.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("rejected"))


def fill_xes_defaults(df: DataFrame) -> DataFrame:
    """XES logs may lack an amount (0.0) or a resource ("unknown")."""
    if "amount" not in df.columns:
        df = df.withColumn("amount", F.lit(0.0))
    return df if "resource" in df.columns else df.withColumn("resource", F.lit("unknown"))


def canonical(df: DataFrame) -> DataFrame:
    df = parse_timestamps(require_columns(normalize_columns(df)))
    seq = F.col("event_seq") if "event_seq" in df.columns else F.monotonically_increasing_id()
    return df.select(F.col("case_id").cast("string"), F.col("task_name").cast("string"), "timestamp", F.col("resource").cast("string"), F.col("amount").cast("double"), seq.cast("long").alias("event_seq"))


def read_event_log(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """A canonical log from CSV (with header), Parquet, ORC, JSON or XES."""
    if format == "xes" or path.endswith((".xes", ".xes.gz")):
        return canonical(fill_xes_defaults(normalize_columns(read_xes(spark, path))))
    reader = spark.read.option("header", True) if format == "csv" else spark.read
    return canonical(reader.format(format).load(path))


def _attribute(lists: list[str], key: str):
    found = [F.get(F.filter(F.col(x), lambda a: a["_key"] == key), F.lit(0))["_value"] for x in lists]
    return F.coalesce(*found)


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """One row per event of a XES file (plain or .gz; one task per gz file), under the standard's names."""
    traces = spark.read.format("xml").option("rowTag", "trace").schema(XES_SCHEMA).load(path)
    traces = traces.withColumn("case", _attribute(["string"], "concept:name")).withColumn("total", _attribute(["float", "int", "string"], "Amount"))
    events = traces.select("case", "total", F.posexplode("event").alias("event_seq", "e"))
    return events.select(
        F.col("case").alias("case:concept:name"),
        _attribute(["e.string"], "concept:name").alias("concept:name"),
        _attribute(["e.date"], "time:timestamp").alias("time:timestamp"),
        F.coalesce(_attribute(["e.string"], "org:resource"), F.lit("unknown")).alias("org:resource"),
        F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("case:Amount"),
        "event_seq",
    )


def in_case():
    """The window that everything rests on: a case's events in order."""
    return Window.partitionBy("case_id").orderBy("timestamp", "event_seq")


def order_log(df: DataFrame) -> DataFrame:
    """Cases together and in order inside each partition; no global sort."""
    return df.repartition("case_id").sortWithinPartitions("case_id", "timestamp", "event_seq")


def drop_last_events(log: DataFrame) -> DataFrame:
    """Without each case's last event (the view of a log that published reference figures rest on)."""
    return log.withColumn("_next", F.lead("event_seq").over(in_case())).filter(F.col("_next").isNotNull()).drop("_next")


def filter_cases(log: DataFrame, cases: DataFrame) -> DataFrame:
    """Only the events of the cases in `cases` (case_id)."""
    return log.join(cases.select("case_id").distinct(), "case_id", "left_semi")


def filter_case(log: DataFrame, case_id: str) -> DataFrame:
    out = log.filter(F.col("case_id") == case_id)
    if out.isEmpty():
        raise ValueError(f"No case {case_id} in the log")
    return out


def write_metrics(df: DataFrame, path: str) -> None:
    """Append metric rows (run_id, stage, metric_path, value) as JSON, a folder per run and stage."""
    df.write.mode("append").partitionBy("run_id", "stage").json(path)


# ----------------------------------------------------------------- event logs in the test tables


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as a log: a case is a user's week."""
    week = F.floor(F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7).cast("int")
    k = F.get_json_object("props", "$.k").cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat_ws("-", F.col("user_id").cast("string"), week.cast("string")).alias("case_id"),
        F.col("event_type").alias("task_name"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("r"), F.floor(k / 10).cast("string")).alias("resource"),
        F.col("value").alias("amount"),
        F.col("event_id").alias("event_seq"),
    )


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a log: a case is an order, a task its line's status. Line numbers alone may repeat, so the part breaks ties."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").cast("string").alias("case_id"),
        F.concat("l_returnflag", "l_linestatus").alias("task_name"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_suppkey").cast("string").alias("resource"),
        F.col("l_extendedprice").cast("double").alias("amount"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey")).alias("event_seq"),
    )


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a log: a turn a minute."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("string").alias("case_id"),
        F.col("role").alias("task_name"),
        F.timestamp_seconds(F.col("turn") * 60).alias("timestamp"),
        F.lit("unknown").alias("resource"),
        F.lit(0.0).alias("amount"),
        F.col("turn").cast("long").alias("event_seq"),
    )
