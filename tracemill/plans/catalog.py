"""Registered queries over the test tables, each with the SQL that must give the same rows.

Times are compared as microseconds, doubles rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import features as ft
from tracemill.operators import analysis as an
from tracemill.operators import cases as cs
from tracemill.operators import conformance as cf
from tracemill.operators import metrics as mt
from tracemill.operators import predict as pr
from tracemill.operators import runs as rn
from tracemill.operators import transitions as tr
from tracemill.sources import eventlog as ev
from tracemill.sources import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ------------------------------------------------------------ SQL building blocks

EV = """
ev as (select concat(user_id, '-', cast(floor(date_diff('day', date '2024-01-01', cast(ts as date)) / 7) as int)) as case_id,
    event_type as task_name, ts, concat('r', cast(floor(cast(json_extract_string(props, '$.k') as int) / 10) as int)) as resource,
    value as amount, event_id as event_seq from events)"""
LI = """
ev as (select cast(l_orderkey as varchar) as case_id, concat(l_returnflag, l_linestatus) as task_name, cast(l_shipdate as timestamp) as ts,
    cast(l_suppkey as varchar) as resource, l_extendedprice as amount, l_linenumber::bigint * 1000000000000 + l_partkey as event_seq from lineitem)"""
CO = """
ev as (select cast(conv_id as varchar) as case_id, role as task_name, make_timestamp(turn * 60000000) as ts, 'unknown' as resource,
    0.0::double as amount, turn as event_seq from conversations)"""
NX = """
nx as (select *, lead(task_name) over w as next_task, (epoch_us(lead(ts) over w) - epoch_us(ts)) / 1e6 as dt,
    (dayofweek(ts) + 6) % 7 as dow, hour(ts) as hod, row_number() over w as k, lag(task_name) over w as prev_task
    from ev window w as (partition by case_id order by ts, event_seq))"""
TR = NX + """,
tr as (select case_id, task_name as src, next_task as tgt, dt as wait_s, dt / 3600 as wait_h, resource, amount, ts, event_seq, dow, hod from nx where next_task is not null)"""
#: The same over a log without each case's last event.
CUT = """
ev as (select * exclude (z) from (select *, lead(event_seq) over (partition by case_id order by ts, event_seq) as z from ev0) where z is not null)"""
EV_CUT = EV.replace("ev as", "ev0 as", 1) + "," + CUT
#: Means of waits are taken over whole microseconds, so they don't depend on the order of addition.
MEAN = "sum(cast(round(wait_s * 1e6) as bigint)) / count(*) / 1e6"
ST = f"st as (select src, tgt, {MEAN} as mean_s, count(*) as n, {MEAN} / 3600 as mean_hours from tr group by all)"
CY = """
cy as (select case_id, min(ts) as a, max(ts) as b, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 as h, avg(amount) as m, count(*) as n from ev group by 1)"""
SP = """
sp as (select case_id, case when row_number() over (order by md5(concat(case_id, ':42')), case_id) <= greatest(1, cast(round_even(count(*) over () * 0.2, 0) as bigint))
    then 'val' else 'train' end as split from (select distinct case_id from ev)),
lb as (select nx.*, split, case when prev_task is not null then concat(prev_task, '>', task_name) end as context_2, ln(1 + greatest(dt, 0)) as dt_log
    from nx join sp using (case_id) where next_task is not null),
tn as (select * from lb where split = 'train'), vl as (select * from lb where split = 'val')"""
#: Smoothed distributions of order 1 and their ranking.
DI = """
labels as (select distinct next_task as label from tn),
grid as (select context, label from (select distinct task_name as context from tn) cross join labels),
pb as (select g.context, g.label, (coalesce(c, 0) + 1.0) / (sum(coalesce(c, 0)) over (partition by g.context) + count(*) over (partition by g.context)) as p
    from grid g left join (select task_name as context, next_task as label, count(*) as c from tn group by all) c using (context, label)),
p0 as (select '' as context, label, (coalesce(c, 0) + 1.0) / (sum(coalesce(c, 0)) over () + count(*) over ()) as p
    from labels left join (select next_task as label, count(*) as c from tn group by all) c using (label)),
md as (select *, row_number() over (partition by context order by p desc, label) as r from (select * from pb union all select * from p0)),
pv as (select vl.*, case when task_name in (select context from pb) then task_name else '' end as context from vl),
rk as (select pv.case_id, pv.event_seq, pv.next_task as y_true, t.label as y_pred, t.p as conf, m.r as rank, m.p as p_true
    from pv join md t on t.context = pv.context and t.r = 1 left join md m on m.context = pv.context and m.label = pv.next_task)"""


#: The feature vector and its length.
FX = """
dt as (select name, row_number() over (order by name) - 1 as id from (select distinct task_name as name from ev)),
dr as (select name, row_number() over (order by name) - 1 as id from (select distinct resource as name from ev)),
fx as (select *, sqrt(task_id * task_id + resource_id * resource_id + amount * amount + day_of_week * day_of_week + hour_of_day * hour_of_day) as l
    from (select case_id, event_seq, k - 1 as idx, dt.id as task_id, dr.id as resource_id, amount, dow as day_of_week, hod as hour_of_day
        from nx join dt on dt.name = task_name join dr on dr.name = resource where next_task is not null))"""
_SCALED = ", ".join(f"round({c} / coalesce(nullif(l, 0), 1), 6) as feat_{c}" for c in ft.FEATURES)


def L1(spark, d):
    return ev.events_log(spark, d)


def L2(spark, d):
    return ev.lineitem_log(spark, d)


def L3(spark, d):
    return ev.conversations_log(spark, d)


def halves(log: DataFrame, order: int = 1):
    """Labelled training and validation events with contexts."""
    both = pr.labelled(pr.contexts(ft.split_cases(log), order))
    return both.filter("split = 'train'"), both.filter("split = 'val'")


def predictions(log: DataFrame):
    train, val = halves(log)
    return pr.predict_distribution(val, pr.next_event_distribution(train)).withColumn("y_true", F.col("next_task"))


def predicted_cells(log: DataFrame):
    """`predictions` with equal rows as one, c times: one pass over the log counts how often each task follows each, by split."""
    both = pr.labelled(pr.contexts(ft.split_cases(log), 1)).groupBy("split", "context_1", "next_task").agg(F.count(F.lit(1)).alias("c"))
    both = scratch.cut(both)
    model = pr.next_event_distribution(both.filter("split = 'train'"), weight="c")
    return pr.predict_distribution(both.filter("split = 'val'"), model).withColumn("y_true", F.col("next_task"))




# --------------------------------------------------------------------- sources


@query(f"with {EV} select case_id, task_name, epoch_us(ts) as ts_us, resource, amount, event_seq from ev")
def normalized_log(spark, d):
    """Tables under other names become the canonical log."""
    other = L1(spark, d).withColumnsRenamed({"case_id": "case:concept:name", "task_name": "concept:name", "timestamp": "time:timestamp", "resource": "org:resource", "amount": "case:Amount"})
    return ev.canonical(other.withColumn("case:id", F.lit("loser"))).select("case_id", "task_name", F.unix_micros("timestamp").alias("ts_us"), "resource", "amount", "event_seq")


@query("select count(*) filter (where event_id % 97 <> 0) as kept, count(*) filter (where event_id % 97 = 0) as rejected from events")
def rejected_timestamps(spark, d):
    text = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return ev.rejected(L1(spark, d).withColumn("timestamp", F.when(F.col("event_seq") % 97 == 0, "not a time").otherwise(text)))


@query(f"with {EV} select case_id, event_seq, row_number() over (partition by case_id order by ts, event_seq) - 1 as idx from ev")
def ordered_events(spark, d):
    return tr.indexed(ev.order_log(L1(spark, d))).select("case_id", "event_seq", "idx")


@query(f"""with {EV}, {NX}, {SP} select count(distinct task_name) as num_tasks, count(distinct resource) as num_resources, count(distinct case_id) as num_cases_total,
    count(distinct case_id) filter (where split = 'train') as num_cases_train, count(distinct case_id) filter (where split = 'val') as num_cases_val,
    min(epoch_us(ts)) as first_us, max(epoch_us(ts)) as last_us, 'l2' as scaler_mode, 42 as seed from ev join sp using (case_id)""")
def preprocessing_summary(spark, d):
    return an.preprocessing_summary(ft.split_cases(L1(spark, d)))


@query(f"with {EV} select case_id, count(*) as n from ev where case_id in (select case_id from ev group by 1 having count(*) >= 20) group by 1")
def filtered_cases(spark, d):
    log = L1(spark, d)
    return ev.filter_cases(log, log.groupBy("case_id").count().filter("count >= 20")).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


_LOG_SQL = f"with {EV} select case_id, task_name, epoch_us(ts) as ts_us, resource, amount, event_seq from ev"


def _log_columns(log):
    return log.select("case_id", "task_name", F.unix_micros("timestamp").alias("ts_us"), "resource", "amount", "event_seq")


def _aliased(log):
    """Under the standard's names, with times as text."""
    text = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return log.withColumn("timestamp", text).withColumnsRenamed({"case_id": "case:concept:name", "task_name": "concept:name", "timestamp": "time:timestamp", "resource": "org:resource", "amount": "case:Amount"})


@query(_LOG_SQL)
def csv_log(spark, d):
    """The events written as CSV and read as a log."""
    path = scratch.place(spark, "csv")
    _aliased(L1(spark, d)).write.option("header", True).csv(path)
    return _log_columns(ev.read_event_log(spark, path))


@query(_LOG_SQL)
def parquet_log(spark, d):
    """The events written as Parquet, times without a zone, and read as a log."""
    path = scratch.place(spark, "parquet")
    L1(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).write.parquet(path)
    return _log_columns(ev.read_event_log(spark, path, "parquet"))


@query(f"""with {EV} select case_id, task_name, epoch_us(ts) as ts_us, resource, min(amount) over (partition by case_id) as amount,
    row_number() over (partition by case_id order by ts, event_seq) - 1 as event_seq from ev""")
def xes_log(spark, d):
    """The cases written as traces of XES and read as a log; a trace has one amount, here its least."""
    attribute = lambda kind, key, value: F.concat(F.lit(f'<{kind} key="{key}" value="'), value, F.lit('"/>'))
    time = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    event = F.concat(F.lit("<event>"), attribute("string", "concept:name", F.col("task_name")), attribute("string", "org:resource", F.col("resource")), attribute("date", "time:timestamp", time), F.lit("</event>"))
    cases = L1(spark, d).withColumn("e", event).groupBy("case_id").agg(F.min("amount").cast("string").alias("a"), F.sort_array(F.collect_list(F.struct("timestamp", "event_seq", "e"))).alias("es"))
    events = F.array_join(F.transform("es", lambda x: x["e"]), "")
    path = scratch.place(spark, "traces.xes")
    traces = cases.select(F.concat(F.lit("<trace>"), attribute("string", "concept:name", F.col("case_id")), attribute("float", "Amount", F.col("a")), events, F.lit("</trace>")).alias("value"))

    def documents(batches):  # a file is a whole log
        yield pa.RecordBatch.from_arrays([pa.array(["<log>"])], ["value"])
        yield from batches
        yield pa.RecordBatch.from_arrays([pa.array(["</log>"])], ["value"])

    traces.mapInArrow(documents, "value string").write.text(path)
    return _log_columns(ev.read_event_log(spark, path))


@query(f"with {EV} select case_id, task_name, epoch_us(ts) as ts_us, 'unknown' as resource, 0.0::double as amount, event_seq from ev")
def xes_defaults(spark, d):
    """A log without resources and amounts."""
    return _log_columns(ev.canonical(ev.fill_xes_defaults(L1(spark, d).drop("resource", "amount"))))


# -------------------------------------------------------------------- features


@query(f"""with {EV}, {NX}, d as (select name, row_number() over (order by name) - 1 as id from (select distinct task_name as name from ev)),
    q as (select name, row_number() over (order by name) - 1 as id from (select distinct resource as name from ev))
    select case_id, event_seq, t.id as task_id, u.id as next_id, q.id as resource_id, round(dt, 6) as dt_seconds, round(ln(1 + greatest(dt, 0)), 6) as dt_log, dow as day_of_week, hod as hour_of_day,
    round(sin(2 * pi() * dow / 7), 6) as dow_sin, round(cos(2 * pi() * hod / 24), 6) as hod_cos
    from nx join d t on t.name = task_name join d u on u.name = next_task join q on q.name = resource""")
def encoded_log(spark, d):
    out = ft.encode_log(L1(spark, d))
    return out.select("case_id", "event_seq", "task_id", "next_id", "resource_id", r6("dt_seconds").alias("dt_seconds"), r6("dt_log").alias("dt_log"), "day_of_week", "hour_of_day", r6("dow_sin").alias("dow_sin"), r6("hod_cos").alias("hod_cos"))


@query(f"with {EV} select case_id, event_seq, task_name as decoded from ev")
def decoded_labels(spark, d):
    log = L1(spark, d)
    names = ft.label_dictionary(log, "task_name")
    return ft.label_decode(ft.label_encode(log, "task_name", "task_id", names), "task_id", "decoded", names).select("case_id", "event_seq", "decoded")


@query(f"with {EV}, {NX}, {FX} select case_id, event_seq, {_SCALED} from fx")
def l2_features(spark, d):
    return ft.create_features(L1(spark, d)).select("case_id", "event_seq", *(r6(f"feat_{c}").alias(f"feat_{c}") for c in ft.FEATURES))


@query(f"""with {EV}, {NX}, {SP}, {FX}, e as (select {', '.join(f'min({c}) as lo_{c}, max({c}) as hi_{c}' for c in ft.FEATURES)} from fx join sp using (case_id) where split = 'train')
    select case_id, event_seq, {', '.join(f'round(({c} - lo_{c}) / coalesce(nullif(hi_{c} - lo_{c}, 0), 1), 6) as feat_{c}' for c in ft.FEATURES)} from fx join sp using (case_id) cross join e where split = 'val'""")
def minmax_features(spark, d):
    """Fitted on the training half; ids come from the whole log."""
    log = ft.encode_log(ft.split_cases(L1(spark, d)))
    out = ft.apply_minmax(log.filter("split = 'val'"), ft.fit_minmax(log.filter("split = 'train'")))
    return out.select("case_id", "event_seq", *(r6(f"feat_{c}").alias(f"feat_{c}") for c in ft.FEATURES))


@query(f"""with {EV}, {NX}, c as (select next_task as name, count(*) as c from nx where next_task is not null group by 1)
    select name, round((select sum(c) from c) / ((select count(*) from c) * c), 6) as weight from c""")
def class_weights(spark, d):
    log = L1(spark, d)
    names = ft.label_dictionary(log, "task_name")
    return ft.class_weights(ft.encode_log(log), "next_id", names).select("name", r6("weight").alias("weight"))


@query(f"with {LI}, {NX}, {SP} select case_id, split from sp")
def split_by_case(spark, d):
    return ft.split_cases(L2(spark, d)).select("case_id", "split").distinct()


@query(f"""with {EV}, c as (select case_id, min(ts) as a from ev group by 1)
    select case_id, case when row_number() over (order by a desc, case_id desc) <= greatest(1, cast(round_even(count(*) over () * 0.2, 0) as bigint)) then 'val' else 'train' end as split from c""")
def split_by_time(spark, d):
    return ft.split_cases(L1(spark, d), "temporal").select("case_id", "split").distinct()


@query(f"""with {LI}, {TR}, q as (select quantile_cont(amount, [0.0, 0.25, 0.5, 0.75, 1.0]) as q from tr)
    select case_id, event_seq, case when amount <= q[2] then 'Q1' when amount <= q[3] then 'Q2' when amount <= q[4] then 'Q3' else 'Q4' end as amount_bucket from tr cross join q""")
def amount_quartiles(spark, d):
    return ft.amount_quartile(tr.transitions(L2(spark, d))).select("case_id", "event_seq", "amount_bucket")


# ------------------------------------------------------- sequences and graphs

_TRANSITIONS = "select case_id, src, tgt, round(wait_s, 6) as wait_s, resource, amount, event_seq, dow, hod from tr"


def _shown(t):
    return t.select("case_id", "src", "tgt", r6("wait_s").alias("wait_s"), "resource", "amount", "event_seq", "dow", "hod")


@query(f"with {EV}, {TR} {_TRANSITIONS}")
def transitions(spark, d):
    return _shown(tr.transitions(L1(spark, d)))


@query(f"with {LI}, {TR} {_TRANSITIONS}")
def transitions_lineitem(spark, d):
    return _shown(tr.transitions(L2(spark, d)))


_ONE = EV.replace("concat(user_id, '-', cast(floor(date_diff('day', date '2024-01-01', cast(ts as date)) / 7) as int))", "case when user_id % 3 = 0 then concat('u', user_id) else 'all' end")


def _one_case(spark, d):
    """The events of two thirds of all users as one case."""
    user = F.split("case_id", "-")[0].cast("long")
    return L1(spark, d).withColumn("case_id", F.when(user % 3 == 0, F.concat(F.lit("u"), user.cast("string"))).otherwise("all"))


@query(f"with {_ONE}, {TR} {_TRANSITIONS}")
def transitions_giant_case(spark, d):
    return _shown(tr.transitions(_one_case(spark, d), spread=True))


@query(f"with {_ONE}, {NX} select case_id, k - 1 as src_idx, k as dst_idx from nx where next_task is not null")
def event_graph_edges_giant_case(spark, d):
    return tr.event_graph_edges(_one_case(spark, d), spread=True)


@query(f"with {EV}, {NX} select case_id, k - 1 as src_idx, k as dst_idx from nx where next_task is not null")
def event_graph_edges(spark, d):
    return tr.event_graph_edges(L1(spark, d))


@query(f"with {EV}, {NX} select case_id, k - 1 as src_idx, k as dst_idx from nx where next_task is not null union all select case_id, k, k - 1 from nx where next_task is not null")
def event_graph_edges_both_ways(spark, d):
    return tr.event_graph_edges(L1(spark, d), causal=False)


@query(f"with {EV}, {NX} select case_id, k - 1 as idx, next_task as y, round(ln(1 + greatest(dt, 0)), 6) as dt, 5 as width from nx where next_task is not null")
def event_graph_nodes(spark, d):
    return tr.event_graph_nodes(ft.create_features(L1(spark, d))).select("case_id", "idx", "y", r6("dt").alias("dt"), F.size("features").alias("width"))


@query(f"""with {LI}, {NX} select case_id, next_task as label from (select case_id, next_task, row_number() over (partition by case_id order by count(*) desc, next_task) as r
    from nx where next_task is not null group by 1, 2) where r = 1""")
def case_modal_labels(spark, d):
    return tr.case_modal_label(L2(spark, d))


@query(f"""with {EV}, {NX} select case_id, k, string_agg(task_name, '>') over w as tasks, string_agg(resource, '>') over w as resources, next_task as label, round(ln(1 + greatest(dt, 0)), 6) as dt
    from nx window w as (partition by case_id order by ts, event_seq) qualify next_task is not null""")
def prefixes(spark, d):
    return tr.prefixes(L1(spark, d)).select("case_id", "k", F.array_join("tasks", ">").alias("tasks"), F.array_join("resources", ">").alias("resources"), "label", r6("dt").alias("dt"))


def _cents(column):
    """Numbers of an array as text, in whole hundredths."""
    return F.array_join(F.transform(column, lambda x: F.round(x * 100).cast("long").cast("string")), ",")


@query(f"""with {EV}, {NX} select case_id, k, string_agg(cast(cast(round(amount * 100) as bigint) as varchar), ',') over w as amounts, string_agg(cast(dow * 100 as varchar), ',') over w as days
    from nx window w as (partition by case_id order by ts, event_seq) qualify next_task is not null""")
def prefix_vectors(spark, d):
    """The vectors of continuous features that a prefix holds."""
    out = tr.prefixes(ft.calendar(L1(spark, d)), continuous=["amount", "day_of_week"])
    return out.select("case_id", "k", _cents(F.transform("vectors", lambda v: v[0])).alias("amounts"), _cents(F.transform("vectors", lambda v: v[1])).alias("days"))


@query(f"""with {CO}, {NX}, d as (select name, row_number() over (order by name) as id from (select distinct task_name as name from ev)),
    p as (select case_id, k, list(d.id) over (partition by case_id order by ts, event_seq) as ids, next_task from nx join d on d.name = task_name),
    m as (select max(len(ids)) as width from p where next_task is not null)
    select case_id, k, len(ids) as length, array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda x: 0)), ',') as padded from p cross join m where next_task is not null""")
def padded_prefixes(spark, d):
    log = L3(spark, d)
    out = tr.pad_prefixes(tr.prefixes(log), ft.label_dictionary(log, "task_name"))
    return out.select("case_id", "k", "length", F.array_join(F.transform("padded", lambda x: x.cast("string")), ",").alias("padded"))


@query(f"""with {EV}, {NX}, d as (select name, row_number() over (order by name) as id from (select distinct task_name as name from ev)), q as (select name, row_number() over (order by name) as id from (select distinct resource as name from ev)),
    p as (select case_id, k, next_task, list(d.id) over w as t, list(q.id) over w as r, list(cast(round(amount * 100) as bigint)) over w as v from nx join d on d.name = task_name join q on q.name = resource window w as (partition by case_id order by ts, event_seq)),
    l as (select case_id, k, least(len(t), 5) as length, t[greatest(len(t) - 4, 1):] as t, r[greatest(len(t) - 4, 1):] as r, v[greatest(len(t) - 4, 1):] as v, list_transform(range(5 - least(len(t), 5)), lambda x: 0) as z from p where next_task is not null)
    select case_id, k, length, array_to_string(list_concat(t, z), ',') as padded, array_to_string(list_concat(r, z), ',') as padded_resources, array_to_string(list_concat(v, z), ',') as padded_amounts from l""")
def padded_prefixes_last5(spark, d):
    """Tasks, resources and amounts of the last five events of each prefix."""
    log = L1(spark, d)
    out = tr.encoded_prefixes(log, ft.label_dictionary(log, "task_name"), 5, ft.label_dictionary(log, "resource"), ["amount"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("case_id", "k", "length", text("padded").alias("padded"), text("padded_resources").alias("padded_resources"), _cents(F.transform("padded_vectors", lambda v: v[0])).alias("padded_amounts"))


@query(f"with {EV}, {NX}, {FX} select case_id, idx, {_SCALED} from fx")
def event_graph_features(spark, d):
    """The values of the feature vectors that `event_graph_nodes` counts."""
    out = tr.event_graph_nodes(ft.create_features(L1(spark, d)))
    return out.select("case_id", "idx", *(r6(F.col("features")[k]).alias(f"feat_{c}") for k, c in enumerate(ft.FEATURES)))


@query(f"with {CO}, {NX} select case_id, k from nx where next_task is not null")
def shuffled_samples(spark, d):
    return tr.shuffle_samples(tr.prefixes(L3(spark, d))).select("case_id", "k")


for _log, _sql, _name in ((L1, EV, ""), (L2, LI, "_lineitem")):
    query(f"with {_sql}, {TR} select src, tgt, count(*) as weight from tr group by all", f"task_adjacency{_name}")(lambda s, d, f=_log: tr.task_adjacency(tr.transitions(f(s, d))))
query(f"with {EV_CUT}, {TR} select src, tgt, count(*) as weight from tr group by all", "task_adjacency_cut")(lambda s, d: tr.task_adjacency(tr.transitions(ev.drop_last_events(L1(s, d)))))


@query(f"with {LI} select task_name, count(*) as n from (select case_id, arg_min(task_name, (ts, event_seq)) as task_name from ev group by 1) group by 1")
def start_activities(spark, d):
    return tr.start_activities(L2(spark, d))


@query(f"with {LI} select task_name, count(*) as n from (select case_id, arg_max(task_name, (ts, event_seq)) as task_name from ev group by 1) group by 1")
def end_activities(spark, d):
    return tr.end_activities(L2(spark, d))


# -------------------------------------------------------------------- analysis

_STATS = "select src, tgt, n, round(mean_hours, 6) as mean_hours from st"


def _stats(df):
    return df.select("src", "tgt", "n", r6("mean_hours").alias("mean_hours"))


query(f"with {EV}, {TR}, {ST} {_STATS}", "bottlenecks")(lambda s, d: _stats(an.bottlenecks(tr.transitions(L1(s, d)))))
query(f"with {LI}, {TR}, {ST} {_STATS}", "bottlenecks_lineitem")(lambda s, d: _stats(an.bottlenecks(tr.transitions(L2(s, d)))))
query(f"with {EV_CUT}, {TR}, {ST} {_STATS}", "bottlenecks_cut")(lambda s, d: _stats(an.bottlenecks(tr.transitions(ev.drop_last_events(L1(s, d))))))
query(f"with {EV}, {TR}, {ST} {_STATS} where n >= 400", "significant_bottlenecks")(lambda s, d: _stats(an.significant_bottlenecks(an.bottlenecks(tr.transitions(L1(s, d))), 400)))
query(f"with {LI}, {TR}, {ST} {_STATS} where n <= 2", "rare_transitions")(lambda s, d: _stats(an.rare_transitions(an.bottlenecks(tr.transitions(L2(s, d))))))
_CYCLES = "select case_id, epoch_us(a) as started_us, epoch_us(b) as ended_us, round(h, 6) as cycle_time_hours, round(m, 6) as mean_amount, n as num_events from cy"


def _cycles(df):
    return df.select("case_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), r6("cycle_time_hours").alias("cycle_time_hours"), r6("mean_amount").alias("mean_amount"), "num_events")


query(f"with {EV}, {CY} {_CYCLES}", "cycle_times")(lambda s, d: _cycles(an.cycle_times(L1(s, d))))
query(f"with {EV_CUT}, {CY} {_CYCLES}", "cycle_times_cut")(lambda s, d: _cycles(an.cycle_times(ev.drop_last_events(L1(s, d)))))
query(f"with {EV}, {CY} select round(quantile_cont(h, 0.95), 6) as cut from cy", "cycle_time_percentile")(lambda s, d: an.cycle_time_percentile(an.cycle_times(L1(s, d))).select(r6("cut").alias("cut")))
query(f"with {EV}, {CY} {_CYCLES} where h > (select quantile_cont(h, 0.95) from cy)", "long_cases")(lambda s, d: _cycles(an.long_cases(an.cycle_times(L1(s, d)))))
query(f"with {EV}, {TR}, {ST} {_STATS} where n >= 10 order by st.mean_hours desc, src, tgt limit 5", "top_transitions")(lambda s, d: _stats(an.top_transitions(tr.transitions(L1(s, d)))))
DG = f"""
qs as (select quantile_cont(amount, [0.0, 0.25, 0.5, 0.75, 1.0]) as q from tr),
tops as (select src, tgt from st where n >= 10 order by mean_hours desc, src, tgt limit 5),
rs as (select src, tgt, wait_s, resource, cast(dow as varchar) as day_of_week, cast(hod as varchar) as hour_of_day,
    case when amount <= q[2] then 'Q1' when amount <= q[3] then 'Q2' when amount <= q[4] then 'Q3' else 'Q4' end as amount_bucket from tr semi join tops using (src, tgt) cross join qs),
dg as (select src, tgt, feature, value, {MEAN} / 3600 as mean_h, count(*) as n from (unpivot rs on resource, day_of_week, hour_of_day, amount_bucket into name feature value value) group by all having count(*) >= 3)"""
query(f"with {EV}, {TR}, {ST}, {DG} select src, tgt, feature, value, round(mean_h, 6) as mean_h, n from dg", "driver_groups")(lambda s, d: an.driver_groups(tr.transitions(L1(s, d))).select("src", "tgt", "feature", "value", r6("mean_h").alias("mean_h"), "n"))


@query(f"""with {EV}, {TR}, {ST}, {DG}, o as (select src, tgt, feature, count(*) as groups, max(mean_h) - min(mean_h) as spread, arg_max(value, (round(mean_h, 9), value)) as worst, arg_min(value, (round(mean_h, 9), value)) as best
    from dg group by all having count(*) >= 2), r as (select src, tgt, feature, groups, round(spread, 6) as spread_h, worst, best, row_number() over (partition by src, tgt order by round(spread, 9) desc, feature) as rank from o)
    select tops.src, tops.tgt, st.n as n_transitions, round(st.mean_hours, 6) as mean_wait_h, feature, groups, spread_h, worst, best, rank from tops join st on st.src = tops.src and st.tgt = tops.tgt left join r on r.src = tops.src and r.tgt = tops.tgt""")
def bottleneck_drivers(spark, d):
    return an.drivers(tr.transitions(L1(spark, d))).select("src", "tgt", "n_transitions", r6("mean_wait_h").alias("mean_wait_h"), "feature", "groups", r6("spread_h").alias("spread_h"), F.col("worst.value").alias("worst"), F.col("best.value").alias("best"), "rank")


query(f"""with {LI}, {TR}, {ST} select a.src, b.tgt, coalesce(n, 0) as n from (select distinct src from st) a cross join (select distinct tgt from st) b left join st on st.src = a.src and st.tgt = b.tgt""", "transition_counts")(lambda s, d: an.transition_counts(tr.transitions(L2(s, d))))
query(f"with {EV}, {TR}, {ST} select src, tgt, round(n / sum(n) over (partition by src), 6) as p from st", "transition_probabilities")(lambda s, d: an.transition_probabilities(tr.transitions(L1(s, d))).select("src", "tgt", r6("p").alias("p")))


@query(f"""with {LI}, {TR}, {ST}, {CY} select count(*) as total_traces, count(*) filter (where h > q) as num_long_cases, round(max(q), 6) as p95_hours, (select count(*) from st where n <= 2) as num_rare_transitions
    from cy cross join (select quantile_cont(h, 0.95) as q from cy)""")
def analysis_summary(spark, d):
    log = L2(spark, d)
    return an.analysis_summary(log, tr.transitions(log)).select("total_traces", "num_long_cases", r6("p95_hours").alias("p95_hours"), "num_rare_transitions")


@query()
def spectral_clusters(spark, d):
    return an.spectral_clusters(tr.task_adjacency(tr.transitions(L2(spark, d))))


@query(f"""with {EV}, {CY}, e as (select min(h) as lo, max(h) as hi from cy)
    select cast(least(floor((h - lo) / ((hi - lo) / 30)), 29) as int) as bin, count(*) as n from cy cross join e group by 1""")
def cycle_time_histogram(spark, d):
    return an.cycle_time_histogram(an.cycle_times(L1(spark, d))).select("bin", "n")


query(f"with {LI}, {CY} select round(avg(h), 6) as mean, count(*) as n from cy", "cycle_time_histogram_mean")(lambda s, d: an.cycle_time_histogram(an.cycle_times(L2(s, d))).groupBy(r6("mean").alias("mean")).agg(F.sum("n").alias("n")))


@query(f"""with {EV}, {TR}, {ST}, b as (select src, tgt, true as slow from st where n >= 5 order by mean_hours desc, src, tgt limit 5)
    select st.src, st.tgt, n, round(mean_hours, 6) as mean_hours, coalesce(slow, false) as is_bottleneck from st left join b on b.src = st.src and b.tgt = st.tgt""")
def process_flow_edges(spark, d):
    return an.process_flow_edges(tr.transitions(L1(spark, d))).withColumn("mean_hours", r6("mean_hours"))


@query(f"""with {LI}, {TR}, {ST}, c as (select case_id, arg_min(task_name, (ts, event_seq)) as a, arg_max(task_name, (ts, event_seq)) as b from ev group by 1)
    select 'Start' as source, a as target, count(*) as n from c group by 2 union all select b, 'End', count(*) from c group by 1 union all select src, tgt, n from st""")
def sankey_links(spark, d):
    log = L2(spark, d)
    return an.sankey_links(log, tr.transitions(log))


# ----------------------------------------------------------------- conformance

SQ = "sq as (select case_id, string_agg(task_name, '>' order by ts, event_seq) as tasks from ev group by 1)"
DF = """
sb as (select case_id, src, tgt from tr union all select case_id, '__start__', arg_min(task_name, (ts, event_seq)) from ev group by 1 union all select case_id, arg_max(task_name, (ts, event_seq)), '__end__' from ev group by 1),
df as (select src, tgt, count(*) as n from sb group by all)"""
DFN = "dn as (select src, tgt, n from df qualify n >= 0.5 * max(n) over (partition by src))"
query(f"with {LI}, {SQ} select tasks, count(*) as n, round(count(*) / (select count(*) from sq), 6) as share from sq group by 1", "variants")(lambda s, d: cf.variants(L2(s, d)).select(F.array_join("tasks", ">").alias("tasks"), "n", r6("share").alias("share")))
query(f"with {CO}, {TR}, {DF} select * from df", "directly_follows_model")(lambda s, d: cf.discover_dfg(L3(s, d)))
query(f"with {LI}, {TR}, {DF}, {DFN} select * from dn", "directly_follows_model_filtered")(lambda s, d: cf.discover_dfg(L2(s, d), 0.5))


@query(f"""with {LI}, {TR}, {DF}, {DFN}, e as (select src, tgt from dn where src <> '__start__' and tgt <> '__end__'), t as (select src as x from dn where src <> '__start__' union select tgt from dn where tgt <> '__end__')
    select a.x as a, b.x as b, case when p.src is not null and q.src is not null then '||' when p.src is not null then '->' when q.src is not null then '<-' else '#' end as relation
    from t a cross join t b left join e p on p.src = a.x and p.tgt = b.x left join e q on q.src = b.x and q.tgt = a.x""")
def footprints(spark, d):
    return cf.footprints(cf.discover_dfg(L2(spark, d), 0.5))


RP = "rp as (select case_id, count(*) as steps, count(dn.src) as allowed from sb left join dn using (src, tgt) group by 1)"
query(f"with {LI}, {TR}, {DF}, {DFN}, {RP} select case_id, steps, allowed, steps = allowed as fit from rp", "replayed_traces")(lambda s, d: cf.replay_traces(L2(s, d), cf.discover_dfg(L2(s, d), 0.5)))


@query(f"""with {EV}, {TR}, {DF}, {DFN.replace('0.5', '0.8')}, {RP}, px as (select md5(string_agg(task_name, '>') over (partition by case_id order by ts, event_seq)) as state, task_name as src, next_task as tgt from nx),
    vs as (select state, src, count(*) as w, list(distinct tgt) as seen from px where tgt is not null group by 1, 2),
    en as (select src, list(distinct tgt) as enabled from dn where src <> '__start__' and tgt <> '__end__' group by 1),
    pc as (select 1 - sum(w * len(list_filter(enabled, lambda x: not list_contains(seen, x)))) / sum(w * len(enabled)) as p from vs join en using (src)),
    fi as (select sum(allowed) / sum(steps) as f, avg((steps = allowed)::int) as t, count(*) filter (where steps <> allowed) as dv, count(*) as n from rp)
    select round(f, 6) as fitness, round(t, 6) as fit_traces, dv as num_deviant, n as total_traces, round(p, 6) as precision, round(2 * f * p / (f + p), 6) as f_score from fi cross join pc""")
def conformance_summary(spark, d):
    log = L1(spark, d)
    out = cf.conformance_summary(log, cf.discover_dfg(log, 0.8))
    return out.select(r6("fitness").alias("fitness"), r6("fit_traces").alias("fit_traces"), "num_deviant", "total_traces", r6("precision").alias("precision"), r6("f_score").alias("f_score"))


@query(f"""with recursive {CO}, v as (select tasks, count(*) as n from (select list(task_name order by ts, event_seq) as tasks from ev group by case_id) group by 1),
    r as (select tasks, n, 0 as i, 1 as s, 0 as a, 0 as t, 1 as produced, 0 as consumed, 0 as missing from v union all
        select tasks, n, i + 1,
            case when x = 'system' then greatest(s - 1, 0) else s end, case when x = 'user' then greatest(a - 1, 0) when x in ('system', 'assistant') then a + 1 else a end, case when x = 'assistant' then greatest(t - 1, 0) when x = 'user' then t + 1 else t end,
            produced + 1, consumed + 1, missing + case when (x = 'system' and s = 0) or (x = 'user' and a = 0) or (x = 'assistant' and t = 0) then 1 else 0 end
        from (select *, tasks[i + 1] as x from r where i < len(tasks))),
    e as (select array_to_string(tasks, '>') as tasks, n, produced, consumed + 1 as consumed, missing + (a = 0)::int as missing, s + greatest(a - 1, 0) + t as remaining from r where i = len(tasks))
    select *, round(0.5 * (1 - missing / consumed) + 0.5 * (1 - remaining / produced), 6) as fitness from e""")
def token_replay(spark, d):
    """Conversations on the net that its own directly-follows model gives: a place per edge."""
    log = L3(spark, d)
    net = [("system", "start", "in"), ("system", "asked", "out"), ("user", "asked", "in"), ("user", "told", "out"), ("assistant", "told", "in"), ("assistant", "asked", "out")]
    out = cf.token_replay(log, spark.createDataFrame(net, "transition string, place string, kind string"), ["start"], ["asked"])
    return out.select(F.array_join("tasks", ">").alias("tasks"), "n", "produced", "consumed", "missing", "remaining", r6("fitness").alias("fitness"))


PT = """
px as (select k, string_agg(task_name, '>') over (partition by case_id order by ts, event_seq) as state, task_name as task, next_task as tgt from nx),
pt as (select k, state, task, count(*) as visits, count(*) filter (where tgt is null) as ends, coalesce(list(distinct tgt) filter (where tgt is not null), []) as children from px group by 1, 2, 3)"""


@query(f"""with {EV}, {NX}, {PT} select c.k, c.task, p.task as parent_task, p.visits as parent_visits, c.visits, c.ends, len(c.children) as n_children
    from pt c left join pt p on p.k = c.k - 1 and starts_with(c.state, p.state || '>') and p.state || '>' || c.task = c.state""")
def prefix_tree(spark, d):
    tree = cf.prefix_tree(L1(spark, d))
    above = tree.select(F.col("state").alias("parent"), (F.col("k") + 1).alias("k"), F.col("task").alias("parent_task"), F.col("visits").alias("parent_visits"))
    return tree.join(above, ["k", "parent"], "left").select("k", "task", "parent_task", "parent_visits", "visits", "ends", F.size("children").cast("long").alias("n_children"))


@query(f"""with {LI}, {TR}, {DF}, {DFN}, {PT}, en as (select src as task, list(distinct tgt) as enabled from dn where src <> '__start__' and tgt <> '__end__' group by 1),
    og as (select pt.k, pt.state, pt.task, visits - ends as w, children, coalesce(enabled, []) as enabled from pt left join en using (task) where visits > ends),
    es as (select k, task, 'escaping' as kind, unnest(list_filter(enabled, lambda x: not list_contains(children, x))) as step, w from og
        union all select k, task, 'unmodelled', unnest(list_filter(children, lambda x: not list_contains(enabled, x))), w from og)
    select k, task, kind, step, count(*) as nodes, cast(sum(w) as bigint) as cases from es group by all""")
def escaping_edges(spark, d):
    log = L2(spark, d)
    out = cf.escaping_edges(cf.prefix_tree(log), cf.discover_dfg(log, 0.5))
    return out.groupBy("k", "task", "kind", "step").agg(F.count(F.lit(1)).alias("nodes"), F.sum("w").alias("cases"))


_CONFORMANCE = ORACLES["conformance_summary"].removeprefix(f"with {EV}, ")
_DRIVERS = ORACLES["bottleneck_drivers"].removeprefix(f"with {EV}, ")


@query(f"""select total_traces, num_long_cases, round(q, 6) as p95_hours, num_rare_transitions, num_deviant, fitness, precision, f_score, drivers
    from (with {EV}, {CY} select count(*) as total_traces, count(*) filter (where h > q) as num_long_cases, max(q) as q from cy cross join (select quantile_cont(h, 0.95) as q from cy))
    cross join (with {EV}, {TR}, {ST} select count(*) filter (where n <= 2) as num_rare_transitions from st) cross join (select num_deviant, fitness, precision, f_score from (with {EV}, {_CONFORMANCE}))
    cross join (select string_agg(concat(src, '>', tgt, ' ', rank, ' ', feature, ' ', worst, ' ', best), '|' order by src, tgt, rank) as drivers from (with {EV}, {_DRIVERS}) where feature is not null)""")
def analysis_summary_full(spark, d):
    """All of it, against a model that leaves rare edges out."""
    log = L1(spark, d)
    out = an.analysis_summary(log, tr.transitions(log), cf.discover_dfg(log, 0.8))
    told = F.array_join(F.transform("drivers", lambda x: F.concat(x["src"], F.lit(">"), x["tgt"], F.lit(" "), x["rank"].cast("string"), F.lit(" "), x["feature"], F.lit(" "), x["worst"]["value"], F.lit(" "), x["best"]["value"])), "|")
    return out.select("total_traces", "num_long_cases", "num_rare_transitions", "num_deviant", *(r6(c).alias(c) for c in ("p95_hours", "fitness", "precision", "f_score")), told.alias("drivers"))


# ------------------------------------------------------------------ prediction


@query(f"""with {EV}, {NX}, {SP}, mc as (select next_task from tn group by 1 order by count(*) desc, 1 limit 1)
    select case_id, event_seq, (select next_task from mc) as most_common from vl""")
def predicted_most_common(spark, d):
    train, val = halves(L1(spark, d))
    return pr.predict_most_common(val, pr.fit_most_common(train)).select("case_id", "event_seq", "most_common")


MK = """
mc as (select next_task as m from tn group by 1 order by count(*) desc, 1 limit 1),
mk as (select task_name, next_task as markov from (select task_name, next_task, row_number() over (partition by task_name order by count(*) desc, next_task) as r from tn group by 1, 2) where r = 1),
pm as (select vl.*, coalesce(markov, (select m from mc)) as guess, markov is not null as covered from vl left join mk using (task_name))"""
query(f"with {CO}, {NX}, {SP}, {MK} select task_name, markov from mk", "markov_table")(lambda s, d: pr.fit_markov(halves(L3(s, d))[0]))
query(f"with {EV}, {NX}, {SP}, {MK} select case_id, event_seq, guess as markov, covered from pm", "predicted_markov")(lambda s, d: (lambda t, v: pr.predict_markov(v, pr.fit_markov(t), pr.fit_most_common(t)).select("case_id", "event_seq", "markov", "covered"))(*halves(L1(s, d))))
_BASE = f"""{MK}, bl as (select max((select m from mc)) as most_common_label, avg((next_task = (select m from mc))::int) as most_common_accuracy, avg((guess = next_task)::int) as markov_accuracy,
    avg(covered::int) as markov_coverage, count(*) as num_val_events from pm)"""
_BASE_COLUMNS = "most_common_label, round(most_common_accuracy, 6) as most_common_accuracy, round(markov_accuracy, 6) as markov_accuracy, round(markov_coverage, 6) as markov_coverage, num_val_events"
for _log, _sql, _name in ((L1, EV, ""), (L2, LI, "_lineitem"), (L3, CO, "_conversations")):
    query(f"with {_sql}, {NX}, {SP}, {_BASE} select {_BASE_COLUMNS} from bl", f"baseline_metrics{_name}")(
        lambda s, d, f=_log: pr.evaluate_baselines(*halves(f(s, d))).select("most_common_label", *(r6(c).alias(c) for c in ("most_common_accuracy", "markov_accuracy", "markov_coverage")), "num_val_events")
    )


@query(f"""with {EV}, {NX}, {SP}, {DI} select case when context = '' then 0 else 1 end as depth, context, label, r as rank, round(p, 6) as prob from md""")
def next_event_distributions(spark, d):
    model = pr.next_event_distribution(halves(L1(spark, d))[0])
    out = model.select("depth", "context", F.posexplode(F.arrays_zip("labels", "probs")).alias("rank", "x"))
    return out.select("depth", "context", F.col("x.labels").alias("label"), (F.col("rank") + 1).alias("rank"), r6("x.probs").alias("prob"))


@query(f"""with {EV}, {NX}, {SP}, labels as (select distinct next_task as label from tn), cs as (select task_name as context, next_task as label from tn union all select context_2, next_task from tn where context_2 is not null),
    grid as (select context, label from (select distinct context from cs) cross join labels),
    md as (select context, label, row_number() over (partition by context order by p desc, label) as r, p from (select g.context, g.label, (coalesce(c, 0) + 1.0) / (sum(coalesce(c, 0)) over (partition by g.context) + count(*) over (partition by g.context)) as p
        from grid g left join (select context, label, count(*) as c from cs group by all) c using (context, label))),
    pv as (select vl.*, case when context_2 in (select context from md) then context_2 else task_name end as context from vl)
    select case_id, event_seq, label as y_pred, round(p, 6) as prob, case when pv.context = task_name then 1 else 2 end as depth from pv join md on md.context = pv.context and r = 1""")
def back_off_predictions(spark, d):
    train, val = halves(L1(spark, d), 2)
    out = pr.predict_distribution(val, pr.next_event_distribution(train, 2), 2)
    return out.select("case_id", "event_seq", F.col("labels")[0].alias("y_pred"), r6(F.col("probs")[0]).alias("prob"), "depth")


@query(f"""with {EV}, {NX}, {SP}, {DI} select case_id, event_seq, r as rank, label, round(p, 6) as prob from pv join md on md.context = pv.context and r <= 3""")
def top3_predictions(spark, d):
    return pr.predict_topk(predictions(L1(spark, d)), 3).withColumn("prob", r6("prob"))


@query(f"""with {EV}, {NX}, {SP}, {DI}, tm as (select task_name, exp(avg(dt_log)) - 1 as s from tn group by 1) select case_id, event_seq, r as rank, label, round(coalesce(s, (select exp(avg(dt_log)) - 1 from tn)) / 3600, 6) as next_dt_hours
    from pv join md on md.context = pv.context and r <= 2 left join tm using (task_name)""")
def top2_predictions_with_waits(spark, d):
    """The two likeliest next tasks and the hours until then, over prefixes whose activities are all known."""
    log = L1(spark, d)
    train, _ = halves(log)
    pr.require_known(log.select(F.array("task_name").alias("tasks")), ft.label_dictionary(log, "task_name"))
    return pr.predict_topk(predictions(log), 2, pr.time_to_next(train)).select("case_id", "event_seq", "rank", "label", r6("next_dt_hours").alias("next_dt_hours"))


@query(f"with {EV}, {NX}, {SP} select task_name, round(avg(dt_log), 6) as mean_dt_log, round(exp(avg(dt_log)) - 1, 3) as seconds from tn group by 1")
def mean_time_to_next(spark, d):
    return pr.time_to_next(halves(L1(spark, d))[0]).select("task_name", r6("mean_dt_log").alias("mean_dt_log"), F.round("seconds", 3).alias("seconds"))


@query(f"with {EV}, {NX}, {SP} select task_name, round(quantile_cont(dt_log, 0.1), 6) as q10, round(quantile_cont(dt_log, 0.5), 6) as q50, round(quantile_cont(dt_log, 0.9), 6) as q90 from tn group by 1")
def time_quantiles(spark, d):
    out = pr.time_quantiles(halves(L1(spark, d))[0])
    return out.select("task_name", *(r6(F.col("quantiles")[k]).alias(n) for k, n in enumerate(("q10", "q50", "q90"))))


@query(f"""with {EV}, {NX}, {SP}, {DI}, tm as (select task_name as context, exp(avg(dt_log)) - 1 as dt from tn group by 1),
    lt as (select case_id, arg_max(task_name, (ts, event_seq)) as last from ev group by 1),
    s1 as (select case_id, last as a, label as b, ln(p) as lp, dt, row_number() over (partition by case_id order by round(ln(p), 9) desc, concat(last, '>', label)) as r from lt join md on md.context = last and md.r <= 2 join tm on tm.context = last),
    s1b as (select *, max(a = b and r = 1) over (partition by case_id) as done from s1 where r <= 2),
    s2 as (select case_id, a, b, label as c, lp + ln(p) as lp, s1b.dt + tm.dt as dt, row_number() over (partition by case_id order by round(lp + ln(p), 9) desc, concat(a, '>', b, '>', label)) as r from s1b join md on md.context = b and md.r <= 2 join tm on tm.context = b where not done),
    al as (select case_id, b as tasks, lp, dt from s1b where done union all select case_id, concat(b, '>', c), lp, dt from s2 where r <= 2)
    select case_id, tasks, round(lp, 6) as log_prob, round(exp(lp) / sum(exp(lp)) over (partition by case_id), 6) as prob, round(dt, 3) as total_dt_s from al""")
def predicted_suffixes(spark, d):
    """Two steps with two beams over every case."""
    log = L1(spark, d)
    train, _ = halves(log)
    out = pr.predict_suffix(pr.last_tasks(log), pr.next_event_distribution(train), pr.time_to_next(train), beam=2, max_steps=2)
    return out.select("case_id", F.array_join("tasks", ">").alias("tasks"), r6("log_prob").alias("log_prob"), r6("prob").alias("prob"), F.round("total_dt_s", 3).alias("total_dt_s"))


def _suffixes(log):
    """Five beams of up to twenty steps, the operator's defaults."""
    train, _ = halves(log)
    return pr.predict_suffix(pr.last_tasks(log), pr.next_event_distribution(train), pr.time_to_next(train))


#: Beams of five, up to twenty steps from each case's last task, by the distributions of order 1 (bm); those that are finished, and the shares of a case (al).
BM = """
tm as (select task_name as context, exp(avg(dt_log)) - 1 as w from tn group by 1), kc as (select distinct context from pb),
lt as (select case_id, arg_max(task_name, (ts, event_seq)) as b from ev group by 1),
bm as (select case_id, [b] as seq, 0.0::double as lp, 0.0::double as dt, 0 as step, false as done from lt
    union all select case_id, seq, lp, dt, step, max(r = 1 and seq[-1] = seq[-2]) over (partition by case_id) as done
        from (select s.case_id, list_append(seq, label) as seq, lp + ln(p) as lp, dt + coalesce(w, 0) as dt, step + 1 as step,
            row_number() over (partition by s.case_id order by round(lp + ln(p), 9) desc, array_to_string(list_append(seq, label), '>')) as r
            from bm s left join kc on kc.context = seq[-1] join md on md.context = coalesce(kc.context, '') and md.r <= 5 left join tm on tm.context = seq[-1] where not done and step < 20) where r <= 5),
al as (select *, exp(lp) / sum(exp(lp)) over (partition by case_id) as prob from bm where done or step = 20)"""


@query(f"""with recursive {EV}, {NX}, {SP}, {DI}, {BM} select case_id, array_to_string(seq[2:], '>') as tasks, round(lp, 6) as log_prob, round(prob, 6) as prob, round(dt, 3) as total_dt_s from al""")
def predicted_suffixes_full(spark, d):
    """The whole continuations; `predicted_suffixes` holds two steps."""
    out = _suffixes(L1(spark, d))
    return out.select("case_id", F.array_join("tasks", ">").alias("tasks"), r6("log_prob").alias("log_prob"), r6("prob").alias("prob"), F.round("total_dt_s", 3).alias("total_dt_s"))


#: A trie of order 2 with back-off: distributions of its contexts over all labels, the five likeliest and the context after each.
CT = """
cn as (select ctx, label, count(*) as c from (select []::varchar[] as ctx, next_task as label from tn union all select [task_name], next_task from tn union all select [prev_task, task_name], next_task from tn where prev_task is not null) group by all),
nu as (select *, sum(c) over (partition by ctx) as n, count(*) over (partition by ctx) as u from cn),
kn as (select distinct ctx, n, u from nu),
d0 as (select ctx, label, (c + 1.0) / (n + u) as p from nu where len(ctx) = 0),
d1 as (select k.ctx, d0.label, coalesce((c - 0.5) / k.n, 0) + 0.5 * k.u / k.n * d0.p as p from kn k cross join d0 left join cn on cn.ctx = k.ctx and cn.label = d0.label where len(k.ctx) = 1),
d2 as (select k.ctx, d1.label, coalesce((c - 0.5) / k.n, 0) + 0.5 * k.u / k.n * d1.p as p from kn k join d1 on d1.ctx = k.ctx[2:] left join cn on cn.ctx = k.ctx and cn.label = d1.label where len(k.ctx) = 2),
mt as (select *, row_number() over (partition by ctx order by round(p, 9) desc, label) as r from (select * from d0 union all select * from d1 union all select * from d2))"""
_NODE = "case when two.ctx is not null then two.ctx when one.ctx is not null then one.ctx else []::varchar[] end"


@query(f"""with {EV}, {NX}, {SP}, {CT} select array_to_string(ctx, '>') as context, label, r as rank, round(p, 6) as prob from mt where r <= 5""")
def context_predictions(spark, d):
    """The five likeliest next tasks of every context of at most two tasks."""
    train = pr.labelled(pr.paths(ft.split_cases(L1(spark, d)), 2)).filter("split = 'train'")
    best = pr.likeliest(pr.context_trie(train, 2), 5, 2)
    return best.select(F.array_join("context", ">").alias("context"), F.posexplode("best").alias("rank", "x")).select("context", "x.label", (F.col("rank") + 1).alias("rank"), r6("x.p").alias("prob"))


@query(f"""with recursive {EV}, {NX}, {SP}, {CT}, wt as (select task_name, exp(avg(dt_log)) - 1 as w from tn group by 1),
    lt as (select case_id, arg_max(task_name, (ts, event_seq)) as b, arg_max(prev_task, (ts, event_seq)) filter (where prev_task is not null) as a, count(*) as n from nx group by 1),
    bm as (select case_id, {_NODE} as node, [b] as seq, 0.0::double as lp, 0.0::double as dt, 0 as step, false as done from lt left join kn two on lt.n > 1 and two.ctx = [a, b] left join kn one on one.ctx = [b]
        union all select case_id, node, seq, lp, dt, step, max(r = 1 and seq[-1] = seq[-2]) over (partition by case_id) as done
            from (select s.case_id, {_NODE} as node, list_append(seq, label) as seq, lp + ln(p) as lp, dt + coalesce(w, 0) as dt, step + 1 as step,
                row_number() over (partition by s.case_id order by round(lp + ln(p), 9) desc, array_to_string(list_append(seq, label), '>')) as r
                from bm s join mt on mt.ctx = s.node and mt.r <= 5 left join wt on wt.task_name = seq[-1] left join kn two on two.ctx = [seq[-1], label] left join kn one on one.ctx = [label] where not done and step < 20) where r <= 5)
    select case_id, array_to_string(seq[2:], '>') as tasks, round(lp, 5) as log_prob, round(exp(lp) / sum(exp(lp)) over (partition by case_id), 6) as prob, round(dt, 2) as total_dt_s from bm where done or step = 20""")
def suffixes_of_prefixes(spark, d):
    """Five beams of up to twenty steps from the whole prefix of every case."""
    log = L1(spark, d)
    train = pr.labelled(pr.paths(ft.split_cases(log), 2)).filter("split = 'train'")
    whole = log.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "event_seq", "task_name"))), lambda e: e["task_name"]).alias("tasks"))
    out = pr.predict_suffix_of_prefix(whole, pr.context_trie(train, 2), pr.time_to_next(train), order=2)
    return out.select("case_id", F.array_join("tasks", ">").alias("tasks"), F.round("log_prob", 5).alias("log_prob"), r6("prob").alias("prob"), F.round("total_dt_s", 2).alias("total_dt_s"))


@query(f"with {EV}, {NX} select case_id, event_seq from nx where k <= 3")
def truncated_prefixes(spark, d):
    return pr.truncate_prefix(L1(spark, d), 3).select("case_id", "event_seq")


@query()
def classifier_predictions(spark, d):
    """Multinomial regression on the last four tasks, resource, calendar features and amount."""
    log = ft.drop_terminal(ft.with_next(pr.earlier_tasks(ft.cyclic(ft.calendar(ft.split_cases(L1(spark, d)))))))
    log = scratch.cut(log.select("case_id", "event_seq", "split", "task_name", "next_task", "resource", "amount", "task_1", "task_2", "task_3", *ft.CYCLIC))  # fitting reads it several times
    model = pr.next_event_classifier(log.filter("split = 'train'"), ["dow_sin", "dow_cos", "hod_sin", "hod_cos", "amount"], ("task_1", "task_2", "task_3"))
    return model.transform(log.filter("split = 'val'")).select("case_id", "event_seq", "next_task", "label", "prediction")


# ---------------------------------------------------------------- quality of predictions

_RANKING = """avg((y_pred = y_true)::int) as accuracy, avg((rank = 1)::int) as top_1, avg((rank <= 3)::int) as top_3, avg((rank <= 5)::int) as top_5, avg(1.0 / rank) as mrr, avg(-ln(p_true)) as cross_entropy"""
_NAMES = ("accuracy", "top_1", "top_3", "top_5", "mrr", "cross_entropy")
_RANK_SQL = f"with {EV}, {NX}, {SP}, {DI}, x as (select {_RANKING}, count(*) as n from rk) select {', '.join(f'round({c}, 6) as {c}' for c in _NAMES)}, n from x"
query(_RANK_SQL, "ranking_metrics")(lambda s, d: mt.ranking_metrics(predictions(L1(s, d))).select(*(r6(c).alias(c) for c in _NAMES), "n"))
query(_RANK_SQL.replace(EV, LI), "ranking_metrics_lineitem")(lambda s, d: mt.ranking_metrics(predictions(L2(s, d))).select(*(r6(c).alias(c) for c in _NAMES), "n"))
query(f"with {LI}, {NX}, {SP}, {DI} select y_true, y_pred, count(*) as n from rk group by all", "confusion_matrix")(lambda s, d: mt.confusion_matrix(predicted_cells(L2(s, d)), "c"))
PC = """
pc as (select name, coalesce(hits / nullif(said, 0), 0) as pr, coalesce(hits / nullif(support, 0), 0) as rc, support from (select name, count(*) filter (where y_true = name) as support,
    count(*) filter (where y_pred = name) as said, count(*) filter (where y_pred = name and y_true = name) as hits from (select distinct task_name as name from ev) cross join rk group by 1)),
pf as (select *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) as f1 from pc)"""


def _classes(s, d):
    log = L2(s, d)
    return mt.per_class_metrics(mt.confusion_matrix(predicted_cells(log), "c"), ft.label_dictionary(log, "task_name"))


query(f"with {LI}, {NX}, {SP}, {DI}, {PC} select name, round(pr, 6) as precision, round(rc, 6) as recall, round(f1, 6) as f1, support from pf", "per_class_metrics")(lambda s, d: _classes(s, d).select("name", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support"))
query(f"with {LI}, {NX}, {SP}, {DI}, {PC} select round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1 from pf", "f1_scores")(lambda s, d: mt.f1_scores(_classes(s, d)).select(r6("macro_f1").alias("macro_f1"), r6("weighted_f1").alias("weighted_f1")))


@query(f"""with {LI}, {NX}, {SP}, {DI}, t as (select y_true as k, count(*) as t from rk group by 1), p as (select y_pred as k, count(*) as p from rk group by 1),
    z as (select sum(coalesce(t, 0) * coalesce(p, 0)) as tp, sum(coalesce(t, 0) * coalesce(t, 0)) as tt, sum(coalesce(p, 0) * coalesce(p, 0)) as pp from t full join p using (k)),
    w as (select count(*)::double as s, count(*) filter (where y_true = y_pred) as c from rk) select round((c * s - tp) / (sqrt(s * s - pp) * sqrt(s * s - tt)), 6) as mcc from z cross join w""")
def matthews_corrcoef(spark, d):
    return mt.matthews_corrcoef(mt.confusion_matrix(predicted_cells(L2(spark, d)), "c")).select(r6("mcc").alias("mcc"))


query(f"""with {LI}, {NX}, {SP}, {DI}, b as (select ceil(conf * 15) as bin, count(*) as n, avg((y_pred = y_true)::int) as acc, avg(conf) as conf from rk group by 1)
    select round(sum(n * abs(acc - conf)) / sum(n), 6) as ece from b""", "expected_calibration_error")(lambda s, d: mt.expected_calibration_error(predictions(L2(s, d))).select(r6("ece").alias("ece")))


@query(f"""with {EV}, {NX}, {SP}, {_BASE}, {DI} select round(a - markov_accuracy, 6) as lift_over_markov, round(a - most_common_accuracy, 6) as lift_over_most_common
    from bl cross join (select avg((y_pred = y_true)::int) as a from rk)""")
def lift_over_baselines(spark, d):
    log = L1(spark, d)
    base = pr.evaluate_baselines(*halves(log)).crossJoin(F.broadcast(mt.ranking_metrics(predictions(log)).select("accuracy")))  # one row each
    return mt.lift(base).select(r6("lift_over_markov").alias("lift_over_markov"), r6("lift_over_most_common").alias("lift_over_most_common"))


@query(f"""with {EV}, {NX}, {SP}, {DI}, ts as (select unnest([0.5, 1.0, 2.0]) as t), z as (select context, t, sum(exp(ln(p) / t)) as z from md cross join ts group by all)
    select t as temperature, round(avg(-ln(exp(ln(m.p) / t) / z)), 6) as nll from pv join md m on m.context = pv.context and m.label = pv.next_task join z on z.context = pv.context group by 1""")
def temperature_grid(spark, d):
    return mt.negative_log_likelihoods(predicted_cells(L1(spark, d)), [0.5, 1.0, 2.0], "c").withColumn("nll", r6("nll"))


def _temperature_sql(rounds=3):
    """Refined grids of 17 temperatures, around the best of the one before."""
    out = ["g0 as (select ln(0.05) as lo, ln(20.0) as hi)"]
    for k in range(rounds):
        out.append(f"t{k} as (select exp(lo + (hi - lo) * unnest(range(17)) / 16) as t from g{k})")
        out.append(f"z{k} as (select context, t, sum(exp(ln(p) / t)) as z from md cross join t{k} group by all)")
        out.append(f"n{k} as (select t, avg(-ln(exp(ln(m.p) / t) / z)) as nll from pv join md m on m.context = pv.context and m.label = pv.next_task join z{k} z on z.context = pv.context group by 1)")
        out.append(f"b{k} as (select arg_min(t, nll) as t from n{k})")
        out.append(f"g{k + 1} as (select ln(t) - (hi - lo) / 16 as lo, ln(t) + (hi - lo) / 16 as hi from b{k} cross join g{k})")
    return ", ".join(out) + f" select round(t, 5) as temperature from b{rounds - 1}"


@query(f"with {EV}, {NX}, {SP}, {DI}, {_temperature_sql()}")
def fitted_temperature(spark, d):
    return spark.createDataFrame([(mt.fit_temperature(predicted_cells(L1(spark, d)), weight="c"),)], "t double").select(F.round("t", 5).alias("temperature"))


@query(f"""with {EV}, {NX}, {SP}, {DI}, cw as (select next_task as name, (select count(*) from tn)::double / ((select count(distinct next_task) from tn) * count(*)) as w from tn group by 1),
    tm as (select task_name, avg(dt_log) as m from tn group by 1), x as (select -ln(p_true) as l, coalesce(w, 1.0) as w, (m - dt_log) ** 2 as e from rk join vl using (case_id, event_seq) join tm using (task_name) left join cw on cw.name = y_true)
    select round(sum(l * w) / sum(w) filter (where l is not null), 6) as cross_entropy, round(avg(e), 6) as dt_mse, round(sum(l * w) / sum(w) filter (where l is not null) + 0.25 * avg(e), 6) as loss from x""")
def combined_loss(spark, d):
    log = L1(spark, d)
    train, _ = halves(log)
    names = train.select(F.col("next_task").alias("id"), F.col("next_task").alias("name")).distinct()
    said = predictions(log).join(pr.time_to_next(train).select("task_name", F.col("mean_dt_log").alias("dt_pred")), "task_name")
    out = mt.combined_loss(said, ft.class_weights(train, "next_task", names), 0.25)
    return out.select(*(r6(c).alias(c) for c in ("cross_entropy", "dt_mse", "loss")))


@query()
def bootstrap_intervals(spark, d):
    return mt.bootstrap_ci(predictions(L1(spark, d)))


TQ = "tq as (select task_name, avg(dt_log) as m, quantile_cont(dt_log, [0.1, 0.5, 0.9]) as q from tn group by 1)"


@query(f"with {EV}, {NX}, {SP}, {TQ} select round(avg(abs((exp(m) - 1) - (exp(dt_log) - 1))) / 3600, 6) as mae_hours from vl join tq using (task_name)")
def time_error(spark, d):
    train, val = halves(L1(spark, d))
    return mt.dt_mae_hours(val.join(pr.time_to_next(train).select("task_name", F.col("mean_dt_log").alias("dt_pred")), "task_name")).select(r6("mae_hours").alias("mae_hours"))


@query()
def boosted_time_error(spark, d):
    """Mean absolute error in hours of boosted trees on the validation half, beside that of the mean per task."""
    log = L1(spark, d)
    both = ft.create_features(ft.split_cases(log))
    both = scratch.cut(both.select("split", "task_name", "dt_log", *(f"feat_{c}" for c in ft.FEATURES)))  # fitting reads it several times
    train, val = both.filter("split = 'train'"), both.filter("split = 'val'")
    trees = mt.dt_mae_hours(pr.boosted_time_to_next(train).transform(val)).select(F.lit("boosted trees").alias("model"), "mae_hours")
    means = mt.dt_mae_hours(val.join(pr.time_to_next(train).select("task_name", F.col("mean_dt_log").alias("dt_pred")), "task_name")).select(F.lit("mean per task").alias("model"), "mae_hours")
    return trees.unionByName(means).select("model", r6("mae_hours").alias("mae_hours"))


@query(f"""with {EV}, {NX}, {SP}, {TQ} select round(avg((greatest(0.1 * (dt_log - q[1]), -0.9 * (dt_log - q[1])) + greatest(0.5 * (dt_log - q[2]), -0.5 * (dt_log - q[2])) + greatest(0.9 * (dt_log - q[3]), -0.1 * (dt_log - q[3]))) / 3), 6) as pinball,
    round(avg((dt_log between q[1] and q[3])::int), 6) as coverage, round(avg(exp(q[3]) - exp(q[1])) / 3600, 6) as width_hours from vl join tq using (task_name)""")
def time_quantile_metrics(spark, d):
    train, val = halves(L1(spark, d))
    out = mt.quantile_metrics(val.join(pr.time_quantiles(train), "task_name"), (0.1, 0.5, 0.9))
    return out.select(*(r6(c).alias(c) for c in out.columns))


# ----------------------------------------------------------------------- cases

RW = f"rw as (select src, tgt, resource, {MEAN} / 3600 as m, count(*) as n from tr group by all), tw as (select src, tgt, {MEAN} / 3600 as m, count(*) as n from tr group by all)"
query(f"with {EV}, {TR}, {RW} select src, tgt, resource, round(m, 6) as mean_h, n from rw", "resource_wait_table")(lambda s, d: cs.resource_wait_table(tr.transitions(L1(s, d))).withColumn("mean_h", r6("mean_h")))
query(f"with {LI}, {TR}, {RW} select src, tgt, round(m, 6) as mean_h, n from tw", "transition_wait_table")(lambda s, d: cs.transition_wait_table(tr.transitions(L2(s, d))).withColumn("mean_h", r6("mean_h")))
WI = """
wi as (select tr.case_id, tr.event_seq, tr.src, tr.tgt, tr.resource, case when tr.resource = 'r1' then 'r99' when tr.resource = 'r2' then 'r3' else tr.resource end as cf, wait_h from tr),
wf as (select case_id, event_seq, wi.src, wi.tgt, wi.resource, cf, wait_h, coalesce(rw.m, tw.m, wait_h) as cw, rw.m is null as fb from wi left join rw on rw.src = wi.src and rw.tgt = wi.tgt and rw.resource = cf left join tw on tw.src = wi.src and tw.tgt = wi.tgt)"""
_WF = WI.replace("when tr.resource = 'r1' then 'r99' ", "")
query(f"with {EV}, {TR}, {RW}, {_WF} select case_id, event_seq, cf as cf_resource, round(cw, 6) as cf_wait_h, round(cw - wait_h, 6) as delta_h, fb as fallback from wf", "whatif_events")(
    lambda s, d: cs.whatif_events(tr.transitions(L1(s, d)), "r2", "r3").select("case_id", "event_seq", "cf_resource", r6("cf_wait_h").alias("cf_wait_h"), r6("delta_h").alias("delta_h"), "fallback")
)
query(
    f"with {EV}, {TR}, {RW}, {WI.replace(chr(39) + 'r2' + chr(39) + ' then ' + chr(39) + 'r3' + chr(39), chr(39) + 'r1' + chr(39) + ' then ' + chr(39) + 'r99' + chr(39))} select case_id, round(sum(wait_h), 6) as actual_h, round(sum(cw), 6) as counterfactual_h, count(*) filter (where fb) as fallbacks from wf group by 1",
    "whatif_summary",
)(lambda s, d: cs.whatif_summary(cs.whatif_events(tr.transitions(L1(s, d)), "r1", "r99")).select("case_id", r6("actual_h").alias("actual_h"), r6("counterfactual_h").alias("counterfactual_h"), "fallbacks"))


@query(f"""with {EV}, {TR}, {RW} select a.resource as swap_from, b.resource as swap_to, sum(a.n) as support, round(sum(a.n * (b.m - a.m)), 5) as delta_h from rw a join rw b using (src, tgt)
    where a.resource <> b.resource and a.n >= 2 and b.n >= 2 group by 1, 2""")
def swap_candidates(spark, d):
    return cs.swap_candidates(tr.transitions(L1(spark, d))).withColumn("delta_h", F.round("delta_h", 5))


@query(f"""with {LI}, {TR}, {RW}, pr as (select a.resource as swap_from, b.resource as swap_to, sum(a.n) as support, sum(a.n * (b.m - a.m)) as delta_h from rw a join rw b using (src, tgt)
    where a.resource <> b.resource and a.n >= 2 and b.n >= 2 group by 1, 2)
    select swap_from, row_number() over (partition by swap_from order by round(delta_h, 9), swap_to) as rank, swap_to, cast(support as bigint) as support, round(delta_h, 5) as delta_h from pr qualify rank <= 3""")
def best_swaps(spark, d):
    return cs.best_swaps(tr.transitions(L2(spark, d)), 3).withColumn("delta_h", F.round("delta_h", 5))


@query(f"""with {EV}, {NX}, {SP}, {MK}, bk as (select case_id, event_seq, next_task, 0 as d, task_name as task from nx union all
    select case_id, event_seq, next_task, 1, lag(task_name, 1) over w from nx window w as (partition by case_id order by ts, event_seq) union all
    select case_id, event_seq, next_task, 2, lag(task_name, 2) over w from nx window w as (partition by case_id order by ts, event_seq)),
    sn as (select * from bk where task is not null), jt as (select d, task, next_task, count(*) as c from sn where next_task is not null group by all),
    wg as (select d, task, next_task as y_pred, greatest(ln(c * sum(c) over (partition by d) / (sum(c) over (partition by d, task) * sum(c) over (partition by d, next_task))), 0) as pmi from jt),
    ot as (select sn.case_id, sn.event_seq, guess as y_pred, sn.d, sn.task, pmi / sum(pmi) over (partition by sn.case_id, sn.event_seq) as weight
        from sn join pm on pm.case_id = sn.case_id and pm.event_seq = sn.event_seq join wg on wg.d = sn.d and wg.task = sn.task and wg.y_pred = pm.guess where pmi > 0)
    select case_id, event_seq, y_pred, d, task, round(weight, 6) as weight from ot""")
def explained_predictions(spark, d):
    log = L1(spark, d)
    train, val = halves(log)
    said = pr.predict_markov(val, pr.fit_markov(train), pr.fit_most_common(train)).withColumn("y_pred", F.col("markov"))
    return cs.explain_case(log, said, look_back=3).select("case_id", "event_seq", "y_pred", "d", "task", r6("weight").alias("weight"))


@query(f"""with {EV}, {NX}, {SP}, {DI}, bk as (select case_id, event_seq, next_task, 0 as d, task_name as task from nx union all
    select case_id, event_seq, next_task, 1, lag(task_name, 1) over w from nx window w as (partition by case_id order by ts, event_seq) union all
    select case_id, event_seq, next_task, 2, lag(task_name, 2) over w from nx window w as (partition by case_id order by ts, event_seq)),
    sn as (select * from bk where task is not null), jt as (select d, task, next_task, count(*) as c from sn where next_task is not null group by all),
    wg as (select d, task, next_task as y_pred, greatest(ln(c * sum(c) over (partition by d) / (sum(c) over (partition by d, task) * sum(c) over (partition by d, next_task))), 0) as pmi from jt),
    ot as (select sn.case_id, sn.event_seq, y_true, rk.y_pred, conf, sn.d, sn.task, pmi / sum(pmi) over (partition by sn.case_id, sn.event_seq) as weight
        from sn join rk on rk.case_id = sn.case_id and rk.event_seq = sn.event_seq join wg on wg.d = sn.d and wg.task = sn.task and wg.y_pred = rk.y_pred where pmi > 0)
    select case_id, event_seq, y_true, y_pred, round(conf, 6) as prob, d, task, round(weight, 6) as weight from ot""")
def explained_cases(spark, d):
    """With what did follow, and the probability that the model gave its prediction."""
    log = L1(spark, d)
    said = predictions(log).select("case_id", "event_seq", F.col("labels")[0].alias("y_pred"), F.col("probs")[0].alias("prob"))
    return cs.explain_case(log, said, look_back=3).select("case_id", "event_seq", "y_true", "y_pred", r6("prob").alias("prob"), "d", "task", r6("weight").alias("weight"))


@query(f"""with {EV}, {TR}, {RW}, us as (select resource, count(*) as u from tr group by 1), ef as (select resource, case when u <= (select avg(u) from us) then 1.0 else greatest(0, 1 - 0.1 * (u / (select avg(u) from us) - 1)) end as e from us),
    sc as (select src, tgt, resource, e - m as score from rw join ef using (resource)) select src, tgt, resource, round(score, 6) as score from sc qualify row_number() over (partition by src order by round(score, 9) desc, tgt, resource) = 1""")
def resource_policy(spark, d):
    return cs.resource_policy(tr.transitions(L1(spark, d))).withColumn("score", r6("score"))


_Q2 = f"""with {EV}, {TR}, {RW}, q0 as (select src, tgt, resource, -m as r, -m as q from rw),
    q1 as (select a.src, a.tgt, a.resource, a.r, a.r + 0.9 * coalesce(b, 0) as q from q0 a left join (select src, max(q) as b from q0 group by 1) x on x.src = a.tgt),
    q2 as (select a.src, a.tgt, a.resource, a.r, a.r + 0.9 * coalesce(b, 0) as q from q0 a left join (select src, max(q) as b from q1 group by 1) x on x.src = a.tgt)"""


@query(f"{_Q2} select src, tgt, resource, round(q, 6) as q from q2")
def offline_q(spark, d):
    return cs.offline_q(tr.transitions(L1(spark, d)), iterations=2).withColumn("q", r6("q"))


@query(f"""{_Q2},
    q3 as (select a.src, a.tgt, a.resource, a.r, a.r + 0.9 * coalesce(b, 0) as q from q0 a left join (select src, max(q) as b from q2 group by 1) x on x.src = a.tgt) select src, tgt, resource, round(q, 6) as q from q3""")
def offline_q_full(spark, d):
    """With the operator's default of iterations; `offline_q` holds two."""
    return cs.offline_q(tr.transitions(L1(spark, d))).withColumn("q", r6("q"))


# ------------------------------------------------------------------------ runs


def _metric_rows(spark, d, logs=((L1, "a"), (L2, "b"), (L3, "c"))):
    """Baseline metrics of several logs as runs, in nested form first."""
    rows = [pr.evaluate_baselines(*halves(f(spark, d))).select(F.lit(k).alias("run_id"), F.lit("baselines").alias("stage"), F.struct("most_common_accuracy", "markov_accuracy").alias("accuracy"), "num_val_events", "most_common_label") for f, k in logs]
    return rn.flatten_metrics(reduce(DataFrame.unionByName, rows))


def _bl(sql, key):
    return f"(with {sql}, {NX}, {SP}, {_BASE} select '{key}' as run_id, unnest(['accuracy.most_common_accuracy', 'accuracy.markov_accuracy', 'num_val_events']) as metric_path, unnest([most_common_accuracy, markov_accuracy, num_val_events::double]) as value from bl)"


MR = f"mr as ({_bl(EV, 'a')} union all {_bl(LI, 'b')} union all {_bl(CO, 'c')})"
query(f"with {MR} select run_id, 'baselines' as stage, metric_path, round(value, 6) as value from mr", "flattened_metrics")(lambda s, d: _metric_rows(s, d).select("run_id", "stage", "metric_path", r6("value").alias("value")))


@query(f"""with {EV}, {TR}, x as (select concat(src, ' → ', tgt, ' v1.0') as move, count(*) as n, {MEAN} as m, max(amount) as top from tr group by src, tgt)
    select 'a' as run_id, 'waits' as stage, unnest([concat('moves.', move, '.n'), concat('moves.', move, '.wait.mean'), concat('moves.', move, '.wait.top amount')]) as metric_path, unnest([n::double, round(m, 6), round(top, 6)]) as value, unnest([true, false, false]) as whole from x
    union all select 'a', 'waits', 'total', count(*)::double, true from tr""")
def flattened_documents(spark, d):
    """A JSON document whose keys are names from the log, with blanks and dots in them, as metric rows."""
    trans = tr.transitions(L1(spark, d))
    of = trans.groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("n"), tr.mean_wait().alias("m"), F.max("amount").alias("top"))
    wait = F.struct(r6("m").alias("mean"), r6("top").alias("top amount"), F.array("n").alias("list"), F.lit(True).alias("flag"))
    entry = F.struct(F.concat_ws("", "src", F.lit(" → "), "tgt", F.lit(" v1.0")), F.struct("n", wait.alias("wait"), F.lit("text").alias("note")))
    doc = of.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("moves"), F.sum("n").alias("total"))).alias("doc"))  # an entry a transition
    return rn.flatten_documents(doc.select(F.lit("a").alias("run_id"), F.lit("waits").alias("stage"), "doc")).select("run_id", "stage", "metric_path", r6("value").alias("value"), "whole")


@query(f"""with {MR}, a as (select * from mr where run_id = 'a'), b as (select * from mr where run_id = 'b' and metric_path <> 'num_val_events')
    select metric_path, case when a.value is null then 'added' when b.value is null then 'removed' else 'changed' end as status, round(b.value - a.value, 6) as delta, round(100 * (b.value - a.value) / abs(a.value), 4) as percent
    from a full join b using (metric_path) where a.value is null or b.value is null or abs(a.value - b.value) > 1e-9""")
def run_differences(spark, d):
    m = _metric_rows(spark, d, ((L1, "a"), (L2, "b")))
    out = rn.diff_runs(m.filter("run_id = 'a'"), m.filter("run_id = 'b' and metric_path <> 'num_val_events'"))
    return out.select("metric_path", "status", r6("delta").alias("delta"), F.round("percent", 4).alias("percent"))


@query(f"""with a as (select task, cluster from (with {EV}, {TR} select src as task, count(*) % 3 as cluster from tr group by 1)), b as (select task, cluster from (with {EV_CUT}, {TR} select src as task, count(*) % 3 as cluster from tr group by 1))
    select task, a.cluster as a, b.cluster as b from a full join b using (task) where a.cluster is distinct from b.cluster""")
def cluster_differences(spark, d):
    groups = lambda log: tr.transitions(log).groupBy(F.col("src").alias("task")).agg((F.count(F.lit(1)) % 3).alias("cluster"))
    return rn.diff_clusters(groups(L1(spark, d)), groups(ev.drop_last_events(L1(spark, d))))


query(f"with {MR} select metric_path, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, round(min(value), 6) as min, round(max(value), 6) as max, count(*) as n from mr group by 1", "seed_variance")(lambda s, d: rn.seed_variance(_metric_rows(s, d)).select("metric_path", *(r6(c).alias(c) for c in ("mean", "std", "min", "max")), "n"))


query(f"with {MR} select metric_path, string_agg(cast(cast(round(value * 10000) as bigint) as varchar), ',' order by run_id) as values from mr group by 1", "seed_values")(
    lambda s, d: rn.seed_variance(_metric_rows(s, d)).select("metric_path", F.array_join(F.transform("values", lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("values"))
)


def _facts(log, key):
    """One nested row about a log: text, a list, booleans."""
    told = log.agg(F.mode("task_name", True).alias("top"), F.collect_set("task_name").alias("tasks"), (F.count_distinct("resource") > 1).alias("several"), (F.min("amount") >= 0).alias("paid"))
    return told.select(F.lit(key).alias("run_id"), F.lit("facts").alias("stage"), F.struct("top", "tasks").alias("task"), "several", *(["paid"] if key == "a" else []))


_FACT = "select mode_task as top, (select count(distinct task_name) from ev) as tasks, (select count(distinct resource) > 1 from ev) as several from (select task_name as mode_task from ev group by 1 order by count(*) desc, 1 limit 1)"


@query(f"""with a as (select * from (with {EV} {_FACT})), b as (select * from (with {CO} {_FACT})), p as (select (select min(amount) >= 0 from (with {EV} select amount from ev)) as paid),
    l as (select unnest(['task.top', 'task.tasks', 'several']) as metric_path, unnest([a.top, a.tasks::varchar, a.several::varchar]) as a, unnest([b.top, b.tasks::varchar, b.several::varchar]) as b from a cross join b)
    select metric_path, 'changed' as status, a, b from l where a <> b union all select 'paid', 'removed', paid::varchar, null from p""")
def run_value_differences(spark, d):
    """Text, list lengths and booleans of two runs; one leaf is in the first alone."""
    return rn.diff_values(rn.flatten_values(_facts(L1(spark, d), "a")), rn.flatten_values(_facts(L3(spark, d), "b"))).drop("stage")


@query(f"with {MR} select run_id, 'baselines' as stage, metric_path, round(value, 6) as value from mr")
def written_metrics(spark, d):
    """Metrics appended as JSON, a folder per run and stage, and read back."""
    path = scratch.place(spark, "metrics")
    for run in "abc":
        ev.write_metrics(_metric_rows(spark, d).filter(F.col("run_id") == run).drop("whole"), path)
    return spark.read.schema("run_id string, stage string, metric_path string, value double").json(path).withColumn("value", r6("value"))


@query(f"with {MR} select run_id, round(max(value) filter (where metric_path = 'accuracy.markov_accuracy'), 6) as markov_accuracy, round(max(value) filter (where metric_path = 'accuracy.markov_accuracy') + 1, 6) as other_accuracy, null::double as absent from mr group by 1")
def leaderboard(spark, d):
    """Two stages that hold metrics of the same name, and one that no run has."""
    rows = _metric_rows(spark, d)
    other = rows.withColumn("stage", F.lit("other")).withColumn("value", F.col("value") + 1)
    out = rn.leaderboard(rows.unionByName(other), [("baselines", "accuracy.markov_accuracy"), ("other", "accuracy.markov_accuracy"), ("baselines", "absent")])
    return out.toDF("run_id", "markov_accuracy", "other_accuracy", "absent").select("run_id", *(r6(c).alias(c) for c in ("markov_accuracy", "other_accuracy", "absent")))


@query(f"""with {MR} select a.metric_path, round(abs(b.value - a.value), 6) as drift, coalesce(abs(b.value - a.value) <= case when a.metric_path = 'num_val_events' then 5 else 0.1 end, false) as ok from (select * from mr where run_id = 'a') a left join (select * from mr where run_id = 'b') b using (metric_path)""")
def drift_check(spark, d):
    m = _metric_rows(spark, d, ((L1, "a"), (L2, "b")))
    return rn.drift_check(m.filter("run_id = 'b'"), m.filter("run_id = 'a'")).select("metric_path", r6("drift").alias("drift"), "ok")


# ------------------------------------------------------------------- streaming


@query(f"with {EV}, {TR} select epoch_us(time_bucket(interval 1 day, ts)) as start_us, src, tgt, round({MEAN}, 6) as mean_s, count(*) as n from tr group by all")
def windowed_bottlenecks(spark, d):
    """The streaming aggregate, run on the whole table."""
    from tracemill.streaming.streams import windowed_bottlenecks as windowed

    return windowed(tr.transitions(L1(spark, d))).select(F.unix_micros("start").alias("start_us"), "src", "tgt", r6("mean_s").alias("mean_s"), "n")


@query(f"with {EV}, {TR} select case_id, src, tgt, round(wait_s, 6) as wait_s, false as late from tr")
def streamed_transitions(spark, d):
    """The log written to a folder in two parts, of which the second fills gaps of the first, read as a stream file by file, and the transitions that stand."""
    from tracemill.streaming.streams import settled_transitions, streaming_transitions

    log, source, sink = L1(spark, d), scratch.place(spark, "stream"), scratch.place(spark, "moves")
    early = F.pmod(F.xxhash64("event_seq"), F.lit(3)) > 0
    log.withColumn("part", F.when(early, 0).otherwise(1)).write.partitionBy("part").parquet(source)
    for part in (0, 1):
        stream = streaming_transitions(spark.readStream.schema(log.schema).parquet(f"{source}/part={part}"), "1000 days", initial=log.filter(early) if part else None)
        stream.writeStream.format("parquet").option("path", f"{sink}/{part}").option("checkpointLocation", scratch.place(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    changes = reduce(DataFrame.unionByName, [spark.read.schema(stream.schema).parquet(f"{sink}/{part}") for part in (0, 1)])
    return settled_transitions(changes).select("case_id", "src", "tgt", r6("wait_s").alias("wait_s"), "late")


# --------------------------------------------------------------------- reports

_SIDE = "arg_{0}({{'value': value, 'mean_h': mean_h, 'n': n}}, (round(mean_h, 9), value))"
_REPORT = f"""with {EV}, {TR}, {ST}, {DG}, o as (select src, tgt, feature, max(mean_h) - min(mean_h) as spread, {_SIDE.format("max")} as worst, {_SIDE.format("min")} as best from dg group by all having count(*) >= 2)
    select src, tgt, row_number() over (partition by src, tgt order by round(spread, 9) desc, feature) as rank,
    printf('| %s → %s | %s | %.2f | %s (%.2f h, n=%d) | %s (%.2f h, n=%d) |', src, tgt, feature, spread, worst.value, worst.mean_h, worst.n, best.value, best.mean_h, best.n) as line from o"""
_SWAPS = f"with {EV}, {TR}, {RW}, {_WF} select case_id, event_seq, printf('| %s → %s | %s → %s | %.2f | %.2f | %+.2f |', src, tgt, resource, cf, wait_h, cw, cw - wait_h) as line from wf"
query(_REPORT, "driver_report")(lambda s, d: an.driver_report(an.drivers(tr.transitions(L1(s, d)))))
query(_SWAPS, "whatif_report")(lambda s, d: cs.whatif_report(cs.whatif_events(tr.transitions(L1(s, d)), "r2", "r3")))
query(f"""with recursive {EV}, {NX}, {SP}, {DI}, {BM} select case_id, printf('| %s | %.4f | %.2f h |', array_to_string(seq[2:], ' → '), prob, dt / 3600) as line from al""", "suffix_report")(lambda s, d: cs.suffix_report(_suffixes(L1(s, d))))
