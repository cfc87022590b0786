"""Contracts of operators on small hand-made logs."""

import gzip
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.functions import features as ft
from tracemill.operators import analysis as an
from tracemill.operators import cases as cs
from tracemill.operators import conformance as cf
from tracemill.operators import metrics as mt
from tracemill.operators import pairs
from tracemill.operators import predict as pr
from tracemill.operators import runs as rn
from tracemill.operators import transitions as tr
from tracemill.sources import eventlog as ev
from tracemill.sources import scratch

SCHEMA = "case_id string, task_name string, timestamp string, resource string, amount double, event_seq long"


def log_of(spark, cases, resource="r"):
    """cases: case id to a string of one-letter tasks, an hour apart."""
    rows = [(c, t, f"2026-01-01 {k:02d}:00:00", resource, 1.0 * k, k) for c, tasks in cases.items() for k, t in enumerate(tasks)]
    return ev.canonical(spark.createDataFrame(rows, SCHEMA))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_aliases_and_bad_times(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("case:concept:name,case:id,concept:name,time:timestamp,org:resource,case:Amount\nc1,x,A,2026-01-01 00:00:00,bob,5\nc1,x,B,nonsense,bob,5\nc1,x,C,2026-01-01T02:00:00.500+00:00,,7\n")
    log = ev.read_event_log(spark, str(path))
    got = [(r.case_id, r.task_name, r.resource, r.amount) for r in log.orderBy("timestamp").collect()]
    assert got == [("c1", "A", "bob", 5.0), ("c1", "C", None, 7.0)]
    assert log.columns == ["case_id", "task_name", "timestamp", "resource", "amount", "event_seq"]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="Missing column case_id"):
        ev.canonical(spark.createDataFrame([(1,)], "foo int"))


XES = """<?xml version="1.0"?><log><trace><string key="concept:name" value="c1"/><float key="Amount" value="12.5"/>
<event><string key="concept:name" value="A"/><string key="org:resource" value="bob"/><date key="time:timestamp" value="2026-01-01T00:00:00.000+00:00"/></event>
<event><string key="concept:name" value="B"/><date key="time:timestamp" value="2026-01-01T01:00:00+00:00"/></event></trace></log>"""


@pytest.mark.parametrize("packed", [False, True])
def test_xes(spark, tmp_path, packed):
    path = tmp_path / ("log.xes.gz" if packed else "log.xes")
    path.write_bytes(gzip.compress(XES.encode()) if packed else XES.encode())
    log = ev.read_event_log(spark, str(path))
    assert [(r.case_id, r.task_name, r.resource, r.amount, r.event_seq) for r in log.orderBy("event_seq").collect()] == [("c1", "A", "bob", 12.5, 0), ("c1", "B", "unknown", 12.5, 1)]


def test_single_events_ties_and_negative_waits(spark):
    log = log_of(spark, {"one": "A", "two": "AB"}).withColumn("timestamp", F.lit("2026-01-01").cast("timestamp"))
    assert rows(tr.transitions(log).select("case_id", "src", "tgt", "wait_s")) == [("two", "A", "B", 0.0)]
    assert rows(tr.event_graph_edges(log)) == [("two", 0, 1)]


def test_prefix_count_and_splits(spark):
    log = ft.split_cases(log_of(spark, {f"c{k}": "ABCAB"[: 1 + k % 5] for k in range(40)}))
    n = tr.prefixes(log).count()
    assert n == sum(max(0, k % 5) for k in range(40))
    both = log.groupBy("case_id").agg(F.count_distinct("split").alias("n"))
    assert both.filter("n > 1").isEmpty() and log.filter("split = 'val'").select("case_id").distinct().count() == 8
    for frac, mode in ((0, "case"), (1, "case"), (0.2, "other")):
        with pytest.raises(ValueError):
            ft.split_cases(log.drop("split"), mode, frac)


def test_quartiles_collapse(spark):
    df = spark.createDataFrame([(1.0,)] * 5, "amount double")
    assert {r.amount_bucket for r in ft.amount_quartile(df).collect()} == {"all"}


def test_two_cliques(spark):
    clique = lambda names: [(a, b, 1) for a, b in itertools.permutations(names, 2)]
    edges = clique("abcd") + clique("wxyz") + [("d", "w", 1)]
    got = {r.task: r.cluster for r in an.spectral_clusters(spark.createDataFrame(edges, "src string, tgt string, weight int")).collect()}
    assert len({got[t] for t in "abcd"}) == 1 and len({got[t] for t in "wxyz"}) == 1 and got["a"] != got["z"]


def test_markov_on_a_chain_and_an_unseen_task(spark):
    chain = pr.labelled(log_of(spark, {f"c{k}": "ABABAB" for k in range(5)}))
    out = pr.evaluate_baselines(chain, chain).first()
    assert out.markov_accuracy == 1.0 and out.markov_coverage == 1.0
    other = pr.labelled(log_of(spark, {"v": "ABX", "w": "XBA"}))
    assert pr.evaluate_baselines(chain, other.filter("task_name in ('A', 'X')")).first().markov_coverage == 0.5


def test_metrics_closed_forms(spark):
    df = spark.createDataFrame([("a", ["a", "b", "c"], [1.0, 0.0, 0.0]), ("b", ["a", "b", "c"], [0.6, 0.3, 0.1]), ("c", ["a", "b", "c"], [0.5, 0.3, 0.2])], "y_true string, labels array<string>, probs array<double>")
    m = mt.ranking_metrics(df).first()
    assert m.accuracy == pytest.approx(1 / 3) and m.top_3 == 1.0 and m.mrr == pytest.approx((1 + 1 / 2 + 1 / 3) / 3)
    assert mt.ranking_metrics(df.limit(0)).first().accuracy == 0.0
    sure = df.filter("y_true = 'a'")
    assert mt.expected_calibration_error(sure).first().ece == 0.0
    ci = {r.metric: (r.low, r.high) for r in mt.bootstrap_ci(df, 100).collect()}
    assert ci["accuracy"][0] <= 1 / 3 <= ci["accuracy"][1]


def test_temperature_finds_the_overconfidence(spark):
    over = [("a", ["a", "b"], [0.99, 0.01])] * 8 + [("b", ["a", "b"], [0.99, 0.01])] * 2
    t = mt.fit_temperature(spark.createDataFrame(over, "y_true string, labels array<string>, probs array<double>"))
    assert t == pytest.approx(4.595 / 1.386, rel=0.1)


def test_pinball(spark):
    df = spark.createDataFrame([(1.0, [1.0, 1.0, 1.0])], "dt_log double, quantiles array<double>")
    m = mt.quantile_metrics(df, (0.1, 0.5, 0.9)).first()
    assert m.pinball == 0 and m.coverage == 1 and m.width_hours == 0
    with pytest.raises(ValueError):
        pr.time_quantiles(df, (0.5, 0.5))


def test_whatif(spark):
    rows_ = [("c1", "A", "2026-01-01 00:00:00", "al", 1.0, 0), ("c1", "B", "2026-01-01 04:00:00", "al", 1.0, 1), ("c2", "A", "2026-01-01 00:00:00", "bo", 1.0, 0), ("c2", "B", "2026-01-01 01:00:00", "bo", 1.0, 1)]
    trans = tr.transitions(ev.canonical(spark.createDataFrame(rows_, SCHEMA)))
    out = {r.case_id: r for r in cs.whatif_events(trans, "al", "bo").collect()}
    assert out["c1"].cf_resource == "bo" and out["c1"].delta_h == -3.0 and not out["c1"].fallback and out["c2"].delta_h == 0.0
    assert cs.whatif_events(trans, "al", "nobody").filter("fallback").count() == 1
    some = spark.createDataFrame([("c1",), ("c9",)], "case_id string")
    assert cs.whatif_events(trans, "al", "bo", some.limit(1)).count() == 1
    with pytest.raises(ValueError, match="Unknown cases: c9"):
        cs.whatif_events(trans, "al", "bo", some)
    with pytest.raises(ValueError):
        ev.filter_case(trans, "none")


def test_suffixes(spark):
    train = pr.labelled(pr.contexts(log_of(spark, {f"c{k}": "ABCD" for k in range(5)}), 1))
    model, times = pr.next_event_distribution(train, alpha=0.01), pr.time_to_next(train)
    cases = spark.createDataFrame([("x", "A")], "case_id string, last string")
    greedy = pr.predict_suffix(cases, model, times, beam=1, max_steps=3).collect()
    assert greedy[0].tasks == ["B", "C", "D"] and greedy[0].prob == 1.0
    wide = pr.predict_suffix(cases, model, times, beam=3, max_steps=2).collect()
    assert sum(r.prob for r in wide) == pytest.approx(1.0)
    long = pr.predict_suffix(cases, model, times, beam=1, max_steps=7, stop_on_self_loop=False).collect()
    assert long[0].tasks[:3] == ["B", "C", "D"] and len(long[0].tasks) == 7
    for beam, steps in ((0, 1), (1, -1)):
        with pytest.raises(ValueError):
            pr.predict_suffix(cases, model, times, beam, steps)


def test_conformance(spark):
    good, odd = log_of(spark, {"a": "ABC", "b": "ABC"}), log_of(spark, {"a": "ABC", "c": "ACB"})
    model = cf.discover_dfg(good)
    assert cf.log_fitness(cf.replay_traces(good, model)).first().fitness == 1.0
    r = {x.case_id: x.fit for x in cf.replay_traces(odd, model).collect()}
    assert r == {"a": True, "c": False}
    assert cf.conformance_summary(good, model).first().f_score == 1.0
    net = spark.createDataFrame([("A", "p0", "in"), ("A", "p1", "out"), ("B", "p1", "in"), ("B", "p2", "out"), ("C", "p2", "in"), ("C", "p3", "out")], "transition string, place string, kind string")
    fits = {"".join(x.tasks): x.fitness for x in cf.token_replay(odd, net, ["p0"], ["p3"]).collect()}
    assert fits["ABC"] == 1.0 and fits["ACB"] < 1.0


def test_policy_and_q(spark):
    rows_ = [(f"c{k}", t, f"2026-01-01 {h:02d}:00:00", res, 1.0, j) for k in range(4) for res, w in (("fast", 1),) for j, (t, h) in enumerate((("A", 0), ("B", w)))]
    rows_ += [(f"s{k}", t, f"2026-01-01 {h:02d}:00:00", "slow", 1.0, j) for k in range(4) for j, (t, h) in enumerate((("A", 0), ("B", 9)))]
    trans = tr.transitions(ev.canonical(spark.createDataFrame(rows_, SCHEMA)))
    assert rows(cs.resource_policy(trans).select("src", "resource")) == [("A", "fast")]
    assert rows(cs.offline_q(trans).select("resource", "q")) == [("fast", -1.0), ("slow", -9.0)]


def test_runs(spark):
    a = spark.createDataFrame([("r", "s", "x", 1.0), ("r", "s", "y", 2.0)], "run_id string, stage string, metric_path string, value double")
    b = spark.createDataFrame([("q", "s", "x", 1.5), ("q", "s", "z", 2.0)], "run_id string, stage string, metric_path string, value double")
    assert {(r.metric_path, r.status) for r in rn.diff_runs(a, b).collect()} == {("x", "changed"), ("y", "removed"), ("z", "added")}
    assert {r.metric_path: (r.mean, r.n) for r in rn.seed_variance(a.union(b)).collect()} == {"x": (1.25, 2)}
    nested = spark.createDataFrame([("r", "s", (1.5, (2,), "t", [1], True))], "run_id string, stage string, m struct<a: double, `b c`: struct<d: int>, t: string, l: array<int>, f: boolean>")
    assert {(r.metric_path, r.value) for r in rn.flatten_metrics(nested).collect()} == {("m.a", 1.5), ("m.b c.d", 2.0)}
    assert {r.metric_path: r.ok for r in rn.drift_check(b, a).collect()} == {"x": False, "y": False}


def test_explanations_never_look_ahead(spark):
    log = log_of(spark, {"a": "ABCD", "b": "ABCD", "c": "BACD"})
    said = log.select("case_id", "event_seq", F.lit("C").alias("y_pred"))
    out = cs.explain_case(log, said).collect()
    assert out and all(r.d >= 0 and r.d <= r.event_seq for r in out)
    totals = {}
    for r in out:
        totals[r.case_id, r.event_seq] = totals.get((r.case_id, r.event_seq), 0) + r.weight
    assert all(t == pytest.approx(1.0) for t in totals.values())


def test_features_on_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0)], "a double, b double")
    assert rows(ft.l2_normalize(df, ["a", "b"]).select("feat_a", "feat_b")) == [(0.0, 0.0), (0.6, 0.8)]
    same = spark.createDataFrame([(5.0,), (5.0,)], "a double")
    assert {r.feat_a for r in ft.apply_minmax(same, ft.fit_minmax(same, ["a"]), ["a"]).collect()} == {0.0}


def test_classifier(spark):
    log = ft.drop_terminal(ft.with_next(log_of(spark, {f"c{k}": "ABAB" for k in range(10)})))
    assert pr.next_event_classifier(log, ["amount"]).transform(log).filter("label <> prediction").count() == 0


def test_registered_suffixes_are_whole(spark, tiny, monkeypatch):
    from tracemill.plans import catalog

    asked = []
    whole, boot = pr.predict_suffix, mt.bootstrap_ci
    monkeypatch.setattr(pr, "predict_suffix", lambda *a, **k: asked.append((a[3:], k)) or whole(*a[:3], beam=1, max_steps=1))
    monkeypatch.setattr(mt, "bootstrap_ci", lambda *a, **k: asked.append((a[1:], k)) or boot(*a[:1], 2))
    for name in ("suffix_report", "bootstrap_intervals", "predicted_suffixes_full"):
        catalog.QUERIES[name](spark, tiny)
    assert asked == [((), {})] * 3  # the operators' defaults


def test_classifier_weighs_classes_and_sees_earlier_tasks(spark):
    case = lambda i, *tasks: [(f"c{i}", t, k, "r", 0.0, k) for k, t in enumerate(tasks)]
    skewed = [e for i in range(40) for e in case(i, "a", "x" if i % 8 else "y")]
    log = spark.createDataFrame(skewed, "case_id string, task_name string, timestamp int, resource string, amount double, event_seq long")
    log = pr.labelled(log.withColumn("timestamp", log.timestamp.cast("timestamp")))
    model = pr.next_event_classifier(log, ["amount"])
    p = model.transform(log).first().probability
    assert abs(p[0] - p[1]) < 0.05  # 35 against 5 rows, equal by weight
    history = [e for i in range(20) for e in case(i, *(("p", "m", "x") if i % 2 else ("q", "m", "y")))]
    log = spark.createDataFrame(history, "case_id string, task_name string, timestamp int, resource string, amount double, event_seq long")
    log = pr.labelled(pr.earlier_tasks(log.withColumn("timestamp", log.timestamp.cast("timestamp")), 1)).filter("task_name = 'm'")
    out = pr.next_event_classifier(log, ["amount"], ("task_1",)).transform(log)
    assert out.filter("label <> prediction").count() == 0


def plans_of(df):
    return df._jdf.queryExecution().toString()


def test_no_window_sees_all_rows(spark, tiny):
    log = ev.events_log(spark, tiny)
    asked = [ft.split_cases(log), ft.split_cases(log, "temporal"), ft.encode_log(log), ft.amount_quartile(log), an.long_cases(an.cycle_times(log)), pr.time_quantiles(pr.labelled(log))]
    for df in asked:
        for line in plans_of(df).splitlines():  # Window [functions], [partition keys], [order]
            assert not re.search(r"Window \[.*\], \[[^\[\]]*(ASC|DESC)[^\[\]]*\]$", line) or re.search(r"\], \[[^\[\]]+\], \[", line), line


def test_numbers_and_quantiles_by_ranges(spark):
    import random

    import numpy as np

    rng = random.Random(3)
    values = [rng.choice([0.0, 1.5, -2.25, rng.uniform(-9, 9)]) for _ in range(700)]
    df = spark.createDataFrame([(v, f"k{i % 3}") for i, v in enumerate(values)] + [(None, "k0"), (None, "none")], "v double, k string").repartition(7)
    qs = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    assert scratch.exact_quantiles(df, "v", qs).first().quantiles == pytest.approx(np.quantile(values, qs).tolist())
    got = {r.k: r.quantiles for r in scratch.exact_quantiles(df, "v", qs, ("k",)).collect()}
    assert set(got) == {"k0", "k1", "k2"}
    for k in range(3):
        assert got[f"k{k}"] == pytest.approx(np.quantile(values[k::3], qs).tolist())
    assert scratch.exact_quantiles(df.limit(0), "v", [0.5]).first().quantiles == [None]
    for n, accuracy in ((2, 50), (51, 50), (5000, 50), (40_000, 500)):  # sketches that keep all and few values
        many = spark.range(n).select(F.expr("pow(pmod(xxhash64(id), 100003) / 1000, 3)").alias("v"), (F.col("id") % 2).alias("k")).repartition(5)
        seen = {0: [], 1: []}
        for r in many.collect():
            seen[r.k].append(r.v)
        assert scratch.exact_quantiles(many, "v", qs, accuracy=accuracy).first().quantiles == pytest.approx(np.quantile(seen[0] + seen[1], qs).tolist())
        for r in scratch.exact_quantiles(many, "v", qs, ("k",), accuracy).collect():
            assert r.quantiles == pytest.approx(np.quantile(seen[r.k], qs).tolist())
    odd = spark.createDataFrame([(x,) for x in [float("nan")] * 3 + [float("inf"), float("-inf"), 1.0, 2.0]], "v double")
    got = scratch.exact_quantiles(odd, "v", [0.0, 1 / 6, 0.5, 1.0]).first().quantiles
    assert got[:3] == [float("-inf"), 1.0, float("inf")] and got[3] != got[3]
    ids = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    assert sorted((r.x, r.n) for r in scratch.numbered(ids, F.col("x")).collect()) == [(i, i) for i in range(1000)]
    assert sorted((r.x, r.n) for r in scratch.numbered(ids, F.col("x").desc()).collect()) == [(i, 999 - i) for i in range(1000)]
    assert scratch.numbered(ids.limit(0), F.col("x")).collect() == []


def test_split_takes_the_first_hashes(spark):
    import hashlib

    for n in (1, 2, 7, 300):
        log = log_of(spark, {f"c{k}": "A" for k in range(n)})
        order = sorted((hashlib.md5(f"c{k}:42".encode()).hexdigest(), f"c{k}") for k in range(n))
        want = {c for _, c in order[: max(1, round(n * 0.2))]}
        assert {r.case_id for r in ft.split_cases(log).filter("split = 'val'").collect()} == want


def test_unknown_activities_and_empty_prefixes(spark):
    names = spark.createDataFrame([(0, "A"), (1, "B")], "id int, name string")
    asked = lambda *x: spark.createDataFrame([(t,) for t in x], "tasks array<string>")
    assert pr.require_known(asked(["A"], ["A", "B"]), names).count() == 2
    with pytest.raises(ValueError, match="Unknown activities: X"):
        pr.require_known(asked(["A"], ["A", "X"]), names)
    for empty in ([], None):
        with pytest.raises(ValueError, match="empty prefix"):
            pr.require_known(asked(["A"], empty), names)


def test_padding(spark):
    log = log_of(spark, {"a": "ABCD"})
    names = ft.label_dictionary(log, "task_name")
    full = {r.k: (r.padded, r.length, r.padded_vectors) for r in tr.pad_prefixes(tr.prefixes(log, continuous=["amount"]), names).collect()}
    assert full == {1: ([1, 0, 0], 1, [[0.0], [0.0], [0.0]]), 2: ([1, 2, 0], 2, [[0.0], [1.0], [0.0]]), 3: ([1, 2, 3], 3, [[0.0], [1.0], [2.0]])}
    short = {r.k: (r.padded, r.length, r.padded_resources) for r in tr.pad_prefixes(tr.prefixes(log), names, 2, ft.label_dictionary(log, "resource")).collect()}
    assert short == {1: ([1, 0], 1, [1, 0]), 2: ([1, 2], 2, [1, 1]), 3: ([2, 3], 2, [1, 1])}
    assert tr.pad_prefixes(tr.prefixes(log.limit(0)), names).collect() == []


def test_differences_of_text_lists_and_booleans(spark):
    schema = "run_id string, stage string, m struct<name: string, l: array<int>, ok: boolean, x: double>, only string"
    a = spark.createDataFrame([("r", "s", ("p", [1, 2], True, 1.0), "here")], schema)
    b = spark.createDataFrame([("q", "s", ("p", [3, 4, 5], False, 2.0), None)], schema)
    got = {r.metric_path: (r.status, r.a, r.b) for r in rn.diff_values(rn.flatten_values(a), rn.flatten_values(b)).collect()}
    assert got == {"m.l": ("changed", "2", "3"), "m.ok": ("changed", "true", "false"), "only": ("removed", "here", None)}
    other = b.withColumn("stage", F.lit("t"))
    assert {(r.stage, r.status) for r in rn.stages_of_one(a, other).collect()} == {("s", "removed"), ("t", "added")}


def test_metrics_are_written_by_run_and_stage(spark, tmp_path):
    import os

    rows_ = spark.createDataFrame([("r", "s", "x", 1.0), ("r", "t", "x", 2.0)], "run_id string, stage string, metric_path string, value double")
    ev.write_metrics(rows_, str(tmp_path / "m"))
    ev.write_metrics(rows_.filter("stage = 's'").withColumn("run_id", F.lit("q")), str(tmp_path / "m"))
    assert sorted(x for x in os.listdir(tmp_path / "m") if x.startswith("run_id")) == ["run_id=q", "run_id=r"]
    assert rows(spark.read.json(str(tmp_path / "m")).select("run_id", "stage", "value")) == [("q", "s", 1.0), ("r", "s", 1.0), ("r", "t", 2.0)]


def test_bootstrap_of_small_cells(spark):
    df = spark.createDataFrame([("a", ["a", "b"], [0.9, 0.1])] * 27 + [("b", ["a", "b"], [0.6, 0.4])] * 3, "y_true string, labels array<string>, probs array<double>")
    got = {r.metric: (r.low, r.high) for r in mt.bootstrap_ci(df, 400).collect()}
    assert set(got) == {"accuracy", "macro_f1", "top_3", "top_5", "mrr"}
    assert 0.72 < got["accuracy"][0] < 0.9 < got["accuracy"][1] <= 1.0 and got["top_3"] == got["top_5"] == (1.0, 1.0)
    assert got["macro_f1"][0] < 0.48 < got["macro_f1"][1] + 0.05 and got["mrr"][0] < 0.95 < got["mrr"][1]
    assert {(r.low, r.high) for r in mt.bootstrap_ci(df.limit(0), 20).collect()} == {(0.0, 0.0)}
    draws = spark.range(4000).select(mt._poisson(F.lit(3.0), (F.col("id") + 0.5) / 4000).alias("k")).agg(F.avg("k"), F.var_samp("k"), F.max("k")).first()
    assert draws[0] == pytest.approx(3.0, abs=0.02) and draws[1] == pytest.approx(3.0, abs=0.1) and draws[2] < 15


def test_combined_loss(spark):
    import math

    df = spark.createDataFrame([("a", ["a", "b"], [0.8, 0.2], 1.0, 1.5), ("b", ["a", "b"], [0.6, 0.4], 2.0, 2.0), ("z", ["a", "b"], [0.6, 0.4], 0.0, 0.0)], "y_true string, labels array<string>, probs array<double>, dt_log double, dt_pred double")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "name string, weight double")
    r = mt.combined_loss(df, weights, 0.5).first()
    assert r.cross_entropy == pytest.approx(-(math.log(0.8) + 3 * math.log(0.4)) / 4) and r.dt_mse == pytest.approx(0.25 / 3)
    assert r.loss == pytest.approx(r.cross_entropy + 0.5 * r.dt_mse)
    assert mt.combined_loss(df).first().loss == pytest.approx(-(math.log(0.8) + math.log(0.4)) / 2)


def _numpy_sides(edges, normalized=True):
    import numpy as np

    names = sorted({x for e in edges for x in e[:2]})
    at = {x: i for i, x in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    for x, y, w in edges:
        a[at[x], at[y]] += w / 2
        a[at[y], at[x]] += w / 2
    d = a.sum(axis=1)
    laplacian = np.eye(len(a)) - a / np.sqrt(d[:, None] * d) if normalized else np.diag(d) - a
    side = np.linalg.eigh(laplacian)[1][:, 1] >= 0
    return dict(zip(names, (side != side[0]).astype(int).tolist(), strict=True))


@pytest.mark.parametrize("normalized", [True, False])
def test_clusters_equal_those_of_a_dense_solver(spark, normalized):
    clique = lambda names: [(a, b, 5) for a, b in itertools.permutations(names, 2)]
    edges = clique("abcd") + clique("wxyz") + [("c", "x", 1), ("d", "d", 3)]
    got = an.spectral_clusters(spark.createDataFrame(edges, "src string, tgt string, weight int"), normalized=normalized)
    assert {r.task: r.cluster for r in got.collect()} == _numpy_sides(edges, normalized)


def test_three_thousand_tasks_cluster_in_spark(spark):
    import random

    rng = random.Random(5)
    side = lambda: rng.randrange(1500)
    edges = [(f"a{side():04d}", f"a{side():04d}", 1 + rng.randrange(5)) for _ in range(30_000)] + [(f"b{side():04d}", f"b{side():04d}", 1 + rng.randrange(5)) for _ in range(30_000)]
    edges += [(f"a{side():04d}", f"b{side():04d}", 1) for _ in range(300)]
    got = {r.task: r.cluster for r in an.spectral_clusters(spark.createDataFrame(edges, "src string, tgt string, weight int")).collect()}
    assert len(got) > 2900 and got == _numpy_sides(edges)


def test_the_scaled_vector_is_that_of_the_features(spark):
    log = log_of(spark, {"a": "BAC", "b": "AB"})
    out = ft.create_features(log)
    assert [c for c in out.columns if c.startswith("feat_")] == [f"feat_{c}" for c in ("task_id", "resource_id", "amount", "day_of_week", "hour_of_day")]
    assert {"dow_sin", "dow_cos", "hod_sin", "hod_cos"} <= set(out.columns)
    r = out.filter("case_id = 'a' and event_seq = 0").first()  # B on a Thursday at midnight, amount 0
    assert (r.feat_task_id, r.feat_resource_id, r.feat_amount, r.feat_hour_of_day) == (pytest.approx(1 / 10**0.5), 0.0, 0.0, 0.0) and r.feat_day_of_week == pytest.approx(3 / 10**0.5)
    both = ft.apply_minmax(out.drop(*[c for c in out.columns if c.startswith("feat_")]), ft.fit_minmax(out))
    assert {r.feat_resource_id for r in both.collect()} == {0.0} and {r.feat_task_id for r in both.collect()} == {0.0, 1.0}


def test_encoded_prefixes_equal_padded_ones(spark, tiny):
    log = ev.events_log(spark, tiny)
    tasks, who = ft.label_dictionary(log, "task_name"), ft.label_dictionary(log, "resource")
    columns = ["case_id", "k", "padded", "padded_resources", "padded_vectors", "length", "label", "dt"]
    a = tr.encoded_prefixes(log, tasks, 4, who, ["amount"]).select(columns)
    b = tr.pad_prefixes(tr.prefixes(log, continuous=["amount"]), tasks, 4, who).select(columns)
    assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()


@pytest.mark.parametrize("mean", [10.0, 37.0, 1e3, 1e6])
def test_poisson_numbers_of_any_mean(spark, mean):
    unit = lambda i: (F.pmod(F.xxhash64("id", i), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 2))
    k = spark.range(40_000).select(mt._poisson_by_rejection(F.lit(mean), unit).alias("k"))
    m, v, skew = k.agg(F.avg("k"), F.var_samp("k"), F.skewness("k")).first()
    assert m == pytest.approx(mean, abs=4 * (mean / 40_000) ** 0.5) and v == pytest.approx(mean, rel=0.04) and skew == pytest.approx(mean**-0.5, abs=0.05)
    if mean == 10.0:
        import math

        got = {r.k: r["count"] / 40_000 for r in k.groupBy("k").count().collect()}
        for i in range(4, 18):
            assert got.get(float(i), 0.0) == pytest.approx(math.exp(-10) * 10**i / math.factorial(i), abs=0.008)


def test_runs_by_stage_and_kind(spark):
    nested = spark.createDataFrame([("r", "s", (10, 0.5)), ("r", "t", (20, 0.9))], "run_id string, stage string, m struct<n: long, x: double>")
    flat = rn.flatten_metrics(nested)
    assert [tuple(r) for r in rn.leaderboard(flat, [("s", "m.n"), ("t", "m.n"), ("t", "m.y")]).collect()] == [("r", 10.0, 20.0, None)]
    pinned = rn.flatten_metrics(spark.createDataFrame([("p", "s", (14, 0.55)), ], nested.schema))
    assert {r.metric_path: r.ok for r in rn.drift_check(flat.filter("stage = 's'"), pinned).collect()} == {"m.n": True, "m.x": True}
    assert {r.metric_path: r.ok for r in rn.drift_check(flat.filter("stage = 't'"), pinned).collect()} == {"m.n": False, "m.x": False}
    own = pinned.withColumn("tolerance", F.when(F.col("metric_path") == "m.n", 2.0))
    assert {r.metric_path: r.ok for r in rn.drift_check(flat.filter("stage = 's'"), own).collect()} == {"m.n": False, "m.x": True}


def test_slow_transitions_without_drivers_stay(spark):
    rows_ = [(f"c{k}", t, f"2026-01-01 0{j}:00:00", "al", 1.0, j) for k in range(12) for j, t in enumerate("AB")]
    out = an.drivers(tr.transitions(ev.canonical(spark.createDataFrame(rows_, SCHEMA)))).collect()
    assert [(r.src, r.tgt, r.n_transitions, r.mean_wait_h, r.feature) for r in out] == [("A", "B", 12, 1.0, None)]


def test_suffixes_of_whole_prefixes(spark):
    """After A>X comes B, after C>X comes D: only a model that sees further than the last task knows."""
    train = pr.labelled(pr.paths(log_of(spark, {**{f"a{k}": "AXBB" for k in range(6)}, **{f"c{k}": "CXDD" for k in range(6)}}), 3))
    trie, times = pr.context_trie(train), pr.time_to_next(train)
    asked = spark.createDataFrame([("p", ["A", "X"]), ("q", ["C", "X"]), ("r", ["Z", "Z", "C", "X"]), ("s", ["new"])], "case_id string, tasks array<string>")
    out = pr.predict_suffix_of_prefix(asked, trie, times, beam=2)
    best = {r.case_id: r for r in out.orderBy("log_prob").collect()}
    assert best["p"].tasks == ["B", "B"] and best["q"].tasks == ["D", "D"] == best["r"].tasks and best["p"].total_dt_s == pytest.approx(7200)
    assert {r.case_id: r.p for r in out.groupBy("case_id").agg(F.sum("prob").alias("p")).collect()} == pytest.approx(dict.fromkeys("pqrs", 1.0))
    whole = trie.groupBy("context").agg(F.sum("p").alias("p"), (0.5 * F.first("u") / F.first("n")).alias("rest"), F.size(F.first("context")).alias("k")).collect()
    assert all(r.p <= 1 + 1e-9 and (r.k or abs(r.p - 1) < 1e-9) and 1 - r.p <= r.rest + 1e-9 for r in whole)
    assert [r.tasks for r in pr.predict_suffix_of_prefix(asked.filter("case_id = 'p'"), trie, times, beam=1, max_steps=0).collect()] == [[]]
    for empty in ([], None):
        with pytest.raises(ValueError, match="empty prefix"):
            pr.predict_suffix_of_prefix(spark.createDataFrame([("p", empty)], asked.schema), trie, times)
    with pytest.raises(ValueError):
        pr.predict_suffix_of_prefix(asked, trie, times, beam=0)


def test_a_giant_case_is_the_work_of_many_tasks(spark):
    """A million events in one case, beside small ones and a tie of two events."""
    n = 1_000_000
    one = spark.range(n).select(F.lit("all").alias("case_id"), F.concat(F.lit("t"), (F.col("id") * 7919 % 13).cast("string")).alias("task_name"), F.timestamp_seconds(F.col("id") * 3).alias("timestamp"), F.lit("r").alias("resource"), F.lit(1.0).alias("amount"), F.col("id").alias("event_seq"))
    small = spark.range(300).select(F.concat(F.lit("c"), (F.col("id") % 100).cast("string")).alias("case_id"), F.lit("s").alias("task_name"), F.timestamp_seconds(F.lit(7)).alias("timestamp"), F.lit("r").alias("resource"), F.lit(1.0).alias("amount"), F.col("id").alias("event_seq"))
    log = one.unionByName(small).repartition(8, F.col("event_seq") % 17)
    sizes = [r["count"] for r in scratch.in_ranges(log, "case_id", "timestamp", "event_seq").groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * n / 8
    got = tr.transitions(log, spread=True)
    assert got.count() == n - 1 + 200
    wrong = got.filter("case_id = 'all'").filter((F.col("wait_s") != 3) | (F.col("tgt") != F.concat(F.lit("t"), ((F.col("event_seq") + 1) * 7919 % 13).cast("string"))))
    assert wrong.isEmpty()
    edges = tr.event_graph_edges(log, spread=True)
    assert edges.filter("case_id = 'all'").agg(F.count_distinct("src_idx"), F.min("src_idx"), F.max("dst_idx"), F.max(F.col("dst_idx") - F.col("src_idx"))).first()[:] == (n - 1, 0, n - 1, 1)
    inner = scratch.in_ranges(log, "case_id", "timestamp", "event_seq")
    assert inner.groupBy("case_id", "_part").count().agg(F.max("count")).first()[0] < 2 * n / 8


def test_spread_gives_the_same_rows(spark, tiny):
    log = ev.events_log(spark, tiny)
    for f in (tr.transitions, pr.labelled, tr.indexed, tr.event_graph_edges, ft.encode_log):
        a, b = f(log), f(log, spread=True)
        b = b.select(a.columns)
        assert a.count() == b.count() and a.exceptAll(b).isEmpty(), f


def _replayed(variant, arcs, initial, final):
    """Replay with a dictionary as marking."""
    marking, produced, consumed, missing = {}, len(initial), 0, 0
    for p in initial:
        marking[p] = marking.get(p, 0) + 1
    for t in [*variant, None]:
        for p in final if t is None else [p for n, p, k in arcs if n == t and k == "in"]:
            consumed += 1
            missing += marking.get(p, 0) <= 0
            marking[p] = max(marking.get(p, 0) - 1, 0)
        for p in [] if t is None else [p for n, p, k in arcs if n == t and k == "out"]:
            marking[p] = marking.get(p, 0) + 1
            produced += 1
    left = sum(marking.values())
    return produced, consumed, missing, left, pytest.approx(0.5 * (1 - missing / max(consumed, 1)) + 0.5 * (1 - left / max(produced, 1)))


def test_token_replay_is_the_loop_over_a_marking(spark):
    log = log_of(spark, {f"c{k}": "".join("ABCX"[(k * 7 + j * j * (k + 3)) % 4] for j in range(1 + k % 9)) for k in range(60)})
    arcs = [("A", "p0", "in"), ("A", "p1", "out"), ("A", "p1", "out"), ("B", "p1", "in"), ("B", "p1", "in"), ("B", "p2", "out"), ("B", "p0", "out"), ("C", "p2", "in")]
    for net, first, last in ((arcs, ["p0", "p0"], ["p2", "p2"]), (arcs, [], []), ([], ["p0"], ["p1"]), ([], [], [])):
        table = spark.createDataFrame(net, "transition string, place string, kind string")
        got = cf.token_replay(log, table, first, last).collect()
        assert got and all((r.produced, r.consumed, r.missing, r.remaining, r.fitness) == _replayed(r.tasks, net, first, last) for r in got)
    assert "Python" not in cf.token_replay(log, table, first, last)._jdf.queryExecution().executedPlan().toString()
    assert cf.token_replay(log.limit(0), table, ["p0"], []).collect() == []


def test_boosted_trees_are_no_worse_than_means(spark):
    at = [(f"c{k}", t, f"2026-01-01 {0 if j == 0 else (1 if k % 2 else 9):02d}:00:00", "r", 5.0 if k % 2 else 900.0, j) for k in range(200) for j, t in enumerate("AB")]
    log = ev.canonical(spark.createDataFrame(at, SCHEMA))
    both = ft.create_features(ft.split_cases(log))
    train, val = both.filter("split = 'train'"), both.filter("split = 'val'")
    trees = mt.dt_mae_hours(pr.boosted_time_to_next(train).transform(val)).first().mae_hours
    means = mt.dt_mae_hours(val.join(pr.time_to_next(train).select("task_name", F.col("mean_dt_log").alias("dt_pred")), "task_name")).first().mae_hours
    assert trees < 0.5 * means
    with pytest.raises(ValueError):
        pr.boosted_time_to_next(train.limit(0))
    odd = val.withColumn("amount", F.lit(None).cast("double")).drop(*(c for c in val.columns if c.startswith("feat_")))
    assert pr.boosted_time_to_next(train).transform(ft.l2_normalize(odd)).filter("dt_pred is null").isEmpty()


def test_documents_with_keys_that_nobody_declared(spark):
    docs = [("a", "s", '{"Pay v1.0 now": {"n": 3, "mean": 2.5, "deep": {"x.y": {"z": -1}}}, "flag": true, "text": "7", "list": [1, {"n": 2}], "none": null, "empty": {}}'),
            ("b", "s", '{"other": {"n": 1e3}, "big": 9007199254740993, "large": 123456789012345678901234567890}'), ("c", "s", "not json"), ("d", "s", "5"), ("e", "s", None), ("f", "s", "[1]"), ("g", "s", "{}")]
    got = rn.flatten_documents(spark.createDataFrame(docs, "run_id string, stage string, doc string"))
    assert rows(got.select("run_id", "metric_path", "value", "whole")) == [
        ("a", "Pay v1.0 now.deep.x.y.z", -1.0, True), ("a", "Pay v1.0 now.mean", 2.5, False), ("a", "Pay v1.0 now.n", 3.0, True),
        ("b", "big", 9007199254740992.0, True), ("b", "large", 123456789012345678901234567890.0, False), ("b", "other.n", 1000.0, False)]
    assert got.filter("value = -1").first().keys_path == ["Pay v1.0 now", "deep", "x.y", "z"]
    assert rn.flatten_documents(spark.createDataFrame([], "run_id string, stage string, doc string")).collect() == []


def test_prefix_tree(spark):
    log = log_of(spark, {"1": "abc", "2": "abd", "3": "ab", "4": "b", "5": "ba"})
    got = sorted((r.k, r.task, r.visits, r.ends, "".join(sorted(r.children)), r.parent is None) for r in cf.prefix_tree(log).collect())
    assert got == [(1, "a", 3, 0, "b", True), (1, "b", 2, 1, "a", True), (2, "a", 1, 1, "", False), (2, "b", 3, 1, "cd", False), (3, "c", 1, 1, "", False), (3, "d", 1, 1, "", False)]
    assert cf.prefix_tree(log.limit(0)).count() == 0
    model = cf.discover_dfg(log_of(spark, {"1": "abc", "2": "bc", "3": "be"}))
    edges = sorted((r.k, r.task, r.step, r.kind, r.w) for r in cf.escaping_edges(cf.prefix_tree(log), model).collect())
    assert edges == [(1, "b", "a", "unmodelled", 1), (1, "b", "c", "escaping", 1), (1, "b", "e", "escaping", 1), (2, "b", "d", "unmodelled", 2), (2, "b", "e", "escaping", 2)]
    # enabled: a>b three times, b>c and b>e after "b" once and after "ab" twice; c is taken after "ab"
    assert cf.etc_precision(log, model).first().precision == pytest.approx(1 - 4 / 9)


def test_prefix_tree_tells_clashing_states(spark, monkeypatch):
    monkeypatch.setattr(cf.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    with pytest.raises(Exception, match="two prefixes share a state"):
        cf.prefix_tree(log_of(spark, {"1": "ab", "2": "ba"})).collect()


@pytest.mark.parametrize(("top", "first"), [(1, 1), (3, 2), (50, 1)])
def test_best_swaps_are_those_of_all_pairs(spark, top, first):
    """Ties and resources that share no transition among them; lists so short that the search goes on."""
    steps = [(f"s{i % 4}", f"t{i % 3}", f"r{i * 7 % 23}", float(i * i % 50)) for i in range(600)] + [("x", "y", "alone", 1.0)] * 2 + [("x", "z", r, 1.0) for r in ("p", "q", "o") for _ in range(2)]
    trans = spark.createDataFrame(steps, "src string, tgt string, resource string, wait_s double").withColumn("wait_s", F.col("wait_s") * 3600)
    want = {}
    for r in cs.swap_candidates(trans).collect():
        want.setdefault(r.swap_from, []).append((round(r.delta_h, 9), r.swap_to, r.support))
    want = sorted((a, k + 1, b, n) for a, found in want.items() for k, (_, b, n) in enumerate(sorted(found)[:top]))
    assert sorted((r.swap_from, r["rank"], r.swap_to, r.support) for r in cs.best_swaps(trans, top, first=first).collect()) == want


def test_best_swaps_stop_early(spark, monkeypatch):
    """Where one resource is fastest everywhere, nobody's whole list is met."""
    trans = spark.range(400).selectExpr("'a' src", "'b' tgt", "concat('r', lpad(id div 2, 3, '0')) resource", "3600.0D * (id div 2) wait_s")
    written = []
    cut = cs.cut
    monkeypatch.setattr(cs, "cut", lambda df: written.append(out := cut(df)) or out)
    found = cs.best_swaps(trans, 2)
    assert {(r.swap_from, r.swap_to) for r in found.filter("rank = 1 and delta_h < 0").collect()} == {(f"r{i:03}", "r000") for i in range(1, 200)}
    assert written[1].filter("sure").count() > 150  # in the first round, of lists of eight
    assert found.count() == 400


def test_best_swaps_where_lists_contradict_each_other(spark, monkeypatch):
    """Nobody is sure after the first lists: all pairs follow at once, as products of blocks, with sums as exact as those of pairs; copies tie by name."""
    steps = "'a' src, 'b' tgt, 3600.0D * (id div 4) wait_s", "'c' src, 'd' tgt, 3600.0D * (300 - id div 4) wait_s"
    halves = [spark.range(1200).selectExpr(*x.split(", ", 2)[:2], x.split(", ", 2)[2], "concat('r', lpad(id div 2, 3, '0')) resource") for x in steps]
    trans = halves[0].unionByName(halves[1])
    written = []
    cut = cs.cut
    monkeypatch.setattr(cs, "cut", lambda df: written.append(out := cut(df)) or out)
    monkeypatch.setattr(pairs, "BLOCK", 2 * 64)  # several blocks either way
    got = sorted((r.swap_from, r["rank"], r.swap_to, r.support, round(r.delta_h, 9)) for r in cs.best_swaps(trans, 3).collect())
    assert len(written) == 2
    want = {}
    for r in cs.swap_candidates(trans).collect():
        want.setdefault(r.swap_from, []).append((round(r.delta_h, 9), r.swap_to, r.support))
    assert got == sorted((a, k + 1, b, n, d) for a, found in want.items() for k, (d, b, n) in enumerate(sorted(found)[:3]))


def test_best_swaps_of_nothing(spark):
    assert cs.best_swaps(spark.createDataFrame([], "src string, tgt string, resource string, wait_s double")).count() == 0


_LONG = [("c", "A", "B", 1e12, 2.8e8)] * 20  # 2e19 microseconds in all, more than 64 bits hold


def _long_waits(spark):
    return spark.createDataFrame(_LONG, "case_id string, src string, tgt string, wait_s double, wait_h double")


def test_bottlenecks_of_long_waits(spark):
    assert [(r.mean_s, r.n) for r in an.bottlenecks(_long_waits(spark)).collect()] == [(1e12, 20)]


def test_rare_transitions_of_long_waits(spark):
    assert [r.mean_s for r in an.rare_transitions(an.bottlenecks(_long_waits(spark)), 20).collect()] == [1e12]


def test_transition_wait_table_of_long_waits(spark):
    assert [(r.mean_h, r.n) for r in cs.transition_wait_table(_long_waits(spark)).collect()] == [(pytest.approx(1e12 / 3600), 20)]


def test_analysis_summary_of_long_waits(spark):
    """A hundred cases of 280,000 years each."""
    log = spark.range(200).selectExpr("concat('c', id div 2) case_id", "if(id % 2 = 0, 'A', 'B') task_name", "timestamp_micros(if(id % 2 = 0, 0L, 200000000000000000L)) timestamp", "'r' resource", "1.0D amount", "id event_seq")
    got = an.analysis_summary(log, tr.transitions(log)).first()
    assert (got.total_traces, got.num_long_cases, got.num_rare_transitions) == (100, 0, 0)


def test_analysis_summary_takes_each_transition_once(spark):
    """As counted by the rows that a function in the transitions sees."""
    log = spark.range(600).selectExpr("concat('c', id div 3) case_id", "concat('T', id % 3) task_name", "timestamp_seconds(id * id) timestamp", "concat('r', id % 2) resource", "1.0D * id amount", "id event_seq")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return x

    trans = tr.transitions(log).withColumn("wait_s", watched.asNondeterministic()("wait_s"))
    got = an.analysis_summary(log, trans).first()
    assert (got.total_traces, got.num_long_cases, got.num_rare_transitions, got.num_deviant, len(got.drivers)) == (200, 10, 0, 0, 8)
    assert seen.value == 400


def test_quantiles_of_rows_that_come_in_another_order_each_time(spark):
    """As a shuffle may hand them over."""

    def unsteady(batches):
        rows = pa.Table.from_batches(list(batches))
        yield from rows.take(np.random.default_rng().permutation(rows.num_rows)).to_batches()

    df = spark.range(0, 400_000, 1, 2).selectExpr("cast(id as double) v").mapInArrow(unsteady, "v double")
    for _ in range(3):
        assert scratch.exact_quantiles(df, "v", [0.25, 0.5, 0.95], accuracy=500).first().quantiles == pytest.approx([399_999 * q for q in (0.25, 0.5, 0.95)], abs=1e-6)


def test_suffixes_are_made_once_per_last_task(spark):
    """Of a task that no model knows, and of null, too."""
    train = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "B")], "task_name string, next_task string").withColumn("context_1", F.col("task_name")).withColumn("dt_log", F.lit(1.0))
    cases = spark.createDataFrame([(f"c{i}", "AB?"[i % 3]) for i in range(300)], "case_id string, last string")
    cases = cases.withColumn("last", F.when(F.col("case_id") != "c299", F.translate("last", "?", "Z")))
    model, times = pr.next_event_distribution(train), pr.time_to_next(train)
    made = []
    cut = pr.cut
    pr.cut = lambda df: made.append(out := cut(df)) or out
    try:
        got = pr.predict_suffix(cases, model, times, beam=2, max_steps=3)
    finally:
        pr.cut = cut
    assert [x.count() for x in made] == [4] and got.select("case_id").distinct().count() == 300
    per = got.join(cases, "case_id").groupBy("last", "case_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("tasks", "prob")))).alias("x")).groupBy("last").agg(F.count_distinct("x").alias("n"))
    assert {r["last"]: r.n for r in per.collect()} == {"A": 1, "B": 1, "Z": 1, None: 1}
