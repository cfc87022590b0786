"""Conformance against directly-follows models, and replay on a given Petri net."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.features import with_next
from tracemill.operators.transitions import end_activities, start_activities, task_adjacency, transitions
from tracemill.sources.eventlog import in_case

START, END = "__start__", "__end__"


def variants(log: DataFrame) -> DataFrame:
    """(tasks, n, share): distinct task sequences."""
    seq = F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "event_seq", "task_name"))), lambda e: e["task_name"])
    out = log.groupBy("case_id").agg(seq.alias("tasks")).groupBy("tasks").agg(F.count(F.lit(1)).alias("n"))
    total = out.agg(F.sum("n").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("tasks", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def steps(log: DataFrame) -> DataFrame:
    """(case_id, src, tgt) with an artificial step into the first and out of the last task."""
    inner = transitions(log).select("case_id", "src", "tgt")
    ends = log.groupBy("case_id").agg(F.min_by("task_name", F.struct("timestamp", "event_seq")).alias("first"), F.max_by("task_name", F.struct("timestamp", "event_seq")).alias("last"))
    return inner.unionByName(ends.select("case_id", F.lit(START).alias("src"), F.col("first").alias("tgt"))).unionByName(ends.select("case_id", F.col("last").alias("src"), F.lit(END).alias("tgt")))


def discover_dfg(log: DataFrame, noise: float = 0.0) -> DataFrame:
    """(src, tgt, n): edges that occur at least `noise` times as often as their source's commonest edge."""
    edges = task_adjacency(transitions(log)).select("src", "tgt", F.col("weight").alias("n"))
    edges = edges.unionByName(start_activities(log).select(F.lit(START).alias("src"), F.col("task_name").alias("tgt"), "n")).unionByName(end_activities(log).select(F.col("task_name").alias("src"), F.lit(END).alias("tgt"), "n"))
    most = F.max("n").over(Window.partitionBy("src"))
    return edges.withColumn("most", most).filter(F.col("n") >= F.col("most") * noise).drop("most")


def footprints(model: DataFrame) -> DataFrame:
    """(a, b, relation) for all pairs of tasks: -> directly followed, <- the reverse, || both ways, # never."""
    real = model.filter((F.col("src") != START) & (F.col("tgt") != END)).select("src", "tgt")
    tasks = model.select(F.col("src").alias("t")).union(model.select("tgt")).filter(~F.col("t").isin(START, END)).distinct()
    pairs = tasks.select(F.col("t").alias("a")).crossJoin(F.broadcast(tasks.select(F.col("t").alias("b"))))  # tasks squared
    there = real.select(F.col("src").alias("a"), F.col("tgt").alias("b"), F.lit(True).alias("there"))
    back = real.select(F.col("tgt").alias("a"), F.col("src").alias("b"), F.lit(True).alias("back"))
    out = pairs.join(there, ["a", "b"], "left").join(back, ["a", "b"], "left")
    relation = F.when(F.col("there") & F.col("back"), "||").when(F.col("there"), "->").when(F.col("back"), "<-").otherwise("#")
    return out.select("a", "b", relation.alias("relation"))


def replay_traces(log: DataFrame, model: DataFrame) -> DataFrame:
    """(case_id, steps, allowed, fit): how many steps of each case the model has. The model may come from another log."""
    known = model.select("src", "tgt", F.lit(1).alias("ok"))
    found = steps(log).join(known, ["src", "tgt"], "left")
    return found.groupBy("case_id").agg(F.count(F.lit(1)).alias("steps"), F.count("ok").alias("allowed")).withColumn("fit", F.col("steps") == F.col("allowed"))


def log_fitness(replayed: DataFrame) -> DataFrame:
    """One row: share of allowed steps, share of fitting traces."""
    return replayed.agg((F.sum("allowed") / F.sum("steps")).alias("fitness"), F.avg(F.col("fit").cast("double")).alias("fit_traces"), F.count_if(~F.col("fit")).alias("num_deviant"), F.count(F.lit(1)).alias("total_traces"))


def prefix_tree(log: DataFrame) -> DataFrame:
    """One row per distinct prefix that cases start with: k (its length), state, parent (state of the prefix without its last task, null at
    the top), task (its last), visits (cases that start with it), ends (cases that are no longer), children (tasks seen after it).

    A state is two hashes that grow with the window, so a case of n events costs n rows and one shuffle of small rows. That equal states are equal
    prefixes is checked where rows meet: all rows of a state must have one last task and one parent, and so on to the top; a clash fails the job.
    """
    w = in_case()
    at = with_next(log).withColumn("_k", F.row_number().over(w))
    own = [F.xxhash64(F.lit(seed), "_k", "task_name") for seed in (1, 2)]
    grown = [F.bit_xor(x).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_s{i}") for i, x in enumerate(own)]
    at = at.select("_k", "task_name", "next_task", *(x.alias(f"_o{i}") for i, x in enumerate(own)), *grown)
    above = F.struct(F.col("_s0").bitwiseXOR(F.col("_o0")).alias("a"), F.col("_s1").bitwiseXOR(F.col("_o1")).alias("b"))
    made = F.collect_set(F.struct(above.alias("parent"), F.col("task_name").alias("task")))  # one entry, unless hashes clash
    nodes = at.groupBy("_k", "_s0", "_s1").agg(F.count(F.lit(1)).alias("visits"), F.count("next_task").alias("on"), F.collect_set("next_task").alias("children"), made.alias("made"))
    sure = F.when(F.size("made") == 1, F.element_at("made", 1)).otherwise(F.raise_error("two prefixes share a state").cast("struct<parent: struct<a: bigint, b: bigint>, task: string>"))
    nodes = nodes.withColumn("made", sure)
    parent = F.when(F.col("_k") > 1, F.col("made.parent"))
    return nodes.select(F.col("_k").alias("k"), F.struct(F.col("_s0").alias("a"), F.col("_s1").alias("b")).alias("state"), parent.alias("parent"), F.col("made.task").alias("task"), "visits", (F.col("visits") - F.col("on")).alias("ends"), "children")


def _enabled(tree: DataFrame, model: DataFrame) -> DataFrame:
    """Nodes that go on, with the weight of their going on and the model's successors of their task (none, if the model lacks it)."""
    steps = model.filter(F.col("src") != START).filter(F.col("tgt") != END).groupBy(F.col("src").alias("task")).agg(F.collect_set("tgt").alias("enabled"))  # a row per task
    return tree.filter("visits > ends").withColumn("w", F.col("visits") - F.col("ends")).join(steps, "task", "left")


def escaping_edges(tree: DataFrame, model: DataFrame) -> DataFrame:
    """(k, state, task, step, kind, w): where the model and the log part, a row per node of the prefix tree and step.

    `escaping`: the model's next steps that no case takes after that prefix (w: cases that go on there); `unmodelled`: steps that cases take
    and the model lacks. Steps out of a case's last task are not looked at.
    """
    both = _enabled(tree, model).withColumn("enabled", F.coalesce("enabled", F.array().cast("array<string>")))
    kinds = [F.struct(F.lit(kind).alias("kind"), F.array_except(x, y).alias("steps")) for kind, x, y in (("escaping", "enabled", "children"), ("unmodelled", "children", "enabled"))]
    out = both.withColumn("of", F.explode(F.array(*kinds)))
    return out.select("k", "state", "task", F.explode("of.steps").alias("step"), "of.kind", "w")


def etc_precision(log: DataFrame, model: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """One row: 1 - escaping / enabled edges over the states that prefixes lead to, weighted by their visits (null if nothing is enabled).

    A state is the whole prefix, a node of `tree` (the log's prefix tree, made here if not given); enabled are the model's successors of its
    last task, escaping those never seen after it.
    """
    both = _enabled(prefix_tree(log) if tree is None else tree, model)
    return both.agg((1 - F.try_divide(F.sum(F.col("w") * F.size(F.array_except("enabled", "children"))), F.sum(F.col("w") * F.size("enabled")))).alias("precision"))


def f_score(fitness, precision):
    return F.when(fitness + precision == 0, 0.0).otherwise(2 * fitness * precision / (fitness + precision))


def conformance_summary(log: DataFrame, model: DataFrame) -> DataFrame:
    both = log_fitness(replay_traces(log, model)).crossJoin(F.broadcast(etc_precision(log, model)))  # one row each
    return both.withColumn("f_score", f_score(F.col("fitness"), F.col("precision")))


def token_replay(log: DataFrame, arcs: DataFrame, initial: list[str], final: list[str]) -> DataFrame:
    """Per variant: tokens produced, consumed, missing and remaining on a given net, and fitness.

    `arcs` (transition, place, kind "in" or "out") is a model, a few rows per task, so it is brought to the driver and becomes part of the plan.
    Each distinct variant is folded once over a marking (an array with the tokens of each place), whatever number of cases follow it; there are
    no silent transitions, and tasks that the net lacks move nothing. A place may be named more than once for a transition.
    """
    found = sorted((r.transition, r.place, r.kind) for r in arcs.collect())
    places = sorted({p for _, p, _ in found} | {*initial, *final})
    vector = lambda held: F.array(*(F.lit(held.count(p)) for p in places)) if places else F.array().cast("array<int>")
    names = sorted({t for t, _, _ in found})
    none = vector([])

    def table(kind: str):
        """Of a task: how many tokens it takes from (gives to) each place."""
        rows = [x for t in names for x in (F.lit(t), vector([p for n, p, k in found if n == t and (k == "in") == (kind == "in")]))]
        return (lambda t: F.coalesce(F.try_element_at(F.create_map(*rows), t), none)) if rows else (lambda t: none)

    takes, gives = table("in"), table("out")
    total = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
    lack = lambda m, need: total(F.zip_with(m, need, lambda a, b: F.greatest(b - a, F.lit(0))))
    less = lambda m, need: F.zip_with(m, need, lambda a, b: F.greatest(a - b, F.lit(0)))
    state = "struct<m: array<int>, produced: bigint, consumed: bigint, missing: bigint>"
    made = lambda m, *n: F.struct(m.alias("m"), *(x.alias(c) for x, c in zip(n, ("produced", "consumed", "missing"), strict=True))).cast(state)
    zero = F.lit(0).cast("long")

    def step(s, t):
        need, new = takes(t), gives(t)
        return made(F.zip_with(less(s["m"], need), new, lambda a, b: a + b), s["produced"] + total(new), s["consumed"] + total(need), s["missing"] + lack(s["m"], need))

    end = vector(final)
    out = variants(log).select("tasks", "n", F.aggregate("tasks", made(vector(initial), F.lit(len(initial)).cast("long"), zero, zero), step).alias("s"))
    out = out.select("tasks", "n", "s.produced", (F.col("s.consumed") + len(final)).alias("consumed"), (F.col("s.missing") + lack(F.col("s.m"), end)).alias("missing"), total(less(F.col("s.m"), end)).alias("remaining"))
    share = lambda part, whole: 1 - F.col(part) / F.greatest(F.col(whole), F.lit(1).cast("long"))
    return out.withColumn("fitness", 0.5 * share("missing", "consumed") + 0.5 * share("remaining", "produced"))
