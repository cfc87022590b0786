"""Questions about cases: what a change of resource would have cost, why a step was expected, which resource to choose."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.pairs import best_pairs, resources_by_step
from tracemill.operators.transitions import mean_wait
from tracemill.sources.eventlog import in_case
from tracemill.sources.scratch import cut


def resource_wait_table(trans: DataFrame) -> DataFrame:
    return trans.groupBy("src", "tgt", "resource").agg((mean_wait() / 3600).alias("mean_h"), F.count(F.lit(1)).alias("n"))


def transition_wait_table(trans: DataFrame) -> DataFrame:
    return trans.groupBy("src", "tgt").agg((mean_wait() / 3600).alias("mean_h"), F.count(F.lit(1)).alias("n"))


def whatif_events(trans: DataFrame, swap_from: str, swap_to: str, cases: DataFrame | None = None) -> DataFrame:
    """Per transition: actual and counterfactual resource and wait, delta, and whether the wait had to fall back.

    The counterfactual wait is the mean of the transition with the counterfactual resource, else of the transition, else actual.
    History comes from all of `trans`; `cases` (case_id) restricts the answer, and one that has no transition is an error.
    """
    if cases is not None and (strange := cases.select("case_id").distinct().join(trans.select("case_id"), "case_id", "left_anti").orderBy("case_id").limit(10).collect()):
        raise ValueError(f"Unknown cases: {', '.join(str(r.case_id) for r in strange)}")
    by_resource = resource_wait_table(trans).select("src", "tgt", F.col("resource").alias("cf_resource"), F.col("mean_h").alias("m1"))
    by_step = transition_wait_table(trans).select("src", "tgt", F.col("mean_h").alias("m2"))
    some = trans if cases is None else trans.join(cases.select("case_id").distinct(), "case_id", "left_semi")
    some = some.withColumn("cf_resource", F.when(F.col("resource") == swap_from, swap_to).otherwise(F.col("resource")))
    out = some.join(by_resource, ["src", "tgt", "cf_resource"], "left").join(by_step, ["src", "tgt"], "left")
    out = out.withColumn("cf_wait_h", F.coalesce("m1", "m2", "wait_h"))
    return out.select("case_id", "event_seq", "src", "tgt", "resource", "cf_resource", "wait_h", "cf_wait_h", (F.col("cf_wait_h") - F.col("wait_h")).alias("delta_h"), F.col("m1").isNull().alias("fallback"))


def whatif_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("case_id").agg(F.sum("wait_h").alias("actual_h"), F.sum("cf_wait_h").alias("counterfactual_h"), F.sum("delta_h").alias("delta_h"), F.count_if("fallback").alias("fallbacks"))


def whatif_report(events: DataFrame) -> DataFrame:
    return events.select("case_id", "event_seq", F.format_string("| %s → %s | %s → %s | %.2f | %.2f | %+.2f |", "src", "tgt", "resource", "cf_resource", "wait_h", "cf_wait_h", "delta_h").alias("line"))


def swap_candidates(trans: DataFrame, least: int = 2) -> DataFrame:
    """(swap_from, swap_to, support, delta_h): hours that each replacement would change over the steps that both resources know.

    All pairs of resources of a transition; `best_swaps` finds each resource's best without them.
    """
    table = resource_wait_table(trans).filter(F.col("n") >= least)
    other = table.select("src", "tgt", F.col("resource").alias("swap_to"), F.col("mean_h").alias("to_h"))
    pairs = table.join(other, ["src", "tgt"]).filter(F.col("resource") != F.col("swap_to"))
    return pairs.groupBy(F.col("resource").alias("swap_from"), "swap_to").agg(F.sum("n").alias("support"), F.sum(F.col("n") * (F.col("to_h") - F.col("mean_h"))).alias("delta_h"))


def best_swaps(trans: DataFrame, top: int = 5, least: int = 2, first: int = 8) -> DataFrame:
    """(swap_from, rank, swap_to, support, delta_h): each resource's `top` replacements in `swap_candidates`, the largest saving first (ties, at
    nine digits, by name).

    Resources of a transition are listed by their mean wait, and all resources meet the first so many of each list. Whoever wasn't met is no
    faster than the next of each list, which bounds what they could save; where the `top` found save more than that, or a resource's lists are at an
    end, it is done. The others meet everybody: all pairs are summed, but as products of blocks (`best_pairs`), so no pair becomes a row.
    """
    in_list = Window.partitionBy("src", "tgt").orderBy("mean_h", "resource")
    table = cut(resource_wait_table(trans).filter(F.col("n") >= least).withColumn("at", F.row_number().over(in_list)))
    n_steps, everybody, rows = table.select("src", "tgt").distinct().count(), table.select("resource").distinct(), resources_by_step(table)
    best = best_pairs(rows, everybody, table.filter(F.col("at") <= first).select("resource").distinct(), top, n_steps)
    ahead = table.filter(F.col("at") == first + 1).select("src", "tgt", F.col("mean_h").alias("next_h"))
    bound = table.join(F.broadcast(ahead), ["src", "tgt"], "left").groupBy(F.col("resource").alias("swap_from")).agg(  # a row per transition
        F.count("next_h").alias("open"), F.sum(F.when(F.col("next_h") < F.col("mean_h"), F.col("n") * (F.col("next_h") - F.col("mean_h"))).otherwise(0.0)).alias("bound"))
    found = best.groupBy("swap_from").agg(F.count(F.lit(1)).alias("have"), F.max("delta_h").alias("last"))
    sure = (F.col("open") == 0) | ((F.coalesce("have", F.lit(0)) == top) & (F.col("last") < F.col("bound") - 1e-6))  # far more than sums of doubles differ by
    state = cut(bound.join(found, "swap_from", "left").select("swap_from", F.coalesce(sure, F.lit(False)).alias("sure")))
    done = best.join(state.filter("sure").select("swap_from"), "swap_from", "left_semi")
    left = state.filter("not sure").select(F.col("swap_from").alias("resource"))
    return done if left.isEmpty() else done.unionByName(best_pairs(rows, left, everybody, top, n_steps))


def explain_case(log: DataFrame, predicted: DataFrame, look_back: int = 5, top: int = 5) -> DataFrame:
    """Per event of `predicted` (case_id, event_seq, y_pred, and prob if it has one): the earlier-or-same events that speak most for the
    prediction, beside the task that did follow (y_true, null if none did) and the prediction's probability.

    The weight of a task at distance d is its positive pointwise mutual information with the next task over the whole log;
    weights of an event sum to 1. Nothing looks ahead.
    """
    w = in_case()
    back = log.withColumn("next_task", F.lead("task_name").over(w))
    for d in range(look_back):
        back = back.withColumn(f"t{d}", F.lag("task_name", d).over(w))
    stack = ", ".join(f"{d}, t{d}" for d in range(look_back))
    seen = back.select("case_id", "event_seq", "next_task", F.expr(f"stack({look_back}, {stack}) as (d, task)")).filter("task is not null")
    joint = seen.filter("next_task is not null").groupBy("d", "task", "next_task").agg(F.count(F.lit(1)).alias("c"))
    of_d = Window.partitionBy("d")
    pmi = F.log(F.col("c") * F.sum("c").over(of_d) / (F.sum("c").over(Window.partitionBy("d", "task")) * F.sum("c").over(Window.partitionBy("d", "next_task"))))
    weights = joint.select("d", "task", F.col("next_task").alias("y_pred"), F.greatest(pmi, F.lit(0.0)).alias("pmi"))
    said = predicted.select("case_id", "event_seq", "y_pred", F.col("prob") if "prob" in predicted.columns else F.lit(None).cast("double").alias("prob"))
    out = seen.withColumnRenamed("next_task", "y_true").join(said, ["case_id", "event_seq"]).join(weights, ["d", "task", "y_pred"]).filter("pmi > 0")
    of_event = Window.partitionBy("case_id", "event_seq")
    out = out.withColumn("weight", F.col("pmi") / F.sum("pmi").over(of_event))
    rank = F.row_number().over(of_event.orderBy(F.desc(F.round("weight", 9)), "d"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= top).select("case_id", "event_seq", "y_true", "y_pred", "prob", "rank", "d", "task", "weight")


def resource_policy(trans: DataFrame) -> DataFrame:
    """(src, tgt, resource, score): the best observed (next task, resource) of each task.

    Score: minus the mean wait, plus 1 for resources used no more than the mean, less by a tenth of the excess (in mean uses).
    """
    used = trans.groupBy("resource").agg(F.count(F.lit(1)).alias("uses"))
    mean = used.agg(F.avg("uses").alias("mean"))
    excess = F.col("uses") / F.col("mean") - 1
    efficiency = used.crossJoin(F.broadcast(mean)).select("resource", F.when(excess <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - 0.1 * excess)).alias("efficiency"))  # one row
    scored = resource_wait_table(trans).join(efficiency, "resource").withColumn("score", F.col("efficiency") - F.col("mean_h"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.round("score", 9)), "tgt", "resource"))
    return scored.withColumn("r", rank).filter("r = 1").select("src", "tgt", "resource", "score")


def offline_q(trans: DataFrame, gamma: float = 0.9, iterations: int = 3) -> DataFrame:
    """(src, tgt, resource, q): fitted Q-iteration on logged steps, reward minus the wait; a task that nothing follows is worth 0.

    Rewards are averaged once; each iteration joins tables of the size of the action set.
    """
    reward = resource_wait_table(trans).select("src", "tgt", "resource", (-F.col("mean_h")).alias("reward"))
    q = reward.withColumn("q", F.col("reward"))
    for _ in range(iterations):
        best = q.groupBy(F.col("src").alias("tgt")).agg(F.max("q").alias("ahead"))
        q = reward.join(best, "tgt", "left").select("src", "tgt", "resource", "reward", (F.col("reward") + gamma * F.coalesce("ahead", F.lit(0.0))).alias("q"))
    return q.select("src", "tgt", "resource", "q")


def suffix_report(suffixes: DataFrame) -> DataFrame:
    return suffixes.select("case_id", F.format_string("| %s | %.4f | %.2f h |", F.array_join("tasks", " → "), "prob", F.col("total_dt_s") / 3600).alias("line"))
