"""Next-event and remaining-path prediction from counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.features import FEATURES, class_weights, with_next
from tracemill.sources.eventlog import in_case
from tracemill.sources.scratch import cut, exact_quantiles


def labelled(log: DataFrame, spread: bool = False) -> DataFrame:
    """Events that have a next one; `spread` as in `with_next`."""
    return with_next(log, spread).filter("next_task is not null")


def fit_most_common(train: DataFrame) -> DataFrame:
    return train.agg(F.mode("next_task", True).alias("most_common"))


def predict_most_common(val: DataFrame, model: DataFrame) -> DataFrame:
    return val.crossJoin(F.broadcast(model))  # one row


def fit_markov(train: DataFrame) -> DataFrame:
    """(task_name, markov): the commonest next task of each, the smallest of equals."""
    return train.groupBy("task_name").agg(F.mode("next_task", True).alias("markov"))


def predict_markov(val: DataFrame, table: DataFrame, fallback: DataFrame) -> DataFrame:
    out = predict_most_common(val.join(table, "task_name", "left"), fallback)
    return out.withColumn("covered", F.col("markov").isNotNull()).withColumn("markov", F.coalesce("markov", "most_common"))


def evaluate_baselines(train: DataFrame, val: DataFrame) -> DataFrame:
    """One row: accuracies of both baselines, coverage of the Markov table, validation events."""
    out = predict_markov(val, fit_markov(train), fit_most_common(train))
    hit = lambda c: F.avg((F.col(c) == F.col("next_task")).cast("double"))
    return out.agg(F.max("most_common").alias("most_common_label"), hit("most_common").alias("most_common_accuracy"), hit("markov").alias("markov_accuracy"), F.avg(F.col("covered").cast("double")).alias("markov_coverage"), F.count(F.lit(1)).alias("num_val_events"))


# ---------------------------------------------------------------- distributions


def contexts(log: DataFrame, order: int) -> DataFrame:
    """`log` with context_1 … context_order: the last tasks joined by ">", null where a case is younger."""
    w = in_case()
    for k in range(1, order + 1):
        back = [F.lag("task_name", j).over(w) for j in range(k - 1, 0, -1)]
        whole = F.concat_ws(">", *back, "task_name")
        log = log.withColumn(f"context_{k}", F.when(back[0].isNotNull(), whole) if back else whole)
    return log


def next_event_distribution(train: DataFrame, order: int = 1, alpha: float = 1.0, weight: str | None = None) -> DataFrame:
    """(depth, context, labels, probs): next tasks by probability, smoothed by alpha; depth 0 holds the unconditional one.

    `train` holds labelled events with their contexts; `weight` names a column that says how many events a row stands for. The table has one row per context.
    """
    labels = train.agg(F.collect_set("next_task").alias("all"))
    seen = None
    for k in range(order + 1):
        part = train.select(F.lit(k).alias("depth"), (F.col(f"context_{k}") if k else F.lit("")).alias("context"), F.col("next_task").alias("label"), (F.col(weight) if weight else F.lit(1)).alias("_w")).filter("context is not null")
        seen = part if seen is None else seen.unionByName(part)
    counts = seen.groupBy("depth", "context", "label").agg(F.sum("_w").alias("c"))
    grid = counts.select("depth", "context").distinct().crossJoin(F.broadcast(labels)).select("depth", "context", F.explode("all").alias("label"))  # one row, a label per task
    full = grid.join(counts, ["depth", "context", "label"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    whole = Window.partitionBy("depth", "context")
    p = (F.col("c") + alpha) / (F.sum("c").over(whole) + alpha * F.count(F.lit(1)).over(whole))
    ranked = full.withColumn("p", p).groupBy("depth", "context").agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("minus"), "label"))).alias("r"))
    return ranked.select("depth", "context", F.transform("r", lambda x: x["label"]).alias("labels"), F.transform("r", lambda x: -x["minus"]).alias("probs"))


def predict_distribution(val: DataFrame, model: DataFrame, order: int = 1) -> DataFrame:
    """`val` (with contexts) with labels, probs and depth of the longest context that the model knows."""
    out = val
    for k in range(order, -1, -1):
        part = model.filter(F.col("depth") == k).select(F.col("context").alias(f"context_{k}"), F.struct("labels", "probs", "depth").alias(f"_m{k}"))
        out = out.join(part, f"context_{k}", "left") if k else out.crossJoin(F.broadcast(part.drop("context_0")))  # one row
    best = F.coalesce(*(F.col(f"_m{k}") for k in range(order, -1, -1)))
    out = out.withColumn("_m", best).withColumn("labels", F.col("_m.labels")).withColumn("probs", F.col("_m.probs")).withColumn("depth", F.col("_m.depth"))
    return out.drop("_m", *(f"_m{k}" for k in range(order + 1)))


def predict_topk(predicted: DataFrame, k: int = 3, times: DataFrame | None = None) -> DataFrame:
    """(case_id, event_seq, rank, label, prob): the k likeliest next tasks; with next_dt_hours, the expected wait, if `times` (see `time_to_next`) is given."""
    if k < 1:
        raise ValueError("k must be 1 at least")
    more = []
    if times is not None:
        predicted = predicted.join(times.select("task_name", (F.coalesce("seconds", "overall_s") / 3600).alias("next_dt_hours")), "task_name", "left")
        more = ["next_dt_hours"]
    best = F.slice(F.arrays_zip("labels", "probs"), 1, k)
    out = predicted.select("case_id", "event_seq", *more, F.posexplode(best).alias("rank", "x"))
    return out.select("case_id", "event_seq", (F.col("rank") + 1).alias("rank"), F.col("x.labels").alias("label"), F.col("x.probs").alias("prob"), *more)


def require_known(prefixes: DataFrame, names: DataFrame, column: str = "tasks") -> DataFrame:
    """`prefixes` (arrays of tasks), or an error: an empty prefix predicts nothing, and an activity that the dictionary lacks is unknown."""
    odd = prefixes.filter(F.coalesce(F.size(column), F.lit(0)) <= 0)
    if not odd.isEmpty():
        raise ValueError("an empty prefix predicts nothing")
    strange = prefixes.select(F.explode(column).alias("name")).distinct().join(names.select("name"), "name", "left_anti").orderBy("name").limit(10).collect()
    if strange:
        raise ValueError(f"Unknown activities: {', '.join(str(r.name) for r in strange)}")
    return prefixes


def time_to_next(train: DataFrame, by: tuple[str, ...] = ("task_name",)) -> DataFrame:
    """Mean of dt_log per key and overall, as seconds."""
    overall = train.agg(F.avg("dt_log").alias("m")).select(F.expm1("m").alias("overall_s"))
    return train.groupBy(*by).agg(F.avg("dt_log").alias("mean_dt_log")).withColumn("seconds", F.expm1("mean_dt_log")).crossJoin(F.broadcast(overall))  # one row


def boosted_time_to_next(train: DataFrame, rounds: int = 20, depth: int = 5, step: float = 0.1, seed: int = 42):
    """A fitted pipeline that adds dt_pred, boosted regression trees' dt_log, to a table that `create_features` made.

    An event without an amount has no scaled vector: it takes no part in fitting, and its prediction goes right at every split.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    if train.filter("dt_log is not null").isEmpty():
        raise ValueError("no labelled events to fit on")
    feats = [f"feat_{c}" for c in FEATURES]
    filled = SQLTransformer(statement="select *, " + ", ".join(f"coalesce({c}, double('NaN')) as _in_{c}" for c in feats) + " from __THIS__")
    all_ = VectorAssembler(inputCols=[f"_in_{c}" for c in feats], outputCol="_vector", handleInvalid="keep")
    trees = GBTRegressor(featuresCol="_vector", labelCol="dt_log", predictionCol="dt_pred", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
    return Pipeline(stages=[filled, all_, trees]).fit(train.filter("dt_log is not null").dropna(subset=feats))


def time_quantiles(train: DataFrame, qs: tuple[float, ...] = (0.1, 0.5, 0.9), by: tuple[str, ...] = ("task_name",)) -> DataFrame:
    if list(qs) != sorted(set(qs)) or not all(0 < q < 1 for q in qs):
        raise ValueError("quantiles must be unique, sorted, and lie between 0 and 1")
    return exact_quantiles(train, "dt_log", list(qs), by)


def predict_suffix(cases: DataFrame, model: DataFrame, times: DataFrame, beam: int = 5, max_steps: int = 20, stop_on_self_loop: bool = True) -> DataFrame:
    """(case_id, tasks, log_prob, prob, total_dt_s): the likeliest continuations of each open case (case_id, last).

    `model` is `next_event_distribution` of order 1, `times` is `time_to_next`; both have a row per task and travel as one map. What
    follows depends on the last task alone, so the beams are those of each different last task, one row that all steps are one expression over, and cases are
    joined with them. A case is finished when its best beam repeats a task.
    """
    if beam < 1 or max_steps < 0:
        raise ValueError("beam must be 1 at least and max_steps 0 at least")
    best = F.slice(F.arrays_zip("labels", "probs"), 1, beam)
    top = model.filter("depth = 1").agg(F.map_from_entries(F.collect_list(F.struct(F.col("context").alias("last"), best.alias("own")))).alias("_top"))
    any_ = model.filter("depth = 0").select(best.alias("_any"))  # for tasks that nothing was seen to follow
    dt = times.agg(F.map_from_entries(F.collect_list(F.struct(F.col("task_name"), F.coalesce("seconds", "overall_s")))).alias("_dt"))
    now = cases.select(F.col("last").alias("_last")).distinct()
    for row in (top, any_, dt):
        now = now.crossJoin(F.broadcast(row))  # one row each, as many entries as tasks

    def longer(b):
        last = F.element_at(b["seq"], -1)
        wait = b["dt"] + F.coalesce(F.try_element_at("_dt", last), F.lit(0.0))

        def one(x):
            seq, lp = F.concat(b["seq"], F.array(x["labels"])), b["lp"] + F.log(x["probs"])
            return F.struct((F.lit(0.0) - F.round(lp, 9)).alias("order"), F.array_join(seq, ">").alias("name"), seq.alias("seq"), lp.alias("lp"), wait.alias("dt"))

        return F.transform(F.coalesce(F.try_element_at("_top", last), F.col("_any")), one)

    def stopped(beams):
        seq = F.element_at(beams, 1)["seq"]
        repeats = F.element_at(seq, -1) == F.element_at(seq, -2)
        return F.struct(beams.alias("beams"), (repeats if stop_on_self_loop else F.lit(False)).alias("done"))

    def step(a, _):
        ranked = F.slice(F.array_sort(F.flatten(F.transform(a["beams"], longer))), 1, beam)
        return F.when(a["done"], a).otherwise(F.transform(F.array(ranked), stopped)[0].cast(kind))

    kind = "struct<beams: array<struct<order: double, name: string, seq: array<string>, lp: double, dt: double>>, done: boolean>"
    first = F.struct(F.lit(0.0).alias("order"), F.col("_last").alias("name"), F.array("_last").alias("seq"), F.lit(0.0).alias("lp"), F.lit(0.0).alias("dt"))
    begin = F.struct(F.array(first).alias("beams"), F.lit(False).alias("done")).cast(kind)
    beams = F.aggregate(F.sequence(F.lit(1), F.lit(max_steps)), begin, step)["beams"] if max_steps else begin["beams"]
    held = cut(now.select("_last", beams.alias("beams")).withColumn("sum", F.aggregate("beams", F.lit(0.0), lambda a, b: a + F.exp(b["lp"]))))
    out = held.select("_last", "sum", F.explode("beams").alias("b"))
    out = out.select("_last", F.slice("b.seq", 2, F.greatest(F.size("b.seq") - 1, F.lit(1))).alias("tasks"), F.col("b.lp").alias("log_prob"), (F.exp("b.lp") / F.col("sum")).alias("prob"), F.col("b.dt").alias("total_dt_s"))
    return cases.join(F.broadcast(out), F.col("last").eqNullSafe(F.col("_last"))).select("case_id", "tasks", "log_prob", "prob", "total_dt_s")  # `beam` rows per task


# ------------------------------------------------------------- contexts of any depth


def paths(log: DataFrame, order: int) -> DataFrame:
    """`log` with path: the last `order` tasks up to each event."""
    return log.withColumn("path", F.collect_list("task_name").over(in_case().rowsBetween(1 - order, 0)))


def context_trie(train: DataFrame, order: int = 3, discount: float = 0.5, alpha: float = 1.0) -> DataFrame:
    """(context, label, c, n, u, p): the seen continuations of every context of 0 to `order` tasks (an array, oldest first).

    A suffix trie of counts, stored sparse: a row per context and label that was seen after it. c counts the pair, n the context, u its
    different labels. p takes `discount` off each count and gives the mass to the context without its oldest task; without any task it is
    smoothed by `alpha`. A label that wasn't seen has discount * u / n times its probability in the shorter context. `train`: labelled events with `path`.
    """
    depths = F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.when(k == 0, F.array().cast("array<string>")).otherwise(F.slice("path", -k, k)))
    seen = train.select(F.explode(depths).alias("context"), F.col("next_task").alias("label")).groupBy("context", "label").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("context")  # rows of a context: its labels
    counts = cut(seen.withColumn("n", F.sum("c").over(whole)).withColumn("u", F.count(F.lit(1)).over(whole)))
    level = counts.filter(F.size("context") == 0).withColumn("p", (F.col("c") + alpha) / (F.col("n") + alpha * F.col("u")))
    out = [level]
    for k in range(1, order + 1):
        shorter = level.select(F.col("context").alias("_shorter"), "label", F.col("p").alias("_p"))
        own = counts.filter(F.size("context") == k).withColumn("_shorter", F.slice("context", 2, k - 1) if k > 1 else F.array().cast("array<string>"))
        level = own.join(shorter, ["_shorter", "label"]).withColumn("p", (F.col("c") - discount) / F.col("n") + discount * F.col("u") / F.col("n") * F.col("_p")).select(counts.columns + ["p"])
        out.append(level)
    return cut(reduce(DataFrame.unionByName, out))


def likeliest(trie: DataFrame, top: int, order: int = 3, discount: float = 0.5) -> DataFrame:
    """(context, best): of each context the `top` likeliest labels of all, as an array of (label, p, next); next is the longest context that the trie knows after it.

    A context's best are among its own labels and the best of the shorter context, so nothing is ever spread over all labels.
    """
    listed = lambda c, f: F.array_sort(F.transform(c, lambda x: F.struct((F.lit(0.0) - F.round(f(x), 9)).alias("order"), x["label"].alias("label"), f(x).alias("p"))))
    pairs = trie.groupBy("context").agg(F.collect_list(F.struct("label", "p")).alias("own"), (discount * F.first("u") / F.first("n")).alias("rest"))  # the labels of a context
    level = pairs.filter(F.size("context") == 0).select("context", F.slice(listed("own", lambda x: x["p"]), 1, top).alias("best"))
    out = [level]
    for k in range(1, order + 1):
        own = pairs.filter(F.size("context") == k).withColumn("_shorter", F.slice("context", 2, k - 1) if k > 1 else F.array().cast("array<string>"))
        both = own.join(level.select(F.col("context").alias("_shorter"), F.col("best").alias("_best")), "_shorter")
        others = F.filter("_best", lambda x: ~F.array_contains(F.transform("own", lambda y: y["label"]), x["label"]))
        everything = F.concat(listed("own", lambda x: x["p"]), listed(others, lambda x: x["p"] * F.col("rest")))
        level = both.select("context", F.slice(F.array_sort(everything), 1, top).alias("best"))
        out.append(level)
    best = reduce(DataFrame.unionByName, out).select("context", F.posexplode("best").alias("_at", "x")).select("context", "_at", "x.label", "x.p")
    ended = known_suffix(best.withColumn("_all", F.concat("context", F.array("label"))), "_all", trie, order)
    packed = ended.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("_at", "label", "p", F.col("node").alias("next")))).alias("best"))  # `top` a context
    return packed


def known_suffix(df: DataFrame, column: str, trie: DataFrame, order: int) -> DataFrame:
    """`df` with node: the longest end of an array of tasks, `order` of them at most, that the trie knows as a context."""
    known = trie.select("context").distinct()
    out, found = df, []
    for k in range(order, 0, -1):
        end = F.when(F.size(column) >= k, F.slice(column, -k, k))
        out = out.withColumn("_end", end).join(known.filter(F.size("context") == k).select(F.col("context").alias("_end"), F.lit(True).alias(f"_is{k}")), "_end", "left").drop("_end")
        found.append(F.when(F.col(f"_is{k}"), F.slice(column, -k, k)))
    node = F.coalesce(*found, F.array().cast("array<string>"))
    return out.withColumn("node", node).drop(*(f"_is{k}" for k in range(1, order + 1)))


def predict_suffix_of_prefix(prefixes: DataFrame, trie: DataFrame, times: DataFrame, beam: int = 5, max_steps: int = 20, stop_on_self_loop: bool = True, order: int = 3, discount: float = 0.5) -> DataFrame:
    """(case_id, tasks, log_prob, prob, total_dt_s): the likeliest continuations of each prefix (case_id, tasks), an array of any length.

    The whole prefix says where in the trie (`context_trie` of the same order and discount) a beam starts, and each step is one join of all
    beams with their contexts, so neither the trie nor the prefixes have to fit in one place. Of equal probabilities the path that is first by name
    wins. A case is finished when its best beam repeats a task. `times` is `time_to_next`; a task that it lacks takes no time. An empty prefix is an error.
    """
    if beam < 1 or max_steps < 0:
        raise ValueError("beam must be 1 at least and max_steps 0 at least")
    if not prefixes.filter(F.coalesce(F.size("tasks"), F.lit(0)) <= 0).isEmpty():
        raise ValueError("an empty prefix predicts nothing")
    wait = cut(times.select(F.col("task_name").alias("_last"), F.coalesce("seconds", "overall_s").alias("_wait")))
    model = cut(likeliest(trie, beam, order, discount).select(F.col("context").alias("node"), "best"))
    begun = known_suffix(prefixes.select("case_id", "tasks"), "tasks", trie, order)
    now = begun.select("case_id", "node", F.slice("tasks", -1, 1).alias("seq"), F.lit(0.0).alias("lp"), F.lit(0.0).alias("dt"), F.lit(False).alias("done"))
    finished = []
    for _ in range(max_steps):
        timed = now.withColumn("_last", F.element_at("seq", -1)).join(wait, "_last", "left").withColumn("dt", F.col("dt") + F.coalesce("_wait", F.lit(0.0)))
        longer = timed.join(model, "node").select("case_id", "seq", "lp", "dt", F.explode("best").alias("x"))
        longer = longer.select("case_id", F.col("x.next").alias("node"), F.concat("seq", F.array("x.label")).alias("seq"), (F.col("lp") + F.log("x.p")).alias("lp"), "dt")
        ranked = longer.withColumn("_r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(F.round("lp", 9)), F.array_join("seq", ">")))).filter(F.col("_r") <= beam)
        repeats = (F.col("_r") == 1) & (F.element_at("seq", -1) == F.element_at("seq", -2))
        done = F.max(repeats).over(Window.partitionBy("case_id")) if stop_on_self_loop else F.lit(False)
        held = cut(ranked.withColumn("done", done).drop("_r"))
        finished.append(held.filter("done"))
        now = held.filter("not done")
        if now.isEmpty():
            break
    out = reduce(DataFrame.unionByName, [*finished, now])
    share = F.exp("lp") / F.sum(F.exp("lp")).over(Window.partitionBy("case_id"))  # `beam` rows a case
    return out.select("case_id", F.slice("seq", 2, F.greatest(F.size("seq") - 1, F.lit(1))).alias("tasks"), F.col("lp").alias("log_prob"), share.alias("prob"), F.col("dt").alias("total_dt_s"))


def last_tasks(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id").agg(F.max_by("task_name", F.struct("timestamp", "event_seq")).alias("last"))


def truncate_prefix(log: DataFrame, n: int) -> DataFrame:
    """The first n events of each case."""
    if n < 1:
        raise ValueError("an empty prefix predicts nothing")
    return log.withColumn("_k", F.row_number().over(in_case())).filter(F.col("_k") <= n).drop("_k")


def earlier_tasks(log: DataFrame, k: int = 3) -> DataFrame:
    """`log` with task_1 … task_k: the tasks before each event, null where a case is younger."""
    for j in range(1, k + 1):
        log = log.withColumn(f"task_{j}", F.lag("task_name", j).over(in_case()))
    return log


def next_event_classifier(train: DataFrame, features: list[str], earlier: tuple[str, ...] = ()):
    """A fitted pipeline: multinomial logistic regression on the current and `earlier` tasks, resource and numeric features, classes weighted."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    shown = ["task_name", "resource", *earlier]
    index = StringIndexer(inputCols=[*shown, "next_task"], outputCols=[*(f"{c}_ix" for c in shown), "label"], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{c}_ix" for c in shown], outputCols=[f"{c}_1h" for c in shown])
    all_ = VectorAssembler(inputCols=[*(f"{c}_1h" for c in shown), *features], outputCol="features", handleInvalid="keep")
    names = train.select(F.col("next_task").alias("id"), F.col("next_task").alias("name")).distinct()
    weights = class_weights(train, "next_task", names).select(F.col("id").alias("next_task"), F.col("weight").alias("class_weight"))
    weighted = train.join(F.broadcast(weights), "next_task", "left").fillna(1.0, ["class_weight"])  # as many rows as tasks
    return Pipeline(stages=[index, hot, all_, LogisticRegression(family="multinomial", maxIter=20, regParam=0.01, weightCol="class_weight")]).fit(weighted)
