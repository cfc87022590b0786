"""Process analysis: bottlenecks, their drivers, cycle times, rare paths, transition matrices, clusters, charts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.features import amount_quartile
from tracemill.operators.conformance import conformance_summary, discover_dfg
from tracemill.operators.transitions import end_activities, mean_wait, start_activities, task_adjacency
from tracemill.sources.scratch import cut, exact_quantiles

def bottlenecks(trans: DataFrame) -> DataFrame:
    """Per (src, tgt): mean wait and count. In no order; `slowest_first` sorts what is shown."""
    return trans.groupBy("src", "tgt").agg(mean_wait().alias("mean_s"), F.count(F.lit(1)).alias("n")).withColumn("mean_hours", F.col("mean_s") / 3600)


def slowest_first(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("mean_hours"), "src", "tgt")


def significant_bottlenecks(stats: DataFrame, least: int = 5) -> DataFrame:
    return stats.filter(F.col("n") >= least)


def rare_transitions(stats: DataFrame, most: int = 2) -> DataFrame:
    return stats.filter(F.col("n") <= most)


def cycle_times(log: DataFrame) -> DataFrame:
    hours = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 3.6e9
    return log.groupBy("case_id").agg(F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"), hours.alias("cycle_time_hours"), F.avg("amount").alias("mean_amount"), F.count(F.lit(1)).alias("num_events"))


def cycle_time_percentile(cycles: DataFrame, q: float = 0.95, exact: bool = True) -> DataFrame:
    """One row; interpolates linearly, or estimates from a bounded sketch if not exact."""
    if exact:
        return exact_quantiles(cycles, "cycle_time_hours", [q]).select(F.col("quantiles")[0].alias("cut"))
    return cycles.agg(F.percentile_approx("cycle_time_hours", q, 10_000).alias("cut"))


def long_cases(cycles: DataFrame, q: float = 0.95, exact: bool = True) -> DataFrame:
    """The cases that take longer than the percentile, or than its estimate."""
    return cycles.crossJoin(F.broadcast(cycle_time_percentile(cycles, q, exact))).filter(F.col("cycle_time_hours") > F.col("cut"))  # one row


def top_transitions(trans: DataFrame, top: int = 5, least: int = 10) -> DataFrame:
    return slowest_first(bottlenecks(trans).filter(F.col("n") >= least)).limit(top)


def driver_groups(trans: DataFrame, top: int = 5, least: int = 10, group_least: int = 3) -> DataFrame:
    """For the slowest transitions: mean wait and count per value of resource, weekday, hour and amount quartile, in one pass."""
    slow = F.broadcast(top_transitions(trans, top, least).select("src", "tgt"))  # `top` rows
    some = amount_quartile(trans).join(slow, ["src", "tgt"], "left_semi")
    long = some.select("src", "tgt", "wait_s", F.expr("stack(4, 'resource', resource, 'day_of_week', cast(dow as string), 'hour_of_day', cast(hod as string), 'amount_bucket', amount_bucket) as (feature, value)"))
    groups = long.filter("value is not null").groupBy("src", "tgt", "feature", "value").agg((mean_wait() / 3600).alias("mean_h"), F.count(F.lit(1)).alias("n"))
    return groups.filter(F.col("n") >= group_least)


def drivers(trans: DataFrame, top: int = 5, least: int = 10, group_least: int = 3) -> DataFrame:
    """Per slow transition and feature with two groups or more: spread of the groups' means, worst and best group, rank of the feature;
    with the transition's count and mean wait. A slow transition without such a feature has one row, its feature null."""
    g = driver_groups(trans, top, least, group_least)
    pick = lambda f, side: f(F.struct("value", "mean_h", "n"), F.struct(F.round("mean_h", 9), "value")).alias(side)
    out = g.groupBy("src", "tgt", "feature").agg(F.count(F.lit(1)).alias("groups"), (F.max("mean_h") - F.min("mean_h")).alias("spread_h"), pick(F.max_by, "worst"), pick(F.min_by, "best")).filter("groups >= 2")
    rank = F.row_number().over(Window.partitionBy("src", "tgt").orderBy(F.desc(F.round("spread_h", 9)), "feature"))
    slow = top_transitions(trans, top, least).select("src", "tgt", F.col("n").alias("n_transitions"), F.col("mean_hours").alias("mean_wait_h"))
    return slow.join(out.withColumn("rank", rank), ["src", "tgt"], "left")


def driver_report(found: DataFrame) -> DataFrame:
    """Markdown rows; a transition without drivers has none."""
    return found.filter("feature is not null").select("src", "tgt", "rank", F.format_string("| %s → %s | %s | %.2f | %s (%.2f h, n=%d) | %s (%.2f h, n=%d) |", "src", "tgt", "feature", "spread_h", "worst.value", "worst.mean_h", "worst.n", "best.value", "best.mean_h", "best.n").alias("line"))


def transition_counts(trans: DataFrame) -> DataFrame:
    """Every seen src with every seen tgt, 0 where the pair never occurs: tasks squared, whatever the log's size."""
    counts = task_adjacency(trans)
    grid = counts.select("src").distinct().crossJoin(F.broadcast(counts.select("tgt").distinct()))
    return grid.join(counts, ["src", "tgt"], "left").select("src", "tgt", F.coalesce("weight", F.lit(0)).alias("n"))


def transition_probabilities(trans: DataFrame) -> DataFrame:
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))
    return task_adjacency(trans).select("src", "tgt", share.alias("p"))


def _leading(entries: DataFrame, nodes: DataFrame, k: int, seed: int, most: int) -> DataFrame:
    """(task, values): the k eigenvectors of largest eigenvalue of a symmetric matrix (src, tgt, w), by block Lanczos steps from k seeded vectors.

    A step is one join of the entries with the last block; the basis is an array column, and only its inner products (`most` * k numbers a step
    at most) come to the driver. New vectors are made orthogonal to all earlier ones twice.
    """
    noise = lambda i: F.pmod(F.xxhash64("task", F.lit(seed), F.lit(i)), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1
    state = cut(nodes.select("task", F.array().cast("array<double>").alias("basis"), F.array(*(noise(i) for i in range(k))).alias("y")))
    size, h = 0, np.zeros((0, 0))
    dots = lambda y: [F.sum(F.col("basis")[i] * y[c]) for i in range(size) for c in range(k)]
    gram = lambda y: [F.sum(a * b) for a in y for b in y]
    turned = lambda y, m: [sum((c * F.lit(float(x)) for c, x in zip(y, m[:, r], strict=True)), F.lit(0.0)) for r in range(m.shape[1])]

    def without(y, share: np.ndarray):
        """y less what it shares with the basis."""
        return [y[c] - sum((F.col("basis")[i] * F.lit(float(share[i, c])) for i in range(size)), F.lit(0.0)) for c in range(k)]

    while True:
        y, total = [F.col("y")[c] for c in range(k)], np.zeros((size, k))
        for _ in range(2 if size else 1):
            found = np.array(state.agg(F.array(*dots(y), *gram(y)).alias("x")).first().x)
            share = found[: size * k].reshape(size, k)
            total += share
            y = without(y, share)
        g = found[size * k :].reshape(k, k) - share.T @ share
        value, turn = np.linalg.eigh(g)
        if size:  # the last block's column of the projected matrix
            h[:, size - width :] = total[:, k - width :]
            h[size - width :, :] = total[:, k - width :].T
            ritz, inside = np.linalg.eigh(h)
            top = inside[:, ::-1][:, :k]
            left = np.sqrt(np.maximum(np.diag(top[size - width :].T @ g[k - width :, k - width :] @ top[size - width :]), 0))
            if size >= most or value[-1] < 1e-18 * max(1.0, np.abs(ritz).max() ** 2) or (top.shape[1] == k and (left < 1e-9 * max(1.0, np.abs(ritz).max())).all()):
                break
        keep = value > 1e-14 * value[-1]  # what is smaller is rounding
        width = int(keep.sum())
        new = turned(y, turn[:, keep] / np.sqrt(value[keep]))
        again, turn = np.linalg.eigh(np.array(state.agg(F.array(*gram(new)).alias("x")).first().x).reshape(width, width))
        new = turned(new, turn / np.sqrt(again))
        state = cut(state.select("task", F.concat("basis", F.array(*new)).alias("basis")))
        size += width
        h = np.pad(h, (0, width))
        last = state.select(F.col("task").alias("tgt"), F.slice("basis", -width, width).alias("x"))
        moved = entries.join(last, "tgt").groupBy(F.col("src").alias("task")).agg(*(F.sum(F.col("w") * F.col("x")[r]).alias(f"y{r}") for r in range(width)))
        filled = [F.lit(0.0)] * (k - width) + [F.coalesce(f"y{r}", F.lit(0.0)) for r in range(width)]
        state = cut(state.join(moved, "task", "left").select("task", "basis", F.array(*filled).alias("y")))
    combine = [sum((F.col("basis")[i] * F.lit(float(top[i, e])) for i in range(size)), F.lit(0.0)) for e in range(top.shape[1])]
    return state.select("task", F.array(*combine).alias("values"))


def spectral_clusters(adjacency: DataFrame, k: int = 2, normalized: bool = True, seed: int = 0, most: int = 200) -> DataFrame:
    """(task, cluster) by the Laplacian's eigenvectors of the symmetrised adjacency, for any number of tasks.

    The eigenvectors come from Lanczos steps in Spark (`most` vectors at most), seeded, so the labels are the same in every run. k = 2: sign of the
    Fiedler vector, turned so that the first task by name is in cluster 0; more: k-means on the eigenvectors after the first. One task is cluster 0.
    """
    half = adjacency.select("src", "tgt", (F.col("weight") / 2).alias("w"))
    edges = cut(half.unionByName(half.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "w")).groupBy("src", "tgt").agg(F.sum("w").alias("w")))
    degree = edges.groupBy(F.col("src").alias("task")).agg(F.sum("w").alias("d"))
    nodes = degree.select("task")
    n = nodes.count()
    if n < 2:
        return nodes.select("task", F.lit(0).alias("cluster"))
    if normalized:
        by = lambda c: degree.select(F.col("task").alias(c), F.col("d").alias(f"d_{c}"))
        scaled = edges.join(by("src"), "src").join(by("tgt"), "tgt")
        entries = scaled.select("src", "tgt", F.when((F.col("d_src") > 0) & (F.col("d_tgt") > 0), F.col("w") / F.sqrt(F.col("d_src") * F.col("d_tgt"))).otherwise(0.0).alias("w"))
    else:
        entries = edges.unionByName(degree.select(F.col("task").alias("src"), F.col("task").alias("tgt"), (-F.col("d")).alias("w")))
    vectors = _leading(cut(entries), nodes, min(k, n), seed, min(most, n))
    if k == 2:
        found = vectors.select("task", F.col("values")[1].alias("x"))
        first = found.orderBy("task").first().x
        side = F.col("x") < 0 if first >= 0 else F.col("x") >= 0
        return found.select("task", side.cast("int").alias("cluster"))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = cut(vectors.select("task", F.slice("values", 2, max(1, min(k, n) - 1)).alias("x")).orderBy("task")).select("task", array_to_vector("x").alias("features"))
    return KMeans(k=min(k, n), seed=seed).fit(rows).transform(rows).select("task", F.col("prediction").alias("cluster"))


def preprocessing_summary(log: DataFrame, scaler: str = "l2", seed: int = 42) -> DataFrame:
    """One row over a log with split, with the scaler's name and the seed that it was prepared with."""
    return log.agg(
        F.count_distinct("task_name").alias("num_tasks"), F.count_distinct("resource").alias("num_resources"), F.count_distinct("case_id").alias("num_cases_total"),
        F.count_distinct(F.when(F.col("split") == "train", F.col("case_id"))).alias("num_cases_train"), F.count_distinct(F.when(F.col("split") == "val", F.col("case_id"))).alias("num_cases_val"),
        F.unix_micros(F.min("timestamp")).alias("first_us"), F.unix_micros(F.max("timestamp")).alias("last_us"),
        F.lit(scaler).alias("scaler_mode"), F.lit(seed).alias("seed"),
    )


def analysis_summary(log: DataFrame, trans: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """One row: cases, 95th percentile of the cycle time, long cases, rare transitions; deviant cases, fitness, precision and
    F of `model` (default: the log's own directly-follows model); and the bottleneck drivers, strongest first, as one array.

    Cycle times and transitions are stored once, with the columns that are asked for: each is read several times."""
    cycles = cut(cycle_times(log).select("cycle_time_hours"))
    trans = cut(trans.select("src", "tgt", "wait_s", "resource", "amount", "dow", "hod"))
    long = cycles.crossJoin(F.broadcast(cycle_time_percentile(cycles))).agg(F.count(F.lit(1)).alias("total_traces"), F.count_if(F.col("cycle_time_hours") > F.col("cut")).alias("num_long_cases"), F.max("cut").alias("p95_hours"))
    rare = rare_transitions(bottlenecks(trans)).agg(F.count(F.lit(1)).alias("num_rare_transitions"))
    fits = conformance_summary(log, discover_dfg(log) if model is None else model).select("num_deviant", "fitness", "precision", "f_score")
    why = F.struct("src", "tgt", "rank", "feature", "spread_h", "worst", "best")
    told = drivers(trans).filter("feature is not null").agg(F.sort_array(F.collect_list(why)).alias("drivers"))  # four features of five transitions
    return long.crossJoin(F.broadcast(rare)).crossJoin(F.broadcast(fits)).crossJoin(F.broadcast(told))  # one row each


# ----------------------------------------------------------------------- charts


def cycle_time_histogram(cycles: DataFrame, bins: int = 30) -> DataFrame:
    """(bin, low, high, n, mean) of equal widths between the extremes, the last bin closed; empty bins are left out. `mean` is that of all cases."""
    ends = cycles.agg(F.min("cycle_time_hours").alias("lo"), F.max("cycle_time_hours").alias("hi"), F.avg("cycle_time_hours").alias("mean"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("cycle_time_hours") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    out = cycles.crossJoin(F.broadcast(ends)).withColumn("bin", place)
    return out.groupBy("bin").agg(F.first(F.col("lo") + width * F.col("bin")).alias("low"), F.first(F.col("lo") + width * (F.col("bin") + 1)).alias("high"), F.count(F.lit(1)).alias("n"), F.first("mean").alias("mean"))


def process_flow_edges(trans: DataFrame, top: int = 5, least: int = 5) -> DataFrame:
    """All edges with frequency, mean wait, and whether they are among the slowest significant ones."""
    stats = bottlenecks(trans)
    slow = F.broadcast(slowest_first(significant_bottlenecks(stats, least)).limit(top).select("src", "tgt", F.lit(True).alias("slow")))
    return stats.join(slow, ["src", "tgt"], "left").select("src", "tgt", "n", "mean_hours", F.coalesce("slow", F.lit(False)).alias("is_bottleneck"))


def sankey_links(log: DataFrame, trans: DataFrame) -> DataFrame:
    """Start → first task, last task → End, and every transition, with counts."""
    first = start_activities(log).select(F.lit("Start").alias("source"), F.col("task_name").alias("target"), "n")
    last = end_activities(log).select(F.col("task_name").alias("source"), F.lit("End").alias("target"), "n")
    return first.unionByName(last).unionByName(task_adjacency(trans).select(F.col("src").alias("source"), F.col("tgt").alias("target"), F.col("weight").alias("n")))
