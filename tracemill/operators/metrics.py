"""Quality of predictions: a table with y_true, labels (likeliest first) and probs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.sources.scratch import cut


def ranked(pred: DataFrame) -> DataFrame:
    """With the predicted label, its probability, and rank and probability of the true label (rank 0: unknown to the model)."""
    rank = F.coalesce(F.array_position("labels", F.col("y_true")), F.lit(0))
    return pred.withColumn("y_pred", F.col("labels")[0]).withColumn("confidence", F.col("probs")[0]).withColumn("rank", rank).withColumn("p_true", F.when(rank > 0, F.element_at("probs", rank.cast("int"))))


def ranking_metrics(pred: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: accuracy, top-k accuracies, mean reciprocal rank, mean negative log-likelihood; 0 for an empty table."""
    r = ranked(pred)
    tops = [F.coalesce(F.avg(F.col("rank").between(1, k).cast("double")), F.lit(0.0)).alias(f"top_{k}") for k in ks]
    mrr = F.coalesce(F.avg(F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)), F.lit(0.0))
    return r.agg(F.coalesce(F.avg((F.col("y_pred") == F.col("y_true")).cast("double")), F.lit(0.0)).alias("accuracy"), *tops, mrr.alias("mrr"), F.avg(-F.log("p_true")).alias("cross_entropy"), F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame, weight: str | None = None) -> DataFrame:
    """`weight` names a column that says how many rows each row stands for."""
    return ranked(pred).groupBy("y_true", "y_pred").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))


def per_class_metrics(confusion: DataFrame, names: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every name in the dictionary; 0 where undefined."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    true = confusion.groupBy(F.col("y_true").alias("name")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    said = confusion.groupBy(F.col("y_pred").alias("name")).agg(F.sum("n").alias("said"))
    out = names.select("name").join(true, "name", "left").join(said, "name", "left").fillna(0, ["support", "hits", "said"])
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    out = out.select("name", share("hits", "said").alias("precision"), share("hits", "support").alias("recall"), "support")
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both))


def f1_scores(per_class: DataFrame) -> DataFrame:
    weighted = F.when(F.sum("support") == 0, 0.0).otherwise(F.sum(F.col("f1") * F.col("support")) / F.sum("support"))
    return per_class.agg(F.avg("f1").alias("macro_f1"), weighted.alias("weighted_f1"))


def matthews_corrcoef(confusion: DataFrame) -> DataFrame:
    """One row: the multiclass coefficient from the confusion counts."""
    true = confusion.groupBy(F.col("y_true").alias("name")).agg(F.sum("n").alias("t"))
    said = confusion.groupBy(F.col("y_pred").alias("name")).agg(F.sum("n").alias("p"))
    sums = true.join(said, "name", "full").fillna(0, ["t", "p"]).agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    whole = confusion.agg(F.sum("n").alias("s"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("c"))
    s, c = F.col("s").cast("double"), F.col("c")
    down = F.sqrt(s * s - F.col("pp")) * F.sqrt(s * s - F.col("tt"))
    return sums.crossJoin(F.broadcast(whole)).select(F.when(down == 0, 0.0).otherwise((c * s - F.col("tp")) / down).alias("mcc"))  # one row each


def expected_calibration_error(pred: DataFrame, bins: int = 15) -> DataFrame:
    """One row; bins of equal width, upper ends included."""
    r = ranked(pred).withColumn("bin", F.ceil(F.col("confidence") * bins)).filter("confidence > 0")
    per = r.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y_pred") == F.col("y_true")).cast("double")).alias("acc"), F.avg("confidence").alias("conf"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def softmax(values, temperature: float = 1.0):
    """Of an array of scores, shifted by its maximum."""
    up = F.transform(values, lambda x: F.exp((x - F.array_max(values)) / temperature))
    return F.transform(up, lambda x: x / F.aggregate(up, F.lit(0.0), lambda a, b: a + b))


def alike(pred: DataFrame, weight: str | None = None) -> DataFrame:
    """(y_true, labels, probs, c): rows of equal prediction and true label as one, c times; as many as contexts have labels."""
    return pred.groupBy("y_true", "labels", "probs").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("c"))


def negative_log_likelihoods(pred: DataFrame, temperatures: list[float], weight: str | None = None) -> DataFrame:
    """(temperature, nll) of each temperature over the log-probabilities, all in one pass, in which equal rows are one (`alike`)."""
    true = F.array_position("labels", F.col("y_true")).cast("int")
    some = alike(pred, weight).withColumn("_k", true).filter("_k > 0").withColumn("_s", F.transform("probs", lambda p: F.log(p)))
    nll = [F.try_divide(F.sum(F.col("c") * -F.log(F.element_at(softmax(F.col("_s"), t), F.col("_k")))), F.sum("c")).alias(f"t{k}") for k, t in enumerate(temperatures)]
    row = some.agg(*nll)
    stack = ", ".join(f"cast({t!r} as double), t{k}" for k, t in enumerate(temperatures))
    return row.selectExpr(f"stack({len(temperatures)}, {stack}) as (temperature, nll)")


def fit_temperature(pred: DataFrame, rounds: int = 3, weight: str | None = None) -> float:
    """The temperature of least likelihood loss, by refined grids. One pass over the predictions counts equal ones, which the rounds read."""
    import math

    cells = cut(alike(pred, weight))
    low, high, best = math.log(0.05), math.log(20.0), 1.0
    for _ in range(rounds):
        grid = [math.exp(low + (high - low) * k / 16) for k in range(17)]
        found = [r for r in negative_log_likelihoods(cells, grid, "c").collect() if r.nll is not None]
        if not found:
            return 1.0
        best = min(found, key=lambda r: r.nll).temperature
        step = (high - low) / 16
        low, high = math.log(best) - step, math.log(best) + step
    return best


def _poisson(mean, unit):
    """The least k whose Poisson distribution function reaches `unit`, for small means (by its recurrence)."""
    start = F.struct(F.lit(0).cast("long").alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("upto"))
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 12).cast("int"))

    def step(a, i):
        p = a["p"] * mean / i
        return F.when(a["upto"] >= unit, a).otherwise(F.struct(i.cast("long").alias("k"), p.alias("p"), (a["upto"] + p).alias("upto")))

    return F.aggregate(steps, start, step, lambda a: a["k"].cast("double"))


def _log_factorial(k):
    """log k!, by Stirling's series eight places further on."""
    x = k + 9.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return series - sum((F.log(k + float(i)) for i in range(2, 9)), F.log(k + 1.0))


#: Attempts of the rejection; each is refused with odds below a quarter.
ATTEMPTS = 64


def _poisson_by_rejection(mean, unit):
    """A Poisson number of a mean of 10 or more: transformed rejection with squeeze. `unit(i)` gives uniform numbers, two for each attempt."""
    b = 0.931 + 2.53 * F.sqrt(mean)
    a = -0.059 + 0.02483 * b
    squeeze = 0.9277 - 3.6224 / (b - 2)
    scale = F.log(1.1239 + 1.1328 / (b - 3.4))

    def attempt(found, i):
        u, v = unit(2 * i) - 0.5, unit(2 * i + 1)
        us = 0.5 - F.abs(u)
        k = F.floor((2 * a / us + b) * u + mean + 0.43).cast("double")
        sure = (us >= 0.07) & (v <= squeeze)
        out = (k < 0) | ((us < 0.013) & (v > us))
        fits = F.log(v) + scale - F.log(a / (us * us) + b) <= -mean + k * F.log(mean) - _log_factorial(F.greatest(k, F.lit(0.0)))
        return F.when(found >= 0, found).when(sure | (~out & fits), k).otherwise(F.lit(-1.0))

    drawn = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), F.lit(-1.0), attempt)
    return F.when(drawn >= 0, drawn).otherwise(F.round(mean))


def bootstrap_ci(pred: DataFrame, replicates: int = 500, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(metric, low, high) of accuracy, macro F1, top-3, top-5 and MRR by a Poisson bootstrap; (0, 0) for an empty table.

    Rows are first summed into cells of equal outcome (true label, predicted label, rank of the true one), so the replicates weigh
    as many cells as the confusion matrix has, not the table: a cell of c rows gets a seeded Poisson(c) weight, exact for any c. Macro F1 is
    over the labels that the table holds, true or predicted, in every replicate.
    """
    cells = ranked(pred).groupBy("y_true", "y_pred", "rank").agg(F.count(F.lit(1)).alias("c"))
    reps = cells.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    unit = lambda s: (F.pmod(F.xxhash64("y_true", "y_pred", "rank", "b", F.lit(seed) + s), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 2))
    c = F.col("c").cast("double")
    w = F.when(c < 10, _poisson(F.least(c, F.lit(10.0)), unit(F.lit(0)))).otherwise(_poisson_by_rejection(F.greatest(c, F.lit(10.0)), unit))
    weighed = reps.withColumn("w", w)
    part = lambda when: F.try_divide(F.sum(F.when(when, F.col("w")).otherwise(0.0)), F.sum("w"))
    per = weighed.groupBy("b").agg(
        part(F.col("y_pred") == F.col("y_true")).alias("accuracy"),
        part(F.col("rank").between(1, 3)).alias("top_3"),
        part(F.col("rank").between(1, 5)).alias("top_5"),
        F.try_divide(F.sum(F.when(F.col("rank") > 0, F.col("w") / F.col("rank")).otherwise(0.0)), F.sum("w")).alias("mrr"),
    )
    sides = weighed.select("b", "w", F.explode(F.array(F.struct(F.col("y_true").alias("name"), F.lit(1).alias("true"), F.lit(0).alias("said")), F.struct(F.col("y_pred").alias("name"), F.lit(0).alias("true"), F.lit(1).alias("said")))).alias("s"), (F.col("y_true") == F.col("y_pred")).alias("hit"))
    of_class = sides.groupBy("b", F.col("s.name").alias("name")).agg(F.sum(F.when(F.col("hit"), F.col("w") * F.col("s.true")).otherwise(0.0)).alias("hits"), F.sum("w").alias("both"))
    macro = of_class.groupBy("b").agg(F.avg(F.coalesce(F.try_divide(2 * F.col("hits"), F.col("both")), F.lit(0.0))).alias("macro_f1"))  # 2 hits / (true + said)
    long = per.join(macro, "b").selectExpr("stack(5, 'accuracy', accuracy, 'macro_f1', macro_f1, 'top_3', top_3, 'top_5', top_5, 'mrr', mrr) as (metric, value)")
    names = pred.sparkSession.createDataFrame([(x,) for x in ("accuracy", "macro_f1", "top_3", "top_5", "mrr")], "metric string")
    long = names.join(long, "metric", "left")  # as many rows as replicates
    tail = (1 - confidence) / 2
    return long.groupBy("metric").agg(F.coalesce(F.percentile("value", tail), F.lit(0.0)).alias("low"), F.coalesce(F.percentile("value", 1 - tail), F.lit(0.0)).alias("high"))


def combined_loss(pred: DataFrame, weights: DataFrame | None = None, dt_weight: float = 0.0, true: str = "dt_log", predicted: str = "dt_pred") -> DataFrame:
    """One row: weighted mean negative log-likelihood of the true label, mean squared error of dt_log, and their sum by `dt_weight`.

    `weights` (name, weight) weighs true labels, as `class_weights` gives them; the mean divides by the weights' sum. Labels that the
    model doesn't know have no likelihood and are left out of the first term. Empty table: nulls.
    """
    r = ranked(pred)
    if weights is not None:
        r = r.join(F.broadcast(weights.select(F.col("name").alias("y_true"), "weight")), "y_true", "left")  # as many rows as tasks
    w = F.coalesce("weight", F.lit(1.0)) if weights is not None else F.lit(1.0)
    known = F.col("p_true").isNotNull()
    nll = F.try_divide(F.sum(F.when(known, -F.log("p_true") * w)), F.sum(F.when(known, w)))
    square = F.avg((F.col(predicted) - F.col(true)) ** 2) if dt_weight else F.lit(0.0)
    return r.agg(nll.alias("cross_entropy"), square.alias("dt_mse")).withColumn("loss", F.col("cross_entropy") + dt_weight * F.col("dt_mse"))


def dt_mae_hours(df: DataFrame, true: str = "dt_log", predicted: str = "dt_pred") -> DataFrame:
    return df.agg((F.avg(F.abs(F.expm1(predicted) - F.expm1(true))) / 3600).alias("mae_hours"))


def quantile_metrics(df: DataFrame, qs: tuple[float, ...], true: str = "dt_log", predicted: str = "quantiles") -> DataFrame:
    """One row: pinball loss, coverage and mean width in hours of the outer quantiles."""
    e = lambda k: F.col(true) - F.col(predicted)[k]
    loss = sum((F.greatest(q * e(k), (q - 1) * e(k)) for k, q in enumerate(qs)), F.lit(0.0)) / len(qs)
    first, last = F.col(predicted)[0], F.col(predicted)[len(qs) - 1]
    return df.agg(F.avg(loss).alias("pinball"), F.avg(F.col(true).between(first, last).cast("double")).alias("coverage"), (F.avg(F.expm1(last) - F.expm1(first)) / 3600).alias("width_hours"))


def lift(accuracies: DataFrame) -> DataFrame:
    """(lift_over_markov, lift_over_most_common) from a row of accuracies."""
    return accuracies.select((F.col("accuracy") - F.col("markov_accuracy")).alias("lift_over_markov"), (F.col("accuracy") - F.col("most_common_accuracy")).alias("lift_over_most_common"))

