"""The best of all pairs of rows by a sum over what both of them know, block by block."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.sources.scratch import cut, numbered

_BEST = "swap_from string, swap_to string, support long, delta_h double, key double"
#: Numbers that a block's table of resources and steps holds at most, and resources of a block.
BLOCK, ROWS = 4_000_000, 32_768


def _dense(rows: pa.Table, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and which of them are there (0 where not), a row per resource and a column per step."""
    shape = (rows.num_rows, len(steps))
    n, mean, known = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    entries = rows["entries"].combine_chunks()
    row = np.repeat(np.arange(rows.num_rows), pa.compute.list_value_length(entries).to_numpy(zero_copy_only=False))
    flat = entries.flatten()
    step = flat.field("step").to_numpy(zero_copy_only=False)
    some = np.isin(step, steps)
    at = row[some], np.searchsorted(steps, step[some])
    n[at], mean[at], known[at] = flat.field("n").to_numpy(zero_copy_only=False)[some], flat.field("mean_h").to_numpy(zero_copy_only=False)[some], 1.0
    return n, mean, known


def _steps(rows: pa.Table) -> np.ndarray:
    return np.unique(rows["entries"].combine_chunks().flatten().field("step").to_numpy(zero_copy_only=False))


def _best_of_block(top: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.rename_columns({"other": "resource", "others": "entries"}).sort_by("resource")  # so that a lower column is an earlier name
        names, others = left["resource"].to_pylist(), right["resource"].to_pylist()
        place = {name: i for i, name in enumerate(others)}
        steps = np.intersect1d(_steps(left), _steps(right)) if names and others else np.array([], int)
        out = [(np.array([], int),) * 3 + (np.array([]),) * 2]
        if len(steps):
            n, own, has = _dense(left, steps)
            _, mean, known = _dense(right, steps)
            n_own, most, terms = n * own, np.abs(mean).max(), len(steps)
            tall = max(1, BLOCK // len(others))
            for start in range(0, len(names), tall):
                part = slice(start, start + tall)
                support = n[part] @ known.T
                delta = n[part] @ mean.T - n_own[part] @ known.T
                delta[support == 0] = np.inf
                self = np.array([place.get(x, -1) for x in names[part]])
                delta[np.flatnonzero(self >= 0), self[self >= 0]] = np.inf
                last = np.partition(delta, top - 1)[:, top - 1] if top < len(others) else np.full(len(self), np.inf)
                unsure = 8 * (terms + 4) * np.finfo(float).eps * (n[part].sum(1) * most + np.abs(n_own[part]).sum(1)) + 4e-9  # rounding of the products, and of the keys
                row, col = np.nonzero((delta <= (last + unsure)[:, None]) & (delta < np.inf))
                exact = np.empty(len(row))
                for k in range(0, len(row), max(1, BLOCK // 4 // terms)):
                    r, c = row[k : k + max(1, BLOCK // 4 // terms)] + start, col[k : k + max(1, BLOCK // 4 // terms)]
                    exact[k : k + len(r)] = (n[r] * (mean[c] - own[r]) * known[c]).sum(1, dtype=np.longdouble)
                key = np.round(exact, 9)
                order = np.lexsort((col, key, row))
                row, col, key, exact = row[order], col[order], key[order], exact[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < top
                row, col = row[kept], col[kept]
                out.append((row + start, col, np.rint(support[row, col]).astype(np.int64), exact[kept], key[kept]))
        row, col, support, delta, key = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"swap_from": pa.array([names[i] for i in row], pa.string()), "swap_to": pa.array([others[i] for i in col], pa.string()), "support": pa.array(support, pa.int64()), "delta_h": pa.array(delta, pa.float64()), "key": pa.array(key + 0.0, pa.float64())})

    return run


def resources_by_step(table: DataFrame) -> DataFrame:
    """(resource, entries) of a table (src, tgt, resource, n, mean_h): its steps by number, with count and mean, an entry per step that it knows."""
    steps = numbered(table.select("src", "tgt").distinct(), F.col("src"), F.col("tgt"), name="step")
    return table.join(steps, ["src", "tgt"]).groupBy("resource").agg(F.sort_array(F.collect_list(F.struct("step", "n", "mean_h"))).alias("entries"))


def best_pairs(rows: DataFrame, left: DataFrame, right: DataFrame, top: int, n_steps: int) -> DataFrame:
    """(swap_from, rank, swap_to, support, delta_h): for each resource of `left` the `top` of `right` with the least delta_h, the sum of
    n * (their mean - own mean) over the steps that both know (support: the sum of n). Ties, at nine digits, by name.

    `rows` is `resources_by_step`; `left` and `right` hold resources. Both are dealt into blocks, and a pair of blocks is a task's: two matrix products give the
    sums of all its pairs, those near the best are added up again term by term, and the block's best go on. No pair of resources is shuffled.
    """
    n_left, n_right = left.count(), right.count()
    most = max(64, min(ROWS, BLOCK // max(1, n_steps)))
    tasks = min(64, math.ceil(n_left * n_right / 1e6))
    across = max(1, math.ceil(n_right / most), min(math.isqrt(tasks), math.ceil(n_right / 512)))
    down = max(1, math.ceil(n_left / most), math.ceil(tasks / across))
    block = lambda k: F.pmod(F.xxhash64("resource"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    lefts = rows.join(left, "resource", "left_semi").select("resource", "entries", block(down).alias("i"), each(across).alias("j")).repartition(down * across, "i", "j")
    rights = rows.join(right, "resource", "left_semi").select(F.col("resource").alias("other"), F.col("entries").alias("others"), block(across).alias("to"), each(down).alias("of")).repartition(down * across, "of", "to")
    found = lefts.groupBy("i", "j").cogroup(rights.groupBy("of", "to")).applyInArrow(lambda a, b: _best_of_block(top)(a, b), _BEST)
    rank = F.row_number().over(Window.partitionBy("swap_from").orderBy("key", "swap_to"))  # `top` rows of each block
    return cut(found.withColumn("rank", rank).filter(F.col("rank") <= top).select("swap_from", "rank", "swap_to", "support", "delta_h"))
