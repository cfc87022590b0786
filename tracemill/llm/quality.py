"""Quality classifier without hand labels: heuristics vote, EM weighs them, a hashed linear model learns.

Eight overlapping labellers call a document bad, good, or abstain, from figures of its words. The
table of vote patterns (3**8 at most) with its counts over all documents goes to the driver, where
expectation-maximisation estimates each labeller's accuracies and the share of bad documents,
abstentions counting as missing. Every pattern's posterior labels a sample of FIT_ROWS documents,
and a logistic model over hashed word shapes is fitted to those soft labels. That model scores all
documents, so a document is judged by all of its words, not by thresholds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_sample, docs_of, mix, parts, range_hashes

#: Documents that the linear model is fitted on, about, drawn by a hash of doc_id and text.
FIT_ROWS = 4000
DIMENSIONS = 2048
LABELLERS = ("symbols", "capitals", "lone marks", "exclaiming", "stuttering", "few words", "no sentences", "repeated lines")
#: Bad above the first bound, good below the second, of each labeller's figure.
BOUNDS = np.array([(0.08, 0.04), (0.5, 0.25), (0.15, 0.05), (0.3, 0.1), (0.3, 0.08), (0.75, 0.55), (0.98, 0.96), (0.45, 0.1)])
#: A labeller abstains on documents of fewer words.
LEAST_WORDS = np.array([4, 6, 8, 8, 8, 60, 40, 12])
_U = np.uint64
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#$%&*@^~|<>{}[]=\\+_"])
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
_STOP = np.isin(np.arange(256), [ord(c) for c in ".?!,;:"])
_SHAPE = np.where(_UPPER, 65, np.where(_LETTER, 97, np.where((np.arange(256) >= 48) & (np.arange(256) <= 57), 48, np.arange(256)))).astype(np.uint8)


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def figures(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, figures of each text in the order of LABELLERS)."""
    bounds, data, at = words.bounds, words.data, words.text_starts
    n = np.diff(bounds)
    size = np.diff(at)
    letters = _per_text(_LETTER[data], at)
    last = data[words.ends - 1] if len(words.ends) else data[:0]
    lone = (words.ends - words.starts == 1) & ~_LETTER[data[words.starts]] & ~((data[words.starts] >= 48) & (data[words.starts] <= 57))
    of = words.text_of_word()
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    first = np.zeros(len(hashes), dtype=bool)
    first[np.unique(hashes ^ mix(of.astype(_U)), return_index=True)[1]] = True
    distinct = _per_text(first, bounds)
    # lines: their bytes between line ends, hashed
    stop = np.flatnonzero(data == 10)
    begin, end = stop[:-1] + 1, stop[1:]
    full = end > begin
    begin, end = begin[full], end[full]
    line_of = np.searchsorted(at, begin, side="right") - 1
    line_bounds = np.searchsorted(line_of, np.arange(len(n) + 1))
    new_line = np.zeros(len(begin), dtype=bool)
    new_line[np.unique(range_hashes(data, begin, end) ^ mix(line_of.astype(_U) + _U(7)), return_index=True)[1]] = True
    lines = np.diff(line_bounds)
    out = np.stack(
        [
            _share(_per_text(_SYMBOL[data], at), size),
            _share(_per_text(_UPPER[data], at), letters),
            _share(_per_text(lone, bounds), n),
            _share(_per_text(last == 33, bounds), n),
            _share(_per_text(again, bounds), n),
            1 - _share(distinct, np.maximum(n, 1) ** 0.8),
            1 - _share(_per_text(_STOP[last], bounds), n),
            1 - np.where(lines > 0, _share(_per_text(new_line, line_bounds), lines), 1),
        ],
        axis=1,
    )
    return n, out


def votes(n: np.ndarray, figure: np.ndarray) -> np.ndarray:
    """1 bad, 0 good, 2 abstains; a row per text."""
    out = np.where(figure > BOUNDS[:, 0], 1, np.where(figure < BOUNDS[:, 1], 0, 2))
    return np.where(n[:, None] < LEAST_WORDS, 2, out)


def pattern_of(votes: np.ndarray) -> np.ndarray:
    return votes @ 3 ** np.arange(votes.shape[1])


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns: (share of bad documents, P(says bad | bad, good) of each labeller, posterior of bad per pattern).

    It starts from "bad if any labeller says so" and keeps every labeller better than chance, so the classes can't swap.
    """
    v = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    bad, said = (v == 1).astype(float), (v != 2).astype(float)
    post = np.clip(bad.max(axis=1), 0.02, 0.98)
    weight = counts.astype(float)
    for _ in range(rounds):
        share = float(np.clip((weight * post).sum() / weight.sum(), 1e-4, 0.5))
        rate = np.empty((len(LABELLERS), 2))
        for c, p in enumerate((post, 1 - post)):
            mass = (weight * p)[:, None]
            rate[:, c] = ((mass * bad).sum(axis=0) + (0.3, 0.02)[c] * 5) / ((mass * said).sum(axis=0) + 5)
        rate[:, 0] = np.clip(rate[:, 0], 0.02, 0.999)
        rate[:, 1] = np.minimum(np.clip(rate[:, 1], 1e-5, 0.5), rate[:, 0] * 0.8)
        score = np.log(share / (1 - share)) + (bad * np.log(rate[:, 0] / rate[:, 1]) + (said - bad) * np.log((1 - rate[:, 0]) / (1 - rate[:, 1]))).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return share, rate, post


def hashed_features(words: Words, hashes: np.ndarray) -> np.ndarray:
    """A row per text: square roots of the shares of its hashed word shapes, shape pairs and repeats."""
    data, bounds = words.data, words.bounds
    n = np.diff(bounds)
    out = np.zeros((len(n), DIMENSIONS), dtype=np.float32)
    if not len(hashes):
        return out
    shape = _SHAPE[data]
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[words.starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shapes = range_hashes(shape[keep], place[words.starts], place[words.ends])
    of = words.text_of_word()
    same = np.zeros(len(of), dtype=bool)
    same[1:] = of[1:] == of[:-1]
    repeat = np.zeros(len(of), dtype=_U)
    repeat[1:] += (hashes[1:] == hashes[:-1]) & same[1:]
    repeat[2:] += _U(2) * ((hashes[2:] == hashes[:-2]) & (of[2:] == of[:-2])).astype(_U)
    before = np.concatenate([[_U(0)], shapes[:-1]]) * same
    length = np.minimum(words.ends - words.starts, 20).astype(_U)
    for k, feature in enumerate((shapes, mix(shapes + _U(3) * before), repeat, length)):
        slot = (mix(feature + _U(k * 1_000_003)) % _U(DIMENSIONS)).astype(np.int64)
        cell, count = np.unique(of * DIMENSIONS + slot, return_counts=True)
        out.reshape(-1)[cell] += np.sqrt(count / n[cell // DIMENSIONS])
    return out * (n / (n + 4.0)).astype(np.float32)[:, None]  # few words are little evidence


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Mean logistic loss of soft labels with its ridge (the bias has none), and the gradient."""
    z = np.clip(x @ w, -30, 30)
    p = 1 / (1 + np.exp(-z))
    flat = np.append(w[:-1], 0)
    return float(np.mean(np.logaddexp(0, z) - y * z) + l2 / 2 * flat @ flat), x.T @ (p - y) / len(y) + l2 * flat


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 2e-4, rounds: int = 120, memory: int = 12) -> np.ndarray:
    """Weights (the last one the bias) of a logistic model for soft labels, by limited-memory BFGS steps."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)]).astype(np.float32)
    w = np.zeros(x.shape[1], dtype=np.float32)
    loss, slope = _loss(x, y, w, l2)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, shares = slope.astype(np.float64), []
        for s, d, r in reversed(moves):
            shares.append(r * (s @ way))
            way = way - shares[-1] * d
        if moves:
            s, d, r = moves[-1]
            way = way / (r * (d @ d))
        for s, d, r in moves:
            way = way + (shares.pop() - r * (d @ way)) * s
        pace, fall = 1.0, float(slope @ way)
        while True:
            new = (w - pace * way).astype(np.float32)
            new_loss, new_slope = _loss(x, y, new, l2)
            if new_loss <= loss - 1e-4 * pace * fall or pace < 1e-4:
                break
            pace /= 2
        step, change = (new - w).astype(np.float64), (new_slope - slope).astype(np.float64)
        if step @ change > 1e-12:
            moves = [*moves, (step, change, 1 / float(step @ change))][-memory:]
        done = loss - new_loss < 1e-7
        w, loss, slope = new, new_loss, new_slope
        if done:
            break
    return w.astype(np.float64)


def _chunked(batches):
    for b in batches:
        for lo, hi, texts in parts(b.column(1)):
            words = Words(texts)
            yield b.column(0).slice(lo, hi - lo), words, words.hashes()


def _patterns(batches):
    for ids, words, hashes in _chunked(batches):
        yield pa.RecordBatch.from_arrays([ids, pa.array(pattern_of(votes(*figures(words, hashes))), pa.int32())], ["doc_id", "pattern"])


def _sampled(batches):
    for ids, words, hashes in _chunked(batches):
        rows = hashed_features(words, hashes)
        pattern = pattern_of(votes(*figures(words, hashes)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(pattern, pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "pattern", "features"])


class Model:
    """Posterior of each vote pattern, labeller rates, and the linear model's weights."""

    def __init__(self, patterns, posterior, share, rates, weights):
        self.patterns, self.posterior, self.share, self.rates, self.weights = patterns, posterior, share, rates, weights

    def posterior_of(self, pattern: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.patterns, pattern), len(self.patterns) - 1)
        return np.where(self.patterns[at] == pattern, self.posterior[at], self.share)

    def score(self, features: np.ndarray) -> np.ndarray:
        """Probability of good."""
        return 1 / (1 + np.exp(np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model | None:
    """Labeller accuracies over all documents, and the linear model over about `fit_rows` of them; None for an empty table."""
    docs = docs_of(df, id_col, text_col)
    table = docs.mapInArrow(_patterns, "doc_id long, pattern int").groupBy("pattern").count().orderBy("pattern").collect()  # 3**8 rows at most
    if not table:
        return None
    patterns, counts = np.array([r["pattern"] for r in table]), np.array([r["count"] for r in table])
    share, rates, post = fit_labellers(patterns, counts)
    model = Model(patterns, post, share, rates, None)
    some = bounded_sample(docs, int(counts.sum()), fit_rows, ["doc_id", "text"])
    rows = some.mapInArrow(_sampled, "doc_id long, pattern int, features binary").collect()
    x = np.array([np.frombuffer(r.features, dtype=np.float32) for r in rows])
    model.weights = fit_linear(x, model.posterior_of(np.array([r.pattern for r in rows])))
    return model


def _scored(spread):
    def run(batches):
        model = spread.value
        for ids, words, hashes in _chunked(batches):
            v = votes(*figures(words, hashes))
            score = model.score(hashed_features(words, hashes))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(score), pa.array(1 - model.posterior_of(pattern_of(v))), pa.array((v == 1).sum(axis=1), pa.int32()), pa.array(score >= 0.5)],
                ["doc_id", "score", "labellers_score", "bad_votes", "kept"],
            )

    return run


SCORES = "doc_id long, score double, labellers_score double, bad_votes int, kept boolean"


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: better), labellers_score (of the votes alone), bad_votes, kept (score >= 0.5), a row per document.

    Null or empty texts have no words, so the prior decides and they are kept; repeated rows score alike.
    """
    docs = docs_of(df, id_col, text_col)
    if model is None:
        return df.sparkSession.createDataFrame([], SCORES)
    return docs.mapInArrow(_scored(df.sparkSession.sparkContext.broadcast(model)), SCORES)


def drop_bad(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns as they are, whose text the model keeps; nothing is shuffled."""
    if model is None:
        return df
    spread = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        out = []
        for _, _, own in parts(pa.array(texts, pa.string())):
            words = Words(own)
            out.append(spread.value.score(hashed_features(words, words.hashes())) >= 0.5)
        return pd.Series(np.concatenate(out) if out else np.zeros(0, dtype=bool))

    return df.filter(keep(F.col(f"`{text_col}`").cast("string")))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs))
