"""Toxicity: Levenshtein automata over a lexicon trie, with scores from the words around each hit.

Lexicon. From a bounded sample of labelled documents: words and word stems (prefixes) that occur
mostly in toxic ones, the strongest first, as many as the loss on a part of the sample that they were
not learned from goes on falling. The terms form a trie; the automaton that accepts every word within
one edit of a term is intersected with it and made deterministic state by state, as words of the
texts lead there, so neither the number nor the length of terms is limited. All words of a batch walk
through it together, a byte a step, so the cost is a few table look-ups per letter.

Score. Each hit counts by its term, by whether it is exact or misspelled, and by its context: a
window of words on both sides, with quotation marks around the hit (quotation) or further hits
(abuse). A logistic model over those sums and densities is fitted on the same sample. Labels,
language, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, docs_of, parts

#: Labelled documents that lexicon and model are learned from, about, drawn by a hash.
FIT_ROWS = 12_000
#: Terms that the search for their number begins with; it doubles them while the loss falls by this share at least.
FIRST_TERMS, LEAST_FALL = 20, 0.002
#: One in so many rows of the sample judges the number of terms.
JUDGES = 4
#: States that a worker holds before it forgets them and begins anew; results don't depend on it.
KEPT_STATES = 100_000
STEM_LENGTHS = range(4, 13)
#: A shorter term must match exactly.
LEAST_FUZZY = 5
#: Words on each side of a hit that make its context.
WINDOW = 6
_LOWER = np.arange(256, dtype=np.uint8) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)
_WORD = ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | ((np.arange(256) >= 48) & (np.arange(256) <= 57)) | (np.arange(256) >= 128)


# --------------------------------------------------------------------- automaton


class Automaton:
    """Deterministic automaton over bytes for a lexicon of (term, is a stem).

    Ending a word in state s means hit[s]: 2 * term + (1 if misspelled), or -1. A stem matches whatever follows it.
    Exact hits go before misspelled ones, then earlier terms before later ones.
    """

    def __init__(self, terms: list[tuple[bytes, bool]]):
        children: list[dict[int, int]] = [{}]
        ends: list[dict[bool, int]] = [{}]
        for i, (term, stem) in enumerate(terms):
            node = 0
            for byte in term:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    ends.append({})
                node = children[node][byte]
            ends[node].setdefault(stem, i)
        long_below = [False] * len(children)  # a term that may be misspelled lies at or below the node
        fuzzy = [len(t) >= LEAST_FUZZY for t, _ in terms]
        for node in range(len(children) - 1, -1, -1):  # children have larger numbers
            long_below[node] = any(fuzzy[i] for i in ends[node].values()) or any(long_below[c] for c in children[node].values())
        alphabet = sorted({b for t, _ in terms for b in t})
        self.classes = np.zeros(256, dtype=np.int64)
        self.classes[alphabet] = 1 + np.arange(len(alphabet))
        self.children, self.ends, self.long_below, self.fuzzy, self.alphabet = children, ends, long_below, fuzzy, alphabet
        self._begin()

    def __getstate__(self) -> dict:
        """Without the states, which every worker makes for itself."""
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "hit", "final", "states", "number")}

    def __setstate__(self, held: dict) -> None:
        self.__dict__.update(held)
        self._begin()

    def _begin(self) -> None:
        self.table = np.full((64, len(self.alphabet) + 1), -1, dtype=np.int32)
        self.hit, self.final = np.full(64, -1, dtype=np.int32), np.zeros(64, dtype=bool)
        self.states: list[tuple[frozenset, tuple[int, int] | None]] = []
        self.number: dict[tuple[frozenset, tuple[int, int] | None], int] = {}
        start = self._closed({(0, 0)})
        self._state(start, self._best(start, True, None))

    def _closed(self, live: set[tuple[int, int]]) -> frozenset:
        """With letters of the term left out."""
        return frozenset(live | {(c, 1) for node, e in live if e == 0 for c in self.children[node].values() if self.long_below[c]})

    def _best(self, live, stem: bool, best):
        """The least of (errors, term) of the terms that end here."""
        for node, e in live:
            i = self.ends[node].get(stem)
            if i is not None and (e == 0 or self.fuzzy[i]) and (best is None or (e, i) < best):
                best = (e, i)
        return best

    def _state(self, live: frozenset, best) -> int:
        found = self.number.setdefault((live, best), len(self.states))
        if found == len(self.states):
            if found == len(self.hit):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.hit, self.final = np.concatenate([self.hit, self.hit]), np.concatenate([self.final, self.final])
            self.states.append((live, best))
            end = self._best(live, False, best)
            self.hit[found] = -1 if end is None else 2 * end[1] + end[0]
            self.final[found] = not live  # whatever follows changes nothing
        return found

    def _step(self, state: int, letter: int) -> int:
        """The state after a letter (a number of the alphabet from 1, or 0 for any other)."""
        live, best = self.states[state]
        byte = self.alphabet[letter - 1] if letter else None
        out = set()
        for node, e in live:
            child = self.children[node].get(byte)
            if child is not None:
                out.add((child, e))
            if e == 0:
                if self.long_below[node]:
                    out.add((node, 1))  # a letter too many
                out.update((c, 1) for c in self.children[node].values() if self.long_below[c])  # another letter
        after = self._closed({(n, e) for n, e in out if e == 0 or (n, 0) not in out})
        return self._state(after, self._best(after, True, best))

    def walk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hit of each word data[start:end], -1 for none."""
        if len(self.states) > KEPT_STATES:
            self._begin()
        state = np.zeros(len(starts), dtype=np.int32)
        some = np.flatnonzero(ends > starts)
        k, letters = 0, self.table.shape[1]
        while len(some):
            letter = self.classes[data[starts[some] + k]]
            after = self.table[state[some], letter]
            if (new := after < 0).any():
                for way in np.unique(state[some][new].astype(np.int64) * letters + letter[new]).tolist():
                    to = self._step(way // letters, way % letters)
                    self.table[way // letters, way % letters] = to
                after = self.table[state[some], letter]
            state[some] = after
            k += 1
            some = some[(starts[some] + k < ends[some]) & ~self.final[after]]
        return self.hit[state]


# ---------------------------------------------------------------------- features


def _mask_marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of words, bytes that begin a quotation mark): general and Latin-1 punctuation isn't part of words."""
    word = _WORD[data]
    n1, n2 = np.append(data[1:], 0), np.append(data[2:], [0, 0])
    wide = np.flatnonzero((data == 0xE2) & ((n1 == 0x80) | (n1 == 0x81)))
    narrow = np.flatnonzero((data == 0xC2) & (n1 >= 0x80) & (n1 < 0xC0))
    for k in range(3):
        word[np.minimum(wide + k, len(data) - 1)] = False
    for k in range(2):
        word[narrow + k] = False
    quote = data == 0x22
    quote[wide] |= (n1[wide] == 0x80) & (n2[wide] >= 0x98) & (n2[wide] <= 0x9F) | (n1[wide] == 0x80) & ((n2[wide] == 0xB9) | (n2[wide] == 0xBA))
    quote[narrow] |= (n1[narrow] == 0xAB) | (n1[narrow] == 0xBB)
    return word, quote


FEATURES = ("plain exact", "plain misspelled", "quoted", "term weight", "largest weight", "abuse nearby", "density", "different terms")


def features(texts: list[bytes], automaton: Automaton, weights: np.ndarray) -> np.ndarray:
    """A row per text, in the order of FEATURES. weights: of each hit code (2 * term + misspelled)."""
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), dtype=np.uint8)
    word, quote = _mask_marks(_LOWER[data])
    low = _LOWER[data]
    edge = np.diff(word.view(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    at = 1 + np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)])
    bounds = np.searchsorted(starts, at)
    n = np.diff(bounds)
    code = automaton.walk(low, starts, ends)
    hit = np.flatnonzero(code >= 0)
    of = np.searchsorted(bounds, hit, side="right") - 1
    out = np.zeros((len(texts), len(FEATURES)))
    if not len(hit):
        return out
    marks = np.concatenate([[0], np.cumsum(quote)])
    lo, hi = np.maximum(hit - WINDOW, bounds[of]), np.minimum(hit + WINDOW, bounds[of + 1] - 1)
    text_start, text_end = at[of], at[of + 1] - 1
    left = np.where(lo == bounds[of], text_start, starts[lo])
    right = np.where(hi == bounds[of + 1] - 1, text_end, ends[hi])
    quoted = (marks[starts[hit]] > marks[left]) & (marks[right] > marks[ends[hit]])
    hits_before = np.concatenate([[0], np.cumsum(code >= 0)])
    near = np.log1p(hits_before[hi + 1] - hits_before[lo] - 1)
    wrong, value = code[hit] % 2 == 1, weights[code[hit]]
    count = lambda x: np.bincount(of, weights=x.astype(float), minlength=len(texts))
    out[:, 0] = np.log1p(count(~quoted & ~wrong))
    out[:, 1] = np.log1p(count(~quoted & wrong))
    out[:, 2] = np.log1p(count(quoted))
    total = count(np.where(quoted, 0.25, 1.0) * value)
    out[:, 3] = np.sign(total) * np.log1p(np.abs(total))
    np.maximum.at(out[:, 4], of, np.where(quoted, 0.25, 1.0) * value)
    out[:, 5] = np.log1p(count(near * ~quoted * (value > 0)))
    out[:, 6] = np.log1p(100 * count(value > 0) / np.maximum(n, 1))
    pairs = np.unique(of * (len(weights) // 2 + 1) + code[hit] // 2)
    out[:, 7] = np.log1p(np.bincount(pairs // (len(weights) // 2 + 1), minlength=len(texts)))
    return out


# ---------------------------------------------------------------------- learning


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool]]:
    """Words and stems of a labelled sample (text, toxic) that mark toxic documents, strongest first.

    Counts are made in Spark; only terms of several toxic documents, mostly toxic, come to the driver.
    """
    totals = sample.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = int(totals.t or 0), int((totals.n or 0) - (totals.t or 0))
    if not toxic or not clean:
        return []
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    stems = [F.transform(F.filter(words, lambda w, k=k: F.char_length(w) > k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEM_LENGTHS]
    terms = sample.select("toxic", F.explode(F.array_distinct(F.concat(words, *stems))).alias("term"))
    least = max(3, toxic // 400)
    counted = terms.groupBy("term").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    ratio = (F.col("t") + 0.1) / F.lit(toxic) / ((F.col("n") - F.col("t") + 0.5) / F.lit(clean))
    gain = F.col("t") / F.lit(toxic) - (F.col("n") - F.col("t")) * 3 / F.lit(clean)
    found = counted.filter(F.col("t") >= least).filter(ratio >= 12).orderBy(F.desc(gain), "term").collect()  # of a bounded sample
    chosen: list[tuple[str, bool]] = []
    stems_chosen: set[str] = set()
    for r in found:
        term, stem = r.term.rstrip("*"), r.term.endswith("*")
        # a term that a chosen stem covers adds nothing
        if not any(term[:k] in stems_chosen for k in range(1, len(term) + 1)):
            chosen.append((term, stem))
            if stem:
                stems_chosen.add(term)
    return chosen


class Model:
    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.automaton = Automaton([(t.encode("utf-8"), s) for t, s in terms]) if terms else None
        self.weights = np.zeros(2 * len(terms) + 2)
        self.linear = np.zeros(len(FEATURES) + 1)
        self.linear[-1] = -3.0

    def raw(self, texts: list[bytes]) -> np.ndarray:
        return features(texts, self.automaton, self.weights) if self.automaton else np.zeros((len(texts), len(FEATURES)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(texts) @ self.linear[:-1] + self.linear[-1], -30, 30)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = -2
    ridge = np.diag([l2 * len(y)] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _fit_rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A model in which no hit speaks for a text: features of negative weight are left out and the rest fitted again."""
    use = np.arange(x.shape[1])
    while True:
        w = _fit_logistic(x[:, use], y)
        if (w[:-1] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[use], out[-1] = w[:-1], w[-1]
            return out
        use = use[w[:-1] >= 0]


def _codes(spread):
    """Of Arrow batches (text, toxic): each text's distinct hit codes."""

    def run(batches):
        automaton = spread.value.automaton
        for b in batches:
            toxic = b.column(1).to_pylist()
            for lo, hi, texts in parts(b.column(0)):
                for t, y in zip(texts, toxic[lo:hi], strict=True):
                    low = _LOWER[np.frombuffer(b"\n" + t + b"\n", dtype=np.uint8)]
                    edge = np.diff(_mask_marks(low)[0].view(np.int8))
                    code = automaton.walk(low, np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1)
                    code = np.unique(code[code >= 0])
                    if len(code):
                        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array([y] * len(code), pa.int32())], ["code", "toxic"])

    return run


def _featured(spread):
    def run(batches):
        for b in batches:
            for lo, hi, texts in parts(b.column(0)):
                rows = spread.value.raw(texts)
                yield pa.RecordBatch.from_arrays([pa.array(rows.tolist(), pa.list_(pa.float64())), *(c.slice(lo, hi - lo) for c in b.columns[1:])], ["x", "toxic", "judge"])

    return run


def _fit_terms(terms: list[tuple[str, bool]], learn: DataFrame, judge: DataFrame | None = None) -> tuple[Model, float]:
    """Weights of the hits of these terms and the model over (text, toxic) rows; and its mean log loss on `judge`."""
    spark, model = learn.sparkSession, Model(terms)
    totals = learn.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    counted = learn.mapInArrow(_codes(spark.sparkContext.broadcast(model)), "code int, toxic int")
    seen = {r.code: (r.t, r.n) for r in counted.groupBy("code").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect()}  # two codes a term
    toxic, clean = totals.t, totals.n - totals.t
    log_odds = lambda t, n: np.log((t + 0.5) / (toxic + 1)) - np.log((n - t + 0.5) / (clean + 1))
    for i in range(len(terms)):
        exact, wrong = seen.get(2 * i, (0, 0)), seen.get(2 * i + 1, (0, 0))
        model.weights[2 * i] = log_odds(*exact) if exact[1] else 0.0
        # a misspelling that the sample lacks counts like the term, less the doubt
        model.weights[2 * i + 1] = max(0.0, log_odds(*wrong)) if wrong[1] >= 3 else 0.6 * max(0.0, model.weights[2 * i])
    both = learn.withColumn("judge", F.lit(0)) if judge is None else learn.withColumn("judge", F.lit(0)).unionByName(judge.withColumn("judge", F.lit(1)))
    rows = both.mapInArrow(_featured(spark.sparkContext.broadcast(model)), "x array<double>, toxic int, judge int").collect()  # eight numbers a row of the sample
    x, y, judges = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], dtype=float), np.array([r.judge == 1 for r in rows])
    model.linear = _fit_rising(x[~judges], y[~judges])
    z = np.clip(x[judges] @ model.linear[:-1] + model.linear[-1], -30, 30)
    return model, float(np.mean(np.logaddexp(0, z) - y[judges] * z)) if judges.any() else 0.0


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Lexicon, weights of its hits, and the model, from about `fit_rows` rows of (doc_id, text, toxic), toxic 0 or 1.

    The number of terms is doubled while a part of the sample that they weren't learned from is predicted better.
    """
    some = labelled.filter("toxic is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    some = bounded_sample(some, some.count(), fit_rows, ["doc_id", "text"]).withColumn("judge", F.pmod(F.xxhash64("text", "doc_id"), F.lit(JUDGES)) == 0)
    kept = some.repartition(16, "doc_id").persist()
    sample, learn, judge = (x.select("text", "toxic") for x in (kept, kept.filter("not judge"), kept.filter("judge")))
    terms = learn_lexicon(learn)
    n, best, least = min(FIRST_TERMS, len(terms)), 0, np.inf
    while terms and n > best:
        loss = _fit_terms(terms[:n], learn, judge)[1]
        if loss >= (1 - LEAST_FALL) * least:
            break
        best, least, n = n, loss, min(2 * n, len(terms))
    terms = learn_lexicon(sample)[: best or FIRST_TERMS]
    model = _fit_terms(terms, sample)[0] if terms else Model([])
    kept.unpersist()
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): probability that a text is toxic. Null and empty texts have no hits; repeated rows score alike."""
    spread = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for lo, hi, texts in parts(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(spread.value.score(texts))], ["doc_id", "score"])

    return docs_of(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter("toxic is not null").filter(~held_out)
    some = bounded_sample(labels, labels.count(), FIT_ROWS, ["doc_id"])  # bounded, so its broadcast is
    model = fit(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
