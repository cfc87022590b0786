"""Language of texts by a linear-chain conditional random field over their words.

Features of a word: hashed runs of 1 to 4 bytes (those at its ends are its short affixes), affixes of 5 and 6,
the word itself, and whether it is in the lexicon of each language. Labels are languages, and the learned
transitions say how seldom a text changes its language from one word to the next. Forward-backward gives
every word of a whole text, code-switched or not, a distribution over languages; a text's language is the
one with the largest sum, its score that sum's share.

Learning is on a bounded sample of labelled texts: pieces drawn from whole texts, of which half are spliced
to pieces of other texts, so that changes are seen. Labels come from `lang` alone, and neither `lang`, source nor doc_id
is an input of a prediction. Prediction is one pass without a shuffle. A text is cut into blocks of words whose transfer
matrices are multiplied side by side, so a long text costs as many steps as it has blocks, not words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import docs_of, eights, mix, only, padded, parts, range_hashes
from .toxicity import _mask_marks

#: Texts that the field is learned from, about; texts of each language at least, where there are as many; languages at most (the commonest).
FIT_ROWS = 6000
LEAST_ROWS = 300
MOST_LANGUAGES = 200
#: Pieces drawn from a text, and words of a piece at most.
PIECES, PIECE = 6, 16
BUCKETS = 1 << 16
#: A lexicon's words occur this often in the sample, and so many times as often in its language as in others.
LEXICON_COUNT, LEXICON_ODDS = 3, 8.0
ROUNDS, PACE, L2 = 80, 0.25, 1e-5
#: Words of a block, and words whose features are made at a time.
BLOCK = 32
SLICE = 50_000
UNKNOWN = "und"
_U = np.uint64
_DIGIT = np.isin(np.arange(256), [*b"0123456789"])


# ------------------------------------------------------------------ features


def words_of(texts: list[bytes]):
    """Of lower-cased texts: all bytes, each word's range in them, and the range of each text's words. Words are runs of letters."""
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), dtype=np.uint8)
    edge = np.diff((_mask_marks(data)[0] & ~_DIGIT[data]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    at = 1 + np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)])
    return data, starts, ends, np.searchsorted(starts, at)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, one word's after another's, and how many each has."""
    size = ends - starts + 2
    first = np.cumsum(size) - size
    marked = np.full(int(size.sum()), 1, dtype=np.uint8)
    inner = np.repeat(starts - first - 1, size) + np.arange(len(marked))
    inside = np.ones(len(marked), dtype=bool)
    inside[first], inside[first + size - 1] = False, False
    marked[inside] = data[inner[inside]]
    marked[first + size - 1] = 2
    word = np.repeat(np.arange(len(size)), size)
    left = np.repeat(first + size, size) - np.arange(len(marked))  # bytes of the word from here on
    read = eights(padded(marked))[: len(marked)]
    found, of = [range_hashes(data, starts, ends, 5)], [np.arange(len(size))]
    for n in range(1, 7):
        here = left >= n
        if n > 4:  # affixes alone
            here &= (left == n) | (np.diff(word, prepend=-1) > 0)
        at = np.flatnonzero(here)
        found.append(mix((read[at] & _U((1 << 8 * n) - 1)) + _U(n << 56)))
        of.append(word[at])
    of, found = np.concatenate(of), np.concatenate(found)
    order = np.argsort(of, kind="stable")
    return (found[order] >> _U(48)).astype(np.int64) % BUCKETS, np.bincount(of, minlength=len(size))


class Field:
    """Languages, weights of features (a column a language), lexicons, transitions and beginnings, all as logarithms."""

    def __init__(self, languages: list[str]):
        n = len(languages)
        self.languages = languages
        self.weights = np.zeros((BUCKETS, n), dtype=np.float32)
        self.known = np.zeros(0, dtype=_U)  # words of lexicons, sorted
        self.lexicon = np.zeros((0, n))
        self.lexicon_weights = np.zeros((n, n))
        self.bias = np.zeros(n)
        self.transitions = np.zeros((n, n))
        self.begin = np.zeros(n)

    def listed(self, hashes: np.ndarray) -> np.ndarray:
        """Which lexicons hold each word."""
        out = np.zeros((len(hashes), len(self.languages)))
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            there = self.known[at] == hashes
            out[there] = self.lexicon[at[there]]
        return out

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The score of each language for each word; a word that repeats is scored once."""
        hashes = range_hashes(data, starts, ends)
        names, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        out = np.empty((len(names), len(self.languages)))
        for lo in range(0, len(names), SLICE):
            some = at[lo : lo + SLICE]
            column, n = features(data, starts[some], ends[some])
            total = np.add.reduceat(self.weights[column], np.cumsum(n) - n, axis=0)
            out[lo : lo + SLICE] = total / np.sqrt(n)[:, None] + self.listed(names[lo : lo + SLICE]) @ self.lexicon_weights + self.bias
        return out[back]


# ---------------------------------------------------------- forward-backward


def _unit(x: np.ndarray, axes) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-300)


def marginals(score: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """P(language) of each word, given all words of its text: forward-backward, block by block.

    `bounds` are the ends of the texts among the words, from 0 on.
    """
    n, width = score.shape
    if not n:
        return score
    e = np.exp(score - score.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    start = np.broadcast_to(_unit(np.exp(begin - begin.max()), 0), (width, width))  # as a move out of anything
    words = np.diff(bounds)
    blocks = -(-words // BLOCK)
    text = np.repeat(np.arange(len(words)), blocks)
    number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = bounds[text] + number * BLOCK
    size = np.minimum(BLOCK, bounds[text + 1] - first)
    moves = lambda at, i: np.where((number[at] + i == 0)[:, None, None], start, move)
    inside = [np.flatnonzero(size > i) for i in range(int(size.max()))]
    whole = np.broadcast_to(np.eye(width), (len(text), width, width)).copy()
    for i, at in enumerate(inside):
        whole[at] = _unit((whole[at] @ moves(at, i)) * e[first[at] + i][:, None, :], (1, 2))
    # what each block begins with, and what follows it
    before, after = np.full((len(text), width), 1 / width), np.full((len(text), width), 1 / width)
    for k in range(1, int(number.max()) + 1):
        at = np.flatnonzero(number == k)
        before[at] = _unit((before[at - 1][:, None, :] @ whole[at - 1])[:, 0], 1)
    last = blocks[text] - 1 - number
    for k in range(1, int(last.max()) + 1):
        at = np.flatnonzero(last == k)
        after[at] = _unit((whole[at + 1] @ after[at + 1][:, :, None])[:, :, 0], 1)
    out = np.empty_like(e)
    now = before
    for i, at in enumerate(inside):
        now[at] = _unit((now[at][:, None, :] @ moves(at, i))[:, 0] * e[first[at] + i], 1)
        out[first[at] + i] = now[at]
    now = after
    for i in range(len(inside) - 1, -1, -1):
        at = inside[i]
        word = first[at] + i
        out[word] = _unit(out[word] * now[at], 1)
        if i:
            now[at] = _unit((move @ (e[word] * now[at])[:, :, None])[:, :, 0], 1)
    return out


# ------------------------------------------------------------------ learning


def _chains(score: np.ndarray, at: np.ndarray, y: np.ndarray, transitions: np.ndarray, begin: np.ndarray):
    """Mean loss a word of sequences (words `at`, languages `y`, -1 after the end), and its slopes by score, transitions and beginnings."""
    there = at >= 0
    n, steps = at.shape
    e = np.where(there[:, :, None], score[at], 0.0)
    top = e.max(axis=2)
    p = np.exp(e - top[:, :, None])
    move = np.exp(transitions)
    forward, scale = np.zeros_like(p), np.ones((n, steps))
    for i in range(steps):
        a = p[:, i] * (np.exp(begin) if i == 0 else forward[:, i - 1] @ move)
        scale[:, i] = np.where(there[:, i], a.sum(axis=1), 1.0)
        forward[:, i] = np.where(there[:, i, None], a / scale[:, i, None], forward[:, i - 1] if i else 0)
    back, by_move = np.ones((n, p.shape[2])), np.zeros_like(transitions)
    by_score = np.zeros_like(score)
    for i in range(steps - 1, -1, -1):
        here = np.flatnonzero(there[:, i])
        gain = forward[here, i] * back[here]
        gain[np.arange(len(here)), y[here, i]] -= 1
        np.add.at(by_score, at[here, i], gain)
        if i:
            next_ = p[here, i] * back[here] / scale[here, i, None]
            by_move += move * (forward[here, i - 1].T @ next_)
            np.add.at(by_move, (y[here, i - 1], y[here, i]), -1)
            back[here] = next_ @ move.T
        else:
            by_begin = gain.sum(axis=0)
    right = np.take_along_axis(e, np.maximum(y, 0)[:, :, None], 2)[:, :, 0]
    paths = begin[y[:, 0]].sum() + transitions[y[:, :-1], y[:, 1:]][there[:, 1:]].sum() + right[there].sum()
    loss = (np.log(scale) + top)[there].sum() - paths
    words = there.sum()
    return loss / words, by_score / words, by_move / words, by_begin / words


def learn(pieces: list[tuple[str, bytes]], rounds: int = ROUNDS, seed: int = 29) -> Field:
    """A field from pieces of texts (language, lower-cased words joined by spaces), by Adam steps over all of them."""
    languages = sorted({lang for lang, _ in pieces})
    field, rng = Field(languages), np.random.default_rng(seed)
    label = np.array([languages.index(lang) for lang, _ in pieces])
    data, starts, ends, bounds = words_of([x for _, x in pieces])
    hashes = range_hashes(data, starts, ends)
    names, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    y_word = np.repeat(label, np.diff(bounds))
    # lexicons: words that mark a language
    seen = np.zeros((len(names), len(languages)))
    np.add.at(seen, (word, y_word), 1)
    rate = (seen + 0.1) / (seen.sum(axis=0) + 1)
    others = (seen.sum(axis=1, keepdims=True) - seen + 0.1) / (seen.sum() - seen.sum(axis=0) + 1)
    mark = (seen >= LEXICON_COUNT) & (rate >= LEXICON_ODDS * others)
    field.known, field.lexicon = names[mark.any(axis=1)], mark[mark.any(axis=1)].astype(float)
    column, n = features(data, starts[first], ends[first])
    begins, of, share = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n), 1 / np.sqrt(n)
    listed = field.listed(names)
    # sequences: each piece, half of them followed by one of another text
    order = rng.permutation(len(pieces))
    other = np.where(rng.random(len(pieces)) < 0.5, rng.permutation(len(pieces)), -1)
    spans = [[np.arange(bounds[a], bounds[a + 1])] + ([np.arange(bounds[b], bounds[b + 1])] if b >= 0 else []) for a, b in zip(order.tolist(), other.tolist(), strict=True)]
    spans = [x for x in map(np.concatenate, spans) if len(x)]
    at = np.full((len(spans), max(map(len, spans), default=1)), -1)
    for i, x in enumerate(spans):
        at[i, : len(x)] = x
    y = np.where(at >= 0, y_word[at] if len(y_word) else 0, -1)
    at = np.where(at >= 0, word[at] if len(word) else 0, -1)
    shape = [field.weights, field.lexicon_weights, field.bias, field.transitions, field.begin]
    mean, square = [np.zeros(x.shape) for x in shape], [np.zeros(x.shape) for x in shape]
    for step in range(1, rounds + 1 if spans else 1):
        score = np.add.reduceat(field.weights[column], begins, axis=0) * share[:, None] + listed @ field.lexicon_weights + field.bias
        _, by_score, by_move, by_begin = _chains(score, at, y, field.transitions, field.begin)
        scaled = by_score * share[:, None]
        slopes = [np.stack([np.bincount(column, weights=scaled[of, k], minlength=BUCKETS) for k in range(len(languages))], axis=1), listed.T @ by_score, by_score.sum(axis=0), by_move, by_begin]
        for x, m, s, g in zip(shape, mean, square, slopes, strict=True):
            g = g + L2 * x
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            x -= (PACE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8) * (1 - 0.9 * step / rounds)).astype(x.dtype)
    return field


def _pieces(batches):
    """Of (lang, lower-cased text): PIECES runs of words of each text, at places that its hash gives."""
    for b in batches:
        langs = b.column(0).to_pylist()
        for lo, hi, texts in parts(b.column(1)):
            data, starts, ends, bounds = words_of(texts)
            raw, out = data.tobytes(), []
            for i, lang in enumerate(langs[lo:hi]):
                a, z = int(bounds[i]), int(bounds[i + 1])
                if a < z:
                    seed = range_hashes(data, starts[a : a + 1], ends[z - 1 : z], 3)[0]
                    draws = mix(np.arange(2 * PIECES, dtype=_U) + seed)
                    for place, size in zip(draws[:PIECES].tolist(), draws[PIECES:].tolist(), strict=True):
                        at = a + place % max(1, z - a - 3)
                        some = range(at, min(z, at + 4 + size % (PIECE - 3)))
                        out.append((lang, b" ".join(raw[starts[w] : ends[w]] for w in some)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], ["lang", "words"])


def fit(df: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field | None:
    """A field learned from about `fit_rows` labelled rows, drawn by a hash; rare languages are drawn more often. None where nothing is labelled."""
    docs = only(df, lang=F.col(f"`{lang_col}`").cast("string"), text=F.lower(F.col(f"`{text_col}`").cast("string")), doc_id=F.col(f"`{id_col}`").cast("string")).filter("lang is not null and text is not null")
    counts = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    total = sum(r["count"] for r in counts)
    if not total:
        return None
    shares = [(r["lang"], int(min(1.0, max(fit_rows / total, LEAST_ROWS / r["count"])) * (1 << 30))) for r in counts]
    rates = F.broadcast(df.sparkSession.createDataFrame(shares, "lang string, most long"))  # MOST_LANGUAGES rows
    some = docs.join(rates, "lang").filter(F.pmod(F.xxhash64(F.lit(41), "doc_id", "text"), F.lit(1 << 30)) < F.col("most"))
    drawn = some.select("lang", "text").mapInArrow(_pieces, "lang string, words binary").collect()  # PIECES short runs of words a row of the sample
    return learn(sorted((r["lang"], bytes(r["words"])) for r in drawn)) if drawn else None


def label_words(field: Field, texts: list[str]) -> list[list[tuple[str, str, float]]]:
    """Each text's words with their languages and the probabilities of these."""
    raw = [t.lower().encode("utf-8") for t in texts]
    data, starts, ends, bounds = words_of(raw)
    p = marginals(field.emissions(data, starts, ends), bounds, field.transitions, field.begin) if len(starts) else np.zeros((0, len(field.languages)))
    said = [(data[a:z].tobytes().decode("utf-8", "replace"), field.languages[int(k)], float(row[k])) for a, z, row, k in zip(starts, ends, p, p.argmax(axis=1), strict=True)]
    return [said[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _lettered(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def _predicted(spread):
    def run(batches):
        field: Field = spread.value
        start = _unit(np.exp(field.begin - field.begin.max()), 0)
        for b in batches:
            for lo, hi, texts in parts(pc.utf8_lower(b.column(1))):
                data, starts, ends, bounds = words_of(texts)
                n = np.diff(bounds)
                total = np.tile(start, (len(texts), 1))  # of texts without words
                if len(starts):
                    p = marginals(field.emissions(data, starts, ends), bounds, field.transitions, field.begin)
                    total[n > 0] = np.add.reduceat(p, bounds[:-1][n > 0], axis=0) / n[n > 0][:, None]
                said = total.argmax(axis=1)
                ok = [_lettered(t) for t in texts]
                langs = [field.languages[k] if good else UNKNOWN for k, good in zip(said.tolist(), ok, strict=True)]
                score = np.where(ok, np.clip(total.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def predict(df: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the language of each text and its share of the words' probabilities.

    `und` with score 0 if a text is null or holds no letter, and for all texts where no field was learned. Letters without a word (signs
    that count as letters) get the likeliest beginning. Equal shares go to the language first in order. Repeated rows are predicted alike.
    """
    docs = docs_of(df, id_col, text_col)
    if field is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return docs.mapInArrow(_predicted(df.sparkSession.sparkContext.broadcast(field)), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    field = fit(docs.filter(~held_out(F.col("doc_id"))))
    said = predict(docs, field)
    return said.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
