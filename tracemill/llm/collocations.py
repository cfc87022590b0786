"""Phrase collocations per language, counted with weighted acyclic automata.

Counting goes by phrase length. Every task reads whole texts, keeps the k-word windows whose two
windows of k - 1 words are frequent (a filter of those that the length before found; what it lets through
by error is counted and found rare), sorts them run by run, and builds from each sorted run one count
transducer per language and prefix range: words are labels, the weights along a path add up to the count,
and states with equal continuations are one. The transducers of a range meet in one task, which unites
them, sums the weights and keeps what is frequent; nothing is dropped before its whole count is known.

Looking up. A phrase's first and last parts lie in other ranges. Every range sends acceptors of the parts it
asks for to the ranges that hold them, weighted with the count of the longest asker, and composes there:
the answers are the parts' counts, and parts that an equally frequent longer phrase contains are marked.

Scale: a prefix range is a range of hashes of the first word; a phrase that occurs more often than a range
should hold (`SPAN`) is divided again by the word after it, so a hot word or phrase fills no single task.
The table of such hot phrases has MOST_HOT entries a length at most. Words travel as 64-bit hashes; every
distinct word of a language is compared with those of its hash, and another seed is taken if two share one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, only, parts, range_hashes, stored
from .exact_dedup import bloom_filter, holds
from .substring_dedup import pack, unpack

LONGEST = 5
LEAST = 100
MOST = 2000
#: Share (in hundredths) of a phrase's count that a longer phrase must have to drop it.
INSIDE = 100
#: Occurrences of a prefix range, about, and ranges (so hot phrases of a length, too) at most.
SPAN = 1 << 20
MOST_HOT = 1 << 16
#: Windows of a language that a task gathers before it sorts them, and distinct words that it holds.
RUN = 1 << 20
HELD_WORDS = 400_000
_U = np.uint64
_BREAK = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
#: 0: part of a word, 1: between words, 2: between pieces.
_KIND = np.where(_BREAK, 2, np.isin(np.arange(256), [0x20, 0x09])).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)


# ------------------------------------------------------------------- automata


def _narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes that hold them."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def _ramps(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1 … of each pair, size numbers long."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


class Transducer:
    """A count for each phrase of k words (64-bit labels): the sum of the weights along its path, zero paths being absent.

    `levels[d]` has (arcs of each state, label, weight, target) at depth d; all phrases end in one state.
    """

    def __init__(self, labels: np.ndarray, levels: list[tuple[np.ndarray, ...]]):
        self.labels = labels
        self.levels = [tuple(x.astype(np.int64) for x in level) for level in levels]

    def dump(self) -> bytes:
        return pack(self.labels, *(_narrow(x) for level in self.levels for x in level))

    @classmethod
    def load(cls, body: bytes) -> Transducer:
        labels, *rest = unpack(body)
        return cls(labels, [tuple(rest[i : i + 4]) for i in range(0, len(rest), 4)])

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """All phrases in order (a row of labels each) and their counts."""
        state, count, columns = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), []
        for size, label, weight, target in self.levels:
            first = np.cumsum(size) - size
            n = size[state]
            arc = _ramps(first[state], n)
            columns = [np.repeat(c, n) for c in columns] + [self.labels[label[arc]]]
            count, state = np.repeat(count, n) + weight[arc], target[arc]
        return np.stack(columns, axis=1), count

    def find(self, rows: np.ndarray) -> np.ndarray:
        """The count of each phrase, -1 where there is none: both walk in step."""
        state, count, ok = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64), np.full(len(rows), len(self.labels) > 0)
        for d, (size, label, weight, target) in enumerate(self.levels):
            if not ok.any():
                break
            code = np.minimum(np.searchsorted(self.labels, rows[:, d]), len(self.labels) - 1)
            ok &= self.labels[code] == rows[:, d]
            arcs = np.repeat(np.arange(len(size)), size) << 32 | label
            way = state << 32 | code
            arc = np.minimum(np.searchsorted(arcs, way), len(arcs) - 1)
            ok &= arcs[arc] == way
            count, state = count + weight[arc], np.where(ok, target[arc], 0)
        return np.where(ok, count, -1)


class Builder:
    """Builds a transducer from sorted blocks of different phrases, one after another.

    A block's phrases are frozen but for those that begin like its last one. Of each state the least weight moves to
    the arcs that lead there, and a register holds all states, so equal ones (128 bits of their arcs) are made once.
    """

    def __init__(self, k: int):
        self.k = k
        self.register: list[dict[tuple[int, int], int]] = [{} for _ in range(k)]
        self.made: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(k)]
        self.open: tuple[np.ndarray, np.ndarray] | None = None

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        if not len(rows):
            return
        if self.open is not None:
            rows, counts = np.concatenate([self.open[0], rows]), np.concatenate([self.open[1], counts])
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if last:
            self._freeze(rows[:last], counts[:last])
        self.open = rows[last:], counts[last:]

    def _freeze(self, rows: np.ndarray, weight: np.ndarray) -> None:
        target = np.zeros(len(rows), dtype=np.int64)
        for d in range(self.k - 1, 0, -1):
            begin = np.flatnonzero(np.concatenate([[True], (rows[1:, :d] != rows[:-1, :d]).any(axis=1)]))
            size = np.diff(np.append(begin, len(rows)))
            least = np.minimum.reduceat(weight, begin)
            target = self._states(d, rows[:, d], weight - np.repeat(least, size), target, begin, size)
            rows, weight = rows[begin], least
        self.made[0].append((np.array([len(rows)]), rows[:, 0], weight, target))

    def _states(self, d: int, label: np.ndarray, weight: np.ndarray, target: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The states with these arcs: those that are there already, and new ones."""
        place = (np.arange(len(label)) - np.repeat(begin, size)).astype(_U)
        arc = mix(mix(label + place) + weight.astype(_U) * _U(0x9E3779B97F4A7C15) + target.astype(_U) * _U(0xD1342543DE82EF95))
        names = [np.add.reduceat(x, begin) + size.astype(_U) for x in (arc, mix(arc ^ _U(0x2545F4914F6CDD1D)))]
        order = np.lexsort(names)
        fresh = np.concatenate([[True], (names[0][order][1:] != names[0][order][:-1]) | (names[1][order][1:] != names[1][order][:-1])])
        some, register = order[fresh], self.register[d]
        known, ids = len(register), np.empty(int(fresh.sum()), dtype=np.int64)
        for i, name in enumerate(zip(names[0][some].tolist(), names[1][some].tolist(), strict=True)):
            ids[i] = register.setdefault(name, len(register))
        new = some[ids >= known]  # in the order of their numbers
        arcs = _ramps(begin[new], size[new])
        self.made[d].append((size[new], label[arcs], weight[arcs], target[arcs]))
        out = np.empty(len(size), dtype=np.int64)
        out[order] = ids[np.cumsum(fresh) - 1]
        return out

    def finish(self) -> Transducer:
        if self.open is not None:
            self._freeze(*self.open)
        none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        levels = [tuple(np.concatenate(x) for x in zip(*(made or [none]), strict=True)) for made in self.made]
        labels, codes = np.unique(np.concatenate([x[1] for x in levels]), return_inverse=True)
        codes = np.split(codes, np.cumsum([len(x[1]) for x in levels])[:-1])
        levels = [(size, code, weight, target) for (size, _, weight, target), code in zip(levels, codes, strict=True)]
        levels[0] = (np.array([len(levels[0][1])]), *levels[0][1:])
        return Transducer(labels, levels)


def built(rows: np.ndarray, counts: np.ndarray) -> Transducer:
    builder = Builder(rows.shape[1])
    builder.add(rows, counts)
    return builder.finish()


def _merged(rows: np.ndarray, counts: np.ndarray, add=np.add) -> tuple[np.ndarray, np.ndarray]:
    """Phrases in order, each once, the counts of equal ones added (or the largest taken)."""
    if not len(rows):
        return rows, counts
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    begin = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[begin], add.reduceat(counts[order], begin)


def united(bodies, add=np.add) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of several transducers with the sums (or the largest) of their weights, a few of them at a time."""
    rows, counts, held, n = None, None, [], 0
    for body in [*bodies, None]:
        if body is not None:
            held.append(Transducer.load(body).phrases())
            n += len(held[-1][0])
        if held and (body is None or n > max(RUN, 2 * len(rows) if rows is not None else 0)):
            rows, counts = _merged(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), add)
            held, n = [(rows, counts)], 0
    return rows, counts


# -------------------------------------------------------------- words and ranges

_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(schema: str, *columns) -> pa.RecordBatch:
    """Columns as a batch of this Spark schema; a single value stands in every row."""
    fields = [x.split() for x in schema.split(", ")]
    n = max((len(c) for c in columns if isinstance(c, list | tuple | np.ndarray | pa.Array)), default=1)
    full = [c if isinstance(c, list | tuple | np.ndarray | pa.Array) else [c] * n for c in columns]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(full, fields, strict=True)], [name for name, _ in fields])


def names_of(lang: str, columns) -> list[np.ndarray]:
    """A 64-bit name of the first 1, 2 … words of each phrase, from one column of hashes per word."""
    raw = np.frombuffer(lang.encode("utf-8"), dtype=np.uint8)
    out, name = [], range_hashes(raw, np.array([0]), np.array([len(raw)]), 7)
    for c in columns:
        name = mix((name + _U(0x9E3779B97F4A7C15)) * _U(0xD1342543DE82EF95) + c)
        out.append(name)
    return out


class Ranges:
    """The prefix range of a phrase: the leading bits of its first word, and of the word after each hot prefix."""

    def __init__(self, words: dict[str, int]):
        """`words`: how many each language has."""
        self.span = max(SPAN, sum(words.values()) // MOST_HOT)
        self.bits = {lang: math.ceil(math.log2(max(1, n / self.span))) for lang, n in words.items()}
        self.hot: list[tuple[np.ndarray, np.ndarray]] = []  # of the prefixes of 1, 2 … words: names and bits

    def add_hot(self, names: list[int], counts: list[int]) -> None:
        names, counts = np.array(names, dtype=np.int64).view(_U), np.array(counts, dtype=np.float64)
        order = np.argsort(names)
        self.hot.append((names[order], np.ceil(np.log2(np.maximum(counts[order] / self.span, 2))).astype(np.int64)))

    def of(self, lang: str, rows: np.ndarray) -> np.ndarray:
        bits = self.bits[lang]
        out = rows[:, 0] >> _U(64 - bits) if bits else np.zeros(len(rows), dtype=_U)
        prefixes = names_of(lang, rows.T)
        for d in range(1, rows.shape[1]):
            names, bits = self.hot[d - 1]
            if len(names):
                at = np.minimum(np.searchsorted(names, prefixes[d - 1]), len(names) - 1)
                hot = names[at] == prefixes[d - 1]
                part = rows[hot, d] >> (64 - bits[at[hot]]).astype(_U)
                out[hot] = mix(prefixes[d - 1][hot] + part)
        return out.view(np.int64)


def _cells(batch: pa.RecordBatch):
    """(language, chunks of its texts) of a batch of (lang, text)."""
    langs = batch.column(0)
    for lang in langs.unique().to_pylist():
        yield lang, batch.column(1).take(pa.array(np.flatnonzero(np.array([x == lang for x in langs.to_pylist()]))))


def _words(texts: list[bytes]):
    """Lower-cased bytes, the ranges of the words in them, and where pieces end."""
    data = _LOWER[np.frombuffer(b"\n".join([b"", *texts, b""]), dtype=np.uint8)]
    kind = _KIND[data]
    edge = np.flatnonzero(np.diff((kind > 0).view(np.int8)))
    return data, edge[::2] + 1, edge[1::2] + 1, np.flatnonzero(kind > 1)


WORD_ROWS = "lang string, h long, word binary, n long"


class _Counts:
    """Counts of different words (hash, word, count), chunk by chunk."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.size = 0

    def add(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        names, at, n = np.unique(h, return_index=True, return_counts=True)
        size = ends[at] - starts[at]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        self.held.append((names, pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[_ramps(starts[at], size)])]), n))
        self.size += len(at)
        if self.size > 2 * HELD_WORDS:
            self.held = [self.merged()]
            self.size = len(self.held[0][0])

    def merged(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Each word once; where words share a hash, all rows as they are, which shows later."""
        h, words, n = np.concatenate([x[0] for x in self.held]), pa.concat_arrays([x[1] for x in self.held]), np.concatenate([x[2] for x in self.held])
        names, at, back = np.unique(h, return_index=True, return_inverse=True)
        some = words.take(pa.array(at))
        if not pc.all(pc.equal(some.take(pa.array(back)), words), min_count=0).as_py():
            return h, words, n
        return names, some, np.bincount(back, weights=n, minlength=len(names)).astype(np.int64)


def _word_counts(seed: int):
    """(lang, hash, word, count) of a partition; a row without hash counts all words of the language."""

    def run(batches):
        held: dict[str, _Counts] = {}
        total: dict[str, int] = {}

        def send(lang):
            h, words, n = held.pop(lang).merged()
            for at in range(0, len(h), HELD_WORDS // 4):
                some = slice(at, at + HELD_WORDS // 4)
                yield _batch(WORD_ROWS, [lang] * len(h[some]), h[some].view(np.int64), words[some], n[some])

        for b in batches:
            for lang, column in _cells(b):
                for _, _, texts in parts(column):
                    data, starts, ends, _ = _words(texts)
                    total[lang] = total.get(lang, 0) + len(starts)
                    held.setdefault(lang, _Counts()).add(range_hashes(data, starts, ends, seed), data, starts, ends)
                    if sum(x.size for x in held.values()) > 4 * HELD_WORDS or held[lang].size > HELD_WORDS and len(held[lang].held) == 1:
                        yield from send(max(held, key=lambda x: held[x].size))
        for lang in list(held):
            yield from send(lang)
        for lang, n in total.items():
            yield _batch(WORD_ROWS, lang, None, None, n)

    return run


def _counted_words(docs: DataFrame, least: int) -> tuple[DataFrame, int]:
    """Words that occur `least` times or more (lang, h, word, f), the language's total in a row without h; and the seed of the hashes."""
    seed = 0
    while True:
        rows = docs.mapInArrow(_word_counts(seed), WORD_ROWS).groupBy("lang", "h").agg(F.sum("n").alias("f"), F.min("word").alias("word"), F.max("word").alias("other"))
        found = stored(rows.filter(F.col("h").isNull() | (F.col("f") >= least) | (F.col("word") != F.col("other"))), "words")
        if found.filter("word != other").isEmpty():
            return found.drop("other"), seed
        seed += 1


# --------------------------------------------------------------------- counting

LEVEL = "lang string, level int, range long, body binary"


def _blob_rows(ranges: np.ndarray, rows: np.ndarray, counts: np.ndarray):
    """(range, transducer) of phrases that are sorted by range and within it."""
    cut = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(rows) else []
    for lo, hi in zip(cut, [*cut[1:], len(rows)], strict=True):
        yield int(ranges[lo]), built(rows[lo:hi], counts[lo:hi]).dump()


def _sorted_run(lang: str, rows: np.ndarray, names: np.ndarray, spread: Ranges):
    """Windows (and their names) as ranges, phrases in order, and counts."""
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    twice = np.flatnonzero(same)
    if (rows[order[twice + 1]] != rows[order[twice]]).any():  # two phrases of one name
        rows, counts = _merged(rows, np.ones(len(rows), dtype=np.int64))
    else:
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        rows, counts = rows[order[begin]], np.diff(np.append(begin, len(order)))
    ranges = spread.of(lang, rows)
    order = np.lexsort((*rows.T[::-1], ranges))
    return ranges[order], rows[order], counts[order]


def _shards(k: int, seed: int, shared):
    """Transducers of a partition's frequent-looking windows of k words, by language and prefix range."""

    def run(batches):
        held: dict[str, list] = {}

        def send(lang):
            some = held.pop(lang)
            rows, names = np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some])
            ranges, bodies = zip(*_blob_rows(*_sorted_run(lang, rows, names, spread)), strict=True)
            yield _batch(LEVEL, lang, k, ranges, bodies)

        spread, bitmap = shared.value
        for b in batches:
            for lang, column in _cells(b):
                for _, _, texts in parts(column):
                    data, starts, ends, breaks = _words(texts)
                    n = len(starts) - k + 1
                    if n < 1:
                        continue
                    h = range_hashes(data, starts, ends, seed)
                    last = np.searchsorted(starts, breaks)  # the first word after each break
                    inside = np.ones(len(starts) + 1, dtype=bool)
                    for i in range(1, k):  # no window begins 1 to k - 1 words before one
                        inside[last[last >= i] - i] = False
                    some = np.flatnonzero(holds(bitmap, names_of(lang, [h[i : i + n + 1] for i in range(k - 1)])[-1]))
                    at = some[:-1][(np.diff(some) == 1) & inside[some[:-1]]]
                    if len(at):
                        rows = np.stack([h[at + i] for i in range(k)], axis=1)
                        held.setdefault(lang, []).append((rows, names_of(lang, rows.T)[-1]))
                    size = {x: sum(len(r) for r, _ in some) for x, some in held.items()}
                    for x in [x for x in size if size[x] >= RUN or sum(size.values()) >= 4 * RUN]:
                        yield from send(x)
        for lang in list(held):
            yield from send(lang)

    return run


def _united(k: int, least: int):
    """Of a range's transducers: one, of the phrases that occur `least` times or more."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        phrases, counts = united(rows["body"].to_pylist())
        keep = counts >= least
        bodies = [built(phrases[keep], counts[keep]).dump()] if keep.any() else []
        return pa.Table.from_batches([_batch(LEVEL, key[0].as_py(), k, key[1].as_py(), bodies)])

    return run


def _ranged_words(shared):
    def run(batches):
        for b in batches:
            langs, h = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).view(_U)
            out = np.zeros(len(h), dtype=np.int64)
            for lang in set(langs):
                at = np.flatnonzero([x == lang for x in langs])
                out[at] = shared.value.of(lang, h[at, None])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], ["lang", "h", "f", "range"])

    return run


def _word_ranges(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The transducer of a range of frequent words (lang, range, h, f)."""
    words, counts = _merged(rows["h"].to_numpy().view(_U)[:, None], rows["f"].to_numpy())
    return pa.Table.from_batches([_batch(LEVEL, key[0].as_py(), 1, key[1].as_py(), [built(words, counts).dump()])])


def _phrase_names(batches):
    """(name, count) of all phrases of transducers."""
    for b in batches:
        for lang, body in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
            rows, counts = Transducer.load(body).phrases()
            yield _batch("name long, f long", names_of(lang, rows.T)[-1].view(np.int64), counts)


def _prepared(level: DataFrame, spread: Ranges) -> bytes:
    """The filter of a level's phrases; its hot ones go to `spread`."""
    names = stored(level.mapInArrow(_phrase_names, "name long, f long"), "names")
    hot = names.filter(F.col("f") > spread.span).collect()  # MOST_HOT rows at most
    spread.add_hot([r["name"] for r in hot], [r["f"] for r in hot])
    return bloom_filter(names.select("name"), 1)


# -------------------------------------------------------------------- composing

REQUEST = "lang string, level int, range long, from_level int, from_range long, body binary"


def _requests(shared):
    """Acceptors of the first and last parts of a range's phrases, by the ranges that hold them.

    The parts that lack one word only weigh as much as the largest count of a phrase that holds them, others nothing.
    """

    def run(batches):
        spread = shared.value
        for b in batches:
            for lang, level, range_, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, counts = Transducer.load(body).phrases()
                for m in range(1, level):
                    weight = counts if m == level - 1 else np.zeros_like(counts)
                    some, most = _merged(np.concatenate([rows[:, :m], rows[:, level - m :]]), np.concatenate([weight, weight]), np.maximum)
                    ranges = spread.of(lang, some)
                    order = np.argsort(ranges, kind="stable")
                    to, bodies = zip(*_blob_rows(ranges[order], some[order], most[order]), strict=True)
                    yield _batch(REQUEST, lang, m, to, level, range_, bodies)

    return run


ANSWER = "lang string, level int, range long, part int, body binary"


def _composed(inside: int):
    """A range's transducer composed with the acceptors sent to it: (asking range, counts of its parts), and for the range itself the phrases that a longer one makes needless (part 0)."""

    def run(key: tuple[pa.Scalar, ...], held: pa.Table, asked: pa.Table) -> pa.Table:
        level, out = key[1].as_py(), []
        if held.num_rows and asked.num_rows:
            counts = Transducer.load(held["body"][0].as_py())
            needless = []
            for to_level, to_range, body in zip(asked["from_level"].to_pylist(), asked["from_range"].to_pylist(), asked["body"].to_pylist(), strict=True):
                rows, longer = Transducer.load(body).phrases()
                found = counts.find(rows)
                out.append((to_level, to_range, level, built(rows, found).dump()))
                needless.append(rows[(found > 0) & (longer > 0) & (100 * longer >= inside * found)])
            rows = np.concatenate(needless)
            if level > 1 and len(rows):
                out.append((level, key[2].as_py(), 0, built(*_merged(rows, np.zeros(len(rows), dtype=np.int64), np.maximum)).dump()))
        return pa.Table.from_batches([_batch(ANSWER, key[0].as_py(), *([x[i] for x in out] for i in range(4)))])

    return run


SCORED = "lang string, range long, words array<long>, a long, l long, r long, n long, score long"


def _scored(totals: dict[str, int], most: int):
    """A range's phrases with the score of their lowest cut: the best `most` and those that tie with the last of them."""

    def run(key: tuple[pa.Scalar, ...], held: pa.Table, answers: pa.Table) -> pa.Table:
        lang, level, range_ = (x.as_py() for x in key)
        rows, a = Transducer.load(held["body"][0].as_py()).phrases() if held.num_rows else (np.zeros((0, level), dtype=_U), np.zeros(0, dtype=np.int64))
        part = answers["part"].to_numpy()
        bodies = answers["body"].to_pylist()
        of = lambda m: built(*united([bodies[i] for i in np.flatnonzero(part == m)], np.maximum))
        if len(rows) and (part == 0).any():
            keep = of(0).find(rows) < 0
            rows, a = rows[keep], a[keep]
        scores, lefts, rights, n = [], [], [], totals[lang]
        if len(rows):
            tables = {m: of(m) for m in range(1, level)}
            for k in range(1, level):
                lefts.append(tables[k].find(rows[:, :k]))
                rights.append(tables[level - k].find(rows[:, k:]))
                scores.append((1000 * n * a.astype(object) // (lefts[-1].astype(object) * rights[-1])).astype(np.int64))  # whole numbers of any size
        if not scores:
            best, score, left, right = np.zeros(0, dtype=np.int64), *(np.zeros(0, dtype=np.int64) for _ in range(3))
        else:
            cut = np.argmin(np.stack(scores), axis=0)  # the first of equals
            score, left, right = (np.choose(cut, x) for x in (scores, lefts, rights))
            best = np.lexsort((-a, -score))
            if len(best) > most:
                last = best[most - 1]
                best = best[(score[best] > score[last]) | ((score[best] == score[last]) & (a[best] >= a[last]))]
        words = pa.FixedSizeListArray.from_arrays(pa.array(rows[best].view(np.int64).reshape(-1)), level).cast(pa.list_(pa.int64()))
        rest = _batch("lang string, range long, a long, l long, r long, n long, score long", lang, range_, a[best], left[best], right[best], n, score[best])
        return pa.Table.from_batches([rest]).add_column(2, "words", words)

    return run


def _first(found: DataFrame, most: int, groups: int) -> DataFrame:
    """The best `most` rows of each language by score and count, with those that tie with the last: in rounds, 64 groups of rows to one."""
    while groups > 1:
        groups = -(-groups // 64)
        best = Window.partitionBy("lang", F.pmod(F.xxhash64("range"), F.lit(groups))).orderBy(F.desc("score"), F.desc("a"))
        found = found.withColumn("_r", F.rank().over(best)).filter(F.col("_r") <= most).drop("_r")
    return found


OUT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most: int = MOST, longest: int = LONGEST, inside: int = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `most` best phrases of 2 to `longest` words that occur `least` times.

    A-Z are lower-cased; phrases lie within pieces between `[.,;:!?\\x0A-\\x0D]`. a, l and r are the counts of the phrase and of
    the two parts of the cut with the lowest score (of equals the one after fewer words), n counts the language's words,
    and score is floor(1000 * a * n / (l * r)), in whole numbers of any size. Phrases that a longer one with `inside` hundredths
    of their count contains are left out. Null texts hold no words, a null language is `und`. Repeated rows count as often as they
    occur; equal scores go by count, then by phrase in byte order. A table without frequent phrases gives no rows.
    """
    spark = df.sparkSession
    docs = only(df, lang=F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")), text=F.col(f"`{text_col}`").cast("string")).filter("text is not null")
    words, seed = _counted_words(docs, least)
    totals = {r["lang"]: r["f"] for r in words.filter("h is null").collect()}  # a row per language
    spread = Ranges(totals)
    frequent = words.filter("h is not null")
    if not totals:
        return spark.createDataFrame([], OUT)
    ranged = frequent.select("lang", "h", "f").mapInArrow(_ranged_words(spark.sparkContext.broadcast(spread)), "lang string, h long, f long, range long")
    level = stored(ranged.groupBy("lang", "range").applyInArrow(_word_ranges, LEVEL), "level")
    levels = level
    for k in range(2, longest + 1):
        bitmap = _prepared(level, spread)
        shared = spark.sparkContext.broadcast((spread, bitmap))
        shards = docs.mapInArrow(_shards(k, seed, shared), LEVEL)
        level = stored(shards.groupBy("lang", "range").applyInArrow(_united(k, least), LEVEL), "level")
        if level.isEmpty():
            break
        levels = levels.unionByName(level)
    n_ranges = levels.count()
    while len(spread.hot) < longest:  # the longest phrases are no one's prefixes
        spread.add_hot([], [])
    asked = levels.filter("level > 1").mapInArrow(_requests(spark.sparkContext.broadcast(spread)), REQUEST)
    key = ["lang", "level", "range"]
    answers = levels.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_composed(inside), ANSWER)
    scored = levels.filter("level > 1").groupBy(*key).cogroup(answers.groupBy(*key)).applyInArrow(_scored(totals, most), SCORED)
    best = _first(stored(scored, "scored"), most, n_ranges).withColumn("_id", F.monotonically_increasing_id())
    best = stored(best, "best")
    each = best.select("_id", "lang", F.posexplode("words").alias("_k", "h")).join(frequent.select("lang", "h", "word"), ["lang", "h"])
    texts = each.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col("word").cast("string").alias("word")))), lambda x: x["word"]), " ").alias("phrase"))  # `longest` words a phrase
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    out = best.join(texts, "_id").withColumn("rank", rank).filter(F.col("rank") <= most)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as x from d),
w as (select lang, list_filter(regexp_split_to_array(x, '[\x20\x09]+'), lambda y: y <> '') as w from p),
g as (select lang, k, w[i:i + k - 1] as g from (select lang, k, w, unnest(range(1, len(w) - k + 2)) as i from (select lang, w, unnest([1, 2, 3, 4, 5]) as k from w))),
f as (select lang, k, array_to_string(g, ' ') as phrase, g, count(*) as a from g group by all),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by 1),
c as (select * from f where k > 1 and a >= 100),
x as (select distinct c.lang, s.phrase from (select lang, a, unnest([array_to_string(g[:k - 1], ' '), array_to_string(g[2:], ' ')]) as phrase from c where k > 2) s join c on c.lang = s.lang and c.phrase = s.phrase and 100 * s.a >= 100 * c.a),
m as (select lang, phrase, a, k, unnest(range(1, k)) as j, g from c anti join x using (lang, phrase)),
s as (select m.lang, m.phrase, m.a, m.j, l.a as l, r.a as r, n.n, (1000::hugeint * m.a * n.n) // (l.a::hugeint * r.a) as score
    from m join n using (lang) join f l on l.lang = m.lang and l.k = m.j and l.phrase = array_to_string(m.g[:m.j], ' ') join f r on r.lang = m.lang and r.k = m.k - m.j and r.phrase = array_to_string(m.g[m.j + 1:], ' ')),
b as (select lang, phrase, a, l, r, n, score::bigint as score from s qualify row_number() over (partition by lang, phrase order by score, j) = 1)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b) where rank <= 2000
"""


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
