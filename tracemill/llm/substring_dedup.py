"""Incremental removal of word windows that started earlier, over a log-structured fingerprint index.

Fingerprints. A window is WINDOW consecutive words. Its fingerprint is the smallest hash among
its inner runs of GRAM words, so equal windows have equal fingerprints while neighbouring
windows mostly share one: about one fingerprint for six windows is indexed.

Index. Each batch of documents gives one sorted, immutable run per hash bucket. A batch's run is
merge-joined with the runs of all earlier batches; a fingerprint that an earlier run holds, or
that the batch holds twice, is a hit. Runs are compacted into one when there are MAX_RUNS.

Verification. Texts are read again, and every window whose fingerprint may be a hit (a Bloom
filter of bounded size tells; false alarms only cost work) sends its window hash with its place: 96
bits from two hashes of the words that are independent of each other. Within a task only the earliest place of a window goes to the bucket where all tasks' first
places meet; later places are known repeats at once. So a passage that a third of all documents
share costs its bucket one entry a task. Places are ordered by (doc_id, row, start word); a null
doc_id comes last. Where doc_ids are null or repeat, rows get a key of their own, in a stored table;
only rows with equal doc_id and equal text count as the same document. Rows whose key a Bloom filter
of the keys with repeats doesn't hold are never shuffled: only the texts that may lose words are joined.

Blocks of sorted arrays (not rows) travel, delta-coded and compressed.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, parts, run_hashes, stored
from .exact_dedup import bloom_filter, holds

WINDOW = 20
GRAM = 10
BATCHES = 3
MAX_RUNS = 2
#: Fingerprints of an index bucket and windows of a verification bucket, about.
BUCKET_ENTRIES = 1 << 19
#: Windows that a task gathers before it sends its blocks.
BLOCK_WINDOWS = 1 << 19
_LAST = np.iinfo(np.int64).max
#: Added to the row keys of documents without doc_id, so that they come after all others.
_UNNAMED = 1 << 62


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as compressed byte planes; a sorted array shrinks by its differences."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        if len(a) and a.dtype.itemsize == 8:
            a = np.concatenate([a[:1], np.diff(a)])
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T
        body = zlib.compress(planes.tobytes(), 1)
        out.append(struct.pack("<2sII", a.dtype.str[1:].encode(), len(a), len(body)) + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<2sII", data, at)
        at += 10
        dtype = np.dtype("<" + kind.decode())
        planes = np.frombuffer(zlib.decompress(data[at : at + size]), dtype=np.uint8).reshape(dtype.itemsize, n)
        a = np.ascontiguousarray(planes.T).reshape(-1).view(dtype)
        out.append(np.cumsum(a, dtype=dtype) if dtype.itemsize == 8 else a)
        at += size
    return out


def _least_of(x: np.ndarray, k: int) -> np.ndarray:
    """The minimum of each k consecutive values."""
    n, have = len(x) - k + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * have <= k:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[k - have : k - have + n])


def _fingerprints(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window that lies in one text, and its fingerprint."""
    gram = min(GRAM, window)
    prints = _least_of(run_hashes(hashes, gram), window - gram + 1)
    of = words.text_of_word()
    whole = of[: len(prints)] == of[len(of) - len(prints) :]
    return np.flatnonzero(whole), prints[whole]


def _selected(words: Words, hashes: np.ndarray, window: int) -> np.ndarray:
    """The fingerprints of a chunk, once for each place that a run of GRAM words stands at."""
    gram = min(GRAM, window)
    span = window - gram + 1
    grams = run_hashes(hashes, gram)
    at, prints = _fingerprints(words, hashes, window)
    padded = np.zeros(len(grams) + span - 1, dtype=np.uint64)  # prints[i] at i + span - 1; 0 where no window lies in one text
    padded[at + span - 1] = prints
    return grams[(~_least_of(~padded, span) == grams) & (grams > 0)] if len(grams) else grams


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _blocks(buckets: int, key: np.ndarray):
    """(bucket, first, last) for keys sorted by hash: the buckets are ranges of hashes."""
    at = np.searchsorted(_bucket(key, buckets), np.arange(buckets + 1))
    return [(k, at[k], at[k + 1]) for k in range(buckets) if at[k] < at[k + 1]]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


# ----------------------------------------------------------------------- index


def _print_blocks(buckets: int, window: int):
    def run(batches):
        held: list[np.ndarray] = []

        def send():
            prints, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for k, a, b in _blocks(buckets, prints):
                yield _batch(bucket=pa.array([k], pa.int32()), body=pa.array([pack(prints[a:b], counts[a:b].clip(max=2).astype(np.uint8))], pa.binary()))

        for b in batches:
            for _, _, texts in parts(b.column(0)):
                words = Words(texts)
                held.append(mix(_selected(words, words.hashes(), window)))  # minima are small numbers: spread them over the buckets
                if sum(map(len, held)) > BLOCK_WINDOWS:
                    yield from send()
        if held:
            yield from send()

    return run


def _merge_blocks(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One sorted run of a bucket: prints and whether each was seen once (1) or more often (2)."""
    bodies = [unpack(x) for x in rows["body"].to_pylist()]
    prints, at = np.unique(np.concatenate([p for p, _ in bodies]), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([c for _, c in bodies])).clip(max=2).astype(np.uint8)
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([pack(prints, counts)], pa.binary())})


def _hits(key: tuple[pa.Scalar, ...], new: pa.Table, old: pa.Table) -> pa.Table:
    """Merge join of a bucket's new run with its earlier runs: the new prints that are known or repeated."""
    out = np.zeros(0, dtype=np.uint64)
    for body in new["body"].to_pylist():
        prints, counts = unpack(body)
        hit = counts > 1
        for earlier in old["body"].to_pylist():
            known = unpack(earlier)[0]
            at = np.minimum(np.searchsorted(known, prints), len(known) - 1)
            hit |= known[at] == prints
        out = np.concatenate([out, prints[hit]])
    return pa.table({"print": pa.array(out.view(np.int64), pa.int64())})


class FingerprintIndex:
    """Sorted runs of the fingerprints of all batches so far, in tables of the shared folder."""

    def __init__(self, spark, buckets: int, window: int = WINDOW):
        self.spark, self.buckets, self.window = spark, buckets, window
        self.runs: list[DataFrame] = []

    def add(self, texts: DataFrame) -> DataFrame:
        """Add a batch (one text column) as a run; a stored table of its hits (print long)."""
        blocks = texts.mapInArrow(_print_blocks(self.buckets, self.window), "bucket int, body binary")
        run = stored(blocks.groupBy("bucket").applyInArrow(_merge_blocks, "bucket int, body binary"), "run")
        old = run.limit(0)
        for r in self.runs:
            old = old.unionByName(r)
        hits = stored(run.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(_hits, "print long"), "hits")
        self.runs.append(run)
        if len(self.runs) > MAX_RUNS:
            self.compact()
        return hits

    def compact(self) -> None:
        """Merge all runs into one."""
        whole = self.runs[0]
        for r in self.runs[1:]:
            whole = whole.unionByName(r)
        self.runs = [stored(whole.groupBy("bucket").applyInArrow(_merge_blocks, "bucket int, body binary"), "compacted")]


# ---------------------------------------------------------------- verification


def _later(text: np.ndarray, start: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (window, place), and which entries in that order are not the first place of their window. `text` holds ranks of texts."""
    order = np.lexsort((start, text, check, key))
    key, check = key[order], check[order]
    same = np.concatenate([[False], (key[1:] == key[:-1]) & (check[1:] == check[:-1])]) if len(key) else np.zeros(0, dtype=bool)
    return order, same


def _ranked(doc: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by (doc_id, row), those without doc_id (shown as _LAST, their rows past all others) last; and the rank of each."""
    order = np.lexsort((row, doc))
    rank = np.empty(len(order), dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return doc[order], row[order], rank


def _by_document(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Rows (row, starts) from the blocks of a bucket of documents."""
    bodies = [unpack(x) for x in rows["body"].to_pylist()]
    doc, start = np.concatenate([d[of] for d, of, _ in bodies]), np.concatenate([s for *_, s in bodies])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)), pa.int32()), pa.array(start.astype(np.int32)))
    return pa.table({"row": pa.array(doc[at], pa.int64()), "starts": lists})


def _window_blocks(spread, buckets: int, window: int):
    """Blocks of windows that may repeat: first places per bucket, and places already known to be later."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        texts_held: list[tuple[np.ndarray, np.ndarray]] = []
        turn = n_held = 0

        def send():
            nonlocal turn, n_held
            of, start, key, check = (np.concatenate(x) for x in zip(*held, strict=True))
            doc, row, rank = _ranked(*(np.concatenate(x) for x in zip(*texts_held, strict=True)))
            held.clear()
            texts_held.clear()
            n_held = 0
            of = rank[of]
            order, later = _later(of, start, key, check)
            of, start, key, check = of[order], start[order], key[order], check[order]
            if later.any():
                turn += 1  # these need no bucket: deal them out
                yield _batch(bucket=pa.array([(turn * 7919 + int(key[0] % np.uint64(buckets))) % buckets], pa.int32()), known=pa.array([pack(row[of[later]], start[later])], pa.binary()), body=pa.array([None], pa.binary()))
            of, start, key, check = of[~later], start[~later], key[~later], check[~later]
            for k, a, b in _blocks(buckets, key):
                some, at = np.unique(of[a:b], return_inverse=True)
                own = row[some] if (row[some] != doc[some]).any() else row[:0]  # unique doc_ids are sent once
                body = pack(key[a:b], check[a:b], doc[some], own, at.astype(np.uint32), start[a:b])
                yield _batch(bucket=pa.array([k], pa.int32()), known=pa.array([None], pa.binary()), body=pa.array([body], pa.binary()))

        for b in batches:
            rows, ids = b.column(0).to_numpy(), b.column(1).fill_null(_LAST).to_numpy()
            for lo, hi, texts in parts(b.column(2)):
                words = Words(texts)
                hashes = words.hashes()
                at, prints = _fingerprints(words, hashes, window)
                at = at[holds(spread.value, mix(prints))]
                if not len(at):
                    continue
                of = words.text_of_word()[at]
                key, check = run_hashes(hashes, window, 1)[at], run_hashes(words.hashes(1), window, 2)[at] >> np.uint64(32)
                held.append((of + n_held, (at - words.bounds[of]).astype(np.uint32), key, check.astype(np.uint32)))
                texts_held.append((ids[lo:hi], rows[lo:hi]))
                n_held += hi - lo
                if sum(len(x[0]) for x in held) > BLOCK_WINDOWS:
                    yield from send()
        if held:
            yield from send()

    return run


def _repeats(buckets: int):
    """Of a bucket of windows: the places that are later than another, as one block per bucket of documents."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _repeats_of(rows, buckets)

    return run


def _repeats_of(rows: pa.Table, buckets: int) -> pa.Table:
    docs, starts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint32)]
    for known in rows["known"].to_pylist():
        if known:
            d, s = unpack(known)
            docs.append(d)
            starts.append(s)
    bodies = [unpack(x) for x in rows["body"].to_pylist() if x]
    if bodies:
        first = np.cumsum([0, *(len(p[2]) for p in bodies)])
        _, row, rank = _ranked(np.concatenate([p[2] for p in bodies]), np.concatenate([p[3] if len(p[3]) else p[2] for p in bodies]))
        of = rank[np.concatenate([p[4] + np.int64(n) for p, n in zip(bodies, first[:-1], strict=True)])]
        start, keys, check = (np.concatenate([p[i] for p in bodies]) for i in (5, 0, 1))
        order, later = _later(of, start, keys, check)
        docs.append(row[of[order][later]])
        starts.append(start[order][later])
    doc, start = np.concatenate(docs), np.concatenate(starts)
    to = (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((start, doc, to))
    doc, start, to = doc[order], start[order], to[order]
    at = np.searchsorted(to, np.arange(buckets + 1))
    out, bodies = [], []
    for k in np.flatnonzero(np.diff(at)).tolist():
        some, of = np.unique(doc[at[k] : at[k + 1]], return_inverse=True)
        out.append(k)
        bodies.append(pack(some, of.astype(np.uint32), start[at[k] : at[k + 1]]))
    return pa.table({"to": pa.array(out, pa.int32()), "body": pa.array(bodies, pa.binary())})


def _tested(spread, wanted: bool):
    """Of Arrow batches whose last column is the row: the rows that the filter may hold, or those that it doesn't."""

    def run(batches):
        for b in batches:
            found = holds(spread.value, b.column(b.num_columns - 1).to_numpy().view(np.uint64))
            some = np.flatnonzero(found == wanted)
            if len(some) == b.num_rows:
                yield b
            elif len(some):
                yield b.take(pa.array(some))

    return run


def _cut(window: int):
    """Of Arrow batches (rest, text, starts): text without the covered words (and the white space behind each), and counts."""

    def run(batches):
        for b in batches:
            starts = b.column(2)
            out, n_words, n_removed = [], [], []
            for lo, hi, texts in parts(b.column(1)):
                words = Words(texts)
                for i in range(lo, hi):
                    first, last = words.bounds[i - lo], words.bounds[i - lo + 1]
                    gone = 0
                    if starts[i].is_valid and last > first:
                        steps = np.zeros(last - first + 1, dtype=np.int64)
                        s = np.unique(starts[i].values.to_numpy())
                        np.add.at(steps, s, 1)
                        np.add.at(steps, s + window, -1)
                        kept = np.cumsum(steps)[:-1] == 0
                        gone = int((~kept).sum())
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]]).view(np.int8)))
                        begin = words.starts[first:last][edges[::2]]
                        end = np.append(words.starts[first + 1 : last], words.text_starts[i - lo + 1] - 1)[edges[1::2] - 1]
                        out.append(b"".join(words.data[x:y].tobytes() for x, y in zip(begin, end, strict=True)).decode("utf-8"))
                    else:
                        out.append(texts[i - lo].decode("utf-8"))
                    n_words.append(int(last - first))
                    n_removed.append(gone)
            yield _batch(rest=b.column(0), kept=pa.array(out, pa.string()), n_words=pa.array(n_words, pa.int64()), n_removed=pa.array(n_removed, pa.int64()))

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """(row, starts): the start words of each row's windows that started earlier; rows without any are left out.

    `docs` holds exactly (row long, doc_id long, text string). `row` tells all rows apart; rows of equal doc_id come in its order.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n"), F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("cuts")).first()
    buckets = max(1, (size.n or 0) // 8 // BUCKET_ENTRIES)
    index, hits = FingerprintIndex(spark, max(1, buckets // 6), window), None
    cuts = [None, *sorted(set(size.cuts or [])), None]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        batch = docs if low is None else docs.filter((F.col("doc_id") > low) | F.col("doc_id").isNull() if high is None else F.col("doc_id") > low)
        batch = batch if high is None else batch.filter(F.col("doc_id") <= high)
        found = index.add(batch.select("text"))
        hits = found if hits is None else hits.unionByName(found)
    spread = spark.sparkContext.broadcast(bloom_filter(hits, 1))  # MAX_FILTER_BITS bounds it
    blocks = docs.mapInArrow(_window_blocks(spread, buckets, window), "bucket int, known binary, body binary")
    found = blocks.groupBy("bucket").applyInArrow(_repeats(buckets), "to int, body binary")
    return found.groupBy("to").applyInArrow(_by_document, "row long, starts array<int>")


def _same_documents(keyed: DataFrame) -> DataFrame:
    """(row, first): rows whose doc_id and text an earlier row has, and the first such row."""
    marks = keyed.filter("doc_id is not null and text is not null").select("row", "doc_id", F.md5(F.col("text").cast("binary")).alias("mark"))
    firsts = marks.groupBy("doc_id", "mark").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return stored(marks.join(firsts, ["doc_id", "mark"]).filter("row <> first").select("row", "first"), "again")


def remove_repeats(df: DataFrame, window: int = WINDOW, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_words, n_removed): `row` holds df's columns, its text without the words of windows that started earlier.

    White space around kept words stays as it was, but for what stood behind removed words. Null texts stay null and have
    no words; texts shorter than a window lose nothing; an empty table gives an empty one.
    """
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rest = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col), F.col(f"`{text_col}`").isNull().alias("_null"))
    again = None
    if df.select(doc_id.alias("doc_id")).groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        keyed = df.select(rest.alias("rest"), text.alias("text"), doc_id.alias("doc_id"), doc_id.alias("row"))
    else:
        number = F.monotonically_increasing_id() + F.when(doc_id.isNull(), F.lit(_UNNAMED)).otherwise(F.lit(0))
        keyed = stored(df.select(rest.alias("rest"), text.alias("text"), doc_id.alias("doc_id"), number.alias("row")), "rows")
        again = _same_documents(keyed)
    docs = keyed.select("row", "doc_id", "text")
    if again is None:
        repeats = repeated_windows(docs, window, batches)
    else:
        repeats = stored(repeated_windows(docs.join(again, "row", "left_anti"), window, batches), "repeats")
        repeats = repeats.unionByName(again.join(repeats.withColumnRenamed("row", "first"), "first").select("row", "starts"))
    repeats = stored(repeats, "places")
    # a text without repeats passes straight through; only the others meet their places
    spread = df.sparkSession.sparkContext.broadcast(bloom_filter(repeats.select("row"), 1))  # MAX_FILTER_BITS bounds it
    rows = keyed.select("rest", "text", F.lit(None).cast("array<int>").alias("starts"), "row")
    joined = rows.mapInArrow(_tested(spread, True), rows.schema).drop("starts").join(repeats, "row", "left").select("rest", "text", "starts")
    schema = joined.select("rest").schema.add("kept", "string").add("n_words", "long").add("n_removed", "long")
    cut, alone = _cut(window), _tested(spread, False)
    out = rows.mapInArrow(lambda batches: cut(alone(batches)), schema).unionByName(joined.mapInArrow(cut, schema))
    text = F.when(~F.col("rest._null"), F.col("kept"))
    row = F.struct(*((text if c == text_col else F.col(f"rest.`{c}`")).alias(c) for c in df.columns))
    return out.select(row.alias("row"), "n_words", "n_removed")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    words = F.trim(F.regexp_replace(F.coalesce(F.col("row.text"), F.lit("")), r"[ \t-\r]+", " "))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


OP6_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
     p as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w where len(ws) >= 20)),
     d as (select doc_id, i from p qualify (doc_id, i) <> min((doc_id, i)) over (partition by win)),
     g as (select distinct doc_id, unnest(range(i, i + 20)) as k from d),
     x as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as k from w),
     t as (select doc_id, string_agg(word, ' ' order by k) as kept, count(*) as n from x anti join g using (doc_id, k) group by 1)
select w.doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join t using (doc_id)
"""
