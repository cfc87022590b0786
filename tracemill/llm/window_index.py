"""Substring deduplication batch by batch: an index of window hashes in the shared folder, which later jobs open and add to.

`remove_repeats` judges one table. Here each batch of documents comes after all batches before it, whenever they were added,
and what is read of those is their windows' hashes, never their texts.

Runs. A batch's distinct new windows are one immutable run: per bucket (a range of hashes) a block of sorted hashes of 96 bits, in a
Parquet folder that is named by its batches. A new batch's windows are merged with the blocks of all runs bucket by bucket; a
window that a run holds, or that stands earlier in the batch, is a repeat. Runs hold no window twice.

Compaction. Neighbouring runs of like size (each at most twice as large as what follows it) become one, so there are about as many runs
as the index has doublings, and an entry is rewritten about as often. Buckets double as the index grows; blocks of older runs
are split as they are read, as ranges of hashes nest.

A run counts once Spark has committed its folder; one whose batches a larger run holds as well is passed over. So a job that fails
leaves the index as it was, and may be repeated. One job at a time may add.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources.scratch import drop

from .common import stored
from .substring_dedup import BUCKET_ENTRIES, WINDOW, _batch, _blocks, _cut, _later, _ranked, _window_blocks, pack, unpack

_BLOCK = "bucket int, body binary, n long"


class _Everything:
    """In place of a filter of the windows that are looked for: all are."""

    value = np.full(1 << 10, 255, dtype=np.uint8)


class Run(NamedTuple):
    """The run of batches first to last, in blocks of so many buckets."""

    first: int
    last: int
    buckets: int
    path: str


def _split(buckets: int):
    def run(batches):
        for b in batches:
            for body in b.column(1).to_pylist():
                key, check = unpack(body)
                for k, lo, hi in _blocks(buckets, key):
                    yield _batch(bucket=pa.array([k], pa.int32()), body=pa.array([pack(key[lo:hi], check[lo:hi])], pa.binary()), n=pa.array([hi - lo], pa.int64()))

    return run


def _windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key, check) of some blocks of runs."""
    held = [unpack(x) for x in bodies] or [(np.zeros(0, np.uint64), np.zeros(0, np.uint32))]
    return np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])


def _united(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The blocks of a bucket as one; runs share no window."""
    keys, check = _windows(rows["body"].to_pylist())
    order = np.lexsort((check, keys))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([pack(keys[order], check[order])], pa.binary()), "n": pa.array([len(keys)], pa.int64())})


def _merged(key: tuple[pa.Scalar, ...], new: pa.Table, old: pa.Table) -> pa.Table:
    """Of a bucket of a batch beside the runs: the block of windows that are new (row null), and each row's starts of those that are not."""
    rows, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for known in new["known"].to_pylist():
        if known:
            r, s = unpack(known)
            rows.append(r)
            starts.append(s)
    block = None
    if bodies := [unpack(x) for x in new["body"].to_pylist() if x]:
        at = np.cumsum([0, *(len(p[2]) for p in bodies)])
        _, row, rank = _ranked(np.concatenate([p[2] for p in bodies]), np.concatenate([p[3] if len(p[3]) else p[2] for p in bodies]))
        of = rank[np.concatenate([p[4] + np.int64(n) for p, n in zip(bodies, at[:-1], strict=True)])]
        keys, check, start = (np.concatenate([p[i] for p in bodies]) for i in (0, 1, 5))
        order, later = _later(of, start, keys, check)
        of, start, keys, check = of[order], start[order], keys[order], check[order]
        old_keys, old_check = _windows(old["body"].to_pylist())
        both, checks = np.concatenate([old_keys, keys]), np.concatenate([old_check, check])
        merge = np.lexsort((np.arange(len(both)), checks, both))  # of equal windows those of runs come first
        edge = np.concatenate([[True], (np.diff(both[merge]) != 0) | (np.diff(checks[merge]) != 0)])
        head = merge[np.flatnonzero(edge)[np.cumsum(edge) - 1]]  # the first of each one's equals
        held = np.zeros(len(both), dtype=bool)
        held[merge] = head < len(old_keys)
        known = later | held[len(old_keys) :]
        rows.append(row[of[known]])
        starts.append(start[known])
        if not known.all():
            block = pack(keys[~known], check[~known]), int((~known).sum())
    row, start = np.concatenate(rows), np.concatenate(starts)
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)), pa.int32()), pa.array(start.astype(np.int32)))
    schema = pa.schema([("bucket", pa.int32()), ("body", pa.binary()), ("n", pa.int64()), ("row", pa.int64()), ("starts", pa.list_(pa.int32()))])
    places = pa.table({"bucket": pa.nulls(len(at), pa.int32()), "body": pa.nulls(len(at), pa.binary()), "n": pa.nulls(len(at), pa.int64()), "row": pa.array(row[at], pa.int64()), "starts": lists}, schema)
    if block is None:
        return places
    own = pa.table({"bucket": [key[0].as_py()], "body": [block[0]], "n": [block[1]], "row": [None], "starts": [None]}, schema)
    return pa.concat_tables([places, own])


class WindowIndex:
    """The index in the folder `path` (one that driver and executors share), made if it isn't there. Windows are of `window` words in all its batches."""

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW):
        self.spark, self.path, self.window = spark, path.rstrip("/"), window
        self._kept = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/window={window}")
        self._files = self._kept.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._files.exists(self._kept):
            if self._files.exists(self._kept.getParent()) and len(self._files.listStatus(self._kept.getParent())):
                raise ValueError(f"{self.path} holds something else, or an index of other windows")
            self._files.mkdirs(self._kept)

    def runs(self) -> list[Run]:
        """The committed runs by batch, without those that a larger one holds."""
        names = [s.getPath().getParent().getName() for s in self._files.globStatus(self._kept.suffix("/*/_SUCCESS")) or []]
        found = sorted((Run(*map(int, name.split("-")), f"{self._kept}/{name}") for name in names), key=lambda r: (r.first, -r.last))
        out: list[Run] = []
        for r in found:
            if not out or r.first > out[-1].last:
                out.append(r)
        return out

    def _read(self, run: Run, buckets: int) -> DataFrame:
        blocks = self.spark.read.schema(_BLOCK).parquet(run.path)
        return blocks if run.buckets == buckets else blocks.mapInArrow(_split(buckets), _BLOCK)

    def _union(self, runs: list[Run], buckets: int) -> DataFrame:
        none = self.spark.createDataFrame([], _BLOCK)
        return reduce(DataFrame.unionByName, (self._read(r, buckets) for r in runs), none)

    def _write(self, blocks: DataFrame, first: int, last: int, buckets: int) -> None:
        blocks.write.mode("overwrite").parquet(f"{self._kept}/{first:08}-{last:08}-{buckets}")

    def size(self, run: Run) -> int:
        """How many windows a run holds."""
        return self._read(run, run.buckets).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n

    def add(self, docs: DataFrame) -> DataFrame:
        """Add a batch, exactly (row long, doc_id long, text string): (row, starts), the start words of each row's windows that an earlier batch
        holds, or that start earlier in this one.

        `row` tells all rows of the batch apart; they come by (doc_id, row), null doc_ids last. Rows without repeats are left out. The answer is a
        stored table and doesn't depend on what the index does later.
        """
        runs = self.runs()
        n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
        wanted = (sum(map(self.size, runs)) + n_bytes // 6) // BUCKET_ENTRIES
        buckets = max([1 << max(0, wanted - 1).bit_length(), *(r.buckets for r in runs)])
        blocks = docs.mapInArrow(_window_blocks(_Everything, buckets, self.window), "bucket int, known binary, body binary")
        old = self._union(runs, buckets)
        both = blocks.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(_merged, f"{_BLOCK}, row long, starts array<int>")
        both = stored(both, "batch")
        number = runs[-1].last + 1 if runs else 0
        self._write(both.filter("row is null").select("bucket", "body", "n"), number, number, buckets)
        self.compact()
        starts = F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts"))))  # of one document
        return both.filter("row is not null").groupBy("row").agg(starts.alias("starts"))

    def compact(self) -> None:
        """Unite the last runs as far as each is at most twice as large as all after it."""
        runs = self.runs()
        if len(runs) < 2:
            return
        sizes, some = [self.size(r) for r in runs], len(runs) - 1
        total = sizes[some]
        while some and sizes[some - 1] <= 2 * total:
            some -= 1
            total += sizes[some]
        if some == len(runs) - 1:
            return
        gone, buckets = runs[some:], max(r.buckets for r in runs[some:])
        self._write(self._union(gone, buckets).groupBy("bucket").applyInArrow(_united, _BLOCK), gone[0].first, gone[-1].last, buckets)
        for r in gone:
            drop(self.spark, r.path)


def remove_known(index: WindowIndex, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_words, n_removed): `row` holds df's columns, its text without the words of windows that the index or an earlier row of df holds;
    df's windows are then in the index.

    Rows come by doc_id, null ones last; each row is a document of its own, so of repeated rows the first keeps its words. Null texts stay
    null and have no words, texts shorter than a window lose nothing, an empty table adds an empty run.
    """
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rest = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col), F.col(f"`{text_col}`").isNull().alias("_null"))
    keyed = stored(df.select(rest.alias("rest"), text.alias("text"), doc_id.alias("doc_id"), F.monotonically_increasing_id().alias("row")), "rows")
    places = index.add(keyed.select("row", "doc_id", "text"))
    joined = keyed.join(places, "row", "left").select("rest", "text", "starts")
    out = joined.mapInArrow(_cut(index.window), joined.select("rest").schema.add("kept", "string").add("n_words", "long").add("n_removed", "long"))
    kept = F.when(~F.col("rest._null"), F.col("kept"))
    return out.select(F.struct(*((kept if c == text_col else F.col(f"rest.`{c}`")).alias(c) for c in df.columns)).alias("row"), "n_words", "n_removed")
