"""Helpers that the training-data operators share: stored tables, word tables and hashes.

Hashing here is done on whole Arrow batches with numpy: the bytes of all texts of a chunk are laid
end to end, and every word (or byte range) is hashed eight bytes at a time, all words at once, with
a non-linear step after each; long ones go through BLAKE2b. Hashes of different seeds are
independent, so two of them together are a hash of 128 bits.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources.scratch import drop as drop_path
from tracemill.sources.scratch import place

_U = np.uint64
#: Bytes of text that one numpy chunk holds; longer texts get a chunk of their own.
CHUNK_BYTES = 1 << 20


class Scratch:
    """The scratch tables of one piece of work; `drop` deletes them once its results are written."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def drop(self) -> None:
        some, self.paths = self.paths, []
        for spark, path in some:
            drop_path(spark, path)


#: The blocks that are open in a thread, the innermost last.
_open = threading.local()


def owner() -> Scratch | None:
    """The innermost open block of this thread."""
    held = getattr(_open, "blocks", None)
    return held[-1] if held else None


@contextmanager
def scratch(own: Scratch | None = None) -> Iterator[Scratch]:
    """Scratch tables that this thread makes inside the block belong to it (and to no other work); whoever opened it drops them.

    What is made outside of any block may be read at any time and goes with the application's folder.
    """
    own = own or Scratch()
    _open.blocks = [*getattr(_open, "blocks", []), own]
    try:
        yield own
    finally:
        _open.blocks = _open.blocks[:-1]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = place(spark, label)
    if owner():
        owner().paths.append((spark, path))
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage,
    survives lost executors, and leaves both sides of a later join free to be split."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(df: DataFrame, **columns) -> DataFrame:
    """`df` as exactly these columns, each an expression over its own columns (clashing names cannot leak)."""
    return df.select(*(c.alias(name) for name, c in columns.items()))


def bounded_sample(df: DataFrame, n_rows: int, most: int, by: list[str], seed: int = 17) -> DataFrame:
    """All rows, or about `most` of `n_rows`, chosen by a hash of the columns `by` where they are read: the same rows however the table is laid out."""
    if n_rows <= most:
        return df
    place = F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 30))
    return df.filter(place < int(most / n_rows * (1 << 30)))


# --------------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    return mix((np.arange(n, dtype=np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15) + _U(seed))


#: Ranges of more bytes are hashed one by one.
LONG_RANGE = 64


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (data must be followed by seven more bytes, see `padded`)."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, dtype=np.uint8)])


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair; equal bytes have equal hashes wherever they stand.

    No two ranges of the same length, eight bytes at most, share one.
    """
    first = seeded(1, 0xB17E + 0x10001 * seed)[0]
    size = ends - starts
    out = mix(size.astype(_U) * _U(0x2545F4914F6CDD1D) + first)
    read = eights(padded(data))
    short = size <= LONG_RANGE
    some, k = np.flatnonzero(short & (size > 0)), 0
    while len(some):
        left = size[some] - k
        part = read[starts[some] + k] << ((np.maximum(8 - left, 0) * 8).astype(_U))
        out[some] = mix((out[some] ^ part) * _U(0xD1342543DE82EF95) + first)
        some, k = some[left > 8], k + 8
    salt = int(first).to_bytes(8, "little")
    for i in np.flatnonzero(~short).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=salt).digest(), "little")
    return out


def run_hashes(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive hashes (len - k + 1 of them, none if fewer), from those of runs of 1, 2, 4 … hashes."""
    if len(hashes) < k or k < 1:
        return np.zeros(0, dtype=np.uint64)
    both = lambda a, b: mix((a + _U(0x9E3779B97F4A7C15)) * _U(0xD1342543DE82EF95) + b)
    run, width, out = hashes, 1, None
    while True:
        if k & width:
            out = run if out is None else both(run[: len(out) - width], out[width:])
        width *= 2
        if width > k:
            return mix(out[: len(hashes) - k + 1] + _U(0x632BE59BD9B4E019 * (2 * seed + 1) % (1 << 64)))
        run = both(run[: len(run) - width // 2], run[width // 2 :])


# ----------------------------------------------------------------- text chunks


def parts(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, last, UTF-8 of these cells, null as empty): runs of cells that hold about `most` bytes together. One run at a time is in Python's hands."""
    column = column.cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi, [x or b"" for x in column.slice(lo, hi - lo).to_pylist()]
        lo = hi


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts: byte ranges, and per text the range of its words."""

    _SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
    _LOWER = np.arange(256, dtype=np.uint8) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = np.frombuffer(b"\n".join([b"", *texts, b""]), dtype=np.uint8)
        if lower:
            self.data = self._LOWER[self.data]
        gap = self._SPACE[self.data]
        edge = np.diff(gap.view(np.int8))
        self.starts = np.flatnonzero(edge == -1) + 1
        self.ends = np.flatnonzero(edge == 1) + 1
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text_starts = 1 + np.concatenate([[0], np.cumsum(lengths + 1)])
        self.bounds = np.searchsorted(self.starts, self.text_starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends, seed)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def docs_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Exactly (doc_id long, text string) whatever else the table holds."""
    return only(df, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"))
