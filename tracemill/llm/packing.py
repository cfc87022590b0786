"""Packing documents into fixed-length training sequences.

A document's ids (with the end id behind them) are cut at multiples of the sequence length: full
pieces fill a sequence each, and the rest is packed first-fit decreasing. Documents are dealt at
random into groups of about `GROUP_DOCS`; a group is packed on its own, with a tournament tree
over the free space of its sequences whose root-to-leaf walk finds the first sequence that an
item fits into. Then the emptiest sequences are taken apart to fill the gaps of the others, so a
group pads less than `MIN_CUT` ids a sequence, and at most one sequence more.

Only what is packed travels: a full piece is sent as its checksum, the rest as its ids (two
bytes an id if the vocabulary allows). Group size is fixed, so a task's memory is too, and
groups are dealt by row, so no key can be hot.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import docs_of, stored

SEQUENCE = 1024
GROUP_DOCS = 2048
#: A gap smaller than this stays padding; cutting a document for it isn't worth while.
MIN_CUT = 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Tournament:
    """Free space of bins, all of one capacity at first; `first_fit` takes space from the leftmost bin that has it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        at = node - self.leaves
        best[node] -= size
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, each item in the first bin with room, largest items first (ties: smaller number first)."""
    tree = Tournament(max(1, len(sizes)), capacity)
    bins: dict[int, list[int]] = {}
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins.setdefault(tree.first_fit(sizes[item]), []).append(item)
    return [bins[k] for k in sorted(bins)]


def fill_gaps(bins: list[list[tuple[int, int, int]]], capacity: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Move ids from the emptiest bins into gaps of at least `least` in the others.

    Bins hold pieces (item, start, length). A piece may be cut; no bin but the last one taken apart keeps such a gap.
    """
    used = lambda b: sum(n for _, _, n in b)
    bins = sorted(bins, key=lambda b: -used(b))
    gaps = [capacity - used(b) for b in bins]
    take, give = next((i for i, g in enumerate(gaps) if g >= least), len(bins)), len(bins) - 1
    while take < give:
        item, start, n = bins[give].pop()
        moved = min(n, gaps[take])
        bins[take].append((item, start, moved))
        gaps[take] -= moved
        if moved < n:
            bins[give].append((item, start + moved, n - moved))
        if gaps[take] < least:
            take += 1
        if not bins[give]:
            give -= 1
    return [b for b in bins if b]


def _cut(path: str, end_id: int, sequence: int):
    """Of Arrow batches (doc_id, text): tokens of each document, checksums of its full pieces, and the ids of the rest."""

    def run(batches):
        wide = np.dtype("<u2") if max(len(bpe.codec(path).size) - 1, end_id) < 1 << 16 else np.dtype("<u4")
        for (doc_id,), ids, at in bpe.encoded_batches(batches, path, added=True):
            tokens, full, tails = [], [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                own = np.append(ids[a:b], end_id).astype("<u4")
                cut = len(own) // sequence * sequence
                full.append([zlib.crc32(own[k : k + sequence]) for k in range(0, cut, sequence)])
                tails.append(own[cut:].astype(wide).tobytes())
                tokens.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [doc_id, pa.array(tokens, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array([wide.itemsize] * len(tails), pa.int32())],
                ["doc_id", "doc_tokens", "full", "tail", "wide"],
            )

    return run


def _pack_group(sequence: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row").combine_chunks()
        wide = rows["wide"][0].as_py()
        tails = [np.frombuffer(t, dtype=f"<u{wide}").astype("<u4") for t in rows["tail"].to_pylist()]
        out: list[tuple] = []
        first = key[0].as_py() << 32
        starts = []
        for i, full in enumerate(rows["full"].to_pylist()):
            for k, crc in enumerate(full):
                out.append((i, k * sequence, sequence, crc, first + len(out), 0))
            starts.append(len(full) * sequence)
        some = [i for i, t in enumerate(tails) if len(t)]
        packed = first_fit_decreasing([len(tails[i]) for i in some], sequence)
        packed = fill_gaps([[(some[k], 0, len(tails[some[k]])) for k in b] for b in packed], sequence, MIN_CUT)
        first += len(out)
        for k, bin_ in enumerate(packed):
            offset = 0
            for i, start, n in bin_:
                out.append((i, starts[i] + start, n, zlib.crc32(tails[i][start : start + n]), first + k, offset))
                offset += n
        of, start, length, crc, sequence_id, offset = (pa.array(x, pa.int64()) for x in zip(*out, strict=True))
        return pa.table([rows["doc_id"].take(of), start, length, crc, rows["doc_tokens"].take(of), sequence_id, offset], names=NAMES)

    return run


def pack(
    df: DataFrame, path: str, end_id: int = 0, sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS, seed: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack every document into sequences of at most `sequence` ids; one row per piece.

    doc_id, start (ids of the document before the piece), length, ids_crc32 (of little-endian unsigned 32-bit ids),
    doc_tokens (with the end id), sequence_id, offset (place in the sequence, without gaps from 0). Text that spells an added
    token of the file gets that token's id, as the `tokenizers` library gives it. Null and empty texts hold the end id only. Every row counts as a document of its own, also if it repeats another's doc_id or has none.
    Empty table: empty result.
    """
    docs = docs_of(df, id_col, text_col)
    cut = stored(
        docs.mapInArrow(_cut(path, end_id, sequence), "doc_id long, doc_tokens long, full array<long>, tail binary, wide int").withColumn("row", F.monotonically_increasing_id()),
        "tokens",
    )
    groups = max(1, -(-cut.count() // group_docs))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_pack_group(sequence), SCHEMA)


def padding(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """One row: sequences, ids, padded ids (a sequence whose length is a power of two isn't padded) and their share."""
    held = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.pow(F.lit(2.0), F.round(F.log2("n"))) == F.col("n")
    total = held.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("ids"), F.sum(F.when(power, 0).otherwise(F.lit(sequence) - F.col("n"))).alias("padded"))
    return total.withColumn("share", F.col("padded") / (F.col("ids") + F.col("padded")))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))

