"""Exact deduplication by two-pass Bloom filtering.

Pass 1 reads only 60-bit prefixes of the SHA-256 digests and sets `HASHES` bits a row in a
filter that remembers which bits were hit once and which at least twice. Pass 2 tests every
row: a row all of whose bits were hit twice is *possibly repeated* and goes through the
shuffle, where the full digests decide; every other row is certainly unique and passes
straight through. A filter's false alarm costs a little shuffle, never a wrong result.

Scale: a filter has `BITS_PER_ROW` bits a row up to `MAX_FILTER_BITS` (two packed bitmaps of 64 MiB
each at most, of which one is broadcast; that bound is what makes the broadcast safe). Digests of more
rows than one filter serves are written in folders by ranges of the digest, without a shuffle, and the
ranges are filtered one after another, so a filter never fills up. What is flagged carries 40 bytes a
row and is aggregated before it is sent, so a hot text costs one row per task. Partial filters travel
as compressed 32 KiB segments, merged per segment on the executors.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, scratch_path, seeded, stored

BITS_PER_ROW = 16
MAX_FILTER_BITS = 1 << 29
HASHES = 3
SEGMENT_BITS = 1 << 18


def _positions(key: np.ndarray, bits: int) -> list[np.ndarray]:
    """HASHES bit positions of each 64-bit key (`bits` is a power of two)."""
    out = []
    for salt in seeded(HASHES, 3):
        x = (key ^ salt) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((x >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64))
    return out


def _set_bits(bits: np.ndarray, at: np.ndarray) -> None:
    """Set the bits at sorted places of a packed bitmap."""
    if len(at):
        begin = np.flatnonzero(np.concatenate([[True], at[1:] >> 3 != at[:-1] >> 3]))
        bits[at[begin] >> 3] |= np.bitwise_or.reduceat((128 >> (at & 7)).astype(np.uint8), begin)


def _saturate(once: np.ndarray, twice: np.ndarray, hit: np.ndarray) -> None:
    """Count the hits (sorted, repeats included) into two packed bitmaps."""
    _set_bits(twice, hit[1:][hit[1:] == hit[:-1]])
    _set_bits(twice, hit[(once[hit >> 3] >> (7 - (hit & 7)).astype(np.uint8) & 1).astype(bool)])
    _set_bits(once, hit)


def _partial_filter(bits: int):
    """Of a partition: its segments that have bits, as (segment, compressed once + twice)."""
    size = min(bits, SEGMENT_BITS)

    def run(batches):
        once, twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for hit in _positions(key, bits):
                _saturate(once, twice, np.sort(hit))
        for k in range(bits // size):
            part = slice(k * size // 8, (k + 1) * size // 8)
            if once[part].any():
                body = zlib.compress(once[part].tobytes() + twice[part].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([body], pa.binary())], ["segment", "body"])

    return run


def _merge_sorted(least: int):
    """Merge partial segments; the rows of a segment come one after another, so one segment is held at a time."""

    def run(rows):
        segment, once, twice = None, None, None

        def out():
            body = zlib.compress((once if least == 1 else twice).tobytes(), 1)
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([body], pa.binary())], ["segment", "body"])

        for b in rows:
            for k, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                one, two = np.split(np.frombuffer(zlib.decompress(body), dtype=np.uint8), 2)
                if k != segment:
                    if segment is not None:
                        yield out()
                    segment, once, twice = k, one.copy(), two.copy()
                else:
                    twice |= two | (once & one)
                    once |= one
        if segment is not None:
            yield out()

    return run


def bloom_filter(keys: DataFrame, least: int, most_bits: int = MAX_FILTER_BITS) -> bytes:
    """Over a stored one-column table of 64-bit keys: the packed bitmap of bits hit at least `least` (1 or 2) times."""
    bits = 1 << max(10, min(most_bits.bit_length() - 1, (BITS_PER_ROW * max(1, keys.count()) - 1).bit_length()))
    size = min(bits, SEGMENT_BITS)
    parts = keys.mapInArrow(_partial_filter(bits), "segment int, body binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge_sorted(least), "segment int, body binary")
    out = bytearray(bits // 8)
    for row in merged.collect():  # at most most_bits / 8 bytes in all
        out[row.segment * size // 8 : (row.segment + 1) * size // 8] = zlib.decompress(row.body)
    return bytes(out)


def holds(bitmap: bytes, key: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each 64-bit key."""
    filled = np.frombuffer(bitmap, dtype=np.uint8)
    out = np.ones(len(key), dtype=bool)
    for at in _positions(key, len(filled) * 8):
        out &= (filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def tester(spark, bitmap: bytes):
    """A column function: may the filter hold the row's key? The bitmap's size is bounded by MAX_FILTER_BITS."""
    spread = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        return pd.Series(holds(spread.value, key.to_numpy().view(np.uint64)))

    return maybe


def may_hold(spark, keys: DataFrame):
    """A column function: false only for a 64-bit key that `keys` (one column) doesn't hold."""
    return tester(spark, bloom_filter(stored(keys, "keys"), 1))


def _digest(text):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def key_of(digest):
    """The first 60 bits of a digest in hexadecimal digits."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def possibly_repeated(digests: DataFrame, column: str, spark):
    """A column function over SHA-256 digests: false only for a digest that `digests` holds once at most."""
    maybe = tester(spark, bloom_filter(stored(digests.select(key_of(F.col(column)).alias("_key")), "keys"), 2))
    return lambda digest: maybe(key_of(digest))


def _decided(hashed: DataFrame, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """Of a stored table (doc_id, text_sha256, _key): the rows that are certainly alone, and (lazily) the others with their groups."""
    maybe = tester(hashed.sparkSession, bloom_filter(hashed.select("_key"), 2, most_bits))
    flagged = hashed.withColumn("_maybe", maybe("_key"))
    alone = flagged.filter(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    same = stored(flagged.filter("_maybe").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n")), "repeated")
    groups = stored(same.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "groups")
    decided = (
        same.join(groups, "text_sha256")
        .withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "text_sha256")
    )
    return alone, decided


def group_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; null counts as empty. Of equal texts the row with
    the largest doc_id stays; a null doc_id is smaller than any other. Of rows that repeat both doc_id
    and text, exactly one is kept. Only digests travel, never texts. Empty table: empty result.
    """
    docs = docs_of(df, id_col, text_col)
    spark, ranges = df.sparkSession, -(-docs.count() * BITS_PER_ROW // most_bits)
    hashed = docs.select("doc_id", _digest(F.col("text")).alias("text_sha256")).withColumn("_key", key_of(F.col("text_sha256")))
    if ranges <= 1:
        alone, decided = _decided(stored(hashed, "digests"), most_bits)
        return alone.unionByName(decided)
    # equal digests are in one range, and a range's rows fit one filter
    path, out = scratch_path(spark, "digests"), scratch_path(spark, "decided")
    hashed.withColumn("_range", F.shiftright(F.shiftright("_key", 30) * ranges, 30)).write.partitionBy("_range").parquet(path)
    by_range = spark.read.schema(hashed.schema.add("_range", "long")).parquet(path)
    for k in range(ranges):
        for part in _decided(by_range.filter(F.col("_range") == k).drop("_range"), most_bits):
            part.write.mode("append").parquet(out)
    return spark.read.schema(part.schema).parquet(out)


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with all its columns and one row of each group of equal texts: that with the largest doc_id.

    Rows that the filter clears pass straight through; the others are reduced inside each task before
    the shuffle (a maximum over whole rows), so a hot text sends one row per task.
    """
    key = key_of(_digest(F.col(f"`{text_col}`")))
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), key.alias("_key"))
    maybe = tester(df.sparkSession, bloom_filter(stored(keyed.select("_key"), "keys"), 2))
    tested = keyed.withColumn("_maybe", maybe("_key"))
    alone = tested.filter(~F.col("_maybe")).select("_row.*")
    text, order = F.col(f"_row.`{text_col}`"), F.struct(F.col(f"_row.`{id_col}`"), F.xxhash64("_row"))
    best = tested.filter("_maybe").groupBy(_digest(text).alias("_digest")).agg(F.max_by("_row", order).alias("_row"))
    return alone.unionByName(best.select("_row.*"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return group_exact(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""
