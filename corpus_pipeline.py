"""The corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All stages but the last return the columns of documents; a stage
works on every row that the one before kept, and what it decides takes effect.
"""

from __future__ import annotations

import threading
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import common, exact_dedup, jaccard, packing, quality, substring_dedup
from tracemill.sources.scratch import place

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies: word n-grams of five words, similarity of 0.8 or more.
WORDS, THRESHOLD = 5, 80


#: Of each thread: scratch tables of the stage that was called last outside of `run`.
_last = threading.local()


def _stage():
    """Scratch tables made inside belong to the run, or, for a stage called by itself, to the stage: they go when the thread begins another one, as the one before is written then."""
    if common.owner():
        return nullcontext()
    if not hasattr(_last, "held"):
        _last.held = common.Scratch()
    _last.held.drop()
    return common.scratch(_last.held)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    with _stage():
        return quality.drop_bad(docs, quality.fit(docs)).select(COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of equal texts, that with the largest doc_id."""
    with _stage():
        return exact_dedup.drop_exact(docs).select(COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest doc_id; documents without words stay."""
    with _stage():
        return jaccard.drop_similar(docs.select(COLUMNS), words=WORDS, threshold=THRESHOLD)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words and more that an earlier document, or an earlier place, has; documents left without words go."""
    with _stage():
        cut = substring_dedup.remove_repeats(docs.select(COLUMNS))
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_words"))
    kept = cut.filter(~emptied).select("row.*", "n_removed")
    size = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", size).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 ids."""
    import public_tokenizers

    with _stage():
        return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("exact copies", exact_stage),
    ("near copies", near_stage),
    ("passages", passage_stage),
    ("packing", packing_stage),
]

#: SQL can't express the learned and the packing stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written to the shared folder; what a stage read or made goes once it is written.

    What the last stage made stays for as long as the application, as its result may be read at any time.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with common.scratch() as own:
            result = stage(spark, docs, sf_dir)
        path = place(spark, "stage")
        result.write.parquet(path)
        own.drop()
        if before:
            common.drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    with common.scratch():
        return STAGES[-1][1](spark, docs, sf_dir)
