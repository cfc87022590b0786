import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tracemill.llm import packing

PATH = P.path("byte_bpe_50k.json")


def test_first_fit_decreasing_is_the_plain_algorithm():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 50))]
        plain: list[list[int]] = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            for b in plain:
                if sum(sizes[k] for k in b) + sizes[i] <= 100:
                    b.append(i)
                    break
            else:
                plain.append([i])
        assert packing.first_fit_decreasing(sizes, 100) == plain


def test_gaps_are_filled_and_nothing_is_lost():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 60))]
        bins = [[(i, 0, sizes[i]) for i in b] for b in packing.first_fit_decreasing(sizes, 100)]
        out = packing.fill_gaps(bins, 100, 5)
        got = defaultdict(list)
        for b in out:
            assert sum(n for *_, n in b) <= 100
            for i, start, n in b:
                got[i].extend(range(start, start + n))
        assert {i: sorted(v) for i, v in got.items()} == {i: list(range(n)) for i, n in enumerate(sizes)}
        assert sum(100 - sum(n for *_, n in b) >= 5 for b in out) <= 1


def check(rows, docs):
    hf = Tokenizer.from_file(PATH)
    hf.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(docs)
    for doc_id, text in docs.items():
        ids = np.array(hf.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_query(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = packing.op1_packing(spark, tiny)
    check(got.collect(), docs)
    assert packing.padding(got).first().share < 0.02


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 40_000, "c"), (4, "x", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    check(packing.pack(df, PATH).collect(), {r[0]: r[1] for r in rows})
    twice = packing.pack(spark.createDataFrame([(1, "x", 1), (1, "x", 1), (None, "y", 1)], "doc_id long, text string, row int"), PATH).collect()
    assert sorted((r.doc_id is None, r.start, r.length) for r in twice) == [(False, 0, 2), (False, 0, 2), (True, 0, 2)]
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_added_tokens_as_the_library_gives_them(spark):
    hf = Tokenizer.from_file(PATH)
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "plain")]
    got = {r.doc_id: r for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    for doc_id, text in rows:
        ids = np.array(hf.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        assert got[doc_id].length == got[doc_id].doc_tokens == len(ids) and got[doc_id].ids_crc32 == zlib.crc32(ids.tobytes())
