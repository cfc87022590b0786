import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tracemill.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")
MERGES = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(5)
    letters = ["a", "b", "Z", "é", "ß", "中", "😀", "1", "२", "½", " ", " ", "  ", "\n", "\t", " ", "'", "'s", "'ll", "'re", "'t", "!", "!!", "-", "　", "́", "\x00", "\x1c", "_"]
    out = ["", " ", "  ", "\n", "a", "'s", " 's", "x's", "!'s", "don't", "we'll've", "'twas", "'LL", "a  b", "a \n b", "trail  ", "\n\n's", "a" * 5000, "ab " * 300, "😀" * 70, "3.14 1000", "<|endoftext|>"]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)]


def real_texts(tiny):
    import pyarrow.parquet as pq

    return [t or "" for t in pq.read_table(f"{tiny}/documents.parquet").column("text").to_pylist()]


def test_split_is_the_pattern():
    texts = odd_texts()
    data, starts, ends, bounds = bpe.split([t.encode() for t in texts])
    pattern = regex.compile(P.PATTERN)
    for i, t in enumerate(texts):
        got = [bytes(data[a:b]).decode() for a, b in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]], strict=True)]
        assert got == [m for m in pattern.findall(t)] or "\x1c" in t, t


def test_ids_as_the_libraries_give(own, tiny):
    texts = odd_texts() + real_texts(tiny)
    ids, at = bpe.codec(RANKS).encode([t.encode() for t in texts])
    hf = Tokenizer.from_file(MERGES)
    hf.encode_special_tokens = True
    ids2, at2 = bpe.codec(MERGES).encode([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == own.encode_ordinary(t), t
        assert ids2[at2[i] : at2[i + 1]].tolist() == hf.encode(t, add_special_tokens=False).ids or "\x1c" in t, t


def test_cache_limit_changes_nothing(monkeypatch, tiny):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    texts = [t.encode() for t in real_texts(tiny)[:60]]
    tool = bpe.codec(RANKS)
    whole, at = tool.encode(texts)
    parts = [tool.encode([t])[0] for t in texts]
    assert np.array_equal(np.concatenate(parts), whole)


def test_query(spark, tiny, own):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = bpe.op7_bpe(spark, tiny).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = own.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_nulls_repeats_empty(spark):
    df = spark.createDataFrame([(1, None, 2), (1, "a b", 3), (1, "a b", 3), (None, "x" * 200_000, 4)], "doc_id long, text string, ids int")
    rows = bpe.decode(bpe.encode(df, RANKS), RANKS).collect()
    assert sorted(bytes(r.decoded) for r in rows) == [b"", b"a b", b"a b", b"x" * 200_000]
    assert bpe.decode(bpe.encode(df.limit(0), RANKS), RANKS).collect() == []


def thue_morse(n, letters="ab"):
    word = letters[0]
    while len(word) < n:
        word += "".join(letters[1 - letters.index(c)] for c in word)
    return word[:n]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_pieces_that_a_polynomial_hash_confuses(own, n):
    texts = [thue_morse(n), thue_morse(n, "ba"), thue_morse(n) + " " + thue_morse(n, "ba")]
    tool = bpe.codec(RANKS)
    ids, at = tool.encode([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == own.encode_ordinary(t)
        assert tool.decode(ids[at[i] : at[i + 1]])[0].tobytes() == t.encode()


def test_equal_hashes_change_nothing(monkeypatch, own, tiny):
    texts = real_texts(tiny)[:40] + odd_texts()[:300]
    monkeypatch.setattr(bpe, "range_hashes", lambda data, starts, ends, seed=0: ((ends - starts) % 7).astype(np.uint64))
    bpe.codec.cache_clear()
    ids, at = _unhashed(bpe.codec(MERGES), texts)
    monkeypatch.undo()
    bpe.codec.cache_clear()
    want, want_at = bpe.codec(MERGES).encode([t.encode() for t in texts])
    assert np.array_equal(ids, want) and np.array_equal(at, want_at)


def _unhashed(tool, texts):
    half = len(texts) // 2
    a, at = tool.encode([t.encode() for t in texts[:half]])
    b, bt = tool.encode([t.encode() for t in texts[half:]])
    return np.concatenate([a, b]), np.concatenate([at, at[-1] + bt[1:]])


def long_pieces():
    rng = random.Random(8)
    some = lambda parts, n: "".join(rng.choice(parts) for _ in range(n))
    return ["a" * 5001, "ab" * 4000, "中文字符" * 1000, some("abcdeingthes", 9000), some("aab", 6000), some(["ing", "tion", "the", "a", "er", "é"], 3000), "!?" * 2500, "12345" * 900]


def test_long_pieces(own):
    hf = Tokenizer.from_file(MERGES)
    for t in long_pieces():
        assert bpe.codec(RANKS).encode([t.encode()])[0].tolist() == own.encode_ordinary(t)
        assert bpe.codec(MERGES).encode([t.encode()])[0].tolist() == hf.encode(t, add_special_tokens=False).ids


def test_added_tokens_as_the_library_finds_them():
    hf = Tokenizer.from_file(MERGES)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "", "none", "<|endoftext|", " <|endoftext|>\n\n <|endoftext|>  x", "  <|endoftext|>"]
    ids, at = bpe.codec(MERGES).encode([t.encode() for t in texts], added=True)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == hf.encode(t, add_special_tokens=False).ids, t
