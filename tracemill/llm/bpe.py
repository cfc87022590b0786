"""Byte-level BPE: encoding and decoding of whole texts.

Splitting: the pattern's alternatives only look at character classes (letter, number, white
space, other), one leading space and seven contractions, so the piece boundaries of a chunk of
texts come from numpy masks over its code points instead of a regular-expression engine.

Merging: every distinct piece that is not cached gets a segment tree whose leaves are its byte
positions; a leaf holds the rank of the pair that starts there, and a node the smallest
(rank, position) below it, so the root names the leftmost pair of least rank. A merge updates
three leaves (the merged pair, the token that vanished, the pair before) along log2(width)
levels. The trees of all pieces of a width are advanced together, one merge a round. A piece longer
than `LONG_PIECE` has a tree of its own: all pairs of the least rank are found by one walk down from
the root and merged in one round, up to the first whose new neighbours would come before the rest.

A worker keeps the ids of up to `CACHE_PIECES` pieces between chunks; the cache is rebuilt when
it is full, so memory stays bounded and results do not depend on it. Pieces are looked up by hash,
and what is found is compared byte by byte.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, parts, range_hashes

CACHE_PIECES = 400_000
TEXT_BYTES = 1 << 20
LONG_PIECE = 1 << 11
_NONE = np.int64(1) << np.int64(62)
_NO_RANK = np.iinfo(np.int32).max
_EDGE, _SPACE, _LETTER, _NUMBER, _OTHER = range(5)
#: The White_Space characters of Unicode.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = _LETTER
        elif kind == "N":
            out[cp] = _NUMBER
    out[_WHITE] = _SPACE
    return out


def split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of UTF-8 texts: (bytes of all texts, piece starts, piece ends, pieces before each text and in all).

    The same pieces as the public byte-level pattern
    `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.
    """
    joined = b"\n".join([b"", *texts, b""])
    data = np.frombuffer(joined, dtype=np.uint8)
    cp = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    kind = _classes()[cp]
    at_byte = np.flatnonzero((data & 0xC0) != 0x80)  # where each code point begins
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    edges = np.concatenate([[0], np.cumsum(lengths + 1)])
    edge_at = np.searchsorted(at_byte, edges)
    kind[edge_at] = _EDGE
    first = np.empty(len(kind), dtype=bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first[edge_at] = True
    blank = (cp == 0x20) & (kind == _SPACE)
    start = first.copy()
    # the last white space before something: a piece of its own, or the head of what follows if it is a blank
    last_ws = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] > _SPACE))
    start[last_ws] = True
    start[last_ws[blank[last_ws]] + 1] = False
    quote = np.flatnonzero((cp[:-1] == 0x27) & first[:-1] & (kind[:-1] == _OTHER) & (kind[1:] == _LETTER))
    quote = quote[~blank[quote - 1]]
    if len(quote):
        c1, c2 = cp[quote + 1], cp[np.minimum(quote + 2, len(cp) - 1)]
        short = np.isin(c1, [ord(c) for c in "stmd"])
        long = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        quote, size = quote[short | long], np.where(short, 1, 2)[short | long]
        start[quote + 1] = False
        rest = quote + 1 + size
        rest = rest[kind[rest] == _LETTER]
        start[rest] = True
    start[edge_at] = True
    begin = np.flatnonzero(start)
    keep = kind[begin] != _EDGE
    bounds = np.append(begin[1:], len(kind))
    starts, ends = at_byte[begin[keep]], np.append(at_byte, len(data))[bounds[keep]]
    return data, starts, ends, np.searchsorted(starts, edges)


def _same(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether x[x_at : x_at + size] and y[y_at : y_at + size] are the same bytes, for each pair."""
    where = _ramp(size)
    differ = x[np.repeat(x_at, size) + where] != y[np.repeat(y_at, size) + where]
    wrong = np.zeros(len(size), dtype=bool)
    wrong[np.repeat(np.arange(len(size)), size)[differ]] = True
    return ~wrong


class Codec:
    """Ids of pieces by a table of mergeable pairs.

    `whole`: a piece that is itself a token gets its id at once (as rank files ask for).
    `added`: tokens outside of the merges, by their bytes, which `encode` can find in texts.
    """

    def __init__(self, tokens: list[bytes], pairs: dict[tuple[int, int], tuple[int, int]], whole: bool, added: dict[bytes, int] | None = None):
        """tokens: bytes by id. pairs: (left id, right id) to (rank, merged id)."""
        self.added = added or {}
        self.added_pattern = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        single = {t: i for i, t in enumerate(tokens) if len(t) == 1}
        self.byte_id = np.array([single[bytes([b])] for b in range(256)], dtype=np.int64)
        order = sorted(pairs)
        self.pair_key = np.array([a << 32 | b for a, b in order], dtype=np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in order], dtype=np.int64)
        self.merged = np.zeros(int(self.pair_rank.max()) + 1, dtype=np.int64)
        self.merged[self.pair_rank] = [pairs[k][1] for k in order]
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_keys = np.zeros(0, dtype=np.uint64)
        self.seed = 0
        if whole:
            key = range_hashes(self.bytes, self.first[:-1], self.first[1:], self.seed)
            while len(np.unique(key)) < len(set(tokens)):  # two tokens with one hash: take another hash
                self.seed += 1
                key = range_hashes(self.bytes, self.first[:-1], self.first[1:], self.seed)
            self.token_ids = np.argsort(key)
            self.token_keys = key[self.token_ids]
        self._forget()

    def _forget(self) -> None:
        """Empty the cache: sorted hashes of pieces, the row of each, and per row its ids and its bytes."""
        self.keys, self.rows = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.at, self.flat = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.body_at, self.body = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def _merge_all(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces no longer than `width` (a power of two): flat, and how many each has."""
        n, bits = len(starts), np.int64(width.bit_length() - 1)
        here = np.arange(width)
        inside = here < size[:, None]
        ids = self.byte_id[data[np.where(inside, starts[:, None] + here, 0)]]
        alive = inside.copy()
        after = np.broadcast_to(here + 1, (n, width)).copy()
        before = np.broadcast_to(here - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        row, col = np.nonzero(inside[:, 1:])
        rank = self._rank(ids[row, col], ids[row, col + 1])
        row, col, rank = row[rank >= 0], col[rank >= 0], rank[rank >= 0]
        tree[row, width + col] = rank << bits | col
        half = width
        while half > 1:
            np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2], out=tree[:, half // 2 : half])
            half //= 2
        # flat views: position p of row r is r * width + p
        ids, alive, after, before, tree = (x.reshape(-1) for x in (ids, alive, after, before, tree))
        rows = np.flatnonzero(tree[1 :: 2 * width] < _NONE)
        while len(rows):
            root = tree[rows * (2 * width) + 1]
            pos, rank = root & np.int64(width - 1), root >> bits
            base, end = rows * width, size[rows]
            right = after[base + pos]
            following = after[base + right]
            token = self.merged[rank]
            ids[base + pos] = token
            alive[base + right] = False
            after[base + pos] = following
            has_next = following < end
            before[(base + following)[has_next]] = pos[has_next]
            ahead = np.full(len(rows), -1, dtype=np.int64)
            ahead[has_next] = self._rank(token[has_next], ids[(base + following)[has_next]])
            prev = before[base + pos]
            has_prev = prev >= 0
            behind = self._rank(ids[(base + prev)[has_prev]], token[has_prev])
            leaf = rows * (2 * width) + width
            tree[leaf + right] = _NONE
            tree[leaf + pos] = np.where(ahead >= 0, ahead << bits | pos, _NONE)
            tree[(leaf + prev)[has_prev]] = np.where(behind >= 0, behind << bits | prev[has_prev], _NONE)
            node = np.concatenate([width + right, width + pos, (width + prev)[has_prev]])
            of = np.concatenate([rows, rows, rows[has_prev]]) * (2 * width)
            for _ in range(int(bits)):
                node >>= 1
                tree[of + node] = np.minimum(tree[of + 2 * node], tree[of + 2 * node + 1])
            rows = rows[tree[rows * (2 * width) + 1] < _NONE]
        return ids[alive].astype(np.int32), alive.reshape(n, width).sum(axis=1)

    def _merge_long(self, piece: np.ndarray) -> np.ndarray:
        """Ids of one long piece. A round merges all pairs of the least rank, from the left, up to one that makes a pair of no larger rank."""
        n = len(piece)
        leaves = 1 << (n - 1).bit_length()
        ids = self.byte_id[piece]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        alive = np.ones(n, dtype=bool)

        def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            found = self._rank(left, right)
            return np.where(found < 0, _NO_RANK, found).astype(np.int32)

        tree = np.full(2 * leaves, _NO_RANK, dtype=np.int32)
        tree[leaves : leaves + n - 1] = ranks(ids[:-1], ids[1:])
        half = leaves
        while half > 1:
            np.minimum(tree[half : 2 * half : 2], tree[half + 1 : 2 * half : 2], out=tree[half // 2 : half])
            half //= 2
        while (rank := tree[1]) < _NO_RANK:
            at = np.ones(1, dtype=np.int64)
            while at[0] < leaves:
                at = (2 * at[:, None] + np.arange(2)).reshape(-1)
                at = at[tree[at] == rank]
            at -= leaves
            # pairs that overlap stand in chains: every other one is merged
            begin = np.concatenate([[True], after[at[:-1]] != at[1:]])
            index = np.arange(len(at))
            at = at[(index - np.maximum.accumulate(np.where(begin, index, 0))) % 2 == 0]
            right = after[at]
            follow, lead = after[right], before[at]
            token = self.merged[rank]
            left_id = np.where(np.concatenate([[False], follow[:-1] == at[1:]]), token, ids[np.maximum(lead, 0)])
            behind = np.where(lead >= 0, ranks(left_id, np.full(len(at), token)), _NO_RANK)
            ahead = np.where(follow < n, ranks(np.full(len(at), token), ids[np.minimum(follow, n - 1)]), _NO_RANK)
            early = np.flatnonzero(np.minimum(behind, ahead) <= rank)
            if len(early):  # a new pair comes next: it may change what is merged behind it
                at, right, follow, lead = (x[: early[0] + 1] for x in (at, right, follow, lead))
            ids[at] = token
            alive[right] = False
            after[at] = follow
            before[follow[follow < n]] = at[follow < n]
            tree[leaves + right] = _NO_RANK
            touched = np.union1d(at, lead[(lead >= 0) & alive[np.maximum(lead, 0)]])
            next_ = after[touched]
            tree[leaves + touched] = np.where(next_ < n, ranks(ids[touched], ids[np.minimum(next_, n - 1)]), _NO_RANK)
            node = np.union1d(touched, right) + leaves
            while node[0] > 1:
                node >>= 1
                node = node[np.concatenate([[True], node[1:] != node[:-1]])]
                tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
        return ids[alive].astype(np.int32)

    def _encode_new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of pieces, in order."""
        size = ends - starts
        width = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        counts = np.zeros(len(starts), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = np.ones(len(starts), dtype=bool)
        if len(self.token_keys):
            at = self.token_ids[np.minimum(np.searchsorted(self.token_keys, keys), len(self.token_keys) - 1)]
            hit = np.flatnonzero(self.size[at] == size)
            hit = hit[_same(self.bytes, self.first[at[hit]], data, starts[hit], size[hit])]
            parts.append((hit, at[hit].astype(np.int32), np.ones(len(hit), dtype=np.int64)))
            todo[hit] = False
        for i in np.flatnonzero(todo & (size > LONG_PIECE)).tolist():
            ids = self._merge_long(data[starts[i] : ends[i]])
            parts.append((np.array([i]), ids, np.array([len(ids)])))
            todo[i] = False
        for w in np.unique(width[todo]):
            some = np.flatnonzero(todo & (width == w))
            step = max(1, (1 << 19) // int(w))
            for k in range(0, len(some), step):
                part = some[k : k + step]
                parts.append((part, *self._merge_all(data, starts[part], size[part], int(w))))
        for part, _, n in parts:
            counts[part] = n
        at = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(at[-1], dtype=np.int32)
        for part, ids, n in parts:
            flat[np.repeat(at[part], n) + _ramp(n)] = ids
        return flat, counts

    def _grow(self, flat: np.ndarray, counts: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Add rows with their ids and bytes; their numbers."""
        first = len(self.at) - 1
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
        self.flat = np.concatenate([self.flat, flat])
        self.body_at = np.concatenate([self.body_at, self.body_at[-1] + np.cumsum(size)])
        self.body = np.concatenate([self.body, data[np.repeat(starts, size) + _ramp(size)]])
        return first + np.arange(len(counts))

    def encode(self, texts: list[bytes], added: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts, and where each text's ids begin (one more entry than texts).

        `added`: text that spells an added token becomes its id, and the text on either side is split for itself.
        """
        if added and self.added_pattern and any(self.added_pattern.search(t) for t in texts):
            return self._encode_around(texts)
        data, starts, ends, bounds = split(texts)
        size = ends - starts
        hashes = range_hashes(data, starts, ends, self.seed)
        keys, piece_of = np.unique(hashes, return_inverse=True)
        sample = np.zeros(len(keys), dtype=np.int64)
        sample[piece_of] = np.arange(len(starts))
        if len(self.keys) > CACHE_PIECES or len(self.body) > 16 * CACHE_PIECES:
            self._forget()
        known = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        if len(self.keys):
            new = self.keys[np.minimum(known, len(self.keys) - 1)] != keys
        if new.any():
            some = sample[new]
            rows = self._grow(*self._encode_new(data, starts[some], ends[some], keys[new]), data, starts[some], size[some])
            self.rows = np.insert(self.rows, known[new], rows)
            self.keys = np.insert(self.keys, known[new], keys[new])
        row = self.rows[np.searchsorted(self.keys, keys)][piece_of]
        right = self.body_at[row + 1] - self.body_at[row] == size
        right[right] = _same(self.body, self.body_at[row[right]], data, starts[right], size[right])
        if not right.all():  # another piece has the same hash: these get rows that no hash leads to
            some = np.flatnonzero(~right)
            row[some] = self._grow(*self._encode_new(data, starts[some], ends[some], hashes[some]), data, starts[some], size[some])
        n = self.at[row + 1] - self.at[row]
        ids = self.flat[np.repeat(self.at[row], n) + _ramp(n)]
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, total[bounds]

    def _encode_around(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[bytes] = []
        of_text: list[list[int]] = []  # numbers of parts, or ids of added tokens as -1 - id
        for t in texts:
            own, at = [], 0
            for m in self.added_pattern.finditer(t):
                own += [len(parts), -1 - self.added[m[0]]]
                parts.append(t[at : m.start()])
                at = m.end()
            own.append(len(parts))
            parts.append(t[at:])
            of_text.append(own)
        ids, at = self.encode(parts)
        out = [np.concatenate([ids[at[k] : at[k + 1]] if k >= 0 else np.array([-1 - k], dtype=np.int32) for k in own]) for own in of_text]
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, end to end, and where the bytes of each id begin (one more entry than ids)."""
        n = self.size[ids]
        return self.bytes[np.repeat(self.first[ids], n) + _ramp(n)], np.concatenate([[0], np.cumsum(n)])


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0 … n-1 for each n, end to end."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


@lru_cache(4)
def codec(path: str) -> Codec:
    """Of a rank file (`.tiktoken`) or a byte-level vocabulary with merges (`.json`); once per Python worker."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        shown = _shown_bytes()
        raw = lambda token: bytes(shown[c] for c in token)
        vocab = model["vocab"]
        tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            tokens[i] = raw(token) if all(c in shown for c in token) else token.encode()
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        return Codec(tokens, pairs, whole=False, added={x["content"].encode("utf-8"): x["id"] for x in whole.get("added_tokens", [])})
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    pairs = {}
    for token, rank in ranks.items():
        tokens[rank] = token
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                pairs[a, b] = (rank, rank)
    return Codec(tokens, pairs, whole=True)


def _shown_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown = {chr(b): b for b in plain}
    shown |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return shown


def encoded_batches(batches, path: str, added: bool = False):
    """Of Arrow batches whose last column is the text: (the other columns, flat ids, where each text's ids begin)."""
    tool = codec(path)
    for b in batches:
        for lo, hi, texts in parts(b.column(b.num_columns - 1), TEXT_BYTES):
            ids, at = tool.encode(texts, added)
            yield [c.slice(lo, hi - lo) for c in b.columns[:-1]], ids, at


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, without special tokens; null text: no ids.

    Repeated rows give repeated rows; an empty table gives an empty one.
    """

    def run(batches):
        for (doc_id,), ids, at in encoded_batches(batches, path):
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([doc_id, lists], ["doc_id", "ids"])

    return docs_of(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded binary) from (doc_id, ids): the bytes that the ids stand for."""

    def run(batches):
        tool = codec(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                lists = part.column(1)
                flat = lists.flatten().to_numpy()
                at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
                body, place = tool.decode(flat)
                whole = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(place[at].astype(np.int32)), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([*part.columns, whole], ["doc_id", "ids", "decoded"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decode(encode(docs, path), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
