"""Exact similarity join of documents on the Jaccard measure of their word n-grams, by PartEnum signatures.

Sets of equal content are one *node* from the start. Sizes fall into bands whose bounds grow by
the inverse of the threshold, so similar sets lie in one band or in neighbouring ones; a set
signs for its own band and for the next. Two such sets differ in at most k shingles, k known per
band. The shingle domain is hashed into n1 parts of three sub-parts, with n1 at least (k + 1) / 2:
then some part differs in at most one shingle, so two of its three sub-parts agree. Every pair of
sub-parts gives one signature, and similar sets share at least one.

Nodes that share a signature form groups; the many signatures of similar sets give the same few
groups, so each distinct group is looked at once. A parity sketch (a bit is the parity of the shingles
hashed to it; about two bits a shingle) bounds the difference of two sets from below, so a group falls apart
into clusters without reading sets, and no similar pair is lost. Clusters are then verified exactly
with an inverted index over their sets. Large groups and clusters are dealt into blocks: components
within blocks, then among one representative per component, and where a cluster is still apart,
between what lies outside of its largest component and every block. No link between different texts is lost and no list of pairs is made.

A node is a set's 64-bit hash, unless another set has the same one: a second hash tells them apart, and
then both are named by it, so identity rests on 128 bits. A shingle is a 64-bit hash of its words; a
collision can only matter between two sets of one cluster.

Where a part has two empty sub-parts their signature says nothing, and unrelated sets would share it. As
such a part differs in one shingle at most, the set signs instead with what the third sub-part holds, whole
and without each one of its shingles. Nothing is left so of a part with one shingle at most. There are some
parts more than similar sets need, so a set with no more such parts than that can do without them; one that has
more signs for a second and independent division of the domain as well (if either of two similar sets has few,
they share a signature of the first; else both sign for the second), and so on for LEVELS divisions.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, docs_of, mix, parts, run_hashes, stored
from .components import components
from .exact_dedup import bloom_filter, holds, key_of, may_hold
from .substring_dedup import pack, unpack

WORDS = 4
THRESHOLD = 85  # per cent
#: Members of a cluster that one verification unit holds at most, about, and their shingles together.
UNIT, UNIT_SHINGLES = 512, 1 << 20
#: Members of a group whose sketches one unit holds at most, about.
GROUP_UNIT = 8192
#: Signatures of a bucket, and those a task gathers before it sends its blocks.
BUCKET_ENTRIES = 1 << 18
BLOCK_ENTRIES = 1 << 18
#: Divisions of the domain for sets with empty sub-parts.
LEVELS = 4
#: Bits of a parity sketch, by the size of the set.
LEAST_BITS, MOST_BITS = 512, 1 << 15
_U = np.uint64


def shingle_sets(texts: list[bytes], words: int = WORDS):
    """Of each text (lower-cased A-Z): sorted distinct hashes of its runs of `words` words; of fewer words, one hash of all."""
    table = Words(texts, lower=True)
    hashes = table.hashes()
    grams = run_hashes(hashes, words)
    for a, b in zip(table.bounds[:-1], table.bounds[1:], strict=True):
        if b - a >= words:
            own = np.sort(grams[a : b - words + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        else:
            yield run_hashes(hashes[a:b], b - a, 1000 + int(b - a)) if b > a else np.zeros(0, dtype=_U)


def set_hashes(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """A 64-bit hash of each set."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    flat = np.concatenate([*sets, np.zeros(0, dtype=_U)])
    sums = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(mix(flat ^ _U(0x5E7 + 0x9E3779B97F4A7C15 * seed % (1 << 64))), dtype=_U)])
    at = np.concatenate([[0], np.cumsum(size)])
    return mix(sums[at[1:]] - sums[at[:-1]] + mix(size.astype(_U) + _U(seed)))


def names_of(sets: list[np.ndarray], shared: np.ndarray | None = None, bits: int = 64) -> np.ndarray:
    """Names of sets: a hash of `bits` bits, or a second hash where the first is one of `shared` (sorted hashes that different sets have)."""
    name = set_hashes(sets, 0) & _U((1 << bits) - 1)
    if shared is not None and len(shared):
        at = np.minimum(np.searchsorted(shared, name.view(np.int64)), len(shared) - 1)
        name = np.where(shared[at] == name.view(np.int64), set_hashes(sets, 2), name)
    return name.view(np.int64)


_BOUNDS: dict[int, list[int]] = {}


def _bounds(threshold: int, size: int) -> tuple[list[int], int]:
    """Where bands of sizes begin, past `size`, and the band of `size`."""
    starts = _BOUNDS.setdefault(threshold, [1])
    while starts[-1] <= size or len(starts) < 3:
        # the first size that can't be similar to the band's first
        starts.append(starts[-1] * 100 // threshold + 1)
    return starts, int(np.searchsorted(starts, size, side="right")) - 1


def _parts(sizes: np.ndarray, threshold: int, up: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tag, n1, spare) of sets of these sizes for their own band (up = 0) or the next; n1 = 0 where only equal sets can be similar.

    Of n1 parts, so many more than `spare` differ in one shingle at most.
    """
    starts, _ = _bounds(threshold, int(sizes.max(initial=1)) * 300 // threshold + 10)
    tag = np.searchsorted(starts, sizes, side="right") - 1 + up
    starts = np.array(starts)
    most = starts[tag + 1] - 1
    k = (100 - threshold) * 2 * most // (100 + threshold)
    n1 = np.where(k > 0, (k + 2) // 2, 0)
    # the smallest sets of the tag expect so many parts of one shingle at most, and hardly ever more than `spare`
    held = starts[np.maximum(tag - 1, 0)] / np.maximum(n1, 1)
    bare = n1 * np.exp(-held) * (1 + held)
    spare = np.where(bare < 0.05, 0, np.ceil(bare + 3 * np.sqrt(bare))).astype(np.int64)
    return tag, n1 + spare, spare


def signatures_of(sets: list[np.ndarray], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, number of the set that each belongs to) of sets of shingles."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=_U)
    out, owner = [], []
    for up in (0, 1):
        tag, n1, spare = _parts(sizes, threshold, up)
        some = np.flatnonzero((sizes > 0) & (n1 > 0))
        for level in range(LEVELS):
            if not len(some):
                break
            sig, own, empty, poor = _signed(flat, sizes, some, tag, n1, level)
            some = np.flatnonzero(poor > spare)
            keep = ~empty if level < LEVELS - 1 else ~empty | (poor > spare)[own]
            out.append(sig[keep])
            owner.append(own[keep])
    return np.concatenate([*out, np.zeros(0, dtype=_U)]), np.concatenate([*owner, np.zeros(0, dtype=np.int64)])


def _signed(flat: np.ndarray, sizes: np.ndarray, some: np.ndarray, tag: np.ndarray, n1: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the sets `some`, under one division of the domain: (signatures, their sets, whether they stand for no shingle at all), and of every set its parts of one shingle at most."""
    n1 = np.where(np.isin(np.arange(len(sizes)), some), n1, 0)
    first = np.cumsum(n1) - n1
    keep = np.repeat(n1 > 0, sizes)
    of = np.repeat(np.arange(len(sizes)), sizes)[keep]
    spread = mix(flat[keep] + tag.astype(_U)[of] * _U(2654435761) + _U(1 + 0x51ED270B * level))
    # the high half of the hash chooses the part, the low half one of its three sub-parts
    part = ((spread >> _U(32)) * n1.astype(_U)[of] >> _U(32)).astype(np.int64) + first[of]
    cell = part * 3 + ((spread & _U(0xFFFFFFFF)) * _U(3) >> _U(32)).astype(np.int64)
    own = mix(spread ^ _U(0xA5A5))
    sums = np.zeros(3 * int(n1.sum()), dtype=_U)
    np.add.at(sums, cell, own)
    count = np.bincount(cell, minlength=len(sums))
    whose = np.repeat(np.arange(len(sizes)), n1)
    place = ((np.arange(len(whose)) - first[whose]) * 3).astype(_U)
    salt = tag.astype(_U)[whose] * _U(40503) + _U(0xC2B2AE3D27D4EB4F * level % (1 << 64))
    order = np.argsort(cell, kind="stable")
    begin = np.cumsum(count) - count
    out, owner, empty = [], [], []
    for j, (a, b, c) in enumerate(((0, 1, 2), (0, 2, 1), (1, 2, 0))):
        base = (place + _U(j)) * _U(0x9E3779B97F4A7C15) + salt
        bare = (count[a::3] == 0) & (count[b::3] == 0)
        out.append(mix(sums[a::3] * _U(0xD6E8FEB86659FD93) + mix(sums[b::3]) + base)[~bare])
        owner.append(whose[~bare])
        # the third sub-part whole, and less each of its shingles
        rest = 3 * np.flatnonzero(bare) + c
        n = count[rest]
        each = np.repeat(rest, n)
        less = own[order[begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)]]
        left = np.concatenate([sums[rest], sums[each] - less])
        at = np.concatenate([rest, each]) // 3
        out.append(mix(mix(left ^ _U(0x3D)) + base[at]))
        owner.append(whose[at])
        empty += [np.zeros(int((~bare).sum()), dtype=bool), np.concatenate([n == 0, np.repeat(n, n) == 1])]
    poor = np.bincount(whose[count.reshape(-1, 3).sum(axis=1) <= 1], minlength=len(sizes))
    return np.concatenate(out), np.concatenate(owner), np.concatenate(empty), poor


def signatures(shingles: np.ndarray, threshold: int) -> np.ndarray:
    return signatures_of([shingles], threshold)[0]


# ------------------------------------------------------------ candidate clusters


class Union:
    """Union-find over 0 … n-1; the smaller root stays."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        return np.fromiter(map(self.find, range(len(self.up))), dtype=np.int64, count=len(self.up))


def sketch_of(shingles: np.ndarray) -> bytes:
    """Parities of the shingles per slot: two sets differ in at least as many shingles as their sketches in bits.

    A larger set has more slots (two a shingle, about), so that its bound doesn't saturate.
    """
    bits = int(min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(shingles) - 1).bit_length())))
    slot = (mix(shingles ^ _U(77)) % _U(bits)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches at the width of the narrowest: halves of a sketch add up to that of half the slots."""
    width = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in sketches])


def _pairs(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (signature, node), by signature and node."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    keep = np.ones(len(sig), dtype=bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    return sig[keep], node[keep]


def _bucket_ranges(sig: np.ndarray, buckets: int):
    at = np.searchsorted(((sig >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64), np.arange(buckets + 1))
    return [(k, at[k], at[k + 1]) for k in range(buckets) if at[k] < at[k + 1]]


def _signature_blocks(buckets: int, words: int, threshold: int, name):
    def run(batches):
        sigs: list[np.ndarray] = []
        nodes: list[np.ndarray] = []

        def send():
            sig, node = _pairs(np.concatenate(sigs), np.concatenate(nodes))
            sigs.clear()
            nodes.clear()
            for k, a, b in _bucket_ranges(sig, buckets):
                names, of = np.unique(node[a:b], return_inverse=True)
                body = pack(sig[a:b], names, of.astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([body], pa.binary())], ["bucket", "body"])

        held = 0
        for b in batches:
            for _, _, texts in parts(b.column(0)):
                own = list(shingle_sets(texts, words))
                sig, of = signatures_of(own, threshold)
                sigs.append(sig)
                nodes.append(name(own)[of])
                held += len(sig)
                if held > BLOCK_ENTRIES:
                    yield from send()
                    held = 0
        if held:
            yield from send()

    return run


def _bucket_groups(most: int):
    """Of a bucket of signatures: the distinct groups (gid, block, blocks, node) of nodes that share one, each node once; blocks hold about `most`."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        bodies = [unpack(x) for x in rows["body"].to_pylist()]
        sig, node = _pairs(np.concatenate([p[0] for p in bodies]), np.concatenate([p[1][p[2]] for p in bodies]))
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(begin, len(sig)))
        gid = mix(np.add.reduceat(mix(node.view(_U)), begin) + size.astype(_U)).view(np.int64)
        some = np.flatnonzero(size > 1)
        some = some[np.unique(gid[some], return_index=True)[1]]
        own = size[some]
        members = node[np.repeat(begin[some], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)]
        blocks = np.repeat(-(-own // most), own)
        block = (mix(members.view(_U) + _U(5)) % blocks.astype(_U)).astype(np.int32)
        return pa.table({"gid": pa.array(np.repeat(gid[some], own), pa.int64()), "block": pa.array(block), "blocks": pa.array(blocks.astype(np.int32)), "node": pa.array(members, pa.int64())})

    return run


def _plausible(threshold: int):
    """Of some units (unit, node, label, size, sketch): links (a, b) that join what the sketches can't tell apart.

    Nodes of one label are known to be together; those of a unit's largest label are compared only with what lies outside of it.
    """

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        names, at = np.unique(rows["node"].to_numpy(), return_inverse=True)
        first = np.zeros(len(names), dtype=np.int64)
        first[at] = np.arange(len(at))
        size = rows["size"].to_numpy()[first]
        sketches = [np.frombuffer(x, dtype=np.uint64) for x in rows["sketch"].take(pa.array(first)).to_pylist()]
        unit, label = rows["unit"].to_numpy(), rows["label"].to_numpy()
        order = np.argsort(unit, kind="stable")
        union = Union(len(names))
        for rows_of in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            _, kind, count = np.unique(label[rows_of], return_inverse=True, return_counts=True)
            outside = kind != count.argmax()
            to = np.argsort(~outside, kind="stable")
            part, kind = at[rows_of][to], kind[to]
            head: dict[int, int] = {}
            for i, c in zip(part.tolist(), kind.tolist(), strict=True):
                union.join(i, head.setdefault(c, i))
            own = folded([sketches[i] for i in part])
            for k in range(min(int(outside.sum()), len(part) - 1)):
                if k % 16 == 0 and len({union.find(x) for x in part.tolist()}) == 1:
                    break
                i, rest = int(part[k]), part[k + 1 :]
                apart = np.bitwise_count(own[k + 1 :] ^ own[k]).sum(axis=1, dtype=np.int64)
                near = rest[apart * (100 + threshold) <= (100 - threshold) * (size[rest] + size[i])]
                for j in near.tolist():
                    union.join(i, j)
        roots = union.roots()
        linked = np.flatnonzero(roots != np.arange(len(names)))
        return pa.table({"a": pa.array(names[linked]), "b": pa.array(names[roots[linked]])})

    return run


def _meetings(labelled: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(unit, node, label) in which what lies outside of a group's largest label meets every block of the group, and about how many.

    labelled: a stored table (gid, block, blocks, node, label). Groups that are one component have none.
    """
    counts = labelled.groupBy("gid", "label").agg(F.count(F.lit(1)).alias("c"), F.max("blocks").alias("blocks"))
    per = counts.groupBy("gid").agg(F.max_by("label", F.struct("c", "label")).alias("largest"), (F.sum("c") - F.max("c")).alias("outside"), F.sum("c").alias("n"), F.max("blocks").alias("k"))
    per = stored(per.filter("outside > 0").withColumn("shares", F.ceil(F.col("outside") / most)), "apart")
    n = per.agg(F.sum(F.col("n") * F.col("shares") + F.col("outside") * F.col("k")).alias("n")).first().n or 0
    rest = labelled.join(per.select("gid", "largest", "shares"), "gid")
    inside = rest.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    outside = rest.filter(F.col("label") != F.col("largest")).withColumn("share", F.pmod(F.xxhash64("node", F.lit(2)), F.col("shares")))
    outside = outside.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = [x.select(F.xxhash64("gid", "share", "block").alias("unit"), "node", "label") for x in (inside, outside)]
    return both[0].unionByName(both[1]).distinct(), n


def _candidate_links(groups: DataFrame, classes: DataFrame, threshold: int, most: int) -> DataFrame:
    """(a, b): links whose components are the candidate clusters. groups: a stored table (gid, block, blocks, node).

    A group of several blocks: components within blocks, then among one node of each, then of what is still
    outside of the largest with every block. No plausible pair of a group is lost.
    """
    sketches = classes.select("node", "size", "sketch")

    def near(units: DataFrame, n: int) -> DataFrame:
        dealt = F.pmod(F.xxhash64("unit"), F.lit(max(1, n // (8 * UNIT))))
        return stored(units.join(sketches, "node").groupBy(dealt.alias("g")).applyInArrow(_plausible(threshold), "a long, b long"), "links")

    within = near(groups.select(F.xxhash64("gid", "block").alias("unit"), "node", F.col("node").alias("label")), groups.count())
    large = stored(groups.filter("blocks > 1"), "large")
    if large.isEmpty():
        return within

    def labelled(links: DataFrame) -> DataFrame:
        known = stored(components(links), "known")
        return stored(large.join(known, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "labelled")

    heads = stored(labelled(within).groupBy("gid", "label").agg(F.min("node").alias("node")), "heads")
    count = stored(heads.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / most).alias("k")), "counts")
    unit = F.xxhash64("gid", F.pmod(F.xxhash64("node", F.lit(1)), F.col("k")))
    links = within.unionByName(near(heads.join(count, "gid").select(unit.alias("unit"), "node", "label"), heads.count()))
    return links.unionByName(near(*_meetings(labelled(links), most)))


# ------------------------------------------------------------------ verification


def similar_components(sets: list[np.ndarray], threshold: int, joined: list[int] | None = None) -> np.ndarray:
    """Of some sets: the smallest position of each one's component under the threshold.

    `joined`: labels of sets that are known to be together. Each query of the inverted index gives one set's
    intersection with all others; a set of the largest component needs none, as any link to another has an end outside.
    """
    n = len(sets)
    union = Union(n)
    if joined is not None:
        seen: dict[int, int] = {}
        for i, label in enumerate(joined):
            union.join(i, seen.setdefault(label, i))
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    begin = np.flatnonzero(new)
    posting = np.repeat(np.arange(n, dtype=np.int32), size)[order]
    count = np.diff(np.append(begin, len(flat)))
    term = np.empty(len(flat), dtype=np.int32)
    term[order] = (np.cumsum(new) - 1).astype(np.int32)
    del flat, order, new
    at = np.concatenate([[0], np.cumsum(size)])
    done = np.zeros(n, dtype=bool)
    while True:
        roots = union.roots()
        largest = np.bincount(roots, minlength=n).argmax()
        todo = np.flatnonzero(~done & (roots != largest))
        if not len(todo):
            return roots
        for i in todo.tolist():
            if union.find(i) == union.find(int(largest)):
                continue
            done[i] = True
            terms = term[at[i] : at[i + 1]]
            c = count[terms]
            idx = np.repeat(begin[terms], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            both = np.bincount(posting[idx], minlength=n)
            for j in np.flatnonzero(100 * both >= threshold * (size + size[i] - both)).tolist():
                union.join(i, j)


def _candidate_sets(spread, words: int, name):
    """Of Arrow batches (doc_id, text): (node, set) of documents that stand for a clustered node; a task sends a node once."""

    def run(batches):
        sent: set[int] = set()
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy()
            for lo, hi, texts in parts(b.column(1)):
                own = list(shingle_sets(texts, words))
                names = name(own)
                some = [i for i in np.flatnonzero(holds(spread.value, stand_in(names, ids[lo:hi]))).tolist() if names[i] not in sent]
                some = list({names[i]: i for i in some}.values())
                sent.update(names[some].tolist())
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array([pack(own[i]) for i in some], pa.binary())], ["node", "shingles"])

    return run


def stand_in(node: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return mix(node.view(_U) + mix(doc_id.astype(np.int64).view(_U)))


def _stand_ins(batches):
    for b in batches:
        key = stand_in(b.column(0).to_numpy(), b.column(1).fill_null(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])


def _verify(threshold: int):
    """Of a group of units (unit, node, label, shingles): links (a, b) within each unit."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        unit, node, label = (np.asarray(rows[c].to_numpy()) for c in ("unit", "node", "label"))
        order = np.lexsort((node, unit))
        cut = np.flatnonzero(np.diff(unit[order])) + 1
        a, b = [], []
        for part in np.split(order, cut):
            sets = [unpack(x)[0] for x in rows["shingles"].take(pa.array(part)).to_pylist()]  # one unit at a time
            roots = similar_components(sets, threshold, label[part].tolist())
            a.append(node[part])
            b.append(node[part][roots])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return run


def _verified(rows: DataFrame, threshold: int, n_rows: int) -> DataFrame:
    """`rows` (unit, node, label, shingles), whole units dealt into groups of about UNIT rows or fewer."""
    groups = max(1, -(-2 * n_rows // UNIT))
    return rows.groupBy(F.pmod(F.xxhash64("unit"), F.lit(groups)).alias("g")).applyInArrow(_verify(threshold), "a long, b long")


def _similar(clusters: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(node, root) of the similarity components within clusters. clusters: a stored table (node, cluster, size); sets: (node, shingles)."""
    per = F.greatest(F.count(F.lit(1)) / UNIT, F.sum("size") / UNIT_SHINGLES)
    sizes = stored(clusters.groupBy("cluster").agg(F.ceil(per).alias("blocks")), "sizes")
    clusters = clusters.drop("size")
    placed = clusters.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = stored(placed.withColumn("unit", F.xxhash64("cluster", "block")).withColumn("label", F.col("node")), "placed")
    within = stored(_verified(sets.join(placed, "node").select("unit", "node", "label", "shingles"), threshold, placed.count()), "within")
    found = within.select(F.col("a").alias("node"), F.col("b").alias("root"))
    large = placed.filter("blocks > 1")
    if large.isEmpty():
        return found
    # clusters of several blocks: their sets are needed again, so they are kept
    rows = stored(sets.join(stored(large, "large"), "node"), "blocks")
    n_large = rows.count()
    within = stored(within.join(rows.select(F.col("node").alias("a")), "a", "left_semi"), "within")
    heads = rows.join(stored(within.select(F.col("b").alias("node")).distinct(), "head"), "node", "left_semi")
    # as many heads in a unit as the cluster's blocks have members
    count = heads.join(large.groupBy("cluster").agg((F.count(F.lit(1)) / F.max("blocks")).alias("fit")), "cluster").groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.max("fit")).alias("k"))
    heads = heads.join(stored(count, "heads"), "cluster").withColumn("unit", F.xxhash64("cluster", F.pmod(F.xxhash64("node", F.lit(1)), F.col("k"))))
    among = stored(_verified(heads.select("unit", "node", "label", "shingles"), threshold, n_large), "among")
    known = stored(components(within.unionByName(among)), "known")
    labelled = rows.drop("label").join(known, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    labelled = stored(labelled, "labelled")
    # a link between two components has an end outside of the cluster's largest: what is outside meets every block
    counts = labelled.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"), F.max("blocks").alias("k"))
    per = counts.groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("largest"), (F.sum("c") - F.max("c")).alias("outside"), (F.sum("c") / F.max("k")).alias("fit")).filter("outside > 0")
    rest = labelled.join(stored(per.select("cluster", "largest", F.ceil(F.col("outside") / F.col("fit")).alias("shares")), "apart"), "cluster")
    share = F.pmod(F.xxhash64("node", F.lit(2)), F.col("shares"))
    inside = rest.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    outside = rest.filter(F.col("label") != F.col("largest")).withColumn("share", share).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meet = inside.select("cluster", "share", "block", "node", "label", "shingles").unionByName(outside.select("cluster", "share", "block", "node", "label", "shingles"))
    meet = meet.withColumn("unit", F.xxhash64("cluster", "share", "block"))
    across = stored(_verified(meet.select("unit", "node", "label", "shingles"), threshold, n_large), "across")
    final = components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(across))
    small = found.join(stored(large.select("node"), "in_large"), "node", "left_anti")
    return small.unionByName(final)


def _named(words: int, name):
    """Of Arrow batches (doc_id, mark, text): doc_id, mark, n_shingles, node, a second hash of the set, and its sketch."""

    def run(batches):
        for b in batches:
            for lo, hi, texts in parts(b.column(2)):
                own = list(shingle_sets(texts, words))
                n, node = pa.array([len(s) for s in own], pa.int64()), pa.array(name(own))
                sketch = pa.array([sketch_of(s) for s in own], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), n, node, pa.array(set_hashes(own, 1).view(np.int64)), sketch],
                    ["doc_id", "mark", "n_shingles", "node", "check", "sketch"],
                )

    return run


def _linked(docs: DataFrame, words: int, threshold: int, name_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (doc_id, mark, text), as stored tables: rows (doc_id, mark, n_shingles, node); nodes (node, first doc_id); and (node, root) of those linked."""
    shared = np.zeros(0, dtype=np.int64)
    while True:  # again only if two sets have one name, which among n sets happens with odds of n * n / 2**65
        name = partial(names_of, shared=shared, bits=name_bits)
        base = stored(docs.mapInArrow(_named(words, name), "doc_id long, mark string, n_shingles long, node long, check long, sketch binary"), "nodes")
        named = base.filter("n_shingles > 0").groupBy("node")
        told = [F.min("doc_id").alias("first"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), (F.min("check") != F.max("check")).alias("several")]
        classes = stored(named.agg(*told), "classes")
        several = [r.node for r in classes.filter("several").select("node").collect()]
        if not several:
            break
        shared = np.unique(np.concatenate([shared, np.array(several, dtype=np.int64)]))
    total = base.agg(F.sum("n_shingles").alias("n")).first().n or 0
    buckets = max(1, total // 2 // BUCKET_ENTRIES)
    blocks = docs.select("text").mapInArrow(_signature_blocks(buckets, words, threshold, name), "bucket int, body binary")
    groups = blocks.groupBy("bucket").applyInArrow(_bucket_groups(GROUP_UNIT), "gid long, block int, blocks int, node long")
    links = _candidate_links(stored(groups.distinct(), "groups"), classes, threshold, GROUP_UNIT)
    clusters = stored(components(links).withColumnRenamed("root", "cluster"), "clusters")
    chosen = stored(clusters.join(classes.select("node", "first", "size"), "node"), "chosen")
    keys = stored(chosen.select("node", "first").mapInArrow(_stand_ins, "key long"), "keys")
    spread = docs.sparkSession.sparkContext.broadcast(bloom_filter(keys, 1))  # MAX_FILTER_BITS bounds it
    sets = docs.select("doc_id", "text").mapInArrow(_candidate_sets(spread, words, name), "node long, shingles binary")
    roots = stored(_similar(chosen.select("node", "cluster", "size"), sets, threshold).distinct(), "roots")
    return base.select("doc_id", "mark", "n_shingles", "node"), classes.select("node", "first"), roots


def similar_documents(df: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", name_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links lead to, its own included).

    Documents link when 100 * intersection >= threshold * union of their sets of word n-grams (lower-cased A-Z; fewer words:
    the whole sequence). A document without words links with nothing. A null doc_id counts as larger than any other.
    Repeated rows are linked like any equal texts. Empty table: empty result.
    """
    docs = docs_of(df, id_col, text_col).select("doc_id", F.lit(None).cast("string").alias("mark"), "text")
    base, classes, roots = _linked(docs, words, threshold, name_bits)
    named = roots.join(classes, "node")
    smallest = stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    of_node = stored(named.join(smallest, "root").select("node", "component_id"), "components")
    told = classes.join(of_node, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    out = base.join(stored(told, "told"), "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_similar(df: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with all its columns and one row of each group of linked documents: that with the smallest doc_id (null last), of several the first by a hash.

    Rows are told apart by doc_id and text together, so a row never goes because another one bears its doc_id; of rows that
    repeat both, one stays. Documents without words stay. Only texts that a Bloom filter of the dropped rows may hold are shuffled.
    """
    spark = df.sparkSession
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    mark = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(" "), F.coalesce(text, F.lit(""))).cast("binary"))
    base, _, roots = _linked(df.select(doc_id.alias("doc_id"), mark.alias("mark"), text.alias("text")), words, threshold, 64)
    rows = base.filter("n_shingles > 0").groupBy("node", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(roots, "node", "left").select("doc_id", "mark", "n", F.coalesce("root", "node").alias("group"))
    rows = stored(rows, "rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    kept = rows.groupBy("group").agg(F.min(order).alias("least"), F.sum("n").alias("of"))
    kept = stored(kept.filter("of > 1").select("group", F.col("least.mark").alias("kept")), "kept")
    # a mark that goes has no rows left over; one that stays but repeats has one
    gone = rows.join(kept, "group").filter((F.col("mark") != F.col("kept")) | (F.col("n") > 1))
    gone = stored(gone.select(F.col("mark").alias("_mark"), (F.col("mark") == F.col("kept")).alias("_once")), "gone")
    tested = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), mark.alias("_mark"))
    tested = tested.withColumn("_maybe", may_hold(spark, gone.select(key_of(F.col("_mark")).alias("_key")))(key_of(F.col("_mark"))))
    straight = tested.filter(~F.col("_maybe")).select("_row.*")
    met = tested.filter("_maybe").join(gone, "_mark", "left")
    once = met.filter("_once").groupBy("_mark").agg(F.first("_row").alias("_row")).select("_row.*")
    return straight.unionByName(met.filter(F.col("_once").isNull()).select("_row.*")).unionByName(once)


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))



OP9_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
     s as (select distinct doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
     n as (select doc_id, count(*) as n from s group by 1),
     c as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
     l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * shared >= 85 * (p.n + q.n - shared)),
     r(doc_id, root) as (select doc_id, doc_id from w union select l.y, r.root from r join l on l.x = r.doc_id)
select w.doc_id, coalesce(n, 0) as n_shingles, m as component_id from w left join n using (doc_id) join (select doc_id, min(root) as m from r group by 1) using (doc_id)
"""
