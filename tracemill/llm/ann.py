"""Approximate nearest neighbours by inner product, along shifted Hilbert curves.

Index. Vectors are projected onto the leading principal directions of a bounded sample, turned
and shifted anew for each curve, and every row gets one Hilbert key per curve. Spark range-partitions
(curve, key, vec_id) and numbers the rows in order, so equal vectors spread over neighbouring
places instead of meeting in one bucket.

Search. A query looks at the rows within `reach` places of its own on every curve. Neighbouring queries
of a curve form blocks, and a block of rows is sent to those blocks of queries alone whose windows
touch it; there, runs of queries meet the rows of their windows in matrix products. Every hit is scored
again with the original vectors in double precision, and the curves' lists merge.

Reach. A sample of queries is answered exactly, and the reach is the least that finds `target` of those
answers on the curves together. On data with structure that is a narrow window, and what is shuffled and
scored grows with the table; on vectors without any (directions drawn at random, say) no ordering helps,
and the windows grow with the table, which keeps the recall and costs several scans in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, stored

NEAREST = 20
CURVES = 4
DIMENSIONS = 6
BITS = 10
#: Rows that the projection is fitted on, about, and queries that the width is fitted on, at most.
FIT_ROWS = 4096
FIT_QUERIES = 96
TARGET = 0.97
#: Rows and queries of a block at most, bytes of its vectors, and queries that meet their rows in one product.
BLOCK_ROWS = 32_768
BLOCK_QUERIES = 8192
BLOCK_BYTES = 16 << 20
RUN = 256


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of points with whole coordinates below 2**bits (one row per dimension)."""
    x = cells.astype(np.uint64).copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, p = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(n):
            up = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(up, x[i], x[i] ^ swap)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t ^= np.where((x[n - 1] & q) > 0, q - one, np.uint64(0))
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | (x[i] >> np.uint64(b) & one)
    return key.view(np.int64)


def fit_curves(sample: np.ndarray, curves: int, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(projection, centre, scale) of each curve, from a bounded sample of vectors."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    _, _, axes = np.linalg.svd(sample - mean, full_matrices=False)
    dims = min(DIMENSIONS, len(axes))
    lead = axes[: min(len(axes), 2 * dims)]
    out = []
    for c in range(curves):
        turn = np.eye(len(lead)) if c == 0 else np.linalg.qr(rng.normal(size=(len(lead), len(lead))))[0]
        way = (turn @ lead)[:dims]
        shown = (sample - mean) @ way.T
        scale = np.maximum(shown.std(axis=0), 1e-12)
        shift = rng.uniform(-0.5, 0.5, dims) * (c > 0)
        out.append((way, mean @ way.T + shift * scale, scale))
    return out


def curve_keys(vectors: np.ndarray, curve: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    way, centre, scale = curve
    z = (vectors @ way.T - centre) / scale
    flat = 0.5 + 0.5 * np.tanh(z * 0.8)  # about even over the cells for bell-shaped data
    return hilbert(np.minimum(flat * (1 << BITS), (1 << BITS) - 1).astype(np.uint64).T, BITS)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors stored as bytes of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, width)


def _clean(width: int):
    """Vectors that take part: as many finite components as `width`, none null, not all zero."""

    def run(batches):
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            n = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero((n == width) & ids.is_valid().to_numpy(zero_copy_only=False))
            if not len(keep):
                continue
            flat = lists.take(pa.array(keep)).flatten().cast(pa.float64())
            m = flat.to_numpy(zero_copy_only=False).reshape(-1, width)  # a null shows as NaN
            good = np.flatnonzero(np.isfinite(m).all(axis=1) & (m != 0).any(axis=1))
            body = [m[i].astype("<f8").tobytes() for i in good]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep[good])).cast(pa.int64()), pa.array(body, pa.binary())], ["vec_id", "vector"])

    return run


def _keyed(curves, width: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1), width)  # vec_id, vector, row, vec_id, asks
                for c, curve in enumerate(curves):
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(m), pa.int32()), pa.array(curve_keys(m, curve)), *b.columns[2:]], ["curve", "key", "row", "vec_id", "asks"])

    return run


def _numbered(batches):
    """Place of each row, and of each query among the queries, within its partition, counted per curve."""
    part, seen, asked = TaskContext.get().partitionId(), {}, {}
    for b in batches:
        curve, asks = b.column(0).to_numpy(), b.column(4).to_numpy(zero_copy_only=False)
        place, query = np.empty(len(curve), dtype=np.int64), np.empty(len(curve), dtype=np.int64)
        for c in np.unique(curve).tolist():
            at = np.flatnonzero(curve == c)
            place[at] = seen.get(c, 0) + np.arange(len(at))
            query[at] = asked.get(c, 0) + np.cumsum(asks[at]) - asks[at]
            seen[c], asked[c] = seen.get(c, 0) + len(at), asked.get(c, 0) + int(asks[at].sum())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * len(curve), pa.int32()), pa.array(place), pa.array(query), *b.columns[2:]], ["curve", "part", "place", "query", "row", "vec_id", "asks"])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _top(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """Of each query: ids and exact scores of its k best rows, itself left out."""
    product = queries @ rows.T
    for i, q in enumerate(q_ids.tolist()):
        s = product[i]
        s[ids == q] = -np.inf
        n = int(np.isfinite(s).sum())
        if not n:
            continue
        # a product may round equal vectors differently: take all within a hair of the k-th, then score them again one way
        least = np.partition(s, len(s) - min(k, n))[len(s) - min(k, n)]
        some = np.flatnonzero(s >= least - 1e-9 * max(1.0, abs(least)))
        exact = (rows[some] * queries[i]).sum(axis=1)
        top = best(exact, ids[some], k)
        yield q, ids[some][top], exact[top]


def _hits(found) -> pa.Table:
    q, ids, scores = [], [], []
    for a, b, c in found:
        q.append(a)
        ids.append(b)
        scores.append(c)
    return pa.table({"query_id": pa.array(q, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64()))})


HITS = "query_id long, ids array<long>, scores array<double>"


def _scan(queries: np.ndarray, q_ids: np.ndarray, k: int):
    width = queries.shape[1]

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from _hits(_top(queries, q_ids, _matrix(b.column(1), width), b.column(0).to_numpy(), k)).to_batches()

    return run


def _meet(width: int, k: int, reach: int):
    """Of a block of queries and one of rows (vec_id, place, vector): hits, runs of queries against the rows of their windows."""

    def found(queries: pa.Table, rows: pa.Table):
        queries, rows = queries.sort_by("place").combine_chunks(), rows.sort_by("place").combine_chunks()
        q_at, at = queries["place"].to_numpy(), rows["place"].to_numpy()
        q_ids, ids = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
        q, m = _matrix(queries["vector"], width), _matrix(rows["vector"], width)
        lo, hi = np.searchsorted(at, q_at - reach), np.searchsorted(at, q_at + reach, side="right")
        i = 0
        while i < len(q):
            # a run ends where its rows would be over twice those of its first query
            j = min(i + RUN, i + 1 + int(np.searchsorted(hi[i + 1 :] - lo[i], 2 * (hi[i] - lo[i]) + RUN, side="right")))
            if hi[j - 1] > lo[i]:
                yield from _top(q[i:j], q_ids[i:j], m[lo[i] : hi[j - 1]], ids[lo[i] : hi[j - 1]], k)
            i = j

    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, rows: pa.Table) -> pa.Table:
        return _hits(found(queries, rows) if queries.num_rows and rows.num_rows else [])

    return run


def _merged(hits: DataFrame, k: int) -> DataFrame:
    """Of lists of hits: each query's k best, ties to smaller vec_id, a row that came by several curves once."""
    each = hits.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("h")).select("query_id", F.col("h.ids").alias("vec_id"), F.col("h.scores").alias("score"))
    once = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.struct((F.lit(0.0) - F.col("score")).alias("far"), "vec_id")  # k hits a curve and block at most
    lists = once.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("hits"))
    out = lists.select("query_id", F.posexplode("hits").alias("rank", "h"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("h.vec_id").alias("vec_id"), (F.lit(0.0) - F.col("h.far")).alias("score"))


OUT = "query_id long, rank int, vec_id long, score double"


def exact_nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Brute force for a bounded set of queries (they are brought to the driver and sent to every task)."""
    some = queries.collect()
    m = np.array([np.frombuffer(r.vector, dtype="<f8") for r in some])
    ids = np.array([r.vec_id for r in some], dtype=np.int64)
    return _merged(vectors.select("vec_id", "vector").mapInArrow(_scan(m, ids, k), HITS), k)


class Index:
    """Vectors that take part (vec_id, vector, asks, row), and every one's place on each curve (curve, place, query, row, vec_id, asks).

    `row` tells rows apart that repeat a vec_id. `query` numbers the queries of a curve by their places.
    """

    def __init__(self, df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding"):
        spark = df.sparkSession
        table = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
        usual = table.filter("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        self.width = usual.n if usual and usual.n else 1
        self.vectors = stored(table.mapInArrow(_clean(self.width), "vec_id long, vector binary").withColumn("asks", F.coalesce(is_query, F.lit(False))).withColumn("row", F.monotonically_increasing_id()), "vectors")
        self.queries = self.vectors.filter("asks")
        self.n_rows, self.n_queries = self.vectors.count(), self.queries.count()
        self.places = None
        fit = bounded_sample(self.vectors, self.n_rows, FIT_ROWS, ["vec_id", "vector"]).collect() if self.n_queries else []
        if not fit:
            return
        curves = fit_curves(np.array([np.frombuffer(r.vector, dtype="<f8") for r in fit]), CURVES)
        keyed = self.vectors.select("vec_id", "vector", "row", F.col("vec_id").alias("id"), "asks").mapInArrow(_keyed(curves, self.width), "curve int, key long, row long, vec_id long, asks boolean")
        ordered = keyed.repartitionByRange(max(1, self.n_rows * CURVES // 100_000), "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
        numbered = stored(ordered.mapInArrow(_numbered, "curve int, part int, place long, query long, row long, vec_id long, asks boolean"), "numbered")
        counts = numbered.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).orderBy("curve", "part")
        before, total = [], {}
        for r in counts.collect():  # a row per curve and 100,000 places
            n, q = total.get(r.curve, (0, 0))
            before.append((r.curve, r.part, n, q))
            total[r.curve] = (n + r.n, q + r.q)
        offsets = spark.createDataFrame(before, "curve int, part int, rows_before long, queries_before long")
        joined = numbered.join(offsets, ["curve", "part"])
        self.places = stored(joined.select("curve", (F.col("place") + F.col("rows_before")).alias("place"), (F.col("query") + F.col("queries_before")).alias("query"), "row", "vec_id", "asks"), "places")

    def fit_reach(self, k: int, target: float) -> int | None:
        """The least reach that finds `target` of the exact answers to a bounded sample of queries; None if there are none."""
        truth = exact_nearest(self.vectors, self.queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_QUERIES), k).collect()
        asked = {r.query_id for r in truth} | {r.vec_id for r in truth}
        if not asked:
            return None
        some = self.vectors.sparkSession.createDataFrame([(x,) for x in asked], "vec_id long")
        places: dict[tuple[int, int], int] = {(r.curve, r.vec_id): r.place for r in self.places.join(F.broadcast(some), "vec_id").collect()}  # FIT_QUERIES * k ids at most
        gaps = np.array([[abs(places[c, r.query_id] - places[c, r.vec_id]) for c in range(CURVES)] for r in truth], dtype=np.int64)
        near = np.sort(gaps.min(axis=1))
        return int(near[max(0, int(np.ceil(target * len(near))) - 1)]) + 1

    def search(self, k: int, reach: int) -> DataFrame:
        """(query_id, rank, vec_id, score) of every query's k nearest among the rows within its windows."""
        fits = BLOCK_BYTES // (8 * self.width)
        rows, queries = max(1, min(BLOCK_ROWS, fits)), max(1, min(BLOCK_QUERIES, fits // 4))
        block = lambda place: F.floor(place / F.lit(rows)).cast("long")
        asking = self.places.filter("asks").withColumn("group", F.floor(F.col("query") / F.lit(queries)).cast("long"))
        spans = asking.groupBy("curve", "group").agg(F.min("place").alias("first"), F.max("place").alias("last"))
        first, last = block(F.greatest(F.lit(0), F.col("first") - reach)), block(F.least(F.lit(self.n_rows - 1), F.col("last") + reach))
        units = stored(spans.select("curve", "group", F.explode(F.sequence(first, last)).alias("block")), "units")
        unit = ["curve", "group", "block"]
        sent = asking.join(units, ["curve", "group"]).join(self.queries.select("row", "vector"), "row")
        held = self.places.withColumn("block", block(F.col("place"))).join(units, ["curve", "block"]).join(self.vectors.select("row", "vector"), "row")
        # columns of their own, as both sides come from one table
        sent, held = (x.select(*(F.col(c).alias(c) for c in (*unit, "vec_id", "place", "vector"))) for x in (sent, held))
        return _merged(sent.groupBy(*unit).cogroup(held.groupBy(*unit)).applyInArrow(_meet(self.width, k, reach), HITS), k)


def nearest(df: DataFrame, is_query, k: int = NEAREST, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row for which `is_query` (a condition on the column vec_id) holds, the k nearest found.

    Vectors that are null, all zero, or hold null or non-finite components take no part, nor do rows without id or of another
    length than most. Rows that repeat an id count as one candidate (the best of them) and one query. Fewer candidates than k:
    all. Equal scores: smaller vec_id first. Empty table: empty result.
    """
    index = Index(df, is_query, id_col, vector_col)
    reach = index.fit_reach(k, target) if index.places is not None else None
    return df.sparkSession.createDataFrame([], OUT) if reach is None else index.search(k, reach)


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
