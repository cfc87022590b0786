"""Hard negatives by inner product, found exactly in a multiway tree of split points.

Space. With M the largest length of a row, a row x becomes (x, sqrt(M² - |x|²)) and an anchor q becomes (q, 0).
Their distance is then sqrt(|q|² + M² - 2 q·x), so a window of scores is an annulus of distances.

Tree. Fitted on a bounded sample: a node has up to ARITY split points, each as far from the others as the
sample allows, and a row goes to the nearest one. Each split point stores the least and the largest distance
to the rows of every sibling subtree, taken over all rows. An anchor at distance d from a split point can
find rows of its annulus only in siblings whose stored range meets [d - outer, d + outer] and reaches the inner
radius; the others are left out. Leaves are dealt into blocks of rows, where scores are whole numbers and exact.

Search. First each anchor looks at the rows of its own block, which bounds the score of its positives from
below; the leaves that may hold better ones are searched, then the leaves that meet the windows of
negatives. An anchor travels to the leaves it needs, in groups; rows of a leaf meet one group at a time.
On vectors without structure (drawn at random) no range excludes much, and every anchor meets every leaf.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, stored

POSITIVES = 5
NEGATIVES = 3
#: Window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
#: Rows that split points are chosen from, about; split points of a node; rows of a leaf, about; leaves at most, about.
FIT_ROWS = 8192
ARITY = 8
LEAF_ROWS = 2048
MOST_LEAVES = 4096
#: Rows of a block, and anchors that meet it at a time, at most, about; anchors of one matrix product.
BLOCK_ROWS = 8192
BLOCK_ANCHORS = 4096
RUN = 128


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, width)


def _clean(width: int):
    """Rows that take part (vec_id, label, x, squared length, largest component): as many finite components as `width`, x being whole numbers."""

    def run(batches):
        for b in batches:
            ids, labels, lists = b.columns
            keep = np.flatnonzero((lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width) & ids.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False))
            m = lists.take(pa.array(keep)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)  # a null shows as NaN
            good = np.flatnonzero(np.isfinite(m).all(axis=1))
            x = np.floor(SCALE * m[good])
            at = pa.array(keep[good])
            yield pa.RecordBatch.from_arrays(
                [ids.take(at).cast(pa.int64()), labels.take(at).cast(pa.int64()), pa.array([r.astype("<f8").tobytes() for r in x], pa.binary()), pa.array((x * x).sum(axis=1)), pa.array(np.abs(x).max(axis=1, initial=0))],
                ["vec_id", "label", "x", "square", "largest"],
            )

    return run


def scores(anchors: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers: in doubles where every sum stays below 2**53, else in whole numbers of any size (an error if they pass 64 bits)."""
    if exact:
        return (anchors @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    return (whole(anchors) @ whole(rows).T).astype(np.int64)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(score) > 8 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((ids[some], -score[some]))][:k]
    return np.lexsort((ids, -score))[:k]


# ----------------------------------------------------------------------- tree


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0))


class Tree:
    """Split points of the inner nodes, the leaf or node below each, and the ranges of distances from each split point to each sibling's rows."""

    def __init__(self, sample: np.ndarray, largest_square: float, share: float):
        """`sample` of rows; nodes of more than `share` of it are divided."""
        self.largest_square = largest_square
        self.points: list[np.ndarray] = []
        self.below: list[list[tuple[bool, int]]] = []  # (is a leaf, its number)
        self.n_leaves = 0
        self.root = self._divide(self.lifted(sample), max(2 * ARITY, share * len(sample)))
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.points]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.largest_square - (x * x).sum(axis=1), 0))[:, None]])

    def _divide(self, some: np.ndarray, most: float) -> tuple[bool, int]:
        points = self._spread(some) if len(some) > most else []
        if len(points) < 2:
            self.n_leaves += 1
            return True, self.n_leaves - 1
        node = len(self.points)
        self.points.append(points)
        self.below.append([])
        nearest = _distances(some, points).argmin(axis=1)
        self.below[node] = [self._divide(some[nearest == j], most) for j in range(len(points))]
        return False, node

    @staticmethod
    def _spread(some: np.ndarray) -> np.ndarray:
        """Rows far from each other: each the one furthest from those before."""
        chosen, far = [0], _distances(some, some[:1])[:, 0]
        while len(chosen) < ARITY and far.max() > 1e-9 * (1 + np.abs(some).max()):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _distances(some, some[chosen[-1:]])[:, 0])
        return some[chosen]

    def place(self, x: np.ndarray, seen=None) -> np.ndarray:
        """The leaf of each row; `seen(node, distances, child)` is shown the way there."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(self.root, np.arange(len(x)), self.lifted(x))]
        while todo:
            (leaf, k), at, rows = todo.pop()
            if leaf:
                out[at] = k
            elif len(at):
                d = _distances(rows, self.points[k])
                child = d.argmin(axis=1)
                if seen:
                    seen(k, d, child)
                todo += [(self.below[k][j], at[child == j], rows[child == j]) for j in range(len(self.points[k]))]
        return out

    def meets(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, leaf): leaves that may hold rows whose score lies in one of the anchor's windows (low to high, a column each; none where low is over high)."""
        square = (anchors * anchors).sum(axis=1)[:, None] + self.largest_square
        ok = low <= high
        with np.errstate(invalid="ignore"):
            inner = np.where(ok, np.sqrt(np.maximum(square - 2 * high, 0)), np.inf)
            outer = np.where(ok, np.sqrt(np.maximum(square - 2 * low, 0)), -np.inf)
        slack = 1e-6 * (1 + np.sqrt(square.max(initial=0)))  # far above what distances are rounded by
        q = np.hstack([anchors, np.zeros((len(anchors), 1))])
        who, leaves = [], []
        todo = [(self.root, np.flatnonzero(ok.any(axis=1)))]
        while todo:
            (leaf, k), at = todo.pop()
            if leaf:
                who.append(at)
                leaves.append(np.full(len(at), k))
            elif len(at):
                d = _distances(q[at], self.points[k])[:, :, None]  # anchor, split point, sibling
                least = np.maximum(np.maximum(d - self.high[k], self.low[k] - d), 0).max(axis=1)
                most = (d + self.high[k]).min(axis=1)
                alive = ((least[:, :, None] <= outer[at][:, None] + slack) & (most[:, :, None] >= inner[at][:, None] - slack)).any(axis=2)
                todo += [(self.below[k][j], at[alive[:, j]]) for j in range(len(self.points[k]))]
        return np.concatenate([*who, np.zeros(0, dtype=np.int64)]), np.concatenate([*leaves, np.zeros(0, dtype=np.int64)])


def _placed(spread, width: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spread.value.place(_matrix(b.column(2), width)))], ["vec_id", "label", "x", "row", "leaf"])

    return run


def _ranges(spread, width: int):
    """Per partition: (node, split point, sibling, least and largest distance)."""

    def run(batches):
        tree = spread.value
        low, high = [x.copy() for x in tree.low], [x.copy() for x in tree.high]

        def seen(node, d, child):
            for j in np.unique(child).tolist():
                low[node][:, j] = np.minimum(low[node][:, j], d[child == j].min(axis=0))
                high[node][:, j] = np.maximum(high[node][:, j], d[child == j].max(axis=0))

        for b in batches:
            if b.num_rows:
                tree.place(_matrix(b.column(0), width), seen)
        for node, (a, z) in enumerate(zip(low, high, strict=True)):
            i, j = np.nonzero(z > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array([node] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(a[i, j]), pa.array(z[i, j])], ["node", "point", "sibling", "low", "high"])

    return run


# --------------------------------------------------------------------- search


def _by_label(anchor_labels: np.ndarray, labels: np.ndarray):
    for y in np.unique(anchor_labels).tolist():
        rows = np.flatnonzero(labels == y)
        if len(rows):
            yield np.flatnonzero(anchor_labels == y), rows


def _positives(a: pa.Table, rows: pa.Table, width: int, exact: bool, k: int):
    """(anchor's position, positions of its k best other rows of its label, their scores) among these rows."""
    ids, own = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
    x, q, asking = _matrix(rows["x"], width), _matrix(a["x"], width), a["row"].to_numpy()
    for who, some in _by_label(a["label"].to_numpy(), rows["label"].to_numpy()):
        for at in range(0, len(who), RUN):
            run = who[at : at + RUN]
            for i, s in zip(run.tolist(), scores(q[run], x[some], exact), strict=True):
                others = np.flatnonzero(own[some] != asking[i])
                best = others[_first(s[others], ids[some][others], k)]
                yield i, some[best], s[best]


ANCHOR = "row long, vec_id long, label long, x binary"


def _home(width: int, exact: bool, k: int):
    """Of a block: its anchors, each with a score that its k-th positive reaches at least (null if the block has fewer)."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        a = rows.filter(rows["asks"])
        bound: list[int | None] = [None] * a.num_rows
        if a.num_rows:
            for i, _, s in _positives(a, rows, width, exact, k):
                bound[i] = int(s[-1]) if len(s) == k else None
        return a.select(["row", "vec_id", "label", "x"]).append_column("lows", pa.array([[x] for x in bound], pa.list_(pa.int64()))).append_column("highs", pa.array([[None]] * a.num_rows, pa.list_(pa.int64())))

    return run


def _asked(spread, width: int, names: list[str]):
    """Anchors with windows of scores (null: open), a row for each leaf that may hold rows of one."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            lows, highs = table["lows"].to_pylist(), table["highs"].to_pylist()
            n = max(map(len, lows))
            fill = lambda lists, sign: np.array([[sign * np.inf if x is None else x for x in r] + [-sign * np.inf] * (n - len(r)) for r in lists], dtype=float).reshape(len(lists), n)
            who, leaf = spread.value.meets(_matrix(table["x"], width), fill(lows, -1), fill(highs, 1))
            yield from table.take(pa.array(who)).append_column("leaf", pa.array(leaf)).select([*names, "leaf"]).combine_chunks().to_batches()

    return run


HIT = "row long, positive int, vec_id long, score long"


def _hits(found) -> pa.Table:
    columns = list(zip(*found, strict=True)) or [[]] * 4
    return pa.table({n: pa.array(np.concatenate(c) if c else [], t) for n, c, t in zip(("row", "positive", "vec_id", "score"), columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)})


def _find_positives(width: int, exact: bool, k: int):
    def run(key: tuple[pa.Scalar, ...], asks: pa.Table, rows: pa.Table) -> pa.Table:
        if not asks.num_rows or not rows.num_rows:
            return _hits([])
        ids, name = rows["vec_id"].to_numpy(), asks["row"].to_numpy()
        return _hits([(np.full(len(s), name[i]), np.zeros(len(s), dtype=np.int64), ids[at], s) for i, at, s in _positives(asks, rows, width, exact, k)])

    return run


def _find_negatives(width: int, exact: bool, k: int):
    """Of each anchor and window: the k best rows of other labels whose score lies in it."""

    def found(asks: pa.Table, rows: pa.Table):
        asks = asks.combine_chunks()
        ids, labels, x = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["x"], width)
        q, name, own = _matrix(asks["x"], width), asks["row"].to_numpy(), asks["label"].to_numpy()
        lows, highs = asks["lows"].to_pylist(), asks["highs"].to_pylist()
        for at in range(0, len(q), RUN):
            for i, s in enumerate(scores(q[at : at + RUN], x, exact), at):
                some = np.flatnonzero((labels != own[i]) & (s >= min(lows[i])) & (s <= max(highs[i])))
                inside = s[some]
                for p, (low, high) in enumerate(zip(lows[i], highs[i], strict=True)):
                    here = some[(inside >= low) & (inside <= high)]
                    best = here[_first(s[here], ids[here], k)]
                    yield np.full(len(best), name[i]), np.full(len(best), p), ids[best], s[best]

    def run(key: tuple[pa.Scalar, ...], asks: pa.Table, rows: pa.Table) -> pa.Table:
        return _hits(list(found(asks, rows)) if asks.num_rows and rows.num_rows else [])

    return run


def _best(hits: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows of each key as `rank` 1 … k; Spark keeps k rows a key and task before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Index:
    """All rows that take part, dealt into the blocks of a tree's leaves (leaf, block, vec_id, label, x, row, asks)."""

    def __init__(self, table: DataFrame, is_anchor: Column):
        """`table`: (vec_id, label, v)."""
        spark = table.sparkSession
        usual = table.filter("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        self.width = usual.n if usual and usual.n else 1
        rows = stored(table.mapInArrow(_clean(self.width), "vec_id long, label long, x binary, square double, largest double").withColumn("row", F.monotonically_increasing_id()), "rows")
        told = rows.agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square"), F.max("largest").alias("largest")).first()
        self.n_rows = told.n
        if not self.n_rows:
            return
        self.exact = self.width * told.largest**2 < 2**53
        sample = bounded_sample(rows, self.n_rows, FIT_ROWS, ["vec_id", "x"]).select("x").collect()
        points = np.array([np.frombuffer(r.x, dtype="<f8") for r in sample]).reshape(-1, self.width)
        self.tree = Tree(points, told.square, max(LEAF_ROWS, self.n_rows / MOST_LEAVES) / self.n_rows)
        held = rows.select("vec_id", "label", "x", "row").mapInArrow(_placed(spark.sparkContext.broadcast(self.tree), self.width), "vec_id long, label long, x binary, row long, leaf long")
        self.rows = stored(held.withColumn("asks", F.coalesce(is_anchor, F.lit(False))), "placed")
        ranges = self.rows.select("x").mapInArrow(_ranges(spark.sparkContext.broadcast(self.tree), self.width), "node int, point int, sibling int, low double, high double")
        for r in ranges.groupBy("node", "point", "sibling").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # ARITY² rows a node
            self.tree.low[r.node][r.point, r.sibling], self.tree.high[r.node][r.point, r.sibling] = r.low, r.high
        self.shared = spark.sparkContext.broadcast(self.tree)
        sizes = self.rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))  # a row a leaf
        self.leaves = spark.createDataFrame([(r.leaf, r.blocks) for r in sizes.collect()], "leaf long, blocks long")
        self.blocks = self.rows.join(F.broadcast(self.leaves), "leaf").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("blocks")

    def bounds(self, k: int) -> DataFrame:
        """The anchors, each with the window of scores that its k first positives lie in."""
        return self.blocks.groupBy("leaf", "block").applyInArrow(_home(self.width, self.exact, k), f"{ANCHOR}, lows array<long>, highs array<long>")

    def meet(self, anchors: DataFrame, names: list[str], find) -> DataFrame:
        """What `find` makes of groups of anchors (with windows lows, highs) and the blocks of rows that the tree leaves to them."""
        kinds = dict(anchors.dtypes)
        asks = stored(anchors.mapInArrow(_asked(self.shared, self.width, names), ", ".join(f"{c} {kinds[c]}" for c in names) + ", leaf long"), "asks")
        groups = asks.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ANCHORS).alias("groups"))
        groups = F.broadcast(anchors.sparkSession.createDataFrame([(r.leaf, r.groups) for r in groups.collect()], "leaf long, groups long"))  # a row a leaf
        asks = asks.join(groups, "leaf").join(F.broadcast(self.leaves), "leaf").withColumn("group", F.pmod(F.xxhash64("row"), F.col("groups")))
        asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("groups", "blocks")
        rows = self.blocks.join(groups, "leaf").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")
        key = ["leaf", "block", "group"]
        return asks.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(find, HIT)


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(df: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row for which `is_anchor` (a condition on vec_id) holds
    and each of its `positives` best other rows of the same label, the `negatives` best rows of other labels whose score lies
    between `low` and `high` hundredths of the positive's.

    Components become floor(256 * x), scores are inner products of those whole numbers, and equal scores go by smaller vec_id. Rows
    with a null id, label or vector, with a null or non-finite component, or of another length than most take no part. Rows that
    repeat an id are rows of their own, so a copy of the anchor can be its positive. Fewer rows than asked for: all. Empty table: empty result.
    """
    table = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), (F.col("`label`") if label is None else label).cast("long").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    index = Index(table, is_anchor)
    if not index.n_rows:
        return df.sparkSession.createDataFrame([], OUT)
    anchors = stored(index.bounds(positives), "anchors")
    near = _best(index.meet(anchors, ["row", "label", "x"], _find_positives(index.width, index.exact, positives)), ["row"], positives)
    order = F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), "score")))
    near = near.groupBy("row").agg(order.alias("positives"))  # `positives` a row
    of = lambda share, f: F.transform("positives", lambda p: f(p["score"] * F.lit(share).cast("decimal(3)") / F.lit(100)).cast("long"))
    asking = stored(near.join(anchors.drop("lows", "highs"), "row").withColumn("lows", of(low, F.ceil)).withColumn("highs", of(high, F.floor)), "asking")
    hits = index.meet(asking, ["row", "label", "x", "lows", "highs"], _find_negatives(index.width, index.exact, negatives))
    found = _best(hits, ["row", "positive"], negatives).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    out = found.join(asking.select("row", F.col("vec_id").alias("anchor_id"), "positives"), "row").withColumn("p", F.get("positives", F.col("positive")))
    return out.select("anchor_id", "p.positive_id", "rank", "negative_id", F.col("p.score").alias("positive_score"), "negative_score")


OP13_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
    from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by score desc, id))::int as rank, id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, id) <= 3
"""


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label=label)
