import random

import numpy as np
import pyarrow as pa

from tracemill.llm import common


def test_parts_hold_every_cell_once():
    rng = random.Random(1)
    texts = [None if rng.random() < 0.1 else "é" * rng.randint(0, 40) for _ in range(500)] + ["x" * 5000, "", None]
    column = pa.array(["before", *texts], pa.string()).slice(1)
    at, got = 0, []
    for lo, hi, some in common.parts(column, 300):
        assert lo == at and len(some) == hi - lo and (len(some) == 1 or sum(len(x) + 1 for x in some) <= 300)
        at = hi
        got += some
    assert got == [(t or "").encode() for t in texts]
    assert list(common.parts(pa.array([], pa.string()))) == []


def test_hashes_of_ranges_depend_on_their_bytes_alone():
    rng = random.Random(2)
    words = ["".join(rng.choice("abé ") for _ in range(n)) for n in [*range(0, 140), 1000] for _ in range(3)]
    data = np.frombuffer("|".join(words).encode(), dtype=np.uint8)
    size = np.array([len(w.encode()) for w in words])
    starts = np.cumsum(size + 1) - size - 1
    for seed in (0, 1):
        found = common.range_hashes(data, starts, starts + size, seed)
        alone = [int(common.range_hashes(np.frombuffer(w.encode(), dtype=np.uint8), np.array([0]), np.array([len(w.encode())]), seed)[0]) for w in words]
        assert found.tolist() == alone and len(set(alone)) == len(set(words))


def test_hashes_of_runs_depend_on_order_and_length():
    h = common.seeded(50, 3)
    for k in (1, 2, 3, 7, 20):
        whole = common.run_hashes(h, k)
        assert len(whole) == 51 - k and whole[4] == common.run_hashes(h[4 : 4 + k], k)[0]
        assert k == 1 or common.run_hashes(h[4 : 4 + k][::-1], k)[0] != whole[4]
    assert len(common.run_hashes(h, 51)) == 0


def test_scratch_tables_belong_to_their_block(spark):
    df = spark.range(5)
    outside = common.stored(df, "outside")
    with common.scratch() as own:
        inside = common.stored(df, "inside")
    after = common.stored(df, "after")
    assert len(own.paths) == 1 and inside.count() == 5
    own.drop()
    assert own.paths == [] and outside.count() == after.count() == 5
    path = common._rest.paths[-1][1]
    common.drop_path(path)
    assert path not in [p for _, p in common._rest.paths] and outside.count() == 5


def test_bounded_samples_do_not_depend_on_the_layout(spark):
    df = spark.range(20_000)
    a, b = (common.bounded_sample(x, 20_000, 500, ["id"]) for x in (df, df.repartition(7)))
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect()) and 400 < a.count() < 600
    assert common.bounded_sample(df, 20_000, 20_000, ["id"]).count() == 20_000
