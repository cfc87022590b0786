"""Every registered query against its SQL on DuckDB, over the same tables."""

import math

import duckdb
import pytest

from conftest import TESTDATA
from tracemill.plans import catalog

SF = f"{TESTDATA}/sf0.01"
TABLES = ("events", "lineitem", "conversations", "documents", "pages", "labels", "embeddings")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    """Null and NaN as None, decimals as floats, -0.0 as 0.0."""
    if type(x).__name__ == "Decimal":
        x = float(x)
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else x + 0.0 if isinstance(x, float) else x


def ordered(rows, names):
    """Rows by their other cells, then by their floats at six significant digits; columns by name."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(cells, key=lambda r: ([str(x) for x in r if not isinstance(x, float)], [float(f"{x:.6g}") for x in r if isinstance(x, float)]))


def differences(ours, theirs):
    """Pairs of rows that differ: floats by more than a millionth of their size, anything else at all."""

    def same(x, y):
        return math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-12) if isinstance(x, float) and isinstance(y, float) else str(x) == str(y) if isinstance(x, float) == isinstance(y, float) else x is not None and y is not None and float(x) == float(y)

    return [(a, b) for a, b in zip(ours, theirs, strict=True) if not all(map(same, a, b))]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows or name in ("rare_transitions",)
    if name in catalog.ORACLES:
        found = db.execute(catalog.ORACLES[name])
        names = [x[0] for x in found.description]
        want = found.fetchall()
        assert sorted(df.columns) == sorted(names) and len(rows) == len(want)
        assert not differences(ordered(rows, df.columns), ordered(want, names))


def test_small_numbers_are_told_apart():
    names = ["a", "b"]
    assert not differences(ordered([("x", 0.00001), ("y", None)], names), ordered([("y", float("nan")), ("x", 0.00001 * (1 + 1e-9))], names))
    assert differences(ordered([("x", 0.00001)], names), ordered([("x", 0.0000101)], names))
    assert differences(ordered([("x", 0.0)], names), ordered([("x", None)], names))


@pytest.fixture(scope="module")
def long_waits(tmp_path_factory):
    """Order lines of which 500 orders wait 690 years each, more microseconds in all than 64 bits hold, and other steps occur once, twice and three times."""
    d = tmp_path_factory.mktemp("long_waits")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    c.execute("""create table lineitem as select o as l_orderkey, o * 7 + k as l_partkey, o % 9 as l_suppkey, cast(k + 1 as integer) as l_linenumber, o * 1.5 as l_extendedprice,
        case when o < 500 or k = 0 then 'A' when o < 501 then 'N' when o < 503 then 'R' else 'S' end as l_returnflag, case k when 0 then 'F' else 'O' end as l_linestatus,
        case when k = 0 then timestamp '1600-01-01' when o < 500 then timestamp '2290-01-01' else timestamp '1600-01-01' + to_days(cast(o - 499 as integer)) end as l_shipdate
        from range(506) o(o), range(2) k(k)""")
    c.execute(f"copy lineitem to '{d}/lineitem.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", ["rare_transitions", "transition_wait_table"])
def test_query_of_long_waits(spark, long_waits, name):
    d, c = long_waits
    df = catalog.QUERIES[name](spark, d)
    found = c.execute(catalog.ORACLES[name])
    names, want = [x[0] for x in found.description], found.fetchall()
    rows = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(names) and len(rows) == len(want) == {"rare_transitions": 2, "transition_wait_table": 4}[name]
    assert not differences(ordered(rows, df.columns), ordered(want, names))
