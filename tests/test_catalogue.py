"""Every catalogue query at sf0.001 against its SQL in DuckDB."""

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = con.sql(catalogue.SQL[name])
    assert got == rows(want.columns, want.fetchall())


def test_joins_take_whole_tables(spark, con):
    orders, customers, nations = (con.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("orders", "customer", "nation"))
    joined = {k: catalogue.QUERIES[f"join_{k}"](spark, SF).collect() for k in ("inner", "left", "outer", "nway", "match_only")}
    assert len({r.o_orderkey for r in joined["outer"] if r.o_orderkey is not None}) == orders
    assert len({r.c_custkey for r in joined["left"]}) == customers
    pairs = {(r.c_custkey, r.o_orderkey) for r in joined["inner"] if r.k is None}
    assert len(pairs) == len({c for c, _ in pairs}) * len({o for _, o in pairs}) > 1
    assert max(r.k for r in joined["nway"]) >= 5 and len({r.k for r in joined["nway"]}) <= nations
    assert max(r.k for r in joined["match_only"]) >= 1000


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
