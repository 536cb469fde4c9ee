import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the sample tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(frame, columns):
    def cell(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "null"
        return str(v) if isinstance(v, (bool, str)) else f"{float(v):.6f}" if hasattr(v, "__float__") and type(v).__name__ != "bool_" else str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.queries())))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and plain(got, columns) == plain(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_paired_bootstrap_has_every_shared_pool(spark, duck):
    got = {(r.factor, r.n): r.n_items for r in entry.queries()["paired_bootstrap"](spark, DATA).collect()}
    pools = duck.execute("SELECT count(DISTINCT p_partkey // 8) FROM part").fetchone()[0]
    chosen = duck.execute(entry.oracle_sql()["selections"].replace("ties FROM sel", "ties FROM sel WHERE model_id = 'm0'")).df()
    assert got == chosen[chosen.model_id == "m0"].groupby(["factor", "n"]).size().to_dict() and pools - 1 <= sum(got.values()) / 3 <= pools
