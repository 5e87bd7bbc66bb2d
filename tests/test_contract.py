import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SEMANTIC = [n for n in entry.queries() if n.split("_")[0] in ("dax", "widget", "rel", "rls", "tab", "cat", "meta", "enc", "src", "sink", "wb", "dash") or n in ("model_diff", "model_history", "struct_except", "list_agg", "unused_keys_anti")]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SEMANTIC)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert got == want
