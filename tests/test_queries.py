"""Every query of the engine's own operators against its SQL, as the entry module registers them."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lexiloom import queries as core

DIR = "/root/testdata/sf0.001"
#: No SQL: class intersections, sequences of splits, byte caps inside characters, merge loops over two stages.
WITHOUT_SQL = {"pretoken_counts_kimi", "pretoken_counts_deepseek_v3", "stage2_unit_counts", "train_superbpe", "bytes_per_token_of_vocabulary"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, (list, tuple)):
        return tuple(shown(x) for x in v)
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    return repr(v)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_equals_sql(spark, duck, name):
    df = core.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    assert (name in core.oracle_sql()) != (name in WITHOUT_SQL)
    if name in WITHOUT_SQL:
        assert rows
        return
    r = duck.sql(core.oracle_sql()[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert sorted(tuple(map(shown, x)) for x in rows) == sorted(tuple(shown(x[i]) for i in at) for x in r.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["pretoken", "count"] and df.count() == 50
    assert set(core.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
