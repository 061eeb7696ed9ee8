import importlib
from decimal import Decimal

import duckdb
import pytest

from lodestone.plans import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 5) if isinstance(v, float | Decimal) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([tuple(plain(v) for v in r) for r in df.select(*cols).collect()], key=repr)
    want = sorted([tuple(plain(v) for v in r) for r in duck.sql(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]})").fetchall()], key=repr)
    assert got == want


def test_entry(spark):
    assert importlib.import_module("__spark_entry__").entry(spark).count() > 0
