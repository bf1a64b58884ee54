"""Every query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from chatloom.plans import catalog
from chatloom.plans.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def table(columns, rows):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return [columns[i] for i in place], sorted(tuple(shown(r[i]) for i in place) for r in rows)


def test_every_query_has_a_twin():
    assert set(catalog.queries()) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = db.execute(entry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
