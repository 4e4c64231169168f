"""Every registered query of the library against its SQL."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from transect.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine(smallest):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{smallest}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.12g}"
    return f"{v:.12g}" if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, engine, smallest, name):
    df = plans.queries()[name](spark, smallest)
    rows = df.collect()
    if name not in plans.oracle_sql():
        assert rows
        return
    cursor = engine.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(cell(v) for _, v in sorted(zip(columns, r, strict=True))) for r in cursor.fetchall())
    assert Counter(tuple(cell(r[c]) for c in sorted(columns)) for r in rows) == want


def test_registry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(plans.queries()) >= 35
    assert __spark_entry__.entry(spark).columns == ["target", "recall", "conf"]
