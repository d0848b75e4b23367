"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from loomweb.plans import queries as plans

SF = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame)]
    return sorted(tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in ("pages", "documents", "benchmark", "conversations", "events"):
        db.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    found = plans.queries()[name](spark, SF).toPandas()
    assert len(found) and rows(found) == rows(duck.execute(plans.oracle_sql()[name]).df())


def test_every_query_reads_a_table():
    for name, sql in plans.oracle_sql().items():
        assert any(f" {t}" in sql for t in ("pages", "documents", "benchmark", "conversations", "events")), name
    assert set(plans.oracle_sql()) == set(plans.queries())
