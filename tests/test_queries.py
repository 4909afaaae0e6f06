import os

import duckdb
import pandas as pd
import pytest

from quire.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(pdf):
    cols = sorted(pdf.columns)

    def show(v):
        if getattr(v, "ndim", 0):
            return str(list(v))
        return "null" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)

    return cols, sorted(tuple(show(v) for v in r) for r in pdf[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_twin(spark, duck, name):
    got = rows(catalogue.queries()[name](spark, SF).toPandas())
    want = rows(duck.execute(catalogue.oracle_sql()[name]).df())
    assert got == want


def test_every_query_has_a_name_of_its_own():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert len(catalogue.queries()) > 60
