"""Every registered query against its SQL, on the smallest tables."""

import os

import pandas as pd
import pytest

from sylvan.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rows_of(frame):
    names = sorted(frame.columns)
    plain = lambda v: None if v is None or v is pd.NA or v != v else (v.isoformat() if hasattr(v, "isoformat") else (round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v))
    table = [tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False)]
    return names, sorted(table, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    ours = catalog.queries()[name](spark, SF).toPandas()
    if name not in catalog.oracle_sql():
        assert len(ours)
        return
    theirs = duck.sql(catalog.oracle_sql()[name]).df()
    assert rows_of(ours) == rows_of(theirs)
