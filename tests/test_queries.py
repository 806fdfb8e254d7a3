"""Every registered query against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from fieldlab import plans

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in sorted(os.listdir(SF)):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def shaped(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].map(lambda v: None if v is None or v != v else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


#: Queries whose right answer has no rows: on all given tables (tested by itself), and on the
#: smallest ones.
EMPTY = {"unknown_references", "elements_by_type_and_tag"}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    assert len(got) or name in EMPTY
    if name not in plans.ORACLES:
        return
    a, b = shaped(got), shaped(duck.sql(plans.ORACLES[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == float:
            np.testing.assert_allclose(a[c], b[c], rtol=1e-9, atol=2e-6)
        else:
            assert a[c].tolist() == b[c].tolist()


def test_entry_point_lists_all_queries():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
