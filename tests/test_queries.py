"""Queries against their SQL counterparts on the smallest data set."""

import math
import os

import pytest

from checks.oracle import ORACLE
from checks.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "supplier", "lineitem", "events")
NO_EXACT_SQL = {"sample_count", "isolation_forest_fit", "isolation_forest_score",
                "forest_importance", "permutation_importance", "reconstruction_fit",
                "reconstruction_score", "recurrent_score"}


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLE) == NO_EXACT_SQL
    assert not set(ORACLE) - set(QUERIES)


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    expected = con.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert len(set(cols)) == len(cols)
    assert cols == sorted(expected.columns)
    at = [expected.columns.index(c) for c in cols]
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert ordered(got) == ordered([tuple(plain(r[i]) for i in at) for r in expected.fetchall()])
