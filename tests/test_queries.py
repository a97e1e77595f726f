"""Every registered query against its SQL on the smallest tables."""

import functools
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from loomline.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")


@functools.cache
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = tables().execute(ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = [Counter(map(tuple, df[cols].itertuples(index=False))) for df in (got, want)]
    assert rows[0] == rows[1]
    assert len(got) > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["dataset"] for r in rows} == {"events", "orders"}
