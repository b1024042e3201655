"""Every query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from cloakframe.plans.registry import MODULES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Its SQL counts on a hundred customers.
BIGGER = {"column_inference", "merge_inferences"}


def connection(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.ORACLE_SQL.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    sf = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = connection(sf).sql(SQL[name])
    at = [list(rel.columns).index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
