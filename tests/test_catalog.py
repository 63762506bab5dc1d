"""Every query against its DuckDB counterpart at the smallest scale."""

import duckdb
import pytest

from sheaf.plans import catalog, checks  # noqa: F401 - registers its queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows or name == "member_collisions"  # too few pages for a collision at this scale
    if name in catalog.ORACLE:
        found = con.execute(catalog.ORACLE[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        want = sorted(repr(tuple(dict(zip(columns, r, strict=True))[c] for c in sorted(columns))) for r in found.fetchall())
        assert sorted(repr(tuple(r[c] for c in sorted(columns))) for r in rows) == want


def test_flagship(spark):
    rows = catalog.flagship(spark, SF).collect()
    assert rows and all(r.height <= 270 for r in rows)
