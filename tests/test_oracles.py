"""Every query of the library with SQL against DuckDB on the smallest driver tables."""

import os

import duckdb
import pytest

from seqloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    found.sql("SET timezone = 'UTC'")
    for name in TABLES:
        found.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return found


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: float(v) if isinstance(v, float) else v
    return sorted([tuple(repr(plain(r[k])) for k in order) for r in rows])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    ours = catalog.QUERIES[name](spark, SF)
    theirs = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours.columns, [tuple(r) for r in ours.collect()]) == rows_of(theirs.columns, theirs.fetchall())


@pytest.mark.parametrize("name", ["pair_identity", "sample_context", "weighted_draws", "token_budget"])
def test_partitioning_does_not_matter(spark, name):
    """The same rows whatever the number of shuffle partitions."""
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for count in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", count)
            frame = catalog.QUERIES[name](spark, SF)
            found.append(rows_of(frame.columns, [tuple(r) for r in frame.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
