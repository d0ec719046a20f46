"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from landlace.plans import polygon_queries, record_queries, registry, spatial_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(float(v) if hasattr(v, "as_tuple") else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    answer = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = plain(tuple(r[names.index(c)] for c in columns) for r in answer.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    """Queries without SQL: rows, as many keys as rows, and scores within their range; what they say is tested with their operators."""
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows and all(any(v is not None for v in r) for r in rows)
    keys = [c for c in df.columns if c in ("a_id", "b_id", "parcel_id", "bin", "type", "feature", "column", "field")]
    assert keys and len({tuple(r[c] for c in keys) for r in rows}) == len(rows)
    for c in set(df.columns) & {"p", "ratio", "token_sort", "token_set", "owner_similarity"}:
        assert all(0 <= r[c] <= 1 for r in rows)
