"""Every registered query against DuckDB on the smallest tables; those without SQL give rows and a stable schema."""

import math

import duckdb
import pytest

from hypolith.plans import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in registry.SQL:
        assert got
        return
    r = duck.execute(registry.SQL[name])
    held = [d[0] for d in r.description]
    assert sorted(held) == columns
    at = [held.index(c) for c in columns]
    assert ordered(got) == ordered(tuple(plain(x[i]) for i in at) for x in r.fetchall())
