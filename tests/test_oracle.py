"""Each query against its DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from cadenza.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def duck():
    """A database of its own for each test, so that a fault in one leaves the others alone."""
    c = duckdb.connect(config={"threads": 1, "memory_limit": "4GB"})
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    yield c
    c.close()


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def cell(x):
        if isinstance(x, float):
            return f"{x:.5f}".replace("-0.00000", "0.00000")
        if hasattr(x, "tzinfo"):
            return x.replace(tzinfo=None).isoformat()
        return str(x)

    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    result = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in result.description]
    want = plain(result.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
