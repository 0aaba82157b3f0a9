"""Every query with SQL gives what DuckDB gives on the driver's tables."""

import duckdb
import pytest

from folioscope.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    def one(v):
        if v is None or v != v:
            return None
        return f"{v + 0.0:.6f}" if isinstance(v, float) else int(v) if hasattr(v, "__index__") else str(v)

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert canonical(map(tuple, got)) == canonical([tuple(r[i] for i in order) for r in cursor.fetchall()])


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)
