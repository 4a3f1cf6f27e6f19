"""Every registered query outside the folder llm, against its SQL in DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from proofsieve.registry import ORACLE_SQL, QUERIES

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(TABLES).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.7g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{float(v):.7g}" if isinstance(v, int) else repr(v)


@pytest.mark.skipif(not Path(TABLES).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert rows or name == "drop_index"
        return
    result = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(map(plain, r)) for r in want)


def test_every_sql_has_its_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
