"""Every query with an oracle gives DuckDB's rows on the smallest tables; the catalogue is consistent."""

import math
from pathlib import Path

import duckdb
import pytest

from quern.plans import load

CATALOG = load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in Path(sf_dir).iterdir():
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def test_oracles_belong_to_queries():
    assert set(CATALOG.ORACLES) <= set(CATALOG.QUERIES) and len(CATALOG.QUERIES) > 80


@pytest.mark.parametrize("name", sorted(CATALOG.QUERIES))
def test_query_equals_its_oracle(spark, duck, sf_dir, name):
    df = CATALOG.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in CATALOG.ORACLES:
        found = duck.execute(CATALOG.ORACLES[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_every_query_takes_empty_tables(spark, sf_dir, tmp_path):
    """No query crashes where its tables have no rows."""
    from concurrent.futures import ThreadPoolExecutor

    for f in Path(sf_dir).iterdir():
        spark.read.parquet(str(f)).limit(0).coalesce(1).write.parquet(f"{tmp_path}/{f.name}")

    def failure(name):
        try:
            CATALOG.QUERIES[name](spark, str(tmp_path)).collect()
        except Exception as e:  # noqa: BLE001
            return f"{name}: {str(e)[:200]}"

    with ThreadPoolExecutor(4) as pool:
        assert [x for x in pool.map(failure, sorted(CATALOG.QUERIES)) if x] == []
