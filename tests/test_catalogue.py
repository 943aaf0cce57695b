"""Every query of the library against its SQL twin in DuckDB, and that it runs over empty tables."""

import math
from pathlib import Path

import duckdb
import pytest

from geoloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for path in Path(SF).glob("*.parquet"):
        spark.read.parquet(str(path)).limit(0).write.parquet(str(at / path.name))
    return str(at)


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value if value is None or isinstance(value, (int, bool, str, bytes)) else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    out = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in out.description]
    assert sorted(df.columns) == sorted(names)
    want = rows_of(names, out.fetchall())
    assert want and rows_of(df.columns, df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_query_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_queries_run_over_empty_tables(spark, empty_dir):
    failed = {}
    for name, f in catalog.QUERIES.items():
        try:
            f(spark, empty_dir).collect()
        except Exception as e:
            failed[name] = str(e)[:200]
    assert not failed
