"""Every query with oracle SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lexloom import catalog, catalog_cases, catalog_forms, catalog_pages, catalog_store  # noqa: F401  (each registers its queries)

SF = "/root/testdata/sf0.001"


def rows(table):
    show = lambda v: str(round(v, 6)) if isinstance(v, float) else str(v)
    names = sorted(table.column_names)
    return names, sorted(tuple(map(show, r)) for r in zip(*[table[n].to_pylist() for n in names], strict=True))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    ours = rows(catalog.queries()[name](spark, SF).toArrow())
    theirs = rows(duck.sql(catalog.oracle_sql()[name]).to_arrow_table())
    assert ours == theirs
