"""Queries on keys of up to seven digits, as large tables have them, against DuckDB."""

import duckdb
import pytest

from lexloom import catalog, catalog_cases, catalog_forms, catalog_pages, catalog_store  # noqa: F401  (each registers its queries)
from tests.test_catalog import rows

#: First keys of the runs that the tables hold, by width.
STARTS = (40, 9_990, 99_990, 999_990, 1_199_980)
TABLES = {
    "nation": "select 0::int as n_nationkey, 'NATION_0' as n_name, 0::int as n_regionkey",
    "customer": "select k as c_custkey, format('Customer#{:09d}', k) as c_name, 0::int as c_nationkey, 0.0::double as c_acctbal, 'BUILDING' as c_mktsegment from keys",
    "orders": "select k as o_orderkey, k as o_custkey, 'O' as o_orderstatus, 1.0::double as o_totalprice, timestamp '1996-01-02' as o_orderdate, '5-LOW' as o_orderpriority from keys",
    "part": "select k as p_partkey, 'hot bolt' as p_name, 'Brand#' || (k % 3) as p_brand, 'LARGE' as p_type, (k % 50 + 1)::int as p_size, 900.0::double as p_retailprice from keys",
    # A line's spellings come twice a volume and page; volumes are both small and large.
    "lineitem": """select k as l_orderkey, k as l_partkey, case when k % 2 = 0 then k // 20 else k % 50 end as l_suppkey, n::int as l_linenumber, 1.0::double as l_quantity,
        1.0::double as l_extendedprice, 0.0::double as l_discount, 0.0::double as l_tax, 'N' as l_returnflag, 'O' as l_linestatus, timestamp '1996-01-02' as l_shipdate from keys, range(1, 8) r(n)""",
}


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    path, con = tmp_path_factory.mktemp("large"), duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    con.sql(f"create table keys as select s + g as k from (values {', '.join(f'({s})' for s in STARTS)}) t(s), range(20) r(g)")
    for name, sql in TABLES.items():
        con.sql(f"copy ({sql}) to '{path}/{name}.parquet'")
        con.sql(f"create view {name} as from '{path}/{name}.parquet'")
    return str(path), con


NAMES = [
    "citation_overrides",
    "cite_dedupe",
    "cite_extract",
    "cite_lookup",
    "docket_papers",
    "docket_tokens",
    "forms_extract",
    "named_authorities",
    "page_records",
    "pinned_citations",
    "renamed_series",
    "search_phrases",
    "store_tables",
    "text_lookup",
]


@pytest.mark.parametrize("name", NAMES)
def test_large_keys(spark, large, name):
    path, duck = large
    ours = rows(catalog.queries()[name](spark, path).toArrow())
    theirs = rows(duck.sql(catalog.oracle_sql()[name]).to_arrow_table())
    assert len(ours[1]) and ours == theirs
