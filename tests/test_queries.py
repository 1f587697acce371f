"""Every registered query runs on the smallest tables; a sample with SQL agrees with it (check.py compares them all)."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of
from pagegrain.sources.tables import BASE

SAMPLE = ["u1_canonical_url", "u15_url_kind", "t15_locale_number", "j1_page_links", "j11_nav_led", "g3_wall", "w1_canonical_attempts", "a1_capability_summary",
          "a4_tool_summary", "k8_domain_hits", "k19_rescue_links", "o3_rank_fusion", "w4_listing_ledger", "e4_crawl", "e5_pagination", "r1_link_watch"]


def test_oracles_name_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [item[0] for item in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(row) for row in df.collect()]) == rows_of(names, cursor.fetchall())
