"""Queries whose registered SQL cuts the input: held here against SQL over the whole tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from marquetry.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def by_sql(sql: str) -> list[tuple]:
    db = pytest.importorskip("duckdb").connect()
    for f in Path(SF).glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return sorted(db.execute(sql).fetchall())


def by_query(spark, name: str) -> list[tuple]:
    return sorted(tuple(r) for r in QUERIES[name](spark, SF).collect())


def test_nested_sections_hold_all_members(spark):
    got = by_query(spark, "q20_nested_sections")
    assert got == by_sql("select n_name, coalesce(string_agg(c_name, ',' order by c_name), '') from nation left join customer on c_nationkey = n_nationkey group by n_nationkey, n_name")
    assert sum(len(m.split(",")) for _, m in got if m) == by_sql("select count(*) from customer")[0][0]


def test_grouped_rows_hold_all_rows(spark):
    got = by_query(spark, "q36_grouped_rows")
    assert got == by_sql("select coalesce(nullif(c_mktsegment, ''), 'Unassigned'), string_agg(cast(c_custkey as varchar), ',' order by c_custkey) from customer group by 1")
    assert sum(len(m.split(",")) for _, m in got) == by_sql("select count(*) from customer")[0][0]


def test_pair_keys_grow_with_the_orders(spark):
    got = by_query(spark, "q12_pair_keys")
    a, b = "'c' || o_custkey", "'c' || o_orderkey"
    assert got == by_sql(f"select least({a}, {b}) || '|' || greatest({a}, {b}), min(o_orderkey) from orders where o_custkey <> o_orderkey group by 1")
    assert len(got) > 780
