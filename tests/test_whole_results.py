"""Queries that return all rows, on a table with more rows than the first pages of their namesakes hold."""

import json
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "part conversations".split()


@pytest.mark.parametrize("name, least", [("k7_all_conversion_outputs", 100), ("j9_pending_all", 200), ("b6_cache_merge_all", 1)])
def test_all_rows_as_sql_has_them(spark, name, least):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(columns).collect()
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert len(got) > least and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_conversion_outputs_have_both_halves(spark):
    rows = entry.queries()["k7_all_conversion_outputs"](spark, SF).collect()
    assert [r["gain"] for r in rows] == sorted((r["gain"] for r in rows), reverse=True)
    r = next(r for r in rows if r["split_off"])
    assert json.loads(r["utility_json"])["messageBody"]["body"] == r["after_body"]
    assert json.loads(r["split_off_json"])["templateName"] == (r["name"] + "_PROMO").lstrip("_")


def test_cache_merge_takes_all_conversations(spark):
    every, half = (entry.queries()[n](spark, SF) for n in ("b6_cache_merge_all", "b6_cache_merge"))
    assert half.select("key").exceptAll(every.select("key")).count() == 0 < every.select("key").exceptAll(half.select("key")).count()
