"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from quernstone.plans import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (int, Decimal)) and not isinstance(value, bool):
        return round(float(value), 6)
    if isinstance(value, (datetime, date)):
        return str(value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    expected = duck.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, expected.fetchall())


def test_repeated_lines_of_documents_are_removed(spark):
    name, data = "repeated_line_removal_in_documents", DATA.parent / "sf0.01"  # the smallest tables have none
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    all_lines = con.execute("select count(*) from (select unnest(string_split(coalesce(text, ''), chr(10))) as line from documents) where trim(line) <> ''").fetchone()[0]
    got = QUERIES[name](spark, str(data))
    expected = con.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    found = got.collect()
    assert rows(got.columns, found) == rows(columns, expected.fetchall())
    assert sum(r.n_lines for r in found) < all_lines


def test_series_of_one_date_are_shown_in_the_order_of_sql(spark, duck, tmp_path):
    """A name that the list of the SQL lacks comes last (F1)."""
    duck.sql("select event_id, timestamp '2024-01-30 23:55:56' as ts, user_id, event_type, value, props from events").write_parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.execute(SQL["trends_shown"] + " order by place").fetchall()
    assert [r[0] for r in want][-1] == "urine_wbc" and len({r[4] for r in want}) == 1
    assert [tuple(r) for r in QUERIES["trends_shown"](spark, str(tmp_path)).select("series_key", "series_unit", "place", "several", "last_date").collect()] == want
