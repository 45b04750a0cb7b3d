"""The driver's entry points, and queries against their SQL on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_
from pressloom.plans import catalog

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
SOME = ["view_ask_sources", "view_ask_stories", "view_ask_daily", "sql_exists", "sql_dates", "sql_group_concat", "sql_window_frames", "report_ranking", "report_outlets", "report_topic_spectrum", "report_daily_tokens", "report_clicks", "text_word_counts", "dedup_matches", "dedup_roots", "search_nearest", "search_hybrid", "eval_fields", "store_harvest", "stream_views"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, con, name):
    df = catalog.queries()[name](spark, D)
    r = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, r.fetchall())


def test_entry(spark):
    assert entry_.entry(spark).count() > 0
    assert set(entry_.oracle_sql()) <= set(entry_.queries())
    assert len(catalog.queries()) > 90


def test_core_does_not_need_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for p in glob.glob(f"{root}/pressloom/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in p:
            assert "pressloom.llm" not in open(p).read(), p
