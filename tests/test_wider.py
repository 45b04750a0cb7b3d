"""Operators of the wider catalog: odd input, ties, nulls, empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pressloom.functions import scores
from pressloom.operators import dedup, evals, reports, retrieval
from pressloom.plans import catalog, wider
from pressloom.session import exists, scratch, settle
from pressloom.sources import feeds as feeds_
from pressloom.sources import pages
from pressloom.streaming import flows


def test_every_query_with_sql_is_registered():
    q, o = catalog.queries(), catalog.oracle_sql()
    assert set(o) <= set(q) and {"sql_casts", "gate_reasons", "report_relevance_rollup", "stream_flood"} <= set(o)
    assert {r for _, r in wider.GATED} >= {"", "empty", "denied_keyword", "unknown_identifier", "limit_invalid"}


def test_in_top(spark):
    rows = spark.createDataFrame([(1, 5), (2, 7), (3, 5), (4, None)], "k long, n int")
    assert {r.k: r.top for r in reports.in_top(rows, "k", "n", 2).collect()} == {1: True, 2: True, 3: False, 4: False}
    assert reports.in_top(rows.limit(0), "k", "n", 2).count() == 0


def test_relevance_rollup(spark):
    stories = spark.createDataFrame([(1, "irrelevant", "old"), (2, None, None), (3, "maybe", "x"), (4, None, None), (5, "relevant", "keep")], "story_id long, relevance string, topic string")
    c = [
        (10, 1, "relevant", "A", "t1", 1, None, None), (11, 1, "irrelevant", "B", "t2", 1, None, None), (12, 1, None, "B", "t2", 1, None, None),
        (20, 2, "maybe", "A", "t", 0, None, None), (21, 2, "irrelevant", "B", "t", 0, "news", None),
        (30, 3, "maybe", "A", None, 0, None, None), (31, 3, "maybe", "B", None, 0, "opinion", None), (32, 3, "irrelevant", "C", None, 0, None, 30),
        (50, 5, None, "A", "n", None, None, None), (60, None, "relevant", "A", "n", 1, None, None),
    ]
    cards = spark.createDataFrame(c, "source_id long, story_id long, relevance string, outlet string, topic string, score int, section string, syndicated_from long")
    got = {r.story_id: (r.card_count, r.relevance, r.topic) for r in reports.relevance_rollup(stories, cards).collect()}
    # ties of topics go to the first card; opinions and copies are no perspectives; without rated cards all stays
    assert got == {1: (3, "relevant", "t1"), 2: (2, "relevant", "t"), 3: (3, "maybe", "x"), 4: (0, None, None), 5: (1, "relevant", "keep")}


def test_click_buckets(spark):
    clicked = spark.createDataFrame([(1, "2024-01-11 00:00:00"), (1, "2024-01-12 00:00:00"), (2, "2024-01-01 00:00:00"), (9, "2024-02-01 00:00:00")], "card_id long, at string").withColumn("at", F.col("at").cast("timestamp"))
    views = spark.createDataFrame([(7, "2024-01-10", 10), (7, "2024-01-09", 90)], "story_id long, day string, views long").withColumn("day", F.col("day").cast("date"))
    cards = spark.createDataFrame([(1, 7, "A", -1), (2, 7, "A", 1), (3, 8, "B", None), (4, None, None, None)], "card_id long, story_id long, outlet string, score int")
    got = {(r.outlet, r.score): (r.clicks, r.impressions, r.ctr) for r in reports.click_buckets(clicked, views, cards, "2024-01-10").collect()}
    assert got == {("A", -1): (2, 10, 20.0), ("A", 1): (0, 10, 0.0)}


def test_context_cost(spark):
    calls = spark.createDataFrame([(1, "a", "g", "eval", 5, 1, 3, None), (1, "a", "g", "eval", 5, 1, 3, None), (2, "a", "g", "eval", 6, 0, None, 2), (3, "a", "h", "web", 6, 1, 1, 1), (4, "a", "i", "eval", 1, 1, 1, 1)], "id long, operation string, call_group string, context_type string, created long, success int, input_tokens int, output_tokens int")
    assert [tuple(r) for r in reports.context_cost(calls, "eval", 5).collect()] == [("a", 2, 1, 1, 3, 2)]


def test_lookups(spark):
    index = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, owner string")
    assert sorted(r.id for r in retrieval.rows_of(index, spark.createDataFrame([("a",), ("a",), (None,)], "owner string"), "owner").collect()) == [1, 2]
    found = spark.createDataFrame([(1, 0.2, 0), (1, 0.1, 0), (2, 0.5, 3)], "query_id long, distance double, keyword_hits int")
    assert sorted(tuple(r) for r in retrieval.search_log(found).collect()) == [(1, 2, 0.9, True), (2, 1, 0.5, False)]
    assert retrieval.search_log(found.drop("keyword_hits").filter("query_id = 1")).first().keyword_zero is None
    s = spark.createDataFrame([(1, 100), (2, 50), (3, None)], "story_id long, created long")
    assert [(r.story_id, r.similarity) for r in retrieval.recent(s, 120, 60).collect()] == [(1, None)]
    cards = spark.createDataFrame([(1, "W"), (2, " "), (3, None), (4, "W")], "source_id long, wire string")
    assert [tuple(r) for r in dedup.wires_of(cards, cards.filter("source_id < 4"), "source_id", "wire").collect()] == [(1, "W")]


def test_keyword_needs_an_order_to_cut(spark):
    rows = spark.createDataFrame([(3, "grain quota", None), (1, "Quota", "grain"), (2, "grain", None)], "id long, title string, summary string")
    assert sorted(r.id for r in retrieval.keyword(rows, ["grain", "quota"]).collect()) == [1, 3]
    assert [r.id for r in retrieval.keyword(rows, ["grain", "quota"], most=1, order=["id"]).collect()] == [1]
    with pytest.raises(ValueError):
        retrieval.keyword(rows, ["grain"], most=1)


def test_by_host(spark):
    items = spark.createDataFrame([(1, "https://www.gull.example/a"), (2, "http://gull.example:80/b"), (3, "https://notgull.example"), (4, None), (5, "https://x.feedburner.com/a")], "item_id long, link string")
    feeds = spark.createDataFrame([(7, "https://rss.gull.example/f"), (8, "https://feeds.feedburner.com/g"), (9, None)], "feed_id long, feed_url string")
    got = sorted((r.item_id, r._feed_id) for r in feeds_.by_host(items, "link", feeds, "feed_url").collect())
    assert got == [(1, 7), (2, 7)]


def test_reviews_and_queue(spark):
    a = spark.createDataFrame([(1, 2), (2, None), (3, 0)], "k long, v int")
    b = spark.createDataFrame([(1, 2), (2, 1), (9, 9)], "k long, v int")
    assert tuple(flows.second_review(a, b, "k", "v").first()) == (2, 1, 1)
    assert tuple(flows.second_review(a.limit(0), b, "k", "v").first()) == (0, 0, 0)
    items = spark.createDataFrame([(1, 10), (2, 30), (3, 30)], "item_id long, fetched_at long")
    assert [(r.item_id, r.place) for r in flows.queue(items, 2).collect()] == [(1, 1), (2, 2)]
    assert [(r.item_id, r.place) for r in flows.queue(items, 2, newest=True).collect()] == [(2, 1), (3, 2)]
    assert [r.x for r in a.select(scores.capped_confidence(F.col("v").cast("double"), F.lit(1), 0.5).alias("x")).collect()] == [0.5, None, 0.0]
    miss = evals.misses(spark.createDataFrame([(1, "a", "b"), (2, "a", "a"), (3, "a", None), (4, None, "b")], "id long, w string, g string"), "w", "g", "id")
    assert [r.id for r in miss.collect()] == [1, 3]


def test_flood_batch_and_due(spark):
    e = spark.createDataFrame([("a", f"2024-01-01 00:00:0{i}", i) for i in range(4)] + [("a", "2024-01-01 01:00:00", 9), ("b", "2024-01-01 00:00:00", 10)], "who string, ts string, event_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.event_id: r.allowed for r in flows.flood_batch(e, 2, "hour").collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 9: True, 10: True}
    stories = spark.createDataFrame([(1, []), (2, ["x"]), (3, None)], "story_id long, common_points array<string>")
    cards = spark.createDataFrame([(1, "A", 1, None, None), (1, "B", 0, None, None), (3, "A", 1, None, None), (3, "B", 1, "opinion", None), (3, "C", 1, None, 5)], "story_id long, outlet string, score int, section string, syndicated_from long")
    assert sorted(r.story_id for r in flows.synthesis_due(stories, cards).collect()) == [1, 2]


def test_settled_tables_go_with_their_scope(spark):
    with scratch():
        t = settle(spark.range(3), "x")
        assert t.count() == 3
        path = t.inputFiles()[0].rsplit("/", 1)[0]
    assert not exists(spark, path)


PAGE = """<html><head><title>Site - x</title><script>var a = "<p>No</p>";</script></head><body><nav><ul><li>Home and all the other sections</li></ul></nav>
<h1>Council <b>votes</b></h1><!-- <p>Not this one, it is a comment.</p> --><p>The council approved the plan on Monday &amp; went home.</p><h2>What next</h2>
<P class='x'>Nothing.</P><p><a href="/a">Read also: a long headline of another article</a></p><p>Short</p><ul><li>A list item of more than twenty-five signs</li></ul><h3>Related</h3>
<footer><p>All rights reserved, whatever that may mean here.</p></footer></body></html>"""


def test_article_of_page(spark, tmp_path):
    (tmp_path / "a.html").write_text(PAGE)
    (tmp_path / "b.html").write_text("")
    (tmp_path / "c.txt").write_text("no page")
    df = pages.read_pages(spark, str(tmp_path))
    got = {r.path[-6:]: (r.t, r.a) for r in df.select("path", pages.title_of(F.col("html")).alias("t"), pages.article_of(F.col("html")).alias("a")).collect()}
    assert got["a.html"] == ("Council votes", "The council approved the plan on Monday & went home.\nWhat next\nNothing.\nA list item of more than twenty-five signs")
    assert set(got.values()) <= {got["a.html"], ("", "")}
    none = spark.createDataFrame([(None,)], "html string").select(pages.title_of(F.col("html")).alias("t"), pages.article_of(F.col("html")).alias("a")).first()
    assert (none.t, none.a) == ("", "")


def test_robots_answers(spark):
    f = spark.createDataFrame([("a", 200, 0), ("b", 404, 0), ("c", 503, 0), ("d", None, 0), ("e", None, -9000), ("f", 500, 0), ("f", 200, 5), ("g", 200, -90000)], "host string, status int, fetched_at long")
    a = pages.robots_answers(f, 100)
    assert {r.host: r.says for r in a.collect()} == {"a": "rules", "b": "all", "c": "none", "d": "none", "e": "ask", "f": "rules", "g": "ask"}
    p = spark.createDataFrame([(h, "/x") for h in "abcdez"] + [("a", "/no")], "host string, path string")
    rules = spark.createDataFrame([("a", "/no", False), ("a", "/x", True)], "host string, path string, allow boolean")
    assert {(r.host, r.path): r.allow for r in pages.may_fetch(p, a, rules).collect()} == {("a", "/x"): True, ("a", "/no"): False, ("b", "/x"): True, ("c", "/x"): False, ("d", "/x"): False, ("e", "/x"): None, ("z", "/x"): None}


def test_extraction_falls_back(spark):
    long, short = "word " * 9, "word"
    rows = [(1, long, None, "a", False, True, None), (2, short, long, "a", False, True, None), (3, long, long, "a", True, True, None), (4, long, short, "a", False, False, None), (5, None, None, None, False, None, "timeout"), (6, "", short, "a", None, True, None), (7, short, short, "a", False, True, None)]
    df = spark.createDataFrame(rows, "id int, page string, feed string, abstract string, skip_page boolean, allow boolean, error string")
    got = {r.id: (r.method, r.is_partial, r.note) for r in pages.extracted(df, 5).collect()}
    assert got == {1: ("page", 0, ""), 2: ("feed_body", 0, ""), 3: ("feed_body", 0, "feed is partial"), 4: ("abstract", 1, "barred by robots"), 5: ("abstract", 1, "fetch failed: timeout"), 6: ("abstract", 1, "no article found"), 7: ("abstract", 1, "page has 1 words")}
    assert {r.method for r in pages.extracted(df, 0).collect()} == {"legacy"}


def test_corrections(spark):
    e = spark.createDataFrame([(1, "pending", 5), (2, "accepted", 6), (3, "pending", 5), (4, None, None)], "id int, status string, created int")
    assert [r.id for r in reports.corrections(e).collect()] == [3, 1] and [r.id for r in reports.corrections(e, None).collect()] == [2, 3, 1, 4]
