from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pressloom.operators import reports
from pressloom.sources import feeds, stores
from pressloom.streaming import flows

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>c</title>
<item><title>One &amp; two</title><link> https://x/1 </link><description>&lt;p&gt;Short&lt;/p&gt; text</description><content:encoded><![CDATA[<p>Body</p>]]></content:encoded></item>
<item><title>Three</title><link>https://x/2</link></item></channel></rss>"""


def test_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text("not a feed at all")
    r = {x.link: x for x in feeds.read_rss(spark, str(tmp_path)).collect()}
    assert sorted(r) == ["https://x/1", "https://x/2"]
    assert (r["https://x/1"].title, r["https://x/1"].abstract, r["https://x/1"].feed_body) == ("One & two", "Short text", "<p>Body</p>")
    assert r["https://x/2"].abstract == "" and r["https://x/2"].feed_body is None


def test_robots(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: newsbot\nUser-agent: other\nDisallow: /private # no\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow:\n"
    rules = feeds.robots_rules(text, "NewsBot/2.0")
    assert rules == [(False, "/private"), (True, "/private/open"), (False, "/*.pdf$")]
    assert feeds.robots_rules(text, "else") == [(False, "/")] and feeds.robots_rules("", "x") == []
    r = spark.createDataFrame([("h", a, p, feeds.robots_regex(p)) for a, p in rules], "host string, allow boolean, pattern string, regex string")
    paths = {"/": True, "/private/x": False, "/private/open/y": True, "/a.pdf": False, "/a.pdf?x": True}
    pages = spark.createDataFrame([("h", p) for p in paths] + [("unknown", "/private")], "host string, path string")
    got = {(x.host, x.path): x.allow for x in feeds.allowed(pages, r).collect()}
    assert got == {**{("h", p): v for p, v in paths.items()}, ("unknown", "/private"): True}


def test_registry(spark):
    e = spark.createDataFrame([(1, "u1", "A", "news", 1, None, None), (2, "u1", "B", None, None, None, None), (3, "", "C", None, None, None, None), (4, "u4", " ", None, None, None, None), (5, "u5", "E", "sport", None, None, None), (6, "u6", "F", None, 3, None, None), (7, "u7", "G", None, None, -3, None), (8, "u8", "H", None, None, None, "x" * 256), (9, "u9", "I", None, None, None, None)], "row int, url string, outlet string, section string, score int, prior int, prior_source string")
    ok, bad = feeds.checked(e)
    assert sorted((r.row, r.section) for r in ok.collect()) == [(1, "news"), (9, "news")]
    assert {r.row: r.error for r in bad.collect()} == {2: "duplicate url", 3: "no url", 4: "no outlet", 5: "unknown section", 6: "score out of range", 7: "prior out of range", 8: "prior_source too long"}
    old = spark.createDataFrame([("u1", "A", 1), ("u2", "B", None), ("u3", "C", 2)], "url string, outlet string, score int")
    new = spark.createDataFrame([("u1", "A", 1), ("u2", "B", 0), ("u4", "D", None)], "url string, outlet string, score int")
    assert {r.url: r.change for r in feeds.upsert(old, new, "url", ["outlet", "score"]).collect()} == {"u1": "unchanged", "u2": "updated", "u3": "kept", "u4": "created"}


def test_body(spark):
    df = spark.createDataFrame([("a b c", "d e f", "z", False), ("a", "d e f", "z", False), ("a b c", None, "z", True), (None, None, None, False)], "p string, f string, a string, s boolean")
    r = [x.b for x in df.select(feeds.chosen_body(F.col("p"), F.col("f"), F.col("a"), F.col("s"), 3).alias("b")).collect()]
    assert [(x.method, x.partial) for x in r] == [("page", 0), ("feed_body", 0), ("abstract", 1), ("abstract", 1)]


def test_stores(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"id": 1, "title": "t", "body_excerpt": "b", "expected": {"bias": "left", "social_relevance": "maybe", "topic": "x"}}], indent=2))
    g = stores.read_golden(spark, str(tmp_path / "g.json"))
    assert g.first().expected.bias == "left"
    stores.write_golden(g, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    log = spark.createDataFrame([("abcdef", None)], "a string, n int")
    stores.append_log(log, str(tmp_path / "log"), {"a": 3}, {"n": 0})
    stores.append_log(log, str(tmp_path / "log"), {"a": 3}, {"n": 0})
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [("abc", 0)] * 2
    df = spark.createDataFrame([(1, 10, "x"), (1, 20, "y"), (2, 5, None)], "k int, created long, v string")
    assert {r.k: r.v for r in stores.latest(df, "k", "created").collect()} == {1: "y", 2: None}
    assert stores.purge(df, 86400 + 10, 1).count() == 2 and stores.purge(df, 0, 0).count() == 3
    rel = stores.relabel(df, "v", "x", "z")
    assert sorted(str(r.v) for r in rel.collect()) == ["None", "y", "z"]
    with pytest.raises(ValueError):
        stores.relabel(df, "v", "x", "y")
    h = spark.createDataFrame([(1, "a &amp; b"), (2, "&lt;b&gt;"), (3, None), (4, "plain"), (5, "<p>x &amp; y</p>")], "k int, v string")
    d = stores.decode_stored(h, "v", html=True)
    assert {r.k: r.v for r in d.collect()} == {1: "a & b", 2: "&lt;b&gt;", 3: None, 4: "plain", 5: "<p>x & y</p>"}
    assert stores.count_changes(h, d, "k", ["v"]).first().v == 2
    c = spark.createDataFrame([(1, 7), (2, 8)], "source_id int, story_id int")
    s = spark.createDataFrame([(7,), (8,)], "story_id int")
    a, b = stores.cascade_delete(s, c, s.filter("story_id = 7"))
    assert [r.story_id for r in a.collect()] == [8] and [r.source_id for r in b.collect()] == [2]


def test_clicks(spark):
    cards = spark.createDataFrame([(1, 9, "Left"), (2, 9, "Right"), (3, 8, "None")], "card_id long, story_id long, outlet string")
    r = {x.outlet: x for x in reports.clicks(spark.createDataFrame([(1,), (1,), (2,)], "card_id long"), spark.createDataFrame([(9, 10)], "story_id long, views long"), cards).collect()}
    assert (r["Left"].clicks, r["Left"].impressions, r["Left"].ctr) == (2, 10, 20.0) and r["Right"].ctr == 10.0 and "None" not in r
    b = spark.createDataFrame([("Mozilla",), ("",), (None,), ("GoogleBot/2",)], "a string").select(reports.bots(F.col("a")).alias("b")).collect()
    assert [x.b for x in b] == [False, True, True, True]
    c = spark.createDataFrame([("A ", "accepted", 2), ("A", "accepted", 5), ("B", "open", 9), (None, "accepted", 9)], "name string, status string, decided long")
    assert [tuple(x) for x in reports.credits(c).collect()] == [("A", 5)]
    e = spark.createDataFrame([(1, '{"accuracy": 0.5, "items": 3}'), (2, "no json"), (3, None)], "id long, metrics string")
    assert [(x.id, x.accuracy) for x in reports.eval_runs(e, 2).collect()] == [(3, None), (2, None)]


def _stream(spark, tmp_path, rows, schema, name):
    p = str(tmp_path / name)
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(p)
    return spark.readStream.schema(spark.read.parquet(p).schema).option("maxFilesPerTrigger", 1).parquet(p)


def test_streams_equal_batches(spark, tmp_path):
    ev = "select cast(u as long) user_id, timestamp_seconds(t) ts, k event_type from values "
    df = spark.sql(ev + "(1, 0, 'view'), (1, 90000, 'view'), (1, 5, 'view'), (2, 7, 'click') as x(u, t, k)")
    df.write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    got = {tuple(r) for r in flows.run_to_end(flows.view_counter(s), "complete").collect()}
    assert got == {tuple(r) for r in flows.view_counter(df).collect()} == {(1, 19700101, 2), (1, 19700102, 1)}
    w = flows.run_to_end(flows.windowed_views(spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))), "complete")
    assert sorted(r.n for r in w.collect()) == [1, 1, 2]


def test_first_by_url(spark, tmp_path):
    df = spark.sql("select u link, timestamp_seconds(t) fetched_at from values ('a', 1), ('b', 2), ('a', 3) as x(u, t)")
    df.coalesce(1).write.parquet(str(tmp_path / "a"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "a"))
    assert sorted(r.link for r in flows.run_to_end(flows.first_by_url(s)).collect()) == ["a", "b"]


def test_lookback(spark, tmp_path):
    df = spark.sql("select k key, cast(i as long) id, timestamp_seconds(1000000000 + t) at from values ('x', 1, 0), ('x', 2, 3600), ('y', 3, 10), ('x', 4, 400000) as v(k, i, t)")
    df.coalesce(1).write.parquet(str(tmp_path / "l"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "l"))
    got = {tuple(r) for r in flows.run_to_end(flows.lookback_pairs(read(), read())).collect()}
    assert got == {(2, 1)}


def test_flood(spark, tmp_path):
    s = _stream(spark, tmp_path, [[("a", 0), ("a", 1), ("a", 2), ("b", 2)], [("a", 5), ("a", 10), ("a", 11)]], "who string, at long", "f")
    got = sorted(tuple(r) for r in flows.run_to_end(flows.flood(s, 2, 10)).collect())
    assert got == [("a", 0, True), ("a", 1, True), ("a", 2, False), ("a", 5, False), ("a", 10, True), ("a", 11, True), ("b", 2, True)]


def test_harvest_and_points(spark):
    i = spark.createDataFrame([(n, 1 if n < 12 else 2, f"u{n % 11}", n) for n in range(14)] + [(50, 1, " ", 1), (51, 1, None, 2)], "item_id long, feed_id long, link string, fetched_at long")
    got = sorted((r.feed_id, r.item_id) for r in flows.harvest(i, spark.createDataFrame([("u3",)], "link string"), 4).collect())
    assert got == [(1, 7), (1, 8), (1, 9), (1, 10)]
    p = flows.settle_points(spark.createDataFrame([(1, [" a", "a ", "", None, "b", "c", "d", "e"]), (2, None)], "key int, points array<string>"), 3)
    assert [(r.key, r.points) for r in p.collect()] == [(1, ["a", "b", "c"]), (2, None)]


def test_micro_batches(spark, tmp_path):
    seen = []
    s = _stream(spark, tmp_path, [[(1,)], [(2,)]], "x int", "m")
    flows.micro_batches(s, lambda df, n: seen.append(sorted(r.x for r in df.collect())), str(tmp_path / "state"))
    assert sorted(sum(seen, [])) == [1, 2] and len(seen) == 2
