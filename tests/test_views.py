"""The four views on a small seed with known figures."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from pressloom.functions.spectrum import THREE
from pressloom.operators import reports, views
from pressloom.plans import ask

T0 = 1790524800
CARD = "source_id long, title string, status int, created long, story_id long, outlet string, section string, score int, confidence decimal(3,2), partial_text int, syndicated_from long, topic string, original_url string, micro_summary string"
STORY = "story_id long, title string, status int, created long, topic string, relevance string, neutral_summary string, common_points array<string>, disputed_points array<string>"
FEED = "feed_id long, outlet string, section string, prior_score int, prior_source string, active int, partial_text int, feed_url string, status int"


def card(i, story, outlet, score, section="news", copied=None, after=0, status=1):
    return (i, f"t{i}", status, T0 + after, story, outlet, section, score, Decimal("0.50"), None, copied, "economy", f"https://x/{i}", None)


@pytest.fixture(scope="module")
def frames(spark):
    cards = [card(1, 10, "Fox News", 2), card(2, 10, "The New York Times", -1, after=41400), card(3, 10, "The New York Times", -2, "opinion"), card(4, 10, "ABC News", 2, copied=1), card(5, 11, "Fox News", 1), card(5, 11, "Fox News", 1), card(6, None, "Axios", 0, None, copied=1, status=1), card(7, 10, "Hidden", 0, status=0)]
    stories = [(10, "tariffs", 1, T0, "economy", "relevant", "s", ["a point"], None), (11, "storm", 1, T0, "climate", None, "", [], None), (12, "gone", 0, T0, None, None, None, None, None), (13, "alone", 1, T0, None, None, None, None, None)]
    feeds = [(1, "Fox News", "news", 2, None, 1, 1, "u1", 1), (2, "The New York Times", "opinion", -2, None, 1, 0, "u2", 1), (3, "Off", None, None, None, None, None, None, 0)]
    return spark.createDataFrame(cards, CARD), spark.createDataFrame(stories, STORY), spark.createDataFrame(feeds, FEED)


@pytest.fixture(scope="module")
def built(frames):
    return views.build(*frames)


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_sources(built):
    r = rows(built["ask_sources"], "source_id")
    assert sorted(r) == [1, 2, 3, 4, 5, 6]
    assert (r[1]["bucket"], r[1]["is_perspective"], str(r[1]["published_at"])) == ("right", 1, "2026-09-27 12:00:00")
    assert (r[2]["bucket"], r[2]["day"]) == ("lean_left", date(2026, 9, 27))
    assert (r[3]["is_opinion"], r[3]["is_perspective"]) == (1, 0)
    assert (r[4]["is_reprint"], r[4]["is_perspective"], r[4]["syndicated"]) == (1, 0, 1)
    # copied, but of which story is unknown: the flags are null
    assert (r[6]["is_reprint"], r[6]["is_opinion"], r[6]["is_perspective"], r[6]["section"]) == (None, 0, None, "news")


def test_stories(built):
    r = rows(built["ask_stories"], "story_id")
    assert sorted(r) == [10, 11, 13]
    t = r[10]
    assert [t[f"{k}_count"] for k in ("source", "perspective", "opinion", "reprint", "outlet", "right", "lean_left", "left")] == [4, 2, 1, 1, 2, 1, 1, 0]
    assert (t["has_summary"], t["has_consensus"], r[11]["has_summary"], r[11]["has_consensus"], r[13]["source_count"]) == (1, 1, 0, 0, 0)


def test_outlets_and_days(built):
    assert [tuple(r)[:4] for r in built["ask_outlets"].orderBy("outlet").collect()] == [("Fox News", "news", 2, "right"), ("The New York Times", "opinion", -2, "left")]
    d = built["ask_daily"].collect()
    assert len(d) == 1 and (d[0]["stories"], d[0]["sources"], d[0]["perspectives"], d[0]["opinion"]) == (3, 6, 3, 1)


def test_other_spectrum(frames):
    b = views.build(*frames, buckets=THREE)
    assert b["ask_daily"].columns[-3:] == ["left_count", "center_count", "right_count"]
    assert views.columns(THREE)["ask_daily"] == b["ask_daily"].columns


def test_ask_over_frames(spark, built):
    got = ask.ask(spark, built, "SELECT COUNT(*) AS n FROM ask_sources WHERE bucket IN ('right','lean_left')").collect()
    assert got[0]["n"] == 3
    with pytest.raises(ask.Rejected) as e:
        ask.ask(spark, built, "DELETE FROM ask_sources")
    assert e.value.reason == "not_select"
    assert ask.relations(spark, "SELECT * FROM a WHERE x IN (SELECT y FROM b.c)") == {"a", "b, c"}
    assert [r["n"] for r in ask.run(spark, built, "SELECT COUNT(*) AS n FROM ask_stories", seconds=60)] == [3]


def test_probe(spark, built):
    own = spark.newSession()
    assert ask.probe(own).reason == "missing_views"


def test_create_and_drop(spark, built):
    views.create(spark, built)
    assert views.exist(spark) and ask.probe(spark).ok
    spark.range(1).createOrReplaceTempView("another")
    assert ask.probe(spark).reason == "extra_tables"
    spark.catalog.dropTempView("another")
    views.drop(spark)
    assert not views.exist(spark)


def test_empty_tables(spark, frames):
    e = views.build(*[f.limit(0) for f in frames])
    assert all(e[n].count() == 0 for n in views.VIEWS)


def test_story_page_and_divergence(frames):
    c, s, f = frames
    page = rows(reports.story_page(views.once(c, "source_id")), "source_id")
    assert page[4]["role"] == "reprint" and page[1]["reprints"] == 1 and page[3]["role"] == "opinion"
    far = rows(reports.story_divergence(c, f), "source_id")
    assert {k: v["delta"] for k, v in far.items()} == {5: -1}
    assert reports.story_divergence(c, f, least=2).count() == 0


def test_reports_on_seed(frames):
    c, s, f = frames
    t = rows(reports.outlet_tally(c), "outlet")
    assert (t["Fox News"]["right_count"], t["Fox News"]["lean_right_count"], t["Fox News"]["total"]) == (1, 1, 2)
    assert [r["story_id"] for r in reports.ranking(s, c, T0 + 86400).collect()] == [10]
    assert rows(reports.story_card_counts(s, c), "story_id")[13]["cards"] == 0
    assert rows(reports.dominant_topic(c), "story_id")[10]["topic"] == "economy"
    ranked, more = reports.page(reports.ranking(s, c, T0 + 86400), 0, 1)
    assert ranked.count() == 1 and not more
