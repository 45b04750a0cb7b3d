from __future__ import annotations

import random

from pyspark.sql import functions as F

from pressloom.operators import evals
from pressloom.streaming import pipeline

CARD = "source_id long, original_url string, created long, story_id long, score int, confidence double, topic string"


def text(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def test_batch(spark):
    a, b, c = text(1), text(2), text(3)
    cards = spark.createDataFrame([(1, "u1", 100, 50, 2, 0.9, "economy")], CARD)
    texts = spark.createDataFrame([(1, a)], "source_id long, text string")
    batch = spark.createDataFrame(
        [(10, "u1", "known", "A", "news", 200, a), (11, "u2", "copy", "B", "news", 300, a + " tail"), (12, "u3", "new", "C", None, 400, b), (13, "u4", "copy of new", "D", "news", 500, b), (14, "u5", "copy of copy", "E", "news", 600, b + " end"), (15, "u6", "joins", "F", "news", 700, c), (16, "u6", "again", "G", "news", 800, c), (17, "u7", "late copy", "H", "news", 10**7, a)],
        "id long, url string, title string, outlet string, section string, created long, text string",
    )
    calls = []

    def scorer(df):
        calls.append(sorted(r.id for r in df.collect()))
        return df.select("id", F.lit(1).alias("score"), F.lit(0.5).alias("confidence"), F.lit("health").alias("topic"), F.when(F.size("candidates") > 0, F.col("candidates")[0]["story_id"]).alias("story_id"))

    near = spark.createDataFrame([(15, 50, 0.8), (15, 51, 0.7)], "id long, story_id long, similarity double")
    out = pipeline.run_batch(batch, cards, spark.createDataFrame([(50,)], "story_id long"), texts, scorer, near)
    r = {x.source_id: x for x in out.cards.collect()}
    assert calls == [[12, 15, 17]]
    assert set(r) == {11, 12, 13, 14, 15, 17}
    assert (r[11].syndicated_from, r[11].score, r[11].story_id, r[11].topic) == (1, 2, 50, "economy")
    assert (r[13].syndicated_from, r[14].syndicated_from, r[13].story_id, r[14].story_id) == (12, 12, 12, 12)
    assert r[15].story_id == 50 and r[12].syndicated_from is None and r[17].story_id == 17
    assert sorted(x.story_id for x in out.stories.collect()) == [12, 17]
    assert out.counts.first().asDict() == {"processed": 8, "duplicates": 2, "syndicated": 3, "created": 2, "cards": 6}


BATCH = "id long, url string, title string, outlet string, section string, created long, text string"


def alone(df):
    return df.select("id", F.lit(1).alias("score"), F.lit(0.5).alias("confidence"), F.lit("health").alias("topic"), F.lit(None).cast("long").alias("story_id"))


def test_long_chains(spark):
    h, a, b, c = 3600, text(1), text(2), text(3)
    # each copy of a reaches the one before only; b copies a card that is a copy of a copy; a ring of cards ends where it was met
    batch = [(100 + i, f"a{i}", "t", "A", "news", (i + 1) * 40 * h, a) for i in range(14)] + [(200, "b", "t", "B", "news", 1000 * h, b), (300, "c", "t", "C", "news", 1000 * h, c)]
    cards = [(1, "k1", 900 * h, 50, 2, 0.9, "economy", None), (2, "k2", 940 * h, 50, 2, 0.9, "economy", 1), (3, "k3", 980 * h, 50, 2, 0.9, "economy", 2), (4, "k4", 990 * h, 51, 2, 0.9, "economy", 5), (5, "k5", 991 * h, 51, 2, 0.9, "economy", 4)]
    texts = spark.createDataFrame([(3, b), (4, c)], "source_id long, text string")
    out = pipeline.run_batch(spark.createDataFrame(batch, BATCH), spark.createDataFrame(cards, CARD + ", syndicated_from long"), spark.createDataFrame([(50,), (51,)], "story_id long"), texts, alone)
    r = {x.source_id: x for x in out.cards.collect()}
    assert set(r) == {x[0] for x in batch} and {r[100 + i].syndicated_from for i in range(1, 14)} == {100}
    assert (r[200].syndicated_from, r[300].syndicated_from, r[300].story_id) == (1, 4, 51)
    assert out.counts.first().asDict() == {"processed": 16, "duplicates": 0, "syndicated": 15, "created": 1, "cards": 16}


def test_earliest_root_over_all_matches(spark):
    # 13 holds both halves: 11 came before 12, but 12 goes back to 10, which is older and too far off for 13
    h, a, b = 3600, text(1), text(2)
    batch = [(10, "u0", "t", "A", "news", 10 * h, b), (11, "u1", "t", "B", "news", 40 * h, a), (12, "u2", "t", "C", "news", 50 * h, b), (13, "u3", "t", "D", "news", 80 * h, a + " " + b)]
    none = spark.createDataFrame([], CARD), spark.createDataFrame([], "story_id long"), spark.createDataFrame([], "source_id long, text string")
    r = {x.source_id: x.syndicated_from for x in pipeline.run_batch(spark.createDataFrame(batch, BATCH), *none, alone).cards.collect()}
    assert r == {10: None, 11: None, 12: 10, 13: 10}


def test_copies_of_a_wire(spark):
    a = text(1, 80)
    batch = spark.createDataFrame([(i, f"u{i}", "t", "A", "news", 100 * i, f"{by} {a} {text(10 + i, 40)}") for i, by in ((1, "(WIRE A)"), (2, "(Wire A)"), (3, "(Wire B)"), (4, ""))], BATCH)
    none = spark.createDataFrame([], CARD), spark.createDataFrame([], "story_id long"), spark.createDataFrame([], "source_id long, text string")
    out = pipeline.run_batch(batch, *none, alone, wires=[("wire a", "A"), ("wire b", "B")])
    assert {x.source_id: x.syndicated_from for x in out.cards.collect()} == {1: None, 2: 1, 3: None, 4: None}


def test_evaluation_drivers(spark):
    from pressloom.functions.spectrum import FIVE
    from pressloom.operators import views

    names = views.columns(FIVE)
    frames = {n: spark.createDataFrame([(1, "a")] if n == "ask_outlets" else [], "prior_score int, outlet string").select("*") for n in names}
    doc = {"questions": [{"id": "q", "question": "how many", "reference_sql": "SELECT COUNT(*) AS n FROM ask_outlets"}, {"id": "w", "question": "wrong", "reference_sql": "SELECT outlet FROM ask_outlets"}], "hostile": [{"id": "h", "question": "drop it"}]}
    drafts = {"how many": "SELECT COUNT(outlet) AS m FROM ask_outlets", "wrong": "SELECT prior_score FROM ask_outlets", "drop it": "DROP TABLE ask_outlets"}
    got = {x["id"]: x for x in evals.run_questions(spark, frames, doc, drafts.get)}
    assert (got["q"]["passed"], got["w"]["passed"], got["h"]["refused"], got["h"]["reason"]) == (1, 0, 1, "not_select")
