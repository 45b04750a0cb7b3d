from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.operators import evals, retrieval


def test_nearest_join_by_brute_force(spark):
    r = np.random.default_rng(2)
    m = r.normal(size=(150, 8))
    m[7] = 0
    m[9] = m[8]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(999, None)], "id long, vector array<double>")
    got = {}
    for x in retrieval.nearest_join(df, df.filter("id % 10 = 0"), 5, block=4, chunk=16).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = x.id
    n = np.linalg.norm(m, axis=1)
    for q in range(0, 150, 10):
        d = [(1 - m[q] @ m[i] / n[q] / n[i], i) for i in range(150) if i != q and n[i] > 0]
        assert [got[q][k] for k in range(1, 6)] == [i for _, i in sorted(d)[:5]]


def test_nearest_and_owner(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "a"), (3, [0.0, 1.0], "b"), (4, [0.0, 0.0], "c"), (5, [1.0, 0.0], "b")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, o string")
    assert [(r.o, r.id) for r in retrieval.nearest(df, [1.0, 0.0], 3, 0.5, "o").orderBy("o").collect()] == [("a", 1), ("b", 5)]
    t = df.select("id", retrieval.truncated(F.col("vector"), 1).alias("t")).collect()
    assert t[3].t == [0.0] and t[1].t == [1.0]
    v = spark.createDataFrame([([3.0, 4.0, 12.0],), ([0.0, 0.0, 1.0],), ([1.0],)], "v array<double>").select(retrieval.truncated(F.col("v"), 2).alias("t")).collect()
    assert [x.t for x in v] == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0], [1.0]]


def test_words_and_hybrid(spark):
    df = spark.createDataFrame([(1, "grain quota grain", "x"), (2, "quota", "Grain"), (3, None, None)], "id long, title string, summary string")
    assert sorted(r.id for r in retrieval.keyword(df, ["grain", "quota"]).collect()) == [1, 2]
    assert retrieval.keyword(df, []).count() == 0
    b = retrieval.bm25(df.select("id", F.col("title").alias("text")), ["Grain"])
    assert [r.id for r in b.collect()] == [1]
    v = spark.createDataFrame([(1, 0.1), (2, 0.9)], "id long, distance double")
    assert {r.id: r.score > 9 for r in retrieval.hybrid(b, v).collect()} == {1: True}
    assert [r.id for r in retrieval.hybrid(b, v, "vector").collect()] == [1] and [r.id for r in retrieval.hybrid(b, v, "keyword").collect()] == [1]
    assert retrieval.mode(None, "vector") == "vector" and retrieval.mode(vectors=False) == "keyword" and retrieval.mode() == "hybrid"
    with pytest.raises(ValueError):
        retrieval.mode("fuzzy")
    f = spark.createDataFrame([("10",), ("9",), ("-2",), ("9",), (None,)], "v string")
    assert [tuple(r) for r in retrieval.facets(f, "v").collect()] == [("-2", 1), ("9", 2), ("10", 1)]


def test_same_rows(spark):
    assert evals.same_rows([("Fox News", "210"), ("Axios", "106")], [("106", "Axios"), ("210.00", "Fox News")])
    assert not evals.same_rows([("a",), ("a",)], [("a",), ("b",)]) and not evals.same_rows([("a",)], [("a",), ("a",)])
    assert evals.same_rows([("a", 1, 2), ("b", 3, 4)], [("a", 2), ("b", 4)], projection=True) and not evals.same_rows([("a", 1)], [("a",)])
    assert [evals.canonical(x) for x in (-0.001, "57.6203", 10, True, "x", 1.5, 0)] == ["0", "57.62", "10", "1", "x", "1.5", "0"]
    a = spark.createDataFrame([("x", 1.0, None), ("y", 2.004, "q")], "a string, b double, c string")
    b = spark.createDataFrame([(2.0, "y", "q"), (1.0, "x", None)], "b double, a string, c string")
    assert evals.same_result(a, b) and not evals.same_result(a, b.limit(1))


def test_summaries(spark):
    i = spark.createDataFrame([(1, 0, 0, 0, 1000.0, 0.01), (0, 1, 0, 0, 3000.0, 0.002), (0, 1, 0, 1, 9000.0, 0.0)], "passed int, refused int, error int, hostile int, ms double, cost double")
    r = evals.ask_summary(i).first()
    assert (r.questions, r.exact_rate, r.refused, r.median_ms, r.hostile_refused, r.cost_each) == (2, 50.0, 1, 3000.0, 1, 0.004)
    runs = spark.createDataFrame([("a", 10, None, [10, 11], [10, 11], []), ("b", 20, [22], [21, 23, 20], [21, 22, 20], [20]), ("c", None, None, [5], [5], []), ("d", None, None, [], [], [])], "id string, expected long, also array<long>, raw array<long>, shown array<long>, keyword array<long>")
    v = {r.id: r for r in evals.search_verdicts(runs).collect()}
    assert v["a"].hit1 and v["a"].keyword_zero and not v["b"].hit1 and v["b"].hit3 and v["b"].raw_rank == 3 and v["b"].keyword_found and not v["c"].hit1 and v["d"].hit1
    s = evals.search_summary(evals.search_verdicts(runs)).first()
    assert (s.questions, s.on_topic, s.hit1_rate, s.hit3_rate, s.rejected) == (4, 2, 0.5, 1.0, 1)


def test_agreement_and_metrics(spark):
    rows = [("Fox", 4, 4, 3), ("Fox", 4, 2, 2), ("NYT", 1, 2, 2), ("The Hill", 2, 2, 2), ("NPR", 1, None, None)]
    p = spark.createDataFrame(rows, "outlet string, expected int, a int, b int")
    r = evals.agreement(p, "a", "expected").first()
    assert (r.n, r.exact, r.within_one, r.mean_delta) == (4, 0.5, 0.75, -0.25)
    i = evals.instability(p, "a", "b").first()
    assert (i.n, i.changed, i.mean_abs_delta) == (4, 0.25, 0.25)
    f = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", None), (None, None), (None, "x")], "w string, g string")
    m = {r.label: r for r in evals.field_metrics(f, "w", "g").collect()}
    assert (m["x"].tp, m["x"].fp, m["x"].fn, m["x"].precision, m["x"].recall) == (1, 1, 1, 0.5, 0.5) and (m["y"].tp, m["y"].fp, m["y"].fn, m["y"].recall) == (0, 1, 1, 0.0)
    c = {r.w: r.asDict() for r in evals.confusion(f, "w", "g", ["x", "y", "z"]).collect()}
    assert c["x"] == {"w": "x", "x": 1, "y": 1, "z": 0} and c["z"]["x"] == 0
    b = spark.createDataFrame([("right", None), (None, -1), ("other", 1)], "l string, s int").select(evals.bucket_index(["left", "center", "right"], F.col("l"), F.col("s")).alias("i")).collect()
    assert [x.i for x in b] == [2, 1, 3]


def test_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], f"u{i % 5}") for i in range(12)], "id long, g string, url string")
    s = evals.sample_per_group(df, "g", ["id"], 2, "url").orderBy("id").collect()
    assert [(r.id, r.g) for r in s] == [(0, "a"), (1, "b"), (2, "a"), (3, "b")]
    e = evals.balanced_export(df, "g", "id", 4, ["b", "a"]).collect()
    assert [r.id for r in e] == [11, 10, 9, 8]
    q, h = evals.parse_questions({"questions": [{"id": "q", "question": "?", "reference_sql": "SELECT 1"}], "hostile": [{"question": "!"}]})
    assert q[0]["match"] == "exact" and h[0]["id"] == "hostile-1"
    for bad in ({"questions": [{"id": "q"}]}, {"questions": [{"id": "q", "question": "?", "reference_sql": "s"}] * 2}, {"questions": [{"id": "q", "question": "?", "reference_sql": "s", "match": "m"}]}):
        with pytest.raises(ValueError):
            evals.parse_questions(bad)
