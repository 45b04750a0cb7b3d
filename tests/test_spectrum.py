from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from pressloom.functions import scores
from pressloom.functions import spectrum as sp


def test_problems():
    assert sp.problems(sp.FIVE) == [] and sp.problems(sp.THREE) == []
    bad = sp.problems((sp.Bucket("Left", -2, -1), sp.Bucket("a", 0, -1), sp.Bucket("a", 1, 2)))
    assert any("column" in p for p in bad) and any("twice" in p for p in bad) and any("above" in p for p in bad) and any("score 0" in p for p in bad)


def test_percent_balance_divergence(spark):
    cs = list(itertools.product(range(7), repeat=3))
    df = spark.createDataFrame(cs, "a int, b int, c int")
    counts = [F.col(x) for x in "abc"]
    per = sp.percentages(counts)
    df = df.select("*", *[p.alias(f"p{i}") for i, p in enumerate(per)]).withColumn("bal", sp.balance([F.col(f"p{i}") for i in range(3)], counts)).withColumn("main", sp.primary(counts, sp.THREE))
    df = df.withColumn("div", sp.divergence(counts, sp.THREE, F.col("main"))).withColumn("lv", sp.level(F.col("div"), sp.DIVERGENCE_LEVELS))
    for r in df.collect():
        n = r.a + r.b + r.c
        p = [int(100 * x / n + 0.5) if n else 0 for x in (r.a, r.b)]
        p.append(100 - sum(p) if n else 0)
        assert [r.p0, r.p1, r.p2] == p
        if not n:
            assert r.bal is None and r["div"] is None and r.lv == "N/A"
            continue
        assert r.bal == int(100 - sum(abs(x - 100 / 3) for x in p) / 2 + 0.5)
        assert r.main == ("left" if r.a == max(r.a, r.b, r.c) else "center" if r.b == max(r.a, r.b, r.c) else "right")
        assert r["div"] == int((n - max(r.a, r.b, r.c)) * 100 / n + 0.5)


@pytest.mark.parametrize(("counts", "declared", "want"), [((1, 7, 2), "center", ("center", 30, "high")), ((4, 4, 2), None, ("left", 60, "high")), ((0, 17, 3), None, ("center", 15, "moderate")), ((1, 9, 0), None, ("center", 10, "low"))])
def test_divergence_examples(spark, counts, declared, want):
    df = spark.createDataFrame([(*counts, declared)], "a int, b int, c int, d string")
    cs = [F.col(x) for x in "abc"]
    df = df.withColumn("m", sp.primary(cs, sp.THREE, F.col("d")))
    r = df.select("m", sp.divergence(cs, sp.THREE, F.col("m")).alias("v")).withColumn("l", sp.level(F.col("v"), sp.DIVERGENCE_LEVELS)).first()
    assert tuple(r) == want


def test_scores(spark):
    df = spark.createDataFrame([(" -1 ",), ("0.0",), ("3",), ("0.5",), ("x",), (None,), ("5",), ("-3",)], "v string")
    r = df.select("v", scores.strict(F.col("v")).alias("s"), scores.clamped(F.col("v")).alias("c"), scores.confidence(F.col("v")).alias("f")).collect()
    assert [x.s for x in r] == [-1, 0, None, None, None, None, None, None]
    assert [x.c for x in r] == [-1, 0, 2, None, None, None, 2, -2]
    assert [x.f for x in r] == [0.0, 0.0, 1.0, 0.5, None, None, 1.0, 0.0]
    e = spark.createDataFrame([([" a ", "", None, "b", "c", "d"],)], "e array<string>").select(scores.evidence(F.col("e")).alias("e")).first()
    assert e.e == ["a", "b", "c"]
    lab = spark.createDataFrame([("left", None), ("Right", 0), (None, None)], "l string, s int").select(scores.from_legacy(F.col("l"), F.col("s")).alias("x")).collect()
    assert [x.x for x in lab] == [-1, 0, None]
