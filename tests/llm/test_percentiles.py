from __future__ import annotations

import math

import numpy as np
import pytest

from pressloom.llm import percentiles as pct


def true(v, q):
    v = sorted(v)
    return v[max(0, math.ceil(round(q * len(v), 6)) - 1)]


@pytest.fixture(scope="module")
def calls(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(30_000):
        g = "a" if i % 3 else "b"
        v = int(r.lognormal(6, 1.5 if g == "a" else 0.4))
        rows.append((i, g, None if i % 50 == 0 else f"m{i % 4}", None if i % 97 == 0 else v, i % 5, "x"))
    rows += rows[:500]
    rows += [(10**6 + i, "one", "m", 7, 0, None) for i in range(3)] + [(10**7, "none", "m", None, 0, None)]
    df = spark.createDataFrame(rows, "id long, g string, m string, v long, n int, sizes string")
    once = {x[0]: x for x in rows}
    return df, list(once.values())


@pytest.mark.parametrize("k", [64, 800])
def test_brackets_hold_and_errors_are_bounded(spark, calls, k):
    df, rows = calls
    spec = pct.Spec(k=k, fan=8)
    qs = (0.01, 0.5, 0.95, 1.0)
    got = {(r.g, r.m): r for r in pct.answers(pct.sketch(df, ["g", "m"], "v", spec, "id"), ["g", "m"], qs, spec).collect()}
    want = {}
    for _, g, m, v, *_ in rows:
        if v is not None:
            want.setdefault((g, m), []).append(v)
    assert set(got) == set(want)
    for key, vs in want.items():
        r, vs = got[key], sorted(vs)
        assert r.n == len(vs)
        for q in qs:
            name = f"p{100 * q:g}"
            t = true(vs, q)
            assert r[f"{name}_least"] <= t <= r[f"{name}_greatest"]
            lo, hi = np.searchsorted(vs, r[name], "left"), np.searchsorted(vs, r[name], "right")
            assert lo - 1 <= q * len(vs) + r.rank_error * len(vs) + 1 and hi + 1 >= q * len(vs) - r.rank_error * len(vs)
    assert got["one", "m"].p50 == 7 and got["one", "m"].rank_error == 0


def test_merged_days_answer_for_the_whole(spark, calls):
    df, rows = calls
    spec = pct.Spec(k=400, fan=4)
    daily = pct.sketch(df, ["g", "n"], "v", spec, "id")
    r = {x.g: x for x in pct.answers(pct.merge(daily, ["g"], spec), ["g"], (0.5, 0.95), spec).collect()}
    for g in ("a", "b"):
        vs = [v for _, gg, _, v, *_ in rows if gg == g and v is not None]
        assert r[g].n == len(vs) and r[g].p50_least <= true(vs, 0.5) <= r[g].p50_greatest and r[g].rank_error < 0.05
    parts = daily.filter("n < 2").unionByName(daily.filter("n >= 2"))
    assert {x.g: x.sk_n for x in pct.merge(parts, ["g"], spec).collect()} == {x.g: x.sk_n for x in pct.merge(daily, ["g"], spec).collect()}
    whole = pct.merge(daily, [], spec).collect()
    assert len(whole) == 1 and whole[0].sk_n == sum(1 for x in rows if x[3] is not None)


def test_the_same_on_every_run(spark, calls):
    df, _ = calls
    a, b = (sorted(tuple(map(str, r)) for r in pct.sketch(d, ["g"], "v", pct.Spec(k=50, fan=4), "id").collect()) for d in (df, df.repartition(7)))
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert a == sorted(tuple(map(str, r)) for r in pct.sketch(df, ["g"], "v", pct.Spec(k=50, fan=4), "id").collect())


@pytest.mark.parametrize("spec", [pct.Spec(fan=4), pct.Spec(k=16, fan=4)])
def test_wide_groups(spark, calls, spec):
    df, rows = calls
    want = set()
    for key in {(x[1], x[2]) for x in rows}:
        vs = [x[3] for x in rows if (x[1], x[2]) == key and x[3] is not None]
        if vs and true(vs, 0.95) >= 5 * true(vs, 0.5):
            want.add(key)
    got = {tuple(r) for r in pct.wide_groups(df, ["g", "m"], "v", "id", 0.5, 0.95, 5, spec).collect()}
    assert got == want and got


def test_limit_met_exactly_and_zero_median(spark):
    rows = [(i, "exact", 1 if i < 50 else 5) for i in range(100)] + [(1000 + i, "under", 10 if i < 50 else 49) for i in range(100)] + [(2000 + i, "zero", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    assert {r.g for r in pct.wide_groups(df, ["g"], "v", "id", 0.5, 0.95, 5).collect()} == {"exact", "zero"}


def test_exact_counts_inside_the_bracket(spark):
    df = spark.createDataFrame([(i, "a", (i * 37) % 1000) for i in range(1000)] + [(5, "a", 185)], "id long, g string, v long")
    b = spark.createDataFrame([("a", 400, 600, 1000)], "g string, least long, greatest long, n long")
    assert pct.exact(df, b.selectExpr("*", "'low' AS side", "0.5D AS q"), ["g"], "v", "id").first().exact == 499


def test_empty_and_doubles(spark):
    e = spark.createDataFrame([], "id long, g string, v long")
    assert pct.sketch(e, ["g"], "v", row_id="id").count() == 0 and pct.wide_groups(e, ["g"], "v", "id", 0.5, 0.95, 5).count() == 0
    d = spark.createDataFrame([("a", 0.5), ("a", float("nan")), ("a", None), ("a", 2.5)], "g string, v double")
    r = pct.answers(pct.sketch(d, ["g"], "v"), ["g"], (0.5,)).first()
    assert (r.n, r.p50) == (2, 0.5)
