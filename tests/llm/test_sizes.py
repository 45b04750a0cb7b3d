"""Problems 6 and 7: whatever the input, the result must be valid; its quality is bounded too."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressloom.llm import mixing, packing
from pressloom.llm.sizes import running, tokens


@pytest.mark.parametrize(("t", "n"), [("", 0), (None, 0), ("word", 1), ("sevenchars", 2), ("12 1234", 3), ("a-b, c.", 6), ("Ünïcödé 12€", 4), (" \n\t ", 0)])
def test_tokens(spark, t, n):
    df = spark.createDataFrame([(None, t), (77, t)], "n int, t string")
    assert sorted(r.x for r in df.select(tokens("n", "t").alias("x")).collect()) == sorted([n, 77])


def test_running(spark):
    rows = [(i, "ab"[i % 3 == 0], i % 5, i % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, o int, v long")
    got = running(df, ["g"], "o", "id", "v", "before", salts=3).collect()
    for g in "ab":
        mine = sorted(((r.o, r.before, r.v) for r in got if r.g == g), key=lambda x: x[1])
        total, last = 0, -1
        assert sorted(mine, key=lambda x: (x[1], x[2] > 0)) and len(mine) == sum(r[1] == g for r in rows)
        for o, before, v in sorted(((r.o, r.before, r.v) for r in got if r.g == g and r.v), key=lambda x: x[1]):
            assert before == total and o >= last
            total, last = total + v, o


def valid(plan: packing.Plan, hist: np.ndarray, cap: int) -> np.ndarray:
    """The fill of each container; every item has exactly one place."""
    fill = np.zeros(plan.containers, np.int64)
    slots = sorted(zip(plan.length, plan.start, plan.times, plan.base))
    for i, (length, start, times, base) in enumerate(slots):
        end = slots[i + 1][1] if i + 1 < len(slots) and slots[i + 1][0] == length else int(hist[length])
        if i == 0 or slots[i - 1][0] != length:
            assert start == 0
        for r in range(start, end):
            fill[base + (r - start) // times] += length
    assert {s[0] for s in slots} == set(np.flatnonzero(hist)) - {0}
    assert (fill <= cap).all() and (fill > 0).all() and fill.sum() == (np.arange(cap + 1) * hist).sum()
    return fill


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_any_histogram(lengths, cap):
    hist = np.bincount(np.array(lengths, np.int64), minlength=cap + 1)
    plan = packing.make_plan(hist, cap)
    valid(plan, hist, cap)


def test_plans_are_tight():
    r = np.random.default_rng(1)
    for cap, least in ((512, 0.985), (2048, 0.995)):
        x = np.minimum(cap, np.maximum(1, r.lognormal(5.1, 0.9, 20_000).astype(int)))
        hist = np.bincount(x, minlength=cap + 1)
        plan = packing.make_plan(hist, cap)
        fill = valid(plan, hist, cap)
        assert fill.sum() / (len(fill) * cap) > least
    hist = np.zeros(513, np.int64)
    hist[300], hist[212] = 500, 500
    assert packing.make_plan(hist, 512).containers == 500
    hist[:] = 0
    hist[300] = 7
    assert packing.make_plan(hist, 512).containers == 7


def test_plans_with_all_lengths():
    # 348,502 triples of lengths
    hist = np.ones(2049, np.int64)
    hist[0] = 0
    assert len(packing.enumerate_patterns(np.flatnonzero(hist), 2048)[0]) > 348_000
    plan = packing.make_plan(hist, 2048, packing.Spec(rounds=40))
    fill = valid(plan, hist, 2048)
    assert len(fill) <= -(-fill.sum() // 2048) + 1


def test_pack(spark):
    rows = [(i, (i * 37) % 90 + 1, 1) for i in range(300)] + [(1000, 250, 1), (1001, 200, 1), (1002, 0, 1), (1003, None, 1), (1004, -4, 1), (None, 5, 1)] + [(2000 + i, 33, 1) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, n long, container int")
    packs = {"s": 100, "l": 1000}
    out = packing.pack(docs, packs).collect()
    for name, cap in packs.items():
        mine = [r for r in out if r.pack_name == name]
        fill, pieces = {}, {}
        for r in mine:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
            pieces.setdefault(r.doc_id, []).append((r.piece, r.start_token, r.tokens))
        assert max(fill.values()) <= cap and sorted(fill) == list(range(len(fill)))
        assert set(pieces) == {x[0] for x in rows if x[0] is not None}
        for i, n, _ in rows:
            if i is None:
                continue
            ps, at = sorted(pieces[i]), 0
            for k, (p, s, t) in enumerate(ps):
                assert (p, s) == (k, at)
                at += t
            assert at == max(0, n or 0) and (len(ps) == 1 or n > cap)
    f = {r.pack_name: r for r in packing.fill(packing.pack(docs, packs), packs).collect()}
    assert f["l"].containers == f["l"].least_containers and f["s"].filled > 0.9 and f["s"].fullest <= 100
    assert packing.pack(docs.limit(0), packs).count() == 0 and packing.pack(docs, {}).count() == 0


SIZES = "doc_id long, source string, n long, copies int, uses int"


def test_mix(spark):
    r = np.random.default_rng(2)
    rows = [(i, "big", int(r.integers(20, 400)), 1, 1) for i in range(4000)] + [(10_000 + i, "mid", int(r.integers(20, 400)), 1, 1) for i in range(900)] + [(20_000 + i, "small", int(r.integers(20, 400)), 1, 1) for i in range(150)]
    rows += [(30_000, "other", 50, 1, 1), (30_001, None, 50, 1, 1), (30_002, "big", 0, 1, 1)]
    sizes = spark.createDataFrame(rows, SIZES)
    targets = spark.createDataFrame([("big", 0.4, 2), ("mid", 0.3, 3), ("small", 0.1, 4), ("absent", 0.2, 5)], "source string, target_share double, max_repeats int")
    m = mixing.mix(sizes, targets)
    got = {x.doc_id: x.uses for x in m.collect()}
    assert set(got) == {x[0] for x in rows}
    cap = {"big": 2, "mid": 3, "small": 4}
    assert all(0 <= got[x[0]] <= cap.get(x[1], 0) for x in rows) and got[30_002] == 0
    assert {got[x[0]] for x in rows if x[1] == "small"} == {4}
    rep = {x.source: x for x in mixing.report(m, sizes, targets).collect()}
    for s, w in (("big", 0.5), ("mid", 0.375), ("small", 0.125)):
        assert abs(rep[s].wanted_share - w) < 1e-9 and abs(rep[s].reached_share - w) < 0.004
    assert rep["absent"].docs == 0 and rep["absent"].reached_share == 0
    # more than the small source can give: it stays at its cap and the report says so
    total = sum(x[2] for x in rows) * 2
    big = {x.source: x for x in mixing.report(mixing.mix(sizes, targets, total), sizes, targets, total).collect()}
    assert big["small"].most_uses == 4 and big["small"].reached_share < 0.125
    # each document of a source is used floor(e) or ceil(e) times
    for s in cap:
        e = rep[s].copies
        assert {got[x[0]] for x in rows if x[1] == s and x[2]} <= {int(np.floor(e)), int(np.ceil(e))}


def test_mix_edges(spark):
    sizes = spark.createDataFrame([(1, "a", 5, 1, 1), (2, "a", 7, 1, 1)], SIZES)
    none = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert {r.uses for r in mixing.mix(sizes, none).collect()} == {0}
    odd = spark.createDataFrame([("a", None, 1), ("a", 0.5, None), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    assert {r.uses for r in mixing.mix(sizes, odd).collect()} == {1}
    assert mixing.mix(sizes.limit(0), odd).count() == 0
    assert mixing.report(mixing.mix(sizes.limit(0), odd), sizes.limit(0), odd).select(F.sum("reached_tokens")).first()[0] == 0


def test_mix_bars_no_size(spark):
    # "a" could give its 4000 tokens by its short documents alone; the long one still gets its e = 4/3 copies
    rows = [(i, "a", 10, 1, 1) for i in range(100)] + [(200, "a", 2000, 1, 1)] + [(300 + i, "b", 100, 1, 1) for i in range(10)]
    sizes = spark.createDataFrame(rows, SIZES)
    targets = spark.createDataFrame([("a", 0.5, 4), ("b", 0.5, 4)], "source string, target_share double, max_repeats int")
    m = mixing.mix(sizes, targets)
    got = {x.doc_id: x.uses for x in m.collect()}
    assert got[200] in (1, 2) and {got[i] for i in range(100)} == {1, 2}
    rep = {x.source: x for x in mixing.report(m, sizes, targets).collect()}
    assert abs(rep["a"].copies - 4 / 3) < 1e-9 and abs(rep["a"].share_miss - (rep["a"].reached_share - 0.5)) < 1e-9
    # the offset is the seed's, whatever the sizes: no part of the offsets is left out
    at = sorted(spark.range(64).select(mixing.offset(11, F.col("id").cast("string")).alias("u")).toPandas()["u"])
    assert at[0] < 0.2 and at[-1] > 0.8
