"""Problems 1 and 2 against brute force, with nulls, repeats, ties, empty tables and clashing names."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from pressloom.llm import near_duplicates as nd
from pressloom.llm import shared_spans as ss

SCHEMA = "id long, title string, body_excerpt string, rep long, n int, text string, key long"


def corpus(seed: int, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(r.randint(24, 90))] for _ in range(8)]
    passage = [r.choice(words) for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(base[i % 8]) if i % 3 else [r.choice(words) for _ in range(60)]
        for _ in range(r.choice([0, 0, 1, 2, 5, 12])):
            w[r.randrange(len(w))] = r.choice(words)
        if i % 7 == 0:
            k = r.randrange(len(w))
            w[k:k] = passage[r.randrange(10) : 25 + r.randrange(15)]
        if i % 11 == 0:
            w = w[5:] + w[:5]
        rows.append((i, " ".join(w[:5]), r.choice([" ", "\n", "  "]).join(w[5:]), 1, 2, "x", 3))
    rows += [(i + 1000, rows[i][1], rows[i][2], 0, 0, None, None) for i in range(0, n, 4)]  # copies under another id
    rows += rows[:9]  # repeated rows
    rows += [(5000, None, None, 1, 1, None, 1), (5001, "", "", 1, 1, None, 1), (5002, "short", "text", 1, 1, None, 1), (5003, None, " ".join(["tick"] * 200), 1, 1, "", 1), (5004, None, " ".join(["tick"] * 210), 1, 1, "", 1), (None, "a", "b " * 60, 1, 1, None, 1)]
    r.shuffle(rows)
    return rows


def want_pairs(rows, least: Fraction, k: int = 5, min_words: int = 25) -> set:
    sets = {}
    for i, t, b, *_ in rows:
        w = re.findall(r"[^\W_]+", f"{t or ''} {b or ''}".lower())
        if i is not None and len(w) >= min_words:
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("seed", "least"), [(1, Fraction(1, 2)), (2, Fraction(4, 5)), (3, Fraction(3, 10))])
def test_pairs(spark, seed, least):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in nd.pairs_of(df, "id", ("title", "body_excerpt"), nd.Spec(least=least)).collect()}
    assert got == want_pairs(rows, least) and got


def test_groups(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, SCHEMA)
    spec = nd.Spec(least=Fraction(1, 2))
    out = {r.id: r for r in nd.groups_of(df, "id", ("title", "body_excerpt"), spec).collect()}
    ids = {r[0] for r in rows if r[0] is not None}
    assert set(out) == ids
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    same_text = defaultdict(list)
    for i, t, b, *_ in rows:
        if i is not None:
            same_text[f"{t or ''} {b or ''}"].append(i)
    for a, b in want_pairs(rows, Fraction(1, 2)) | {(v[0], x) for v in same_text.values() for x in v}:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {i: out[i].group_id for i in ids} == {i: find(i) for i in ids}
    assert all(out[i].class_id == min(v) and out[i].copies == len(set(v)) for v in same_text.values() for i in v)
    # links join classes: no pair of different texts is lost
    pairs = {(out[a].class_id, out[b].class_id) for a, b in want_pairs(rows, Fraction(1, 2))}
    links = defaultdict(set)
    for a, b in pairs:
        if a != b:
            links[a].add(b), links[b].add(a)
    assert {i: out[i].links for i in ids} == {i: len(links[out[i].class_id]) for i in ids}


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nd.pairs_of(df, "id", ("title", "body_excerpt"), nd.Spec()).count() == 0
    assert nd.groups_of(df, "id", ("title", "body_excerpt"), nd.Spec()).count() == 0
    assert ss.spans_of(df, "id", "body_excerpt").count() == 0
    assert ss.shares_of(df, "id", "body_excerpt").count() == 0


def test_long_chain_is_one_group(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (501, 502), (502, 500)], "a long, b long")
    got = {r.v: r.c for r in nd.components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 501: 500, 502: 500}


def want_spans(rows, run: int) -> set:
    docs = {i: [x for x in re.split(r"[ \n]+", b or "") if x] for i, _, b, *_ in rows if i is not None}
    held = defaultdict(set)
    for i, w in docs.items():
        for j in range(len(w) - run + 1):
            held[tuple(w[j : j + run])].add(i)
    out = set()
    for i, w in docs.items():
        hit = [False] * (len(w) + 1)
        for j in range(len(w) - run + 1):
            if len(held[tuple(w[j : j + run])]) > 1:
                hit[j : j + run] = [True] * run
        s = None
        for k, x in enumerate(hit):
            if x and s is None:
                s = k
            if not x and s is not None:
                out.add((i, s, k))
                s = None
    return out


@pytest.mark.parametrize("spec", [ss.Spec(), ss.Spec(shard_words=200), ss.Spec(hot=0), ss.Spec(run=12, gram=5, hot=1, longest=3)])
def test_spans(spark, spec):
    rows = corpus(7)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in ss.spans_of(df, "id", "body_excerpt", spec).collect()}
    assert got == want_spans(rows, spec.run) and got


def test_shares(spark):
    rows = corpus(8)
    got = {r.id: r for r in ss.shares_of(spark.createDataFrame(rows, SCHEMA), "id", "body_excerpt").collect()}
    spans = want_spans(rows, 20)
    for i, _, b, *_ in rows:
        if i is None:
            continue
        n = len((b or "").split())
        shared = sum(e - s for k, s, e in spans if k == i)
        assert (got[i].words, got[i].shared_words) == (n, shared)
        assert got[i].shared_share == (shared / n if n else 0.0)


def test_index_counts_every_pattern():
    r = np.random.default_rng(3)
    text = np.concatenate([np.r_[r.integers(1, 6, 40), 0] for _ in range(5)]).astype(np.int64)
    own = np.repeat([0, 1, 2, 1, 0], 41)
    fm = ss.FMIndex(text, own, 8)
    s = text.tolist()
    for _ in range(200):
        k = int(r.integers(1, 7))
        p = [int(x) for x in r.integers(1, 6, k)]
        a, b = np.array([fm.count[p[-1]]]), np.array([fm.count[p[-1] + 1]])
        for c in p[-2::-1]:
            a, b = fm.extend(np.array([c]), a, b)
        assert max(0, int(b[0] - a[0])) == sum(s[i : i + k] == p for i in range(len(s)))
        assert bool(fm.several(a, b)[0]) == (len({int(own[i]) for i in range(len(s)) if s[i : i + k] == p}) > 1)


def test_matching_statistics():
    r = np.random.default_rng(5)
    units = [r.integers(1, 4, int(r.integers(6, 15))) for _ in range(12)]
    lo, hi = np.arange(12), np.arange(12)
    hi[3], hi[7] = 40, 5
    lo[7] = 5
    words, size = np.concatenate(units), np.array([len(u) for u in units])
    got = set(zip(*(v.tolist() for v in ss.shared_stretches(words, size, lo, hi, 4))))
    held = defaultdict(set)
    for u, w in enumerate(units):
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                held[tuple(w[i:j])] |= {lo[u], hi[u]}
    want = set()
    for u, w in enumerate(units):
        best = [max((n for n in range(e + 1) if len(held[tuple(w[e - n : e])]) > 1 or n == 0), default=0) for e in range(1, len(w) + 1)]
        for e, n in enumerate(best, 1):
            if n >= 4 and not (e < len(w) and best[e] == n + 1):
                want.add((u, e - n, e))
    assert got == want and got
