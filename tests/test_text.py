from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from pressloom.functions import text
from pressloom.operators import dedup
from pressloom.sources import feeds as feeds_


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_plain_and_words(spark):
    assert one(spark, "<p>Don’t</p><p>panic &amp; run</p>", text.plain) == "Don’t panic & run"
    assert one(spark, "<p>Don’t</p><p>panic</p>", text.word_count) == 3
    assert one(spark, "<td>a</td><td>b</td><br/>c<h2>d</h2>e <b>f</b>g", text.plain) == "ab cd e fg"
    assert one(spark, "&Eacute;t&#233; &#8364; &#x1F600; &nosuch; &#0; &#1114112; a &lt b & c", text.plain) == "Été € 😀 &nosuch; &#0; &#1114112; a &lt b & c"
    assert one(spark, "a <!-- <p>no</p> -->b <3 c < d <a href='x'", text.plain) == "a b <3 c < d"
    assert one(spark, "&amp;lt;b&amp;gt;", text.plain) == "&lt;b&gt;"
    assert one(spark, None, text.plain) == "" and one(spark, "", text.word_count) == 0
    assert one(spark, "Été 2026: ÄRZTE", text.words) == ["été", "2026", "ärzte"]


@pytest.mark.parametrize(("t", "n", "want"), [("One two three.", 5, "One two three."), ("One two. Three four five.", 4, "One two."), ("One two three, four", 3, "One two three…"), (None, 3, ""), ("One. Two three four", 3, "One. Two three…"), (" One\n two ", 2, "One\n two"), ("One two three", 0, "One two three"), ('He said "no." Then left', 4, 'He said "no."')])
def test_cap_words(spark, t, n, want):
    assert one(spark, t, lambda c: text.cap_words(c, n)) == want


def test_redaction(spark):
    terms = text.outlet_terms("The Daily (North)", "https://www.daily.example/rss", ["TDN"])
    assert one(spark, "the daily (north) and DAILY (NORTH) on daily.example, TDN, dailyx", lambda c: text.redact(c, terms)) == "[outlet] and [outlet] on [outlet], [outlet], dailyx"
    assert one(spark, "ab cd", lambda c: text.redact(c, ["ab"])) == "ab cd" and text.outlet_terms("A", "https://feeds.feedburner.com/a") == ["A", "A"]
    feeds = spark.createDataFrame([(1, "The Times+", "https://rss.times.example/a"), (2, " the times+", "https://user@x.feedburner.com:80/b"), (3, None, "https://c.example"), (4, "Ab", None)], "feed_id long, outlet string, feed_url string")
    aliases = spark.createDataFrame([("THE TIMES+", "Old Lady"), (None, "x")], "outlet string, term string")
    pat = feeds_.outlet_patterns(feeds, aliases)
    rows = spark.createDataFrame([(1, "The Times+ said. Times+ again, times.example, old lady"), (2, "Times+"), (3, "x c.example"), (4, "Ab"), (1, None), (9, "Times+")], "feed_id long, t string")
    r = rows.join(pat, "feed_id", "left").select("feed_id", text.redact_by(F.col("t"), F.col("pattern")).alias("x")).collect()
    assert sorted((x.feed_id, x.x) for x in r) == [(1, ""), (1, "[outlet] said. [outlet] again, [outlet], [outlet]"), (2, "[outlet]"), (3, "x c.example"), (4, "Ab"), (9, "Times+")]


def test_byline_terms_initials(spark):
    body = "(Wire A) " + "word " * 100 + "by wire b"
    assert one(spark, body, lambda c: text.byline(c, [("wire b", "B"), ("wire a", "A")])) == "B"
    assert one(spark, "word " * 70 + "wire a " + "word " * 70, lambda c: text.byline(c, [("wire a", "A")])) is None
    assert one(spark, "Senate passes a  bill! Bill", text.search_terms) == ["senate", "passes", "bill"]
    assert [one(spark, x, text.initials) for x in ("BBC News", "The New York Times", "Axios", None)] == ["BBC", "NY", "A", ""]
    assert one(spark, 'He said "one two three" twice', lambda c: text.long_quotation(c, 3)) and not one(spark, '"one two"', lambda c: text.long_quotation(c, 3))
    assert one(spark, "x" * 9, text.token_estimate) == 3
    assert text.render("a {x} [y] {z}", {"x": "1", "y": "2"}) == "a 1 2 {z}"


@pytest.mark.parametrize(("age", "full", "short"), [(10, "1 min", "1 min ago"), (3599, "59 min", "59 min ago"), (3600, "1 hour", "1 h ago"), (7300, "2 hours", "2 h ago"), (3 * 86400, "3 days", "3 d ago"), (15 * 86400, "2 wk", "15 d ago"), (31 * 86400, "1 month", "31 d ago"), (70 * 86400, "2 months", "70 d ago")])
def test_relative_time(spark, age, full, short):
    r = spark.range(1).select(text.relative_time(F.lit(0), F.lit(age)).alias("a"), text.relative_time(F.lit(0), F.lit(age), True).alias("b")).first()
    assert (r.a, r.b) == (full, short)


def test_copied_run(spark):
    src = "Alpha beta gamma delta epsilon zeta eta theta iota."
    rows = [(1, "x ALPHA, beta gamma delta epsilon zeta eta theta!", src), (2, "alpha beta gamma delta epsilon zeta eta", src), (3, None, src), (4, "", "")]
    got = {r.key: (r.at, r.run) for r in dedup.first_copied_run(spark.createDataFrame(rows, "key int, candidate string, source string")).collect()}
    assert got == {1: (1, "alpha beta gamma delta epsilon zeta eta theta")}
    with pytest.raises(ValueError):
        dedup.first_copied_run(spark.createDataFrame(rows, "key int, candidate string, source string"), 1)


def _doc(words, at=0, n=120):
    return " ".join(f"w{(at + i) % words}" for i in range(n))


def test_matches_by_brute_force(spark):
    import random

    r = random.Random(4)
    base = [[f"b{k}w{r.randrange(400)}" for _ in range(r.randint(80, 160))] for k in range(6)]
    docs = []
    for i in range(40):
        w = list(base[i % 6])
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"new{r.randrange(999)}"
        if i % 5 == 0:
            w = w[: max(81, len(w) * 2 // 3)]
        docs.append((i, 1000 * (i % 9), " ".join(w)))
    docs += [(90, 5, None), (91, 5, "short text"), (92, 10**7, docs[0][2])]
    df = spark.createDataFrame(docs, "id long, created long, t string")
    sh = dedup.shingled(df, "id", F.col("t")).join(df.select("id", "created"), "id")
    got = {(x.id, x.of, x.shared) for x in dedup.matches(sh).collect()}
    sets = {}
    for i, at, t in docs:
        w = (t or "").lower().split()
        if len(w) >= 80:
            sets[i] = (at, {tuple(w[j : j + 5]) for j in range(len(w) - 4)})
    want = set()
    for a, (ta, x) in sets.items():
        for b, (tb, y) in sets.items():
            o = len(x & y)
            if (tb, b) < (ta, a) and ta - tb <= 48 * 3600 and (5 * o >= 4 * len(x | y) or 20 * o >= 17 * min(len(x), len(y))):
                want.add((a, b, o))
    assert got == want and want
    first = {x.id: x.of for x in dedup.first_of(dedup.matches(sh), df).collect()}
    assert all(first[a] == min(((sets[b][0], b) for a2, b, _ in want if a2 == a))[1] for a in first)


def test_matches_of_one_wire(spark):
    import random

    r = random.Random(8)
    base = [[f"b{k}w{r.randrange(900)}" for _ in range(r.randint(100, 160))] for k in range(4)]
    docs = []
    for i in range(48):
        w = list(base[i % 4])
        cut = r.randrange(0, len(w) // 2)
        w[:cut] = [f"own{r.randrange(10**6)}" for _ in range(r.choice([cut, cut // 2]))]
        docs.append((i, 1000 * (i % 9), " ".join(w), r.choice(["A", "B", None])))
    df = spark.createDataFrame(docs, "id long, created long, t string, wire string")
    sh = dedup.shingled(df, "id", F.col("t")).join(df.select("id", "created", "wire"), "id")
    sets = {i: (at, wire, {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)}) for i, at, t, wire in docs if len(t.split()) >= 80}
    want, lower = set(), 0
    for a, (ta, wa, x) in sets.items():
        for b, (tb, wb, y) in sets.items():
            o = len(x & y)
            usual = 5 * o >= 4 * len(x | y) or 20 * o >= 17 * min(len(x), len(y))
            wired = wa is not None and wa == wb and (2 * o >= len(x | y) or 2 * o >= min(len(x), len(y)))
            if (tb, b) < (ta, a) and (usual or wired):
                want.add((a, b, o))
                lower += not usual
    assert {(m.id, m.of, m.shared) for m in dedup.matches(sh).collect()} == want and lower > 10
    assert len(want) - lower == dedup.matches(sh.drop("wire")).count()


def test_wires_of_the_queries(spark, tmp_path):
    from pressloom.plans import catalog

    own, body = _doc(10**6, 5000, 40), _doc(10**6, 0, 80)
    rows = [(1, "t", f"(Quarrel Wire) {body} {own}"), (2, "t", f"(QUARREL WIRE) {body} {_doc(10**6, 9000, 40)}"), (3, "t", f"(Longacre Wire) {body} {_doc(10**6, 7000, 40)}")]
    spark.createDataFrame(rows, "id long, title string, body_excerpt string").write.parquet(f"{tmp_path}/classify_cluster.parquet")
    spark.createDataFrame([(i, 100 * i) for i in (1, 2, 3)], "source_id long, created long").write.parquet(f"{tmp_path}/cards.parquet")
    for q in ("dedup_matches", "dedup_estimates"):
        assert [(m.id, m.of) for m in catalog.queries()[q](spark, str(tmp_path)).collect()] == [(2, 1)]


def test_redacted_keeps_items_without_feed(spark, tmp_path):
    from pressloom.plans import catalog

    spark.createDataFrame([(1, 7, "The Daily Gull says"), (2, None, "The Daily Gull says"), (3, 9, "none")], "item_id long, feed_id long, body string").write.parquet(f"{tmp_path}/ingestion_engine.parquet")
    spark.createDataFrame([(7, "Daily Gull", None), (None, "says", "")], "feed_id long, outlet string, feed_url string").write.parquet(f"{tmp_path}/feeds.parquet")
    got = {r.item_id: r.digest for r in catalog.queries()["text_redacted"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(t.encode()).hexdigest() for i, t in {1: "The [outlet] says", 2: "The Daily Gull says", 3: "none"}.items()}


def test_signature_estimates(spark):
    a, b = _doc(10**6), _doc(10**6, 20)
    df = spark.createDataFrame([(1, a), (2, b), (3, a.upper()), (4, "too few words"), (5, None)], "id long, t string")
    sig = dedup.signatures(dedup.shingled(df, "id", F.col("t")))
    s = {r.id: r for r in sig.collect()}
    assert s[4].sig == [] and s[5].sig == [] and len(s[1].sig) == 128 and s[1].sig == s[3].sig
    p = sig.alias("x").crossJoin(sig.alias("y")).select(F.col("x.id").alias("i"), F.col("y.id").alias("j"), dedup.estimate(F.col("x.sig"), F.col("y.sig")).alias("e")).collect()
    e = {(r.i, r.j): r.e for r in p}
    assert e[1, 3] == 1.0 and abs(e[1, 2] - 96 / 136) < 0.15 and e[1, 4] == 0.0
    c = spark.range(1).select(dedup.containment(F.lit(1.0), F.lit(5), F.lit(5)).alias("a"), dedup.containment(F.lit(0.5), F.lit(0), F.lit(5)).alias("b")).first()
    assert (c.a, c.b) == (1.0, 0.0)


def test_roots(spark):
    rows = [(1, 1, None), (2, 1, 1), (3, 1, 2), (4, 0, 1), (5, 1, 4), (6, 1, 99)] + [(10 + i, 1, 9 + i if i else None) for i in range(9)]
    got = {r.source_id: (r.root, r.hops) for r in dedup.roots(spark.createDataFrame(rows, "source_id long, status int, syndicated_from long")).collect()}
    assert got == {2: (1, 1), 3: (1, 2), 4: (1, 1), 11: (10, 1), 12: (10, 2), 13: (10, 3), 14: (10, 4), 15: (10, 5), 16: (11, 5), 17: (12, 5), 18: (13, 5)}
