"""Reprints: signatures, similarity, candidate search and the root of a chain of copies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions.text import shingles, words
from pressloom.session import settle

#: Hash functions of a signature, and the prime they work in (fixed values).
HASHES, PRIME = 128, (1 << 31) - 1
LEAST_WORDS = 80
#: Shingles that the rare end of one set must share with the other set before both are compared; the result doesn't depend on it.
COMMON = 4
#: Windows in a span of time, by which texts are parted; a text meets the next span too where its window reaches there.
SPAN = 8


def coefficients(n: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """a and b of (a x + b) mod PRIME for each function, by rule."""
    k = np.arange(1, n + 1, dtype=np.int64)
    return (k * 1103515245 + 12345) % PRIME, (k * 69069 + 1) % PRIME


def hash32(shingle: Column) -> Column:
    """The first 32 bits of md5 as a number."""
    return F.conv(F.substring(F.md5(shingle), 1, 8), 16, 10).cast("long")


def shingled(df: DataFrame, id_col: str, text: Column, k: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """id, the columns of keep, words (their number), sh (distinct shingles)."""
    # the one-row explode keeps the word list a column, so it isn't split again for every shingle
    w = df.select(F.col(id_col).alias("id"), *keep, F.explode(F.array(words(text))).alias("w"))
    return w.select("id", *keep, F.size("w").alias("words"), shingles(F.col("w"), k).alias("sh"))


def signatures(sh: DataFrame, n: int = HASHES) -> DataFrame:
    """id, size, sig: the least value of each hash function over the shingles; empty without shingles. sh: id, sh."""
    x = sh.select("id", F.transform("sh", hash32).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(n)
        for t in batches:
            size = t.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            v = t.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            some = np.flatnonzero(size)
            start = (np.cumsum(size) - size)[some]
            sig = np.zeros((len(some), n), np.int64)
            if len(some):
                for j in range(n):
                    sig[:, j] = np.minimum.reduceat(((v * np.uint64(a[j]) + np.uint64(b[j])) % np.uint64(PRIME)).astype(np.int64), start)
            off = np.r_[0, np.cumsum(np.where(size > 0, n, 0))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(off), pa.array(sig.ravel()))], ["id", "size", "sig"])

    kind = sh.schema["id"].dataType.simpleString()
    return x.mapInArrow(run, f"id {kind}, size int, sig array<bigint>")


def estimate(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures; 0 where one is empty."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), same / F.size(a)).otherwise(0.0)


def containment(jaccard: Column, size_a: Column, size_b: Column) -> Column:
    """Share of the smaller set that lies in the other, from the Jaccard coefficient and the sizes; at most 1, and 0 for empty sets."""
    small = F.least(size_a, size_b)
    return F.when(small > 0, F.least(F.lit(1.0), jaccard * (size_a + size_b) / (1 + jaccard) / small)).otherwise(0.0)


def matches(docs: DataFrame, least_jaccard: tuple[int, int] = (4, 5), least_containment: tuple[int, int] = (17, 20), window: int = 48 * 3600, least_words: int = LEAST_WORDS, least_wired: tuple[int, int] = (1, 2)) -> DataFrame:
    """(id, of, shared, size, size_of): `of` came before `id` (by created, id) within the window and the two are similar enough, either
    by Jaccard or by the share of the smaller one. docs: id, created, words, sh, and wire where known (null for none): for two texts of the
    same wire both limits are `least_wired`. With a column `fresh`, pairs of which neither is fresh are left out.

    Exact, by prefixes: two sets of which the smaller, of n shingles, has a share c in the other must share `COMMON` of its
    n - ceil(c n) + COMMON rarest shingles (or all that must be common, where that is less). So the rare ends of all sets are met with all
    shingles of the sets of neighbouring time windows, what each pair shares is counted, and pairs that share enough are counted out. c is
    the smaller of both limits, as a Jaccard coefficient of j puts at least a share j of the smaller set into the other. The ends of texts
    with a wire are longer, and what is beyond the usual end meets texts of that wire only.
    """
    cn, cd = min(least_jaccard, least_containment, key=lambda f: f[0] / f[1])
    wn, wd = min((cn, cd), least_wired, key=lambda f: f[0] / f[1])
    wire = F.col("wire") if "wire" in docs.columns else F.lit(None).cast("string")
    fresh = F.col("fresh") if "fresh" in docs.columns else F.lit(True)
    d = docs.filter((F.col("words") >= least_words) & (F.size("sh") > 0)).select("id", "created", wire.alias("wire"), fresh.alias("fresh"), F.size("sh").alias("n"), F.explode(F.transform("sh", lambda s: F.xxhash64(s))).alias("s"))
    df = d.groupBy("s").agg(F.count("*").alias("f")).filter("f > 1")
    lists = d.join(df, "s").groupBy("id", "created", "wire", "fresh", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("x"))
    lists = settle(lists.select("id", "created", "wire", "fresh", "n", F.col("x.s").alias("toks")), "postings")
    must = lambda n, d: F.floor((n * F.col("n") + d - 1) / d)
    keep = lambda n, d: (F.least(F.col("n"), F.col("n") - must(n, d) + COMMON) - (F.col("n") - F.size("toks"))).cast("int")
    k, wide = keep(cn, cd), keep(wn, wd)
    length = SPAN * max(1, window)
    span = lambda at: F.floor(at / length)
    rare = lists.withColumn("k", k).withColumn("wide", F.when(F.col("wire").isNotNull(), wide).otherwise(k)).filter("wide > 0")
    rare = rare.select("id", "created", "wire", "fresh", "n", "k", F.posexplode(F.slice("toks", 1, F.col("wide"))).alias("at", "s"))
    # texts no further apart than the window lie in the same span of time or in neighbouring ones, which few texts reach
    rare = rare.withColumn("span", F.explode(F.array_distinct(F.array(span(F.col("created") - window), span(F.col("created") + window)))))
    full = lists.select(F.col("id").alias("o"), F.col("created").alias("ot"), F.col("wire").alias("ow"), F.col("fresh").alias("ofresh"), F.col("n").alias("on"), span(F.col("created")).alias("span"), F.explode("toks").alias("s"))
    near = rare.join(full, ["s", "span"]).filter((F.col("id") != F.col("o")) & (F.col("fresh") | F.col("ofresh")) & (F.abs(F.col("created") - F.col("ot")) <= window) & (F.col("n") <= F.col("on")) & ((F.col("at") < F.col("k")) | (F.col("wire") == F.col("ow"))))
    met = near.groupBy(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).agg(F.count("*").alias("met"), F.min(F.least(F.lit(COMMON), must(wn, wd))).alias("enough"))
    pair = met.filter("met >= enough").select("a", "b")
    side = lambda c: lists.select(F.col("id").alias(c), F.col("created").alias(f"{c}t"), F.col("wire").alias(f"{c}w"), F.col("n").alias(f"{c}n"), F.col("toks").alias(f"{c}x"))
    p = pair.join(side("a"), "a").join(side("b"), "b")
    p = p.withColumn("shared", F.size(F.array_intersect("ax", "bx")))
    reach = lambda j, c: (j[1] * F.col("shared") >= j[0] * (F.col("an") + F.col("bn") - F.col("shared"))) | (c[1] * F.col("shared") >= c[0] * F.least("an", "bn"))
    alike = reach(least_jaccard, least_containment) | (F.col("aw") == F.col("bw")) & reach(least_wired, least_wired)
    later = F.struct("at", "a") > F.struct("bt", "b")
    p = p.filter(alike).withColumn("later", later)
    pick = lambda x, y: F.when(F.col("later"), F.col(x)).otherwise(F.col(y))
    return p.select(pick("a", "b").alias("id"), pick("b", "a").alias("of"), "shared", pick("an", "bn").alias("size"), pick("bn", "an").alias("size_of"))


def roots(cards: DataFrame, hops: int = 5) -> DataFrame:
    """source_id, root, hops: the card a copy goes back to over at most `hops` steps of syndicated_from, where each step must lead to a
    published card. Cards without an original are left out."""
    base = cards.dropDuplicates(["source_id"])
    link = base.filter("status = 1").select(F.col("source_id").alias("_id"), F.col("syndicated_from").alias("_next"))
    cur = base.filter("syndicated_from IS NOT NULL").select("source_id", F.col("syndicated_from").alias("next"), F.lit(None).cast("long").alias("root"), F.lit(0).alias("hops"))
    for _ in range(hops):
        j = cur.join(link, F.col("next") == F.col("_id"), "left")
        cur = j.select("source_id", F.col("_next").alias("next"), F.coalesce("_id", "root").alias("root"), (F.col("hops") + F.col("_id").isNotNull().cast("int")).alias("hops"))
    return cur.filter("root IS NOT NULL").select("source_id", "root", "hops")


def first_of(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Per record the earliest match by (created, id). found: id, of; docs: id, created."""
    d = docs.select(F.col("id").alias("of"), "created")
    return found.join(d, "of").groupBy("id").agg(F.min(F.struct("created", "of")).alias("m")).select("id", F.col("m.of").alias("of"))


def reprint_cards(new: DataFrame, originals: DataFrame) -> DataFrame:
    """A copy's row: its own id, outlet, title, section and url, all judgement from the original. new: with syndicated_from."""
    taken = ["story_id", "score", "confidence", "partial_text", "topic", "micro_summary"]
    o = originals.select(F.col("source_id").alias("_o"), *[F.col(c).alias(f"_{c}") for c in taken])
    j = new.join(o, F.col("syndicated_from") == F.col("_o"))
    return j.select("source_id", "title", "outlet", "section", "original_url", "syndicated_from", *[F.col(f"_{c}").alias(c) for c in taken])


def wires_of(cards: DataFrame, wanted: DataFrame, key: str, wire: str) -> DataFrame:
    """key and wire of the wanted cards that name one."""
    return cards.filter(F.trim(F.coalesce(F.col(wire), F.lit(""))) != "").join(wanted.select(key).distinct(), key, "left_semi").select(key, wire)


def first_copied_run(pairs: DataFrame, n: int = 8) -> DataFrame:
    """key, at, run: the first run of n words of a candidate that a source of the same key holds too. pairs: key, candidate, source."""
    def grams(col: str) -> DataFrame:
        w = pairs.select("key", F.explode(F.array(words(F.col(col)))).alias("w")).filter(F.size("w") >= n).distinct()
        at = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        return w.select("key", F.posexplode(F.transform(at, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("at", "run"))

    if n < 2:
        raise ValueError("a run has two words or more")
    hit = grams("candidate").join(grams("source").select("key", "run").distinct(), ["key", "run"], "left_semi")
    return hit.groupBy("key").agg(F.min(F.struct("at", "run")).alias("m")).select("key", "m.at", "m.run")
