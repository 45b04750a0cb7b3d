"""Near-duplicate records by a grouped prefix join (problem 1).

Similarity is the Jaccard coefficient of the distinct k-word sequences (shingles) of two records. The join is exact:

1. Records with the same text are one class; only its first record goes on, all members are kept beside it.
2. Shingles are ordered by the number of classes that hold them, rare ones first. For threshold t two records of size n can only
   be similar if they share `Spec.shared` of their first n - ceil(t*n) + shared shingles (the prefix), or all that must be common where
   that is less. Shingles of a single class can't match and are only counted.
3. Classes with the same size and the same prefix form one group. Groups, not records, are joined on prefix shingles, under the
   length and position filters, and what they share is counted; the surviving group pairs are expanded to their members.
4. Each pair of classes is verified on the full shingle sets in whole numbers.

Shingles are compared by their 64-bit hashes: among 10^9 different shingles two collide with a probability of about 3 %, and a
collision changes an overlap by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm import flat
from pressloom.session import settle


@dataclass(frozen=True)
class Spec:
    """k: words in a shingle; least: the similarity from which a pair counts; min_words: shorter records are left out; shared: shingles
    that two prefixes must share (changes the work, not the result)."""

    k: int = 5
    least: Fraction = Fraction(4, 5)
    min_words: int = 25
    shared: int = 4


def _text(*cols: str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols])


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.hash(F.reverse(text)).alias("h2"), F.length(text).alias("h3")]


def _shingled(classes: DataFrame, spec: Spec) -> DataFrame:
    """rep, n, sh: the distinct shingle hashes of each class long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, part in flat.text_pieces(b.column(1).fill_null("")):
                of, g = flat.shingle_sets(part.to_pylist(), spec.k, max(spec.min_words, spec.k))
                n = np.bincount(of, minlength=z - a)
                some = np.flatnonzero(n)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[some])].astype(np.int32)), pa.array(g))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a).take(pa.array(some)), pa.array(n[some].astype(np.int32)), lists], ["rep", "n", "sh"])

    return classes.select("rep", "text").mapInArrow(run, "rep long, n int, sh array<long>")


def classes_of(df: DataFrame, id_col: str, text_cols: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(classes: rep, text; members: id, rep). Repeated rows of an id count once; a null text is empty, a null id is left out.

    Should an id come with several texts, each counts, and the id belongs to all their classes.
    """
    src = df.select(F.col(id_col).cast("long").alias("id"), _text(*text_cols).alias("text")).filter(F.col("id").isNotNull())
    keyed = src.select("id", *_key(F.col("text")))
    ids = keyed.distinct()
    reps = ids.groupBy("h1", "h2", "h3").agg(F.min("id").alias("rep"))
    members = ids.join(reps, ["h1", "h2", "h3"]).select("id", "rep")
    classes = src.select(*_key(F.col("text")), "id", "text").groupBy("h1", "h2", "h3").agg(F.min(F.struct("id", "text")).alias("m")).select(F.col("m.id").alias("rep"), F.col("m.text").alias("text"))
    return classes, members


def class_links(classes: DataFrame, spec: Spec) -> DataFrame:
    """(a, b, overlap, union) for each pair of classes with a < b and overlap / union >= spec.least."""
    num, den = spec.least.numerator, spec.least.denominator
    each = _shingled(classes, spec).select("rep", "n", F.explode("sh").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    sets = (
        each.join(often, "s")
        .groupBy("rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("x"))
        .select("rep", "n", (F.col("n") - F.size("x")).alias("n1"), F.col("x.s").alias("toks"))
        # the prefix has n - ceil(num*n/den) + shared shingles, of which the n1 that nobody else holds come first
        .withColumn("k", F.expr(f"CAST(least(n, n - (({num}L * n + {den - 1}) div {den}) + {spec.shared}) - n1 AS INT)"))
        .filter("k > 0")
        .withColumn("prefix", F.slice("toks", 1, F.col("k")))
        .withColumn("g1", F.xxhash64("prefix"))
        .withColumn("g2", F.hash("prefix"))
    )
    sets = settle(sets, "sets")
    key = ["n", "n1", "g1", "g2"]
    groups = sets.groupBy(*key).agg(F.min("rep").alias("gid"))
    grouped = settle(sets.select("rep", *key).join(groups, key).select("gid", "rep"), "groups")
    index = (
        sets.join(grouped.filter("gid = rep").select("rep"), "rep")
        .select(F.col("rep").alias("gid"), "n", "n1", F.posexplode("prefix").alias("p", "tok"))
        .select("tok", "gid", "n", (F.col("n1") + F.col("p")).alias("pos"))
    )
    a, b = index.alias("a"), index.alias("b")
    # of two sizes the smaller must reach t times the larger; with what was shared before, at most shared - 1 of those that are
    # counted, what can still be shared from here on must reach the needed overlap
    need = f"{num + den}L * ({spec.shared - 1} + least(a.n - a.pos, b.n - b.pos)) >= {num}L * (a.n + b.n)"
    size = f"{den}L * least(a.n, b.n) >= {num}L * greatest(a.n, b.n)"
    first = F.expr(f"a.tok = b.tok AND a.gid < b.gid AND {size} AND {need}")
    met = a.join(b, first).select(F.col("a.gid").alias("ga"), F.col("b.gid").alias("gb"), F.greatest("a.n", "b.n").alias("big"))
    # the larger of two similar sets holds at least t times its size in common
    enough = F.expr(f"least({spec.shared}L, ({num}L * big + {den - 1}) div {den})")
    pairs = met.groupBy("ga", "gb", "big").agg(F.count("*").alias("c")).filter(F.col("c") >= enough).select("ga", "gb")
    m1, m2 = grouped.select(F.col("gid").alias("ga"), F.col("rep").alias("x")), grouped.select(F.col("gid").alias("gb"), F.col("rep").alias("y"))
    across = pairs.join(m1, "ga").join(m2, "gb").select("x", "y")
    within = m1.join(m2.withColumnRenamed("gb", "ga"), "ga").filter("x < y").select("x", "y")
    cand = across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("toks").alias(f"t_{c}"))
    seen = cand.join(side("a"), "a").join(side("b"), "b")
    seen = seen.select("a", "b", F.size(F.array_intersect("t_a", "t_b")).alias("overlap"), (F.col("n_a") + F.col("n_b")).alias("both"))
    return seen.filter(F.expr(f"{num + den}L * overlap >= {num}L * both")).select("a", "b", "overlap", (F.col("both") - F.col("overlap")).alias("union"))


def pairs_of(df: DataFrame, id_col: str, text_cols: tuple[str, ...], spec: Spec) -> DataFrame:
    """id_a < id_b for every similar pair of records, copies included. Empty input gives no rows."""
    classes, members = classes_of(df, id_col, text_cols)
    members, classes = settle(members, "members"), settle(classes, "classes")
    links = class_links(classes, spec).select("a", "b")
    ma, mb = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.join(ma, "a").join(mb, "b").select("x", "y")
    several = members.groupBy("rep").count().filter("count > 1").select("rep")
    long_enough = _shingled(classes.join(several, "rep", "left_semi"), spec).select("rep")
    mine = members.join(long_enough, "rep", "left_semi")
    within = mine.select("rep", F.col("id").alias("x")).join(mine.select("rep", F.col("id").alias("y")), "rep").filter("x < y").select("x", "y")
    both = across.unionByName(within).filter("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the least vertex c of the connected part each vertex of edges (a, b) lies in.

    Alternates the large-star and small-star steps until nothing changes; every round is written to the shared folder.
    """
    cur = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    sign = None
    while True:
        sym = cur.union(cur.select("v", "u"))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        cur = settle(small, "edges")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            return cur.select(F.col("u").alias("v"), F.col("v").alias("c")).union(cur.select("v", F.col("v").alias("c"))).distinct()
        sign = now


def groups_of(df: DataFrame, id_col: str, text_cols: tuple[str, ...], spec: Spec) -> DataFrame:
    """One row per record: id, class_id (first record with the same text), group_id (first record of the connected group),
    links (similar classes of its class) and copies (records with the same text, itself included)."""
    classes, members = classes_of(df, id_col, text_cols)
    members, classes = settle(members, "members"), settle(classes, "classes")
    links = settle(class_links(classes, spec).select("a", "b"), "links")
    degree = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("links"))
    comp = components(links)
    size = members.groupBy("rep").agg(F.count("*").alias("copies"))
    info = size.join(degree, "rep", "left").join(comp.select(F.col("v").alias("rep"), "c"), "rep", "left")
    out = members.join(info, "rep")
    return out.select(F.col("id"), F.col("rep").alias("class_id"), F.coalesce("c", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), "copies")
