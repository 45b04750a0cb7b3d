"""Nearest vectors, keyword search, and both together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions.text import words_of_plain


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a vector without length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, 1 - dot(a, b) / n)


def truncated(v: Column, k: int) -> Column:
    """The first k dimensions scaled to length 1; shorter vectors and zero ones stay as they are."""
    head = F.slice(v, 1, k)
    norm = F.sqrt(dot(head, head))
    return F.when(F.size(v) <= k, v).when(norm == 0, head).otherwise(F.transform(head, lambda x: (x / norm).cast("double")))


def nearest(index: DataFrame, query: Sequence[float], k: int = 100, ceiling: float | None = 0.32, owner: str | None = None) -> DataFrame:
    """The k nearest rows, those beyond the ceiling cut off, then the nearest per owner. index: id, vector[, owner]."""
    q = F.array(*[F.lit(float(x)) for x in query])
    top = index.withColumn("distance", cosine_distance(F.col("vector"), q)).filter("distance IS NOT NULL").orderBy("distance", "id").limit(k)
    if ceiling is not None:
        top = top.filter(F.col("distance") <= ceiling)
    if owner:
        w = Window.partitionBy(owner).orderBy("distance", "id")
        top = top.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return top.withColumn("similarity", F.round(1 - F.col("distance"), 4))


def nearest_join(index: DataFrame, queries: DataFrame, k: int = 10, block: int = 512, chunk: int = 4096) -> DataFrame:
    """query_id, id, distance, rank: the k nearest rows of each query, itself left out. index: id, vector; queries: id, vector.

    Exact and in blocks: queries and rows are packed into blocks, each pair of blocks is one matrix product of which only the k best per
    query go on, and these meet per query. Rows without a length are left out.
    """
    def packed(df: DataFrame, size: int, name: str) -> DataFrame:
        n = df.count()
        parts = max(1, -(-n // size))
        b = df.filter(F.col("vector").isNotNull()).select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(name), "id", F.col("vector").cast("array<double>").alias("vector"))
        return b.groupBy(name).agg(F.collect_list(F.struct("id", "vector")).alias(f"{name}_rows")), parts

    q, nq = packed(queries, block, "qb")
    r, _ = packed(index, chunk, "rb")
    pairs = r.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).join(q, "qb").select("qb_rows", "rb_rows")

    def unit(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = rows.field("id").to_numpy(zero_copy_only=False)
        vec = rows.field("vector")
        m = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        n = np.linalg.norm(m, axis=1)
        return ids[n > 0], m[n > 0] / n[n > 0, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qi, qm = unit(b.column(0)[i].values)
                ri, rm = unit(b.column(1)[i].values)
                if not len(qi) or not len(ri):
                    continue
                d = 1 - qm @ rm.T
                d[qi[:, None] == ri[None]] = np.inf
                take = min(k, len(ri))
                best = np.argpartition(d, take - 1, axis=1)[:, :take]
                dist = np.take_along_axis(d, best, 1).ravel()
                ok = np.isfinite(dist)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, take)[ok]), pa.array(ri[best.ravel()][ok]), pa.array(dist[ok])], ["query_id", "id", "distance"])

    near = pairs.mapInArrow(run, "query_id long, id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def keyword(rows: DataFrame, terms: Sequence[str], columns: Sequence[str] = ("title", "summary"), most: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Rows in which every term occurs in one of the columns; none without terms. With `most`, the first ones in the order given."""
    if not terms:
        return rows.limit(0)
    for t in terms:
        hit = None
        for c in columns:
            x = F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t.lower()))
            hit = x if hit is None else hit | x
        rows = rows.filter(hit)
    if most is None:
        return rows
    if not order:
        raise ValueError("the first rows need an order")
    return rows.orderBy(*order).limit(most)


def rows_of(index: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """All rows of the index that belong to given entities; an entity asked for twice gives its rows once."""
    return index.join(wanted.select(key).distinct(), key, "left_semi")


def search_log(found: DataFrame) -> DataFrame:
    """Per search: results, the similarity of the best one, and whether words found nothing (null without that column).
    found: query_id, distance[, keyword_hits]."""
    zero = (F.max("keyword_hits") == 0) if "keyword_hits" in found.columns else F.lit(None).cast("boolean")
    return found.groupBy("query_id").agg(F.count("*").alias("results"), F.round(1 - F.min("distance"), 4).alias("top_similarity"), zero.alias("keyword_zero"))


def recent(stories: DataFrame, now: int, seconds: int = 86400) -> DataFrame:
    """Stories of the last seconds as candidates without a similarity."""
    return stories.filter(F.col("created") > now - seconds).withColumn("similarity", F.lit(None).cast("double"))


def bm25(docs: DataFrame, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, bm25 of documents that hold a term. docs: id, text. One pass for lengths and frequencies of the terms only."""
    terms = sorted({t.lower() for t in terms})
    w = docs.select("id", F.explode(F.array(words_of_plain(F.col("text")))).alias("w"))
    tf = [F.size(F.filter("w", lambda x: x == F.lit(t))).alias(f"t{i}") for i, t in enumerate(terms)]  # noqa: B023 - used at once
    d = w.select("id", F.size("w").alias("len"), *tf)
    s = d.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(terms))])
    j = d.withColumn("_k", F.lit(1)).join(F.broadcast(s.withColumn("_k", F.lit(1))), "_k")  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        f = F.col(f"t{i}").cast("double")
        idf = F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return j.select("id", score.alias("bm25")).filter("bm25 > 0")


#: How a search may run (fixed values).
MODES = ("keyword", "vector", "hybrid")


def mode(option: str | None = None, request: str | None = None, config: str | None = None, vectors: bool = True) -> str:
    """The first that is given, hybrid without any; keyword where there are no vectors. An unknown one is an error."""
    m = next((x for x in (option, request, config) if x), "hybrid")
    if m not in MODES:
        raise ValueError(f"no such mode: {m}")
    return m if vectors else "keyword"


def hybrid(words: DataFrame, vectors: DataFrame, how: str = "hybrid", floor: float = 0.8, weight: float = 10.0) -> DataFrame:
    """id, score. words: id, bm25; vectors: id, distance. Vectors count from a similarity (1 + cosine) / 2 of `floor` on."""
    sim = vectors.select("id", ((2 - F.col("distance")) / 2).alias("sim")).filter(F.col("sim") >= floor)
    if how == "keyword":
        return words.select("id", F.col("bm25").alias("score"))
    if how == "vector":
        return sim.select("id", F.col("sim").alias("score"))
    both = words.join(sim, "id", "full_outer")
    return both.select("id", (F.coalesce("bm25", F.lit(0.0)) + weight * F.coalesce("sim", F.lit(0.0))).alias("score"))


def facets(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, ordered as numbers."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col(column).cast("double"))
