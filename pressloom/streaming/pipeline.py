"""One pass of new articles through the pipeline, as joins over whole batches.

A batch is a set, but an article may repeat or copy an earlier one of the same batch: "earlier" is by (created, id), and chains of copies
are followed to their ends after the joins, so the result doesn't depend on how articles are cut into batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import text as text_
from pressloom.operators import dedup
from pressloom.session import settle

#: How far apart a copy and its original may lie, in seconds (fixed value).
WINDOW = 48 * 3600
#: Judges articles: takes id, title, text, candidates and returns id, score, confidence, topic, story_id (null for a new story).
Scorer = Callable[[DataFrame], DataFrame]


@dataclass
class Outcome:
    """cards: the new cards; stories: the new stories; counts: one row of how many articles went which way."""

    cards: DataFrame
    stories: DataFrame
    counts: DataFrame


def new_by_url(batch: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first article of each unknown url, all others)."""
    w = Window.partitionBy("url").orderBy("created", "id")
    b = batch.withColumn("_n", F.row_number().over(w))
    known = cards.select(F.col("original_url").alias("url")).filter("url IS NOT NULL").distinct().withColumn("_k", F.lit(True))
    b = b.join(known, "url", "left").withColumn("_new", (F.col("_n") == 1) & F.col("_k").isNull())
    return b.filter("_new").drop("_n", "_k", "_new"), b.filter("NOT _new").drop("_n", "_k", "_new")


def ends(link: DataFrame) -> DataFrame:
    """id, of: pointers followed until nothing changes, twice as far each round. link: id, of, one row per id. Rows that lead into a ring are left out."""
    cur = settle(link.select("id", "of", F.lit(True).alias("moved")), "link")
    # a way without a ring is no longer than the number of pointers
    for _ in range(cur.count().bit_length() + 1):
        nxt = cur.select(F.col("id").alias("_i"), F.col("of").alias("_o"))
        cur = settle(cur.join(nxt, F.col("of") == F.col("_i"), "left").select("id", F.coalesce("_o", "of").alias("of"), F.col("_o").isNotNull().alias("moved")), "link")
        if cur.filter("moved").isEmpty():
            break
    return cur.filter("NOT moved").select("id", "of")


def originals(batch: DataFrame, seen: DataFrame, cards: DataFrame, wires: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """id, of: for each article that copies an earlier one, the card all goes back to: the earliest by (created, id) of those that its
    matches, and theirs, lead to and that copy none themselves. batch, seen: id, created, text; cards: the known cards; wires:
    literals of bylines and the wires they name."""
    lo, hi = batch.agg(F.min("created"), F.max("created")).first()
    if lo is None:
        return batch.select("id", F.col("id").alias("of")).limit(0)
    # of what was seen before only the texts within the window of the batch can match, and only with texts of the batch
    old = seen.filter(F.col("created").between(lo - WINDOW, hi + WINDOW)).select("id", "created", "text", F.lit(False).alias("fresh"))
    both = batch.select("id", "created", "text", F.lit(True).alias("fresh")).unionByName(old)
    both = both.withColumn("wire", text_.byline(text_.plain(F.col("text")), wires))
    sh = dedup.shingled(both, "id", F.col("text"), keep=("created", "fresh", "wire"))
    found = dedup.matches(sh, window=WINDOW).select("id", "of").join(batch.select("id"), "id", "left_semi")
    known = cards.select(F.col("source_id").alias("id"), "created").dropDuplicates(["id"])
    if "syndicated_from" in cards.columns:
        link = cards.dropDuplicates(["source_id"]).select(F.col("source_id").alias("id"), F.col("syndicated_from").alias("of")).filter("id <> of")
        root = ends(link.join(known.select(F.col("id").alias("of")), "of", "left_semi")).select(F.col("id").alias("_i"), F.col("of").alias("_o"))
        found = found.join(root, F.col("of") == F.col("_i"), "left").select("id", F.coalesce("_o", "of").alias("of"))
    made = batch.select("id", "created").unionByName(known).select(F.col("id").alias("of"), "created")
    step = settle(found.distinct().join(made, "of").select("id", "of", F.struct("created", "of").alias("at")), "steps")
    # a card at the end of each chain of earliest matches, then the earliest one over all matches, until nothing changes
    first = step.groupBy("id").agg(F.min("at")["of"].alias("of"))
    cur = settle(ends(first).join(made, "of").select("id", F.struct("created", "of").alias("root")), "roots")
    while True:
        over = cur.select(F.col("id").alias("_i"), F.col("root").alias("_r"))
        best = step.join(over, F.col("of") == F.col("_i"), "left").groupBy("id").agg(F.min(F.coalesce("_r", "at")).alias("best"))
        new = settle(best.join(cur, "id").select("id", F.col("best").alias("root"), (F.col("best") != F.col("root")).alias("moved")), "roots")
        if new.filter("moved").isEmpty():
            return new.select("id", F.col("root.of").alias("of"))
        cur = new


def run_batch(batch: DataFrame, cards: DataFrame, stories: DataFrame, texts: DataFrame, scorer: Scorer, candidates: DataFrame | None = None, wires: Sequence[tuple[str, str]] = ()) -> Outcome:
    """batch: id, url, title, outlet, section, created, text; texts: source_id, text of known cards; candidates: id, story_id, similarity;
    wires: literals of bylines and the wires they name, whose copies match at lower limits.

    Copies take over the judgement of their original; the rest goes to the scorer once. An article without a matching story opens one,
    with the article's id as the story's.
    """
    fresh, dropped = new_by_url(batch, cards)
    fresh = settle(fresh, "fresh")
    seen = cards.select(F.col("source_id").alias("id"), "created").join(texts.select(F.col("source_id").alias("id"), "text"), "id")
    copies = settle(originals(fresh, seen, cards, wires), "copies")
    own = fresh.join(copies.select("id"), "id", "left_anti")
    near = candidates.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("k"), "story_id"))).alias("candidates")) if candidates is not None else None
    asked = own.join(near, "id", "left") if near is not None else own.withColumn("candidates", F.array().cast("array<struct<k:double,story_id:bigint>>"))
    judged = settle(scorer(asked.select("id", "title", "text", "candidates")), "judged")
    j = own.select("id", "url", "title", "outlet", "section", "created").join(judged, "id")
    j = j.withColumn("opens", F.col("story_id").isNull()).withColumn("story_id", F.coalesce("story_id", "id"))
    shape = lambda df: df.select(F.col("id").alias("source_id"), "title", "outlet", "section", "created", F.col("url").alias("original_url"), "syndicated_from", "story_id", "score", "confidence", "topic")
    first = shape(j.withColumn("syndicated_from", F.lit(None).cast("long")))
    pool = first.select("source_id", "story_id", "score", "confidence", "topic").unionByName(cards.select("source_id", "story_id", "score", F.col("confidence").cast(first.schema["confidence"].dataType).alias("confidence"), "topic"))
    c = fresh.select("id", "url", "title", "outlet", "section", "created").join(copies, "id").join(pool.withColumnRenamed("source_id", "of"), "of", "left").withColumnRenamed("of", "syndicated_from")
    made = first.unionByName(shape(c))
    opened = j.filter("opens").select("story_id", "title", "created", "topic")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(batch, "processed").join(n(dropped, "duplicates")).join(n(c, "syndicated")).join(n(opened, "created")).join(n(made, "cards"))  # one row each
    return Outcome(made, opened.join(stories.select("story_id"), "story_id", "left_anti"), counts)
