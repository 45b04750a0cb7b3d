"""The four analytic views over cards, stories and feeds.

Repeated rows count once per key. The role flags are 0, 1 or null, as a copied card without a story can't be told to be a reprint;
sums skip the nulls. Times are local to `zone`.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions.spectrum import FIVE, Bucket, bucket
from pressloom.session import table

ZONE = "America/New_York"
VIEWS = ("ask_sources", "ask_stories", "ask_outlets", "ask_daily")


def local_time(epoch: Column, zone: str = ZONE) -> Column:
    """Local date and time of Unix seconds, without a zone; the session's own zone plays no part."""
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=epoch.cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def _flag(c: Column) -> Column:
    return c.cast("int")


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per key: repeated rows are full copies."""
    # new names for the columns: a semi join pushed below the deduplication would otherwise bind the old ones (Spark 4.1)
    return df.dropDuplicates([key]).select(*[F.col(c).alias(c) for c in df.columns])


def sources(cards: DataFrame, buckets: Sequence[Bucket] = FIVE, zone: str = ZONE) -> DataFrame:
    c = once(cards, "source_id")
    of = c.filter("story_id IS NOT NULL").select(F.col("source_id").alias("_of"), F.col("story_id").alias("_of_story"))
    c = c.filter("status = 1").join(of, F.col("syndicated_from") == F.col("_of"), "left")
    copied = F.col("syndicated_from").isNotNull()
    reprint = copied & (F.col("_of_story") == F.col("story_id"))
    section = F.coalesce("section", F.lit("news"))
    opinion = section == "opinion"
    at = local_time(F.col("created"), zone)
    return c.select(
        "source_id", "story_id", "outlet", section.alias("section"), "score", bucket(F.col("score"), buckets).alias("bucket"), "confidence",
        F.coalesce("partial_text", F.lit(0)).alias("partial_text"), _flag(copied).alias("syndicated"), _flag(reprint).alias("is_reprint"),
        _flag(~reprint & opinion).alias("is_opinion"), _flag(~reprint & ~opinion & F.col("score").isNotNull()).alias("is_perspective"),
        "topic", at.alias("published_at"), at.cast("date").alias("day"),
    )


def per_bucket(buckets: Sequence[Bucket]) -> list[Column]:
    return [F.sum(F.when((F.col("is_perspective") == 1) & (F.col("bucket") == b.key), 1).otherwise(0)).alias(f"{b.key}_count") for b in buckets]


def stories(stories_: DataFrame, src: DataFrame, buckets: Sequence[Bucket] = FIVE, zone: str = ZONE) -> DataFrame:
    names = ["source_count", "perspective_count", "opinion_count", "reprint_count", "outlet_count", *[f"{b.key}_count" for b in buckets]]
    agg = (
        src.filter("story_id IS NOT NULL")
        .groupBy("story_id")
        .agg(F.count("*").alias("source_count"), F.sum("is_perspective").alias("perspective_count"), F.sum("is_opinion").alias("opinion_count"), F.sum("is_reprint").alias("reprint_count"), F.countDistinct(F.when(F.col("is_perspective") == 1, F.col("outlet"))).alias("outlet_count"), *per_bucket(buckets))
        .withColumnRenamed("story_id", "_id")
    )
    at = local_time(F.col("created"), zone)
    e = once(stories_, "story_id").filter("status = 1").join(agg, F.col("story_id") == F.col("_id"), "left")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return e.select(
        "story_id", "title", at.alias("published_at"), at.cast("date").alias("day"), "topic", "relevance", *[F.coalesce(n, F.lit(0)).alias(n) for n in names],
        _flag(F.coalesce("neutral_summary", F.lit("")) != "").alias("has_summary"), _flag(some("common_points") | some("disputed_points")).alias("has_consensus"),
    )


def outlets(feeds: DataFrame, buckets: Sequence[Bucket] = FIVE) -> DataFrame:
    f = once(feeds, "feed_id").filter("status = 1")
    return f.select("outlet", F.coalesce("section", F.lit("news")).alias("section"), "prior_score", bucket(F.col("prior_score"), buckets).alias("prior_bucket"), "prior_source", F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("partial_text", F.lit(0)).alias("partial_text"))


def daily(st: DataFrame, src: DataFrame, buckets: Sequence[Bucket] = FIVE) -> DataFrame:
    days = st.select("day").union(src.select("day")).distinct()
    a = st.groupBy("day").agg(F.count("*").alias("stories"))
    b = src.groupBy("day").agg(F.count("*").alias("sources"), F.sum("is_perspective").alias("perspectives"), F.sum("is_opinion").alias("opinion"), *per_bucket(buckets))
    names = ["stories", "sources", "perspectives", "opinion", *[f"{k.key}_count" for k in buckets]]
    return days.join(a, "day", "left").join(b, "day", "left").select("day", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def build(cards: DataFrame, stories_: DataFrame, feeds: DataFrame, buckets: Sequence[Bucket] = FIVE, zone: str = ZONE) -> dict[str, DataFrame]:
    """All four by name, each over the one before."""
    src = sources(cards, buckets, zone)
    st = stories(stories_, src, buckets, zone)
    return {"ask_sources": src, "ask_stories": st, "ask_outlets": outlets(feeds, buckets), "ask_daily": daily(st, src, buckets)}


class Folder(Mapping):
    """The views over the tables of a folder, each made when it is asked for and over reads of its own: frames that share columns can't
    meet in a correlated subquery."""

    def __init__(self, spark: SparkSession, d: str, buckets: Sequence[Bucket] = FIVE, zone: str = ZONE) -> None:
        self.read = lambda name: table(spark, d, name)
        self.buckets, self.zone = buckets, zone

    def __getitem__(self, name: str) -> DataFrame:
        if name == "ask_outlets":
            return outlets(self.read("feeds"), self.buckets)
        if name not in VIEWS:
            raise KeyError(name)
        src = sources(self.read("cards"), self.buckets, self.zone)
        if name == "ask_sources":
            return src
        st = stories(self.read("stories"), src, self.buckets, self.zone)
        return st if name == "ask_stories" else daily(st, src, self.buckets)

    def __iter__(self) -> Iterator[str]:
        return iter(VIEWS)

    def __len__(self) -> int:
        return len(VIEWS)


def from_dir(spark: SparkSession, d: str, **kw) -> Folder:
    return Folder(spark, d, **kw)


def create(spark: SparkSession, frames: Mapping[str, DataFrame]) -> None:
    """As temporary views of the session, in order."""
    for name in VIEWS:
        frames[name].createOrReplaceTempView(name)


def drop(spark: SparkSession) -> None:
    for name in reversed(VIEWS):
        spark.catalog.dropTempView(name)


def exist(spark: SparkSession) -> bool:
    return all(spark.catalog.tableExists(n) for n in VIEWS)


def columns(buckets: Sequence[Bucket] = FIVE) -> dict[str, list[str]]:
    """The columns of each view, which the statement gate admits."""
    counts = [f"{b.key}_count" for b in buckets]
    return {
        "ask_sources": "source_id story_id outlet section score bucket confidence partial_text syndicated is_reprint is_opinion is_perspective topic published_at day".split(),
        "ask_stories": ["story_id", "title", "published_at", "day", "topic", "relevance", "source_count", "perspective_count", "opinion_count", "reprint_count", "outlet_count", *counts, "has_summary", "has_consensus"],
        "ask_outlets": "outlet section prior_score prior_bucket prior_source active partial_text".split(),
        "ask_daily": ["day", "stories", "sources", "perspectives", "opinion", *counts],
    }
