"""Flows over streams. Each has a batch twin that gives the same rows, which the tests compare."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pressloom.session import exists, mine, scratch, shared_dir


def read_files(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and reads what it wrote, from the shared folder. In mode complete, the last state."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/pressloom-flow-{uuid.uuid4().hex[:12]}"
    out, schema = f"{base}/out", stream.schema
    if mode == "append":
        w = stream.writeStream.format("parquet").option("path", out).outputMode(mode)
    else:
        w = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).outputMode(mode)
    q = w.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    mine(spark, base)
    return spark.read.schema(schema).parquet(out) if exists(spark, out) else spark.createDataFrame([], schema)


def run_updates(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs an aggregation in update mode: every batch appends the rows it changed, and the latest of each key is read."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/pressloom-flow-{uuid.uuid4().hex[:12]}"
    out, schema = f"{base}/out", stream.schema
    step = lambda df, n: df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/n={n}")
    stream.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    mine(spark, base)
    if not exists(spark, out):
        return spark.createDataFrame([], schema)
    got = spark.read.parquet(f"{out}/n=*")
    rest = [c for c in schema.names if c not in keys]
    return got.groupBy(*keys).agg(F.max(F.struct("_batch", *rest)).alias("x")).select(*keys, *[F.col("x")[c].alias(c) for c in rest]).select(*schema.names)


def view_counter(events: DataFrame, kind: str = "view", late: str = "2 days") -> DataFrame:
    """Views per owner and UTC day, an upsert counter as a keyed aggregation; a day's counts leave the state once the watermark has
    passed it. events: user_id, ts, event_type."""
    e = events.filter(F.col("event_type") == kind).withWatermark("ts", late)
    n = e.groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("views"))
    return n.select("user_id", F.date_format("window.start", "yyyyMMdd").cast("int").alias("day"), "views")


def windowed_views(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """The same in tumbling windows that close once the watermark has passed."""
    e = events.withWatermark("ts", late)
    return e.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def first_by_url(articles: DataFrame, within: str = "30 days") -> DataFrame:
    """Articles whose address wasn't met within the time. articles: link, fetched_at."""
    return articles.withWatermark("fetched_at", within).dropDuplicatesWithinWatermark(["link"])


def lookback_pairs(new: DataFrame, seen: DataFrame, hours: int = 48) -> DataFrame:
    """Stream-stream join of records that share a key within the hours before. Both: key, id, at."""
    a = new.withWatermark("at", f"{hours} hours").alias("a")
    b = seen.withWatermark("at", f"{hours} hours").alias("b")
    on = F.expr(f"a.key = b.key AND b.id < a.id AND b.at <= a.at AND b.at >= a.at - INTERVAL {hours} HOURS")
    return a.join(b, on).select(F.col("a.id").alias("id"), F.col("b.id").alias("of"))


def flood(events: DataFrame, most: int, seconds: int, late: int = 3600) -> DataFrame:
    """events (who, at in seconds) with `allowed`: not beyond `most` allowed ones within the last `seconds` of the same one.

    Custom state: the times of the allowed events that still count, at most `most`. It is forgotten once the watermark, `late` seconds
    behind the latest event, has passed the last of them. Events later than that are dropped.
    """
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = deque(state.get[0] if state.exists else ())
        for p in parts:
            p = p.sort_values(["at"], kind="stable")
            ok = []
            for t in p["at"].tolist():
                while times and times[0] <= t - seconds:
                    times.popleft()
                ok.append(len(times) < most)
                if ok[-1]:
                    times.append(t)
            yield pd.DataFrame({"who": p["who"], "at": p["at"], "allowed": ok})
        state.update((list(times),))
        last = (times[-1] + 1 + seconds + 1) * 1000 if times else 0
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))

    # a second later: the watermark begins at 0, and what isn't beyond it is late
    timed = events.withColumn("_ts", F.timestamp_seconds(F.col("at") + 1)).withWatermark("_ts", f"{late} seconds")
    return timed.groupBy("who").applyInPandasWithState(step, "who string, at long, allowed boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def flood_batch(events: DataFrame, most: int, unit: str) -> DataFrame:
    """events (who, ts, event_id) with `allowed`: the first `most` of each one in every calendar hour (or other unit)."""
    w = Window.partitionBy("who", F.date_trunc(unit, F.col("ts"))).orderBy("ts", "event_id")
    return events.withColumn("allowed", F.row_number().over(w) <= most)


def queue(items: DataFrame, most: int = 5, newest: bool = False) -> DataFrame:
    """The next items with their place: by id, or the newest first."""
    order = (F.desc("fetched_at"), F.col("item_id")) if newest else (F.col("item_id"),)
    some = items.orderBy(*order).limit(most)
    return some.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def synthesis_due(stories: DataFrame, cards: DataFrame) -> DataFrame:
    """Stories to be written up: those that were before, and those on which two outlets or more have perspectives."""
    own = cards.filter("story_id IS NOT NULL AND syndicated_from IS NULL AND coalesce(section, 'news') <> 'opinion' AND score IS NOT NULL")
    n = own.groupBy("story_id").agg(F.countDistinct("outlet").alias("_outlets"))
    return stories.join(n, "story_id", "left").filter((F.coalesce(F.size("common_points"), F.lit(0)) > 0) | (F.col("_outlets") >= 2)).drop("_outlets")


def second_review(cards: DataFrame, again: DataFrame, key: str, value: str) -> DataFrame:
    """How many cards were judged again, and how many judgements were confirmed or corrected."""
    j = cards.select(key, value).join(again.select(key, F.col(value).alias("_now")), key)
    same = F.col(value).eqNullSafe(F.col("_now")).cast("int")
    return j.agg(F.count("*").alias("reviewed"), F.coalesce(F.sum(same), F.lit(0)).alias("confirmed"), F.coalesce(F.sum(1 - same), F.lit(0)).alias("corrected"))


def harvest(items: DataFrame, known: DataFrame, most: int = 8) -> DataFrame:
    """Per feed at most `most` new items, latest first, without empty or known addresses; one item per address.

    items: feed_id, link, item_id, fetched_at; known: link.
    """
    i = items.filter("trim(coalesce(link, '')) <> ''").join(known.select("link").distinct(), "link", "left_anti")
    one = Window.partitionBy("link").orderBy("fetched_at", "item_id")
    i = i.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    w = Window.partitionBy("feed_id").orderBy(F.desc("fetched_at"), "item_id")
    return i.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("_n")


def micro_batches(stream: DataFrame, steps: Callable[[DataFrame, int], None], state: str) -> None:
    """Runs the steps on each micro-batch of what is there; `state` keeps the place between runs. What a step settles goes with it."""
    def step(df: DataFrame, n: int) -> None:
        with scratch():
            steps(df, n)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def settle_points(points: DataFrame, most: int = 4) -> DataFrame:
    """key, points: distinct trimmed points in order, at most `most`; empty ones go."""
    t = F.transform("points", lambda x: F.trim(x))
    return points.select("key", F.slice(F.array_distinct(F.filter(t, lambda x: x.isNotNull() & (x != ""))), 1, most).alias("points"))
