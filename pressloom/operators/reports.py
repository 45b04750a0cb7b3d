"""Fixed reports over the views, the base tables and the call log. Times are given, never taken from the clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import spectrum as sp
from pressloom.functions.spectrum import FIVE, Bucket
from pressloom.operators.views import once

DAY = 86400


def ranking(stories: DataFrame, cards: DataFrame, now: int, days: int = 33, offset: int = 0, limit: int | None = None, without: int | None = None) -> DataFrame:
    """Relevant stories of the last days by cards / (age in days + 2)^1.5; ties by time, then id."""
    e = eligible(stories, now, days)
    if without is not None:
        e = e.filter(F.col("story_id") != without)
    n = once(cards, "source_id").filter("status = 1 AND story_id IS NOT NULL").groupBy("story_id").agg(F.count("*").alias("cards"))
    age = (F.lit(now) - F.col("created")).cast("double") / float(DAY)
    score = F.coalesce("cards", F.lit(0)).cast("double") / F.pow(age + 2.0, F.lit(1.5))
    out = e.join(n, "story_id", "left").select("story_id", "created", F.coalesce("cards", F.lit(0)).alias("cards"), score.alias("score")).orderBy(F.desc("score"), F.desc("created"), "story_id")
    return out if limit is None else out.offset(offset).limit(limit)


def eligible(stories: DataFrame, now: int, days: int = 33) -> DataFrame:
    return once(stories, "story_id").filter((F.col("status") == 1) & (F.col("created") >= now - days * DAY) & (F.col("relevance") == "relevant"))


def page(ranked: DataFrame, number: int, size: int = 12) -> tuple[DataFrame, bool]:
    """One page and whether more follows."""
    n = ranked.count()
    return ranked.offset(number * size).limit(size), (number + 1) * size < n


def outlet_tally(cards: DataFrame, buckets: Sequence[Bucket] = FIVE) -> DataFrame:
    """Cards per outlet and bucket with the last time: published, not copied, no opinion; scores outside the scale are skipped."""
    c = once(cards, "source_id").filter("status = 1 AND syndicated_from IS NULL AND (section IS NULL OR section <> 'opinion') AND outlet IS NOT NULL")
    c = c.withColumn("bucket", sp.bucket(F.col("score"), buckets)).filter("bucket IS NOT NULL")
    return c.groupBy(F.trim("outlet").alias("outlet")).agg(*[F.sum(F.when(F.col("bucket") == b.key, 1).otherwise(0)).alias(f"{b.key}_count") for b in buckets], F.count("*").alias("total"), F.max("created").alias("last"))


def outlet_report(cards: DataFrame, feeds: DataFrame, buckets: Sequence[Bucket] = FIVE) -> DataFrame:
    """The tally with each outlet's main bucket, how far it strays from it, and in spectrum order."""
    first = Window.partitionBy("_o").orderBy("feed_id")
    prior = once(feeds, "feed_id").filter("status = 1 AND outlet IS NOT NULL AND coalesce(section, 'news') = 'news' AND prior_score IS NOT NULL").withColumn("_o", F.lower(F.trim("outlet")))
    prior = prior.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("_o", sp.bucket(F.col("prior_score"), buckets).alias("declared"))
    t = outlet_tally(cards, buckets)
    t = t.join(prior, F.lower("outlet") == F.col("_o"), "left")
    counts = [F.col(f"{b.key}_count") for b in buckets]
    t = t.withColumn("main", sp.primary(counts, buckets, F.col("declared")))
    t = t.withColumn("strays", sp.divergence(counts, buckets, F.col("main")))
    order = sp.reduce(lambda c, ib: c.when(F.col("main") == ib[1].key, ib[0]), enumerate(buckets), F.when(F.lit(False), F.lit(0)))
    return t.withColumn("level", sp.level(F.col("strays"), sp.DIVERGENCE_LEVELS)).withColumn("place", order).drop("_o")


def distribution(rows: DataFrame, keys: Sequence[str], buckets: Sequence[Bucket] = FIVE) -> DataFrame:
    """Counts per bucket, zero-filled, with percentages and balance. rows: keys and bucket."""
    g = rows.groupBy(*keys).agg(*[F.sum(F.when(F.col("bucket") == b.key, 1).otherwise(0)).alias(f"{b.key}_count") for b in buckets])
    counts = [F.col(f"{b.key}_count") for b in buckets]
    per = sp.percentages(counts)
    g = g.select("*", *[p.alias(f"{b.key}_percent") for p, b in zip(per, buckets)])
    g = g.withColumn("balance", sp.balance([F.col(f"{b.key}_percent") for b in buckets], counts))
    return g.withColumn("level", sp.level(F.col("balance"), sp.BALANCE_LEVELS))


def tracked(stories: DataFrame, cards: DataFrame, latest: int = 10, buckets: Sequence[Bucket] = FIVE) -> DataFrame:
    """The latest published stories with the buckets of their perspectives (not copied, no opinion)."""
    top = once(stories, "story_id").filter("status = 1").select("story_id", "title", "created").orderBy(F.desc("created"), "story_id").limit(max(1, min(50, latest)))
    c = once(cards, "source_id").filter("status = 1 AND syndicated_from IS NULL AND coalesce(section, 'news') <> 'opinion'").select("story_id", sp.bucket(F.col("score"), buckets).alias("bucket"))
    agg = c.join(F.broadcast(top.select("story_id")), "story_id", "left_semi").groupBy("story_id").agg(*[F.sum(F.when(F.col("bucket") == b.key, 1).otherwise(0)).alias(f"{b.key}_count") for b in buckets])
    return top.join(agg, "story_id", "left").na.fill(0, [f"{b.key}_count" for b in buckets])


def perspectives(cards: DataFrame, story: int, buckets: Sequence[Bucket] = FIVE) -> DataFrame:
    """The published cards of one story per bucket, latest first."""
    c = once(cards, "source_id").filter((F.col("status") == 1) & (F.col("story_id") == story)).withColumn("bucket", sp.bucket(F.col("score"), buckets))
    item = F.struct((-F.col("created")).alias("k"), "source_id", "outlet", "title", "score", F.col("micro_summary").alias("summary"), F.col("original_url").alias("url"))
    return c.groupBy("bucket").agg(F.sort_array(F.collect_list(item)).alias("cards")).withColumn("n", F.size("cards"))


def story_page(src: DataFrame) -> DataFrame:
    """Per story and card: whether it is a reprint of another card of the same story (tested first), opinion, or a perspective, with the
    reprints counted under their originals. src: source_id, story_id, section, score, syndicated_from."""
    here = src.filter("story_id IS NOT NULL").select("source_id", "story_id", "section", "score", "syndicated_from")
    orig = here.select(F.col("source_id").alias("_of"), F.col("story_id").alias("_st"))
    j = here.join(orig, (F.col("syndicated_from") == F.col("_of")) & (F.col("story_id") == F.col("_st")), "left")
    role = F.when(F.col("_of").isNotNull(), "reprint").when(F.coalesce("section", F.lit("news")) == "opinion", "opinion").otherwise("perspective")
    j = j.select("source_id", "story_id", "score", "syndicated_from", role.alias("role"))
    reps = j.filter("role = 'reprint'").groupBy(F.col("syndicated_from").alias("_of")).agg(F.count("*").alias("reprints"))
    return j.join(reps, F.col("source_id") == F.col("_of"), "left").select("source_id", "story_id", "role", "score", F.coalesce("reprints", F.lit(0)).alias("reprints"))


def story_divergence(cards: DataFrame, feeds: DataFrame, least: int = 1, buckets: Sequence[Bucket] = FIVE) -> DataFrame:
    """Cards whose score lies at least `least` from their outlet's declared one, in another bucket. The first feed of (outlet, section) declares."""
    w = Window.partitionBy("_o", "_s").orderBy("feed_id")
    prior = once(feeds, "feed_id").filter("outlet IS NOT NULL").select(F.lower(F.trim("outlet")).alias("_o"), F.coalesce("section", F.lit("news")).alias("_s"), "feed_id", "prior_score")
    prior = prior.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("_o", "_s", "prior_score")
    c = once(cards, "source_id").filter("status = 1").select("source_id", "outlet", F.coalesce("section", F.lit("news")).alias("section"), "score")
    j = c.join(prior, (F.lower(F.trim("outlet")) == F.col("_o")) & (F.col("section") == F.col("_s")))
    j = j.withColumn("delta", F.col("score") - F.col("prior_score")).withColumn("bucket", sp.bucket(F.col("score"), buckets)).withColumn("prior_bucket", sp.bucket(F.col("prior_score"), buckets))
    return j.filter((F.abs("delta") >= least) & (F.col("bucket") != F.col("prior_bucket"))).select("source_id", "outlet", "section", "score", "prior_score", "delta", "bucket", "prior_bucket")


def dominant_topic(cards: DataFrame) -> DataFrame:
    """Per story the topic of most published cards; ties go to the topic met first."""
    c = once(cards, "source_id").filter("status = 1 AND story_id IS NOT NULL AND topic IS NOT NULL").groupBy("story_id", "topic").agg(F.count("*").alias("n"), F.min("source_id").alias("first"))
    w = Window.partitionBy("story_id").orderBy(F.desc("n"), "first")
    return c.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("story_id", "topic", "n")


def story_card_counts(stories: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards of every story, also of those without any."""
    n = once(cards, "source_id").filter("story_id IS NOT NULL").groupBy("story_id").agg(F.count("*").alias("cards"))
    return once(stories, "story_id").select("story_id").join(n, "story_id", "left").na.fill(0, ["cards"])


def in_top(rows: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """rows with `top`: whether the row is among the k with the largest score, ties by key. Only k keys are looked up."""
    best = rows.orderBy(F.desc(score), key).limit(k).select(F.col(key).alias("_k"), F.lit(True).alias("top"))
    return rows.join(F.broadcast(best), F.col(key) == F.col("_k"), "left").drop("_k").na.fill(False, ["top"])


def relevance_rollup(stories: DataFrame, cards: DataFrame) -> DataFrame:
    """stories with card_count, relevance and topic from their cards.

    Relevant if any card is, or if one may be and two outlets or more have perspectives; else "maybe" if any may be; else irrelevant. The
    topic is the one most rated cards have, the one of the first card among equals. Stories without rated cards keep what they have.
    cards: source_id, story_id, relevance, outlet, topic, score, section, syndicated_from.
    """
    c = cards.filter("story_id IS NOT NULL")
    own = F.col("syndicated_from").isNull() & (F.coalesce("section", F.lit("news")) != "opinion") & F.col("score").isNotNull()
    is_ = lambda x: F.sum((F.coalesce("relevance", F.lit("")) == x).cast("int"))
    g = c.groupBy("story_id").agg(F.count("*").alias("_n"), F.count("relevance").alias("_rated"), is_("relevant").alias("_yes"), is_("maybe").alias("_may"), F.countDistinct(F.when(own, F.col("outlet"))).alias("_outlets"))
    t = c.filter("topic IS NOT NULL AND relevance IS NOT NULL").groupBy("story_id", "topic").agg(F.count("*").alias("n"), F.min("source_id").alias("first"))
    t = t.groupBy("story_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "topic"))["topic"].alias("_topic"))
    j = stories.join(g, "story_id", "left").join(t, "story_id", "left")
    rated = F.coalesce("_rated", F.lit(0)) > 0
    told = F.when((F.col("_yes") > 0) | (F.col("_may") > 0) & (F.col("_outlets") >= 2), "relevant").when(F.col("_may") > 0, "maybe").otherwise("irrelevant")
    j = j.withColumn("relevance", F.when(rated, told).otherwise(F.col("relevance"))).withColumn("topic", F.when(rated, F.coalesce("_topic", "topic")).otherwise(F.col("topic")))
    return j.withColumn("card_count", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n", "_rated", "_yes", "_may", "_outlets", "_topic")


def context_cost(calls: DataFrame, context: str, start: int) -> DataFrame:
    """Per operation of one context since a time: attempts, logical calls, failures and tokens."""
    c = once(calls, "id").filter((F.col("context_type") == context) & (F.col("created") >= start))
    tokens = [F.sum(F.coalesce(F.col(t).cast("long"), F.lit(0))).alias(t) for t in ("input_tokens", "output_tokens")]
    return c.groupBy("operation").agg(F.count("*").alias("attempts"), F.countDistinct("call_group").alias("calls"), F.sum(F.when(F.col("success") == 0, 1).otherwise(0)).alias("failures"), *tokens)


def click_buckets(clicked: DataFrame, views: DataFrame, cards: DataFrame, since: str) -> DataFrame:
    """Per outlet and score, from a day on: clicks, impressions (views of the stories of its cards) and click-through in percent.

    clicked: card_id, at; views: story_id, day, views; cards: card_id, story_id, outlet, score.
    """
    k = clicked.filter(F.col("at") >= F.lit(since).cast("timestamp")).groupBy("card_id").agg(F.count("*").alias("clicks"))
    v = views.filter(F.col("day") >= F.lit(since).cast("date")).groupBy("story_id").agg(F.sum("views").alias("views"))
    # one pass over the cards: what each was clicked and shown, added up
    each = cards.join(k, "card_id", "left").join(v, "story_id", "left").filter("clicks IS NOT NULL OR views IS NOT NULL")
    out = each.groupBy("outlet", "score").agg(F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"), F.coalesce(F.sum("views"), F.lit(0)).alias("impressions"))
    return out.withColumn("ctr", F.when(F.col("impressions") > 0, F.floor((2000 * F.col("clicks") + F.col("impressions")) / (2 * F.col("impressions"))) / 10))


def content_counts(cards: DataFrame, stories: DataFrame, feeds: DataFrame, since: int | None = None) -> DataFrame:
    """One row per counter."""
    c = once(cards, "source_id")
    recent = F.lit(True) if since is None else F.col("created") >= since
    parts = [
        c.agg(F.count("*").alias("n")).select(F.lit("cards").alias("counter"), "n"),
        c.filter("status = 1").agg(F.count("*").alias("n")).select(F.lit("cards_published").alias("counter"), "n"),
        c.filter(F.col("score").isNull() & recent).agg(F.count("*").alias("n")).select(F.lit("cards_unrated").alias("counter"), "n"),
        once(stories, "story_id").agg(F.count("*").alias("n")).select(F.lit("stories").alias("counter"), "n"),
        once(feeds, "feed_id").filter("status = 1 AND active = 1").agg(F.count("*").alias("n")).select(F.lit("feeds_active").alias("counter"), "n"),
    ]
    return sp.reduce(DataFrame.unionByName, parts)


def label_counts(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """One row per label in order, zero-filled; other values are dropped."""
    got = df.filter(F.col(column).isin(*labels)).groupBy(column).agg(F.count("*").alias("n"))
    all_ = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], f"{column} string, place int")
    return all_.join(got, column, "left").na.fill(0, ["n"])


def recent_median(calls: DataFrame, operation: str, latest: int = 30) -> DataFrame:
    """The median latency of an operation's latest successful calls, middles averaged."""
    last = once(calls, "id").filter((F.col("operation") == operation) & (F.col("success") == 1)).orderBy(F.desc("created"), F.desc("id")).limit(latest)
    return last.agg(F.count("*").alias("calls"), F.expr("percentile(latency_ms, 0.5)").alias("median_ms"))


def call_stats(calls: DataFrame, since: int) -> DataFrame:
    """Per operation: attempts, logical calls, retries, errors, latency and tokens."""
    c = once(calls, "id").filter(F.col("created") >= since)
    tok = ("input_tokens", "output_tokens", "reasoning_tokens", "cached_tokens")
    g = c.groupBy("operation").agg(
        F.count("*").alias("attempts"), F.countDistinct("call_group").alias("calls"), F.sum(F.when(F.col("success") == 0, 1).otherwise(0)).alias("errors"),
        F.sum("latency_ms").alias("latency_sum"), *[F.sum(F.coalesce(F.col(t).cast("long"), F.lit(0))).alias(t) for t in tok], F.sum(F.coalesce(F.col("estimated").cast("long"), F.lit(0))).alias("estimated"),
    )
    return g.withColumn("retries", F.col("attempts") - F.col("calls")).withColumn("error_percent", F.round(100 * F.col("errors") / F.col("attempts"), 1)).withColumn("latency_avg", F.round(F.col("latency_sum") / F.col("attempts"), 1)).drop("latency_sum")


def daily_tokens(calls: DataFrame, cards: DataFrame, offset: int) -> DataFrame:
    """Days by a fixed offset: calls and tokens of regular and evaluation calls, beside the cards created that day; newest first by day."""
    day = lambda c: F.date_from_unix_date(F.floor((c + offset) / DAY).cast("int"))
    c = once(calls, "id").withColumn("day", day(F.col("created"))).withColumn("kind", F.when(F.col("context_type") == "eval", "eval").otherwise("regular"))
    sums = []
    for k in ("regular", "eval"):
        here = F.col("kind") == k
        sums += [F.sum(F.when(here, 1).otherwise(0)).alias(f"{k}_attempts"), F.sum(F.when(here, F.coalesce("input_tokens", F.lit(0)).cast("long") + F.coalesce("output_tokens", F.lit(0))).otherwise(0)).alias(f"{k}_tokens")]
    a = c.groupBy("day").agg(*sums)
    b = once(cards, "source_id").withColumn("day", day(F.col("created"))).groupBy("day").agg(F.count("*").alias("cards"))
    names = ["regular_attempts", "regular_tokens", "eval_attempts", "eval_tokens", "cards"]
    return a.join(b, "day", "full_outer").na.fill(0, names)


def monthly_tokens(days: DataFrame) -> DataFrame:
    """The daily report added up by month, without reading the log again."""
    names = [c for c in days.columns if c != "day"]
    return days.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(*[F.sum(n).alias(n) for n in names])


def day_detail(calls: DataFrame, start: int) -> DataFrame:
    """Per logical call of one day of 86,400 seconds."""
    c = once(calls, "id").filter((F.col("created") >= start) & (F.col("created") < start + DAY))
    return c.groupBy("call_group").agg(F.min("created").alias("first_created"), F.max("operation").alias("operation"), F.max("model").alias("model"), F.count("*").alias("attempts"), F.max("success").alias("success"), F.sum(F.coalesce(F.col("input_tokens").cast("long"), F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("latency_ms", F.lit(0))).alias("latency_ms"))


def group_cost(calls: DataFrame, groups: DataFrame) -> DataFrame:
    """Tokens of the successful attempts of given logical calls."""
    c = once(calls, "id").filter("success = 1").join(groups.select("call_group").distinct(), "call_group", "left_semi")
    return c.groupBy("call_group").agg(F.count("*").alias("attempts"), F.sum(F.coalesce(F.col("input_tokens").cast("long"), F.lit(0))).alias("input_tokens"), F.sum(F.coalesce(F.col("output_tokens").cast("long"), F.lit(0))).alias("output_tokens"))


def clicks(clicked: DataFrame, views: DataFrame, cards: DataFrame) -> DataFrame:
    """Per outlet: clicks, impressions (views of the stories of its cards) and click-through in percent with one decimal, null without impressions.

    clicked: card_id; views: story_id, views; cards: card_id, story_id, outlet.
    """
    k = clicked.groupBy("card_id").agg(F.count("*").alias("clicks")).join(cards.select("card_id", "outlet"), "card_id").groupBy("outlet").agg(F.sum("clicks").alias("clicks"))
    v = views.groupBy("story_id").agg(F.sum("views").alias("views"))
    i = cards.join(v, "story_id").groupBy("outlet").agg(F.sum("views").alias("impressions"))
    out = k.join(i, "outlet", "full_outer").na.fill(0, ["clicks", "impressions"])
    return out.withColumn("ctr", F.when(F.col("impressions") > 0, F.floor((2000 * F.col("clicks") + F.col("impressions")) / (2 * F.col("impressions"))) / 10))


def bots(agent: Column) -> Column:
    """An empty agent, or one that says it is a robot."""
    return (F.trim(F.coalesce(agent, F.lit(""))) == "") | F.coalesce(agent, F.lit("")).rlike("(?i)bot|crawl|spider|slurp|preview|fetch|monitor|curl|wget|python|headless")


def partial_share(cards: DataFrame) -> DataFrame:
    c = once(cards, "source_id").filter("status = 1 AND score IS NOT NULL")
    return c.agg(F.count("*").alias("classified"), F.sum(F.when(F.col("partial_text") == 1, 1).otherwise(0)).alias("partial")).withColumn("percent", F.when(F.col("classified") > 0, F.floor((200 * F.col("partial") + F.col("classified")) / (2 * F.col("classified"))).cast("long")))


def corrections(entries: DataFrame, status: str | None = "pending") -> DataFrame:
    """Entries of one status, or of all with None, the newest first. entries: id, status, created."""
    return (entries if status is None else entries.filter(F.col("status") == status)).orderBy(F.desc("created"), F.desc("id"))


def credits(entries: DataFrame, most: int = 100) -> DataFrame:
    """Distinct names of accepted entries, the latest decision first. entries: name, status, decided."""
    return entries.filter("status = 'accepted' AND trim(coalesce(name, '')) <> ''").groupBy(F.trim("name").alias("name")).agg(F.max("decided").alias("decided")).orderBy(F.desc("decided"), "name").limit(most)


def story_list(st: DataFrame, relevance: str | None = None, by: str = "published_at", size: int = 24, number: int = 0) -> DataFrame:
    """A page of published stories by time or by number of sources."""
    if by not in ("published_at", "source_count"):
        raise ValueError(f"can't sort by {by}")
    s = st if relevance is None else st.filter(F.col("relevance") == relevance)
    return s.orderBy(F.desc(by), "story_id").offset(number * size).limit(size)


def card_list(cards: DataFrame, topics: Sequence[str] = (), size: int = 50, number: int = 0) -> DataFrame:
    c = once(cards, "source_id")
    c = c.filter(F.col("topic").isin(*topics)) if topics else c
    return c.orderBy(F.desc("created"), "source_id").offset(number * size).limit(size)


def eval_runs(runs: DataFrame, latest: int = 50) -> DataFrame:
    """The latest runs with accuracy and counts read from their JSON metrics. runs: id, metrics."""
    m = F.from_json("metrics", "accuracy double, items long, failed long")
    return runs.orderBy(F.desc("id")).limit(latest).select("id", m.alias("m")).select("id", "m.*")
