"""Feeds, the registry of feeds, and what robots may read."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions.text import domain, plain, term_pattern, word_count

RSS = "title string, link string, description string, `content:encoded` string, pubDate string, guid string"


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """link, title, abstract, feed_body of every item of the RSS files under path; a file that can't be parsed gives no row."""
    raw = spark.read.format("xml").option("rowTag", "item").option("mode", "DROPMALFORMED").option("ignoreNamespace", "false").schema(RSS).load(path)
    link = F.trim(F.coalesce("link", F.lit("")))
    return raw.select(link.alias("link"), plain(F.col("title")).alias("title"), plain(F.col("description")).alias("abstract"), F.col("`content:encoded`").alias("feed_body"))


def active(feeds: DataFrame) -> DataFrame:
    """Published and active feeds with an address, by name: the outlet's, else the address."""
    f = feeds.dropDuplicates(["feed_id"]).filter("status = 1 AND active = 1 AND trim(coalesce(feed_url, '')) <> ''")
    return f.select("feed_id", F.coalesce(F.when(F.trim("outlet") != "", F.trim("outlet")), F.col("feed_url")).alias("name"), "feed_url").orderBy("name", "feed_id")


def outlet_patterns(feeds: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """feed_id and `pattern`: what names the feed's outlet, over all feeds of that outlet: its name with and without an article, the domains
    of its feeds, and its aliases (outlet, term). Outlets are the same if their trimmed names are, in any case; a feed without one has none."""
    key = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    f = feeds.select("feed_id", F.trim("outlet").alias("name"), key("outlet").alias("k"), domain(F.col("feed_url")).alias("host")).filter("k <> ''")
    each = f.select("k", F.explode(F.array("name", F.regexp_replace("name", r"(?i)^the\s+", ""), "host")).alias("term"))
    if aliases is not None:
        each = each.unionByName(aliases.select(key("outlet").alias("k"), "term").filter("k <> ''"))
    # a list kept by hand: some names an outlet
    terms = each.filter("term IS NOT NULL").groupBy("k").agg(term_pattern(F.array_sort(F.collect_set("term"))).alias("pattern"))
    return f.join(terms, "k", "left").select("feed_id", "pattern")


def by_host(items: DataFrame, link: str, feeds: DataFrame, feed_url: str) -> DataFrame:
    """items with _feed_id, a row for each feed whose domain is the item's host or a parent of it.

    The join is one of equal domains: a host has the domain of its last two labels only.
    """
    f = feeds.select(F.col("feed_id").alias("_feed_id"), domain(F.col(feed_url)).alias("_domain")).filter("_domain <> ''")
    return items.withColumn("_host", domain(F.col(link))).join(f, F.col("_host") == F.col("_domain")).drop("_host", "_domain")


def checked(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feeds, errors) of registry entries: row, url, outlet, section, score, prior, prior_source.

    The first error of an entry is told: no url, no outlet, an address met before, a score or prior outside of -2..2, an unknown section,
    or a source of more than 255 characters.
    """
    w = Window.partitionBy(F.trim("url")).orderBy("row")
    e = entries.withColumn("_n", F.row_number().over(w))
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    off = lambda c: F.col(c).isNotNull() & ~F.col(c).between(-2, 2)
    why = F.when(empty("url"), "no url").when(empty("outlet"), "no outlet").when(F.col("_n") > 1, "duplicate url").when(off("score"), "score out of range").when(off("prior"), "prior out of range")
    why = why.when(~F.coalesce("section", F.lit("news")).isin("news", "opinion"), "unknown section").when(F.length("prior_source") > 255, "prior_source too long")
    e = e.withColumn("error", why).drop("_n")
    return e.filter("error IS NULL").drop("error").withColumn("section", F.coalesce("section", F.lit("news"))), e.filter("error IS NOT NULL").select("row", "url", "error")


def upsert(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, fields and `change`: created, updated, unchanged, or kept where only the old registry has it."""
    o = old.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    j = new.select(key, *fields).join(o, F.col(key) == F.col("_k"), "full_outer")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    change = F.when(F.col("_k").isNull(), "created").when(F.col(key).isNull(), "kept").when(same, "unchanged").otherwise("updated")
    return j.select(F.coalesce(key, "_k").alias(key), *[F.when(F.col(key).isNull(), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields], change.alias("change"))


def robots_rules(text: str, agent: str) -> list[tuple[bool, str]]:
    """(allow, pattern) of the group for the agent's token, else of the group for all."""
    groups: list[tuple[list[str], list[tuple[bool, str]]]] = []
    rules_begun = True
    for line in text.splitlines():
        key, _, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if rules_begun:
                groups.append(([], []))
            rules_begun = False
            groups[-1][0].append(value.lower())
        elif key in ("allow", "disallow") and groups:
            rules_begun = True
            if value:
                groups[-1][1].append((key == "allow", value))
    token = agent.lower()
    own = [r for names, r in groups if any(n != "*" and n and n in token for n in names)]
    return [x for r in (own or [r for names, r in groups if "*" in names]) for x in r]


def robots_regex(pattern: str) -> str:
    """A robots pattern as an anchored expression: * is anything, a $ at the end is the end."""
    end = pattern.endswith("$")
    body = "".join(".*" if c == "*" else re.escape(c) for c in (pattern[:-1] if end else pattern))
    return "^" + body + ("$" if end else "")


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (host, path) with `allow`: the longest matching pattern of the host decides, allow on ties; without one, allowed.

    rules: host, allow, pattern, regex.
    """
    keyed = pages.withColumn("_row", F.monotonically_increasing_id())
    hit = keyed.join(rules.withColumnRenamed("host", "_h"), (F.col("host") == F.col("_h")) & F.expr("path rlike regex"), "left")
    return hit.groupBy("_row", "host", "path").agg(F.max(F.struct(F.length("pattern").alias("n"), F.col("allow").alias("a"))).alias("m")).select("host", "path", F.coalesce("m.a", F.lit(True)).alias("allow"))


def chosen_body(page: Column, feed: Column, abstract: Column, skip_page: Column, least: int = 80) -> Column:
    """(body, method, partial): the page's text, else the feed's, whichever first has enough words; else the abstract, which is partial."""
    enough = lambda c: word_count(c) >= least
    out = lambda c, m, p: F.struct(c.alias("body"), F.lit(m).alias("method"), F.lit(p).alias("partial"))
    return F.when(~skip_page & enough(page), out(page, "page", 0)).when(enough(feed), out(feed, "feed_body", 0)).otherwise(out(abstract, "abstract", 1))
