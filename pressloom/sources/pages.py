"""Pages as they were fetched: whether they may be, the article's text in them, and what is used where there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions.text import plain, word_count

#: Elements that hold no article, and those that hold its paragraphs.
ASIDE = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "svg", "iframe", "figure", "button", "select")
BLOCK = ("p", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre")
#: How long an answer about robots holds, in seconds: one that came, and none (fixed values).
ROBOTS_TTL, UNREACHABLE_TTL = 86400, 3600


def read_pages(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """path and html of every page stored as a file under path."""
    return spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def title_of(html: Column) -> Column:
    """The first heading, else the title; empty without either."""
    first = lambda tag: plain(F.regexp_extract(F.coalesce(html, F.lit("")), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))
    return F.when(first("h1") != "", first("h1")).otherwise(first("title"))


def article_of(html: Column, linked: float = 0.5, least: int = 25) -> Column:
    """The paragraphs, headings, list items and quotations of a page, a line each; empty if there is none.

    Navigation, headers, footers, asides, forms and scripts are left out, and so are blocks of which more than the share `linked` is the
    text of links. A heading counts if a paragraph follows, other blocks from `least` characters on or with the end of a sentence.
    Nested blocks of one kind end with the first end tag.
    """
    t = F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<!--.*?-->", " ")
    for e in ASIDE:
        t = F.regexp_replace(t, rf"(?is)<{e}\b[^>]*>.*?</{e}\s*>", " ")
    blocks = F.regexp_extract_all(t, F.lit("(?is)" + "|".join(rf"<{b}\b[^>]*>.*?</{b}\s*>" for b in BLOCK)), 0)

    def told(b: Column) -> Column:
        links = F.array_join(F.regexp_extract_all(b, F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), 0), " ")
        return F.struct(b.rlike(r"(?i)^<h\d").alias("head"), plain(b).alias("text"), F.length(plain(links)).alias("linked"))

    rows = F.transform(blocks, told)
    full = F.filter(rows, lambda r: (F.length(r["text"]) > 0) & (r["linked"] <= linked * F.length(r["text"])) & (r["head"] | (F.length(r["text"]) >= least) | r["text"].rlike(r"[.!?…][\"'”’»)]?$")))
    last = F.coalesce(F.array_max(F.filter(F.transform(full, lambda r, i: F.when(~r["head"], i + 1)), lambda i: i.isNotNull())), F.lit(0))
    kept = F.filter(full, lambda r, i: ~r["head"] | (i < last))
    return F.array_join(F.transform(kept, lambda r: r["text"]), "\n")


def robots_answers(fetched: DataFrame, now: int) -> DataFrame:
    """host, says and `again` (when to ask next) of robots files: their rules, "all" where there is none (4xx), "none" where the host can't be
    reached (no answer, 5xx), which holds for an hour only. fetched: host, status (null for no answer), fetched_at; the latest answer counts."""
    latest = fetched.groupBy("host").agg(F.max(F.struct("fetched_at", "status")).alias("x")).select("host", "x.*")
    gone = F.col("status").isNull() | (F.col("status") >= 500)
    says = F.when(gone, "none").when(F.col("status") >= 400, "all").otherwise("rules")
    again = F.col("fetched_at") + F.when(gone, UNREACHABLE_TTL).otherwise(ROBOTS_TTL)
    return latest.select("host", F.when(again <= now, "ask").otherwise(says).alias("says"), again.alias("again"))


def may_fetch(pages: DataFrame, answers: DataFrame, by_rules: DataFrame) -> DataFrame:
    """pages (host, path) with `allow`: by what the host says, by its rules where it has some; unknown hosts have to be asked and give null.

    by_rules: host, path, allow, as feeds.allowed gives it.
    """
    r = by_rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("allow").alias("_a")).distinct()
    j = pages.join(answers.select(F.col("host").alias("_o"), "says"), F.col("host") == F.col("_o"), "left").join(r, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    allow = F.when(F.col("says") == "all", True).when(F.col("says") == "none", False).when(F.col("says") == "rules", F.coalesce("_a", F.lit(True)))
    return j.select(*pages.columns, allow.alias("allow"))


def extracted(items: DataFrame, least: int = 80) -> DataFrame:
    """items with body, method, is_partial and note: the page's text, else the feed's, whichever first has `least` words; else the abstract.

    items: page, feed (texts, null for none), abstract, skip_page (the registry says the feed is partial), allow (by robots), error (of the
    fetch). The note tells why the page wasn't used. With `least` 0 or less the page is taken whatever its length.
    """
    page, feed = F.coalesce("page", F.lit("")), F.coalesce("feed", F.lit(""))
    if least <= 0:
        return items.select("*", page.alias("body"), F.lit("legacy").alias("method"), F.lit(0).alias("is_partial"), F.lit("").alias("note"))
    skip, barred = F.coalesce("skip_page", F.lit(False)), ~F.coalesce("allow", F.lit(True))
    usable = ~skip & ~barred & F.col("error").isNull()
    n = F.when(usable, word_count(page)).otherwise(0)
    why = F.when(skip, "feed is partial").when(barred, "barred by robots").when(F.col("error").isNotNull(), F.concat(F.lit("fetch failed: "), F.substring("error", 1, 120))).when(page == "", "no article found")
    by_page, by_feed = n >= least, word_count(feed) >= least
    note = F.when(by_page, "").when(why.isNotNull(), why).when(by_feed, "").otherwise(F.concat(F.lit("page has "), n.cast("string"), F.lit(" words")))
    return items.select(
        "*", F.when(by_page, page).when(by_feed, feed).otherwise(F.coalesce("abstract", F.lit(""))).alias("body"),
        F.when(by_page, "page").when(by_feed, "feed_body").otherwise("abstract").alias("method"), F.when(by_page | by_feed, 0).otherwise(1).alias("is_partial"), note.alias("note"),
    )
