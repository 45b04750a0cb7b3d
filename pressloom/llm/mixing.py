"""Sources mixed to target shares by systematic sampling (problem 7).

Each document of a source is expected to be used e = wanted tokens / tokens of the source times. Along the documents of a source the
running sum of e is taken, one random offset is added, and a document is used once for every whole number its stretch crosses: floor(e)
or ceil(e) times, never more than max_repeats as e is capped by it. Documents run by size, so short and long ones are drawn evenly.

The offset depends on the seed and the source only, never on sizes: over all offsets a document of any size is used e times on average.
So a source of few draws and some very long documents misses its share by what the draw happens to hold; the report gives the miss.

Targets of sources without tokens can't be met; the others keep their proportions. By default the mix is the largest in which every
source still reaches its share: the smallest source, used max_repeats times throughout, sets the total. A larger `total` is filled by
the sources that can; those at their cap fall short, which the report shows.

Every document gives one row; documents of other sources, of none, and without tokens are used 0 times. A source listed twice counts
with the sum of its shares and its lower cap; null or negative shares count as 0, null caps as 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm.sizes import running
from pressloom.session import settle


#: Offsets are (j + 1/2) / OFFSETS, binary fractions, so that sums with whole numbers are exact.
OFFSETS = 1 << 20


def offset(seed: int, source: Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), source), F.lit(OFFSETS)) + 0.5) / OFFSETS


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row per listed source: docs, tokens, target_share, wanted_share (among sources with tokens), max_repeats, wanted_tokens
    and copies (e)."""
    sizes = sizes.select("doc_id", "source", "n")
    t = targets.filter("source IS NOT NULL").groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    s = sizes.filter("n > 0").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    both = t.join(s, "source", "left").na.fill(0, ["docs", "tokens"])
    # some dozens of sources: the list of targets, not the data
    live = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    sums = both.agg(F.sum(F.when(live, F.col("target_share"))).alias("given"), F.min(F.when(live, F.col("tokens") * F.col("max_repeats") / F.col("target_share"))).alias("limit"))
    out = both.withColumn("one", F.lit(1)).join(sums.withColumn("one", F.lit(1)), "one", "left").drop("one")
    want = F.when(live, F.col("target_share") / F.col("given")).otherwise(0.0)
    goal = F.lit(float(total)) if total is not None else F.col("limit") * F.col("given")
    out = out.select("source", "docs", "tokens", "target_share", want.alias("wanted_share"), "max_repeats", F.when(live, want * goal).otherwise(0.0).alias("wanted_tokens"))
    e = F.least(F.col("wanted_tokens") / F.col("tokens"), F.col("max_repeats").cast("double"))
    e = F.when(F.col("wanted_tokens") > 0, e).otherwise(0.0)
    # the source that sets the total is used exactly max_repeats times, whatever the rounding
    e = F.when(F.abs(e - F.round(e)) < 1e-9, F.round(e)).otherwise(e)
    return out.withColumn("copies", e)


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11, salts: int = 64) -> DataFrame:
    """sizes: doc_id, source, n. Rows doc_id, source, n, uses."""
    sizes = sizes.select("doc_id", "source", "n")
    # one row per listed source, used twice
    p = settle(plan(sizes, targets, total), "plan").filter("copies > 0").select(F.col("source").alias("__src"), "copies")
    drawn = sizes.filter("n > 0").join(p, F.col("source") == F.col("__src")).drop("__src").withColumn("one", F.lit(1))
    drawn = running(drawn, ["source"], "n", "doc_id", "one", "rank", salts)
    mark = lambda r: F.floor(r.cast("double") * F.col("copies") + offset(seed, F.col("source")))
    used = drawn.select("doc_id", "source", "n", (mark(F.col("rank") + 1) - mark(F.col("rank"))).cast("int").alias("uses"))
    rest = sizes.join(p, F.col("source") == F.col("__src"), "left").filter("copies IS NULL OR n IS NULL OR n <= 0").select("doc_id", "source", "n", F.lit(0).alias("uses"))
    return used.unionByName(rest)


def report(mixed: DataFrame, sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per listed source the shares wanted and reached, and by how much the one misses the other."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n") * F.col("uses")).alias("reached_tokens"), F.sum(F.when(F.col("uses") > 0, 1).otherwise(0)).alias("docs_used"), F.max("uses").alias("most_uses"))
    out = plan(sizes, targets, total).join(got, "source", "left").na.fill(0, ["reached_tokens", "docs_used", "most_uses"])
    whole = out.agg(F.sum("reached_tokens").alias("__all")).withColumn("one", F.lit(1))
    out = out.withColumn("one", F.lit(1)).join(whole, "one").drop("one")
    out = out.withColumn("reached_share", F.when(F.col("__all") > 0, F.col("reached_tokens") / F.col("__all")).otherwise(0.0)).drop("__all")
    return out.withColumn("share_miss", F.col("reached_share") - F.col("wanted_share"))
