"""Writers and the changes a store goes through. Each returns the new state; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions.text import decode_entities

DAY = 86400


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A pretty-printed JSON array of id, title, body_excerpt and expected labels."""
    schema = "id long, title string, body_excerpt string, expected struct<bias: string, social_relevance: string, topic: string>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_golden(df: DataFrame, path: str) -> None:
    df.select("id", "title", "body_excerpt", "expected").write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str, lengths: Mapping[str, int], defaults: Mapping[str, object]) -> None:
    """Rows appended with texts cut to their column's length and defaults for nulls."""
    for c, n in lengths.items():
        df = df.withColumn(c, F.substring(c, 1, n))
    df.na.fill(dict(defaults)).write.mode("append").parquet(path)


def latest(df: DataFrame, key: str, by: str, *ties: str) -> DataFrame:
    """The row of each key with the greatest `by`: what is left after upserts."""
    w = Window.partitionBy(key).orderBy(F.desc(by), *[F.desc(t) for t in ties])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def purge(df: DataFrame, now: int, days: int, column: str = "created") -> DataFrame:
    """Rows not older than `days`; all of them if days is 0 or less."""
    return df if days <= 0 else df.filter(F.col(column) >= now - days * DAY)


def cascade_delete(stories: DataFrame, cards: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stories and cards without the given story ids and the cards under them. gone: story_id."""
    g = gone.select("story_id").distinct()
    return stories.join(g, "story_id", "left_anti"), cards.join(g, "story_id", "left_anti")


def backfill(have: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of source whose key isn't there yet, added: INSERT ... SELECT ... WHERE NOT EXISTS."""
    return have.unionByName(source.join(have.select(key), key, "left_anti").select(*have.columns))


def relabel(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """old becomes new; refused if new is there already."""
    if not df.filter(F.col(column) == new).isEmpty():
        raise ValueError(f"{column} already holds {new}")
    return df.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def decode_stored(df: DataFrame, column: str, html: bool = False) -> DataFrame:
    """Entities decoded where there are any; in markup, not where decoding would make a tag."""
    some = F.col(column).rlike("&(amp|lt|gt|quot|apos|#0?39|nbsp);")
    got = decode_entities(F.col(column))
    ok = some & (~got.rlike("<[a-zA-Z/!]") | F.col(column).rlike("<[a-zA-Z/!]") & (F.regexp_count(got, F.lit("<[a-zA-Z/!]")) == F.regexp_count(F.col(column), F.lit("<[a-zA-Z/!]")))) if html else some
    return df.withColumn(column, F.when(ok, got).otherwise(F.col(column)))


def count_changes(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """How many rows a migration changed per column."""
    a = after.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = before.join(a, F.col(key) == F.col("_k"))
    return j.agg(*[F.sum((~F.col(c).eqNullSafe(F.col(f"_{c}"))).cast("int")).alias(c) for c in columns])
