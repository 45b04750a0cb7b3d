"""Token counts and ranks that need no single task per source or length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A run of letters counts one per started six letters, a run of digits one per started three, any other sign but white space one.
TOKEN = r"\p{L}{1,6}|\p{N}{1,3}|[^\p{L}\p{N}\s]"


def tokens(known: str, text: str) -> Column:
    """The stated size, or the recount where it is null; a null text has 0 tokens."""
    return F.coalesce(F.col(known).cast("long"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN)).cast("long"))


def running(df: DataFrame, group: Sequence[str], order: str, row_id: str, amount: str, out: str, salts: int = 64) -> DataFrame:
    """df with `out`: the sum of `amount` over the rows of the group that come before, in the order (order, salt, row_id).

    Rows are summed up per (group, order, salt) first; only these few sums are scanned along a group, and the rows of one such cell
    along themselves, so a group of a third of all rows is spread over many tasks.
    """
    cell = [*group, order, "__salt"]
    rows = df.withColumn("__salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    sums = rows.groupBy(*cell).agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(order, "__salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*cell).orderBy(row_id).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    r, s = rows.alias("r"), sums.alias("s")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in cell]
    # both sides are already parted by cell, so the sums needn't be sent to every task
    return r.join(s.hint("merge"), on).select("r.*", (F.col("s.__base") + F.col("r.__in")).alias(out)).drop("__salt", "__in")
