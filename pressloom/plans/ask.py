"""Ad-hoc questions: check, rewrite, run in a session that knows the four views only."""

from __future__ import annotations

import hashlib
import re
import threading
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pressloom.functions.spectrum import FIVE, Bucket
from pressloom.operators import views
from pressloom.plans.dialect import Rewriter, Unsupported
from pressloom.plans.gate import MAX_ROWS, Gate


class Rejected(Exception):
    def __init__(self, reason: str, detail: str = "") -> None:
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason, self.detail = reason, detail


@dataclass
class Probe:
    ok: bool
    reason: str = ""
    detail: str = ""


def relations(spark: SparkSession, sql: str) -> set[str]:
    """Names of all relations the parsed statement reads, subqueries included."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    return {x.strip().lower() for x in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan)}


def probe(spark: SparkSession, expected: Sequence[str] = views.VIEWS) -> Probe:
    """Whether the session shows exactly the views."""
    seen = {t.name.lower() for t in spark.catalog.listTables()}
    missing, extra = set(expected) - seen, seen - set(expected)
    if missing:
        return Probe(False, "missing_views", ", ".join(sorted(missing)))
    if extra:
        return Probe(False, "extra_tables", ", ".join(sorted(extra)))
    return Probe(True)


def translate(sql: str, buckets: Sequence[Bucket] = FIVE, max_rows: int = MAX_ROWS, today: str | None = None) -> str:
    """The Spark SQL of an admitted statement."""
    v = Gate(views.columns(buckets), max_rows).check(sql)
    if not v.ok:
        raise Rejected(v.reason, v.detail)
    try:
        out = Rewriter(today).rewrite(v.pieces)
    except Unsupported as e:
        raise Rejected("unsupported", str(e)) from e
    return out + (v.sql[len(sql.strip().rstrip(";").rstrip()) :])


def ask(spark: SparkSession, frames: Mapping[str, DataFrame], sql: str, buckets: Sequence[Bucket] = FIVE, max_rows: int = MAX_ROWS, today: str | None = None) -> DataFrame:
    """The rows of an ad-hoc statement over the views, at most max_rows of them."""
    text = translate(sql, buckets, max_rows, today)
    bad = {r for r in relations(spark, text)} - {v for v in views.VIEWS} - _ctes(text)
    if bad:
        raise Rejected("table_not_allowed", ", ".join(sorted(bad)))
    return spark.sql(_bind(text, frames), **{n: frames[n] for n in frames if re.search(rf"\b{n}\b", text, re.I)})


def _ctes(sql: str) -> set[str]:
    return {m.lower() for m in re.findall(r"(?:\bWITH|,)\s+([A-Za-z_]\w*)\s*(?:\([^()]*\)\s*)?AS\s*\(", sql, re.I)} | {m.lower() for m in re.findall(r"\bWITH\s+([A-Za-z_]\w*)", sql, re.I)}


def _bind(sql: str, frames: Mapping[str, DataFrame]) -> str:
    """View names in table places become parameters, so the statement can see these frames and nothing else."""

    def at(m: re.Match) -> str:
        name = m.group(2).lower()
        rest = sql[m.end() :].lstrip()
        alias = "" if re.match(r"(?:AS\s+)?(?!ON\b|USING\b|WHERE\b|GROUP\b|ORDER\b|JOIN\b|LEFT\b|RIGHT\b|INNER\b|CROSS\b|LIMIT\b|HAVING\b|UNION\b|INTERSECT\b|EXCEPT\b)[A-Za-z_]", rest, re.I) else f" AS {name}"
        return f"{m.group(1)}{{{name}}}{alias}"

    parts = re.split(r"('(?:[^'\\]|\\.|'')*')", sql)
    names = "|".join(frames)
    for i in range(0, len(parts), 2):
        sql = parts[i]
        parts[i] = re.sub(rf"((?:\bFROM|\bJOIN|,)\s+)({names})\b(?!\s*\.)", at, sql, flags=re.I)
    return "".join(parts)


def run(spark: SparkSession, frames: Mapping[str, DataFrame], sql: str, seconds: float = 5.0, **kw) -> list:
    """The rows, or Rejected('timeout') once the time is up."""
    df, group = ask(spark, frames, sql, **kw), f"ask-{threading.get_ident()}-{id(sql)}"
    sc = spark.sparkContext
    sc.setJobGroup(group, "ad-hoc statement", interruptOnCancel=True)
    late = threading.Timer(seconds, lambda: sc.cancelJobGroup(group))
    late.start()
    try:
        return df.collect()
    except Exception as e:
        if not late.is_alive():
            raise Rejected("timeout") from e
        raise
    finally:
        late.cancel()
        sc.setJobGroup("", "")


def normal_question(text: str, most: int = 500) -> tuple[str, str]:
    """The question with white space folded and cut, and the key under which its answer is kept."""
    q = " ".join(text.split())[:most]
    return q, hashlib.sha256(q.lower().encode()).hexdigest()
