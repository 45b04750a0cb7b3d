"""Queries of the training-data operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import boilerplate, encoding, mixing, packing
from pressloom.llm import near_duplicates as nd
from pressloom.llm import percentiles as pct
from pressloom.llm import shared_spans as ss
from pressloom.llm import text_quality as tq
from pressloom.llm.sizes import tokens
from pressloom.session import settle, table

#: TESTDATA.md sets one half for the reprints of problem 1.
REPRINT = nd.Spec(k=5, least=Fraction(1, 2), min_words=25)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nd.pairs_of(table(spark, d, "classify_cluster"), "id", ("title", "body_excerpt"), REPRINT)


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return nd.groups_of(table(spark, d, "classify_cluster"), "id", ("title", "body_excerpt"), REPRINT)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ss.spans_of(table(spark, d, "classify_cluster"), "id", "body_excerpt")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each excerpt is shared, beside what the sources view says of it."""
    told = table(spark, d, "ask_sources").groupBy(F.col("source_id").alias("id")).agg(F.max("is_reprint").alias("is_reprint"))
    return ss.shares_of(table(spark, d, "classify_cluster"), "id", "body_excerpt").join(told, "id", "left")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "maemgaba_ai_call_log").filter("success = 1")
    return calls.select("id", "operation", "model", "latency_ms", F.to_date(F.timestamp_seconds("created")).alias("day"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pct.wide_groups(_calls(spark, d), ["operation", "model"], "latency_ms", "id", 0.5, 0.95, 5)


def p3_daily(spark: SparkSession, d: str) -> DataFrame:
    keys, spec = ["operation", "model", "day"], pct.Spec(fan=4)
    return pct.answers(pct.sketch(_calls(spark, d), keys, "latency_ms", spec, "id"), keys, (0.5, 0.9, 0.95, 0.99), spec)


def p3_models(spark: SparkSession, d: str) -> DataFrame:
    """The daily sketches added up over days and operations."""
    spec = pct.Spec(fan=4)
    daily = pct.sketch(_calls(spark, d), ["operation", "model", "day"], "latency_ms", spec, "id")
    return pct.answers(pct.merge(daily, ["model"], spec), ["model"], (0.5, 0.9, 0.95, 0.99), spec)


def p3_inside(spark: SparkSession, d: str) -> DataFrame:
    """Whether the exact percentiles lie inside the brackets that the sketches give, per operation and model, with days added up."""
    keys, spec, calls = ["operation", "model"], pct.Spec(fan=4), _calls(spark, d)
    daily = pct.sketch(calls, [*keys, "day"], "latency_ms", spec, "id")
    told = pct.answers(pct.merge(daily, keys, spec), keys, (0.5, 0.95), spec).select(*[F.col(k).alias(f"_{k}") for k in keys], "n", *[f"{p}_{e}" for p in ("p50", "p95") for e in ("least", "greatest")])
    exact = calls.filter("latency_ms IS NOT NULL").select("id", *keys, "latency_ms").distinct().groupBy(*keys).agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY latency_ms)").alias(c) for q, c in ((0.5, "x50"), (0.95, "x95"))])
    both = exact.join(told, [exact[k].eqNullSafe(told[f"_{k}"]) for k in keys])
    return both.select(*keys, "n", F.col("x50").between(F.col("p50_least"), F.col("p50_greatest")).alias("p50_inside"), F.col("x95").between(F.col("p95_least"), F.col("p95_greatest")).alias("p95_inside"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.damaged(table(spark, d, "classify_cluster"), "id", ("title", "body_excerpt")).select("id", "field")


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.damaged(table(spark, d, "classify_cluster"), "id", ("title", "body_excerpt"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_lines(table(spark, d, "ingestion_engine"))


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_text(table(spark, d, "ingestion_engine"))


def _packs(spark: SparkSession, d: str) -> dict[str, int]:
    """The container sizes: a list kept by hand, of a few rows."""
    return {r["pack_name"]: int(r["capacity_tokens"]) for r in table(spark, d, "pack_sizes").filter("capacity_tokens > 0").orderBy("pack_name").collect()}


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return settle(table(spark, d, "documents").select("doc_id", "source", tokens("n_tokens", "text").alias("n")), "sizes")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), _packs(spark, d))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    packs = _packs(spark, d)
    return packing.fill(packing.pack(_sizes(spark, d), packs), packs)


def p6_valid(spark: SparkSession, d: str) -> DataFrame:
    """Per pack, what any valid packing must meet: documents and tokens placed, none in a container too small, none cut that would fit."""
    packs = _packs(spark, d)
    out = packing.pack(_sizes(spark, d), packs)
    cap = F.create_map(*[x for k, v in packs.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col("pack_name")]
    full = out.groupBy("pack_name", "container").agg(F.sum("tokens").alias("used")).groupBy("pack_name").agg(F.max("used").alias("fullest"))
    docs = out.groupBy("pack_name", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    per = docs.groupBy("pack_name").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.sum(F.when((F.col("pieces") > 1) & (F.col("tokens") <= cap), 1).otherwise(0)).alias("cut_in_vain"))
    return per.join(full, "pack_name").select("pack_name", "documents", "tokens", "cut_in_vain", (F.col("fullest") <= cap).alias("fits"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    return mixing.report(mixing.mix(sizes, targets), sizes, targets)


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """The shares where the mix is to be as large as all listed documents together: small sources end at their cap and fall short."""
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    total = sizes.join(targets.select("source").distinct(), "source", "left_semi").agg(F.sum("n")).first()[0] or 0
    return mixing.report(mixing.mix(sizes, targets, total), sizes, targets, total)


def p7_valid(spark: SparkSession, d: str) -> DataFrame:
    """Per listed source, what any valid mix must meet: all its documents have a row, none is used more often than it may be."""
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    m = mixing.mix(sizes, targets).join(targets.select("source", "max_repeats"), "source")
    return m.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.max(F.col("uses") > F.col("max_repeats")).alias("beyond"), F.min(F.col("uses") >= 0).alias("whole"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return tq.no_prose(tq.quality(table(spark, d, "documents"), table(spark, d, "doc_labels"), once=False))


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    return tq.quality(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """The figures of p8_stats that SQL can count too."""
    return p8_stats(spark, d).select("doc_id", "chars", "lines", "words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


#: Words, sets of five-word sequences, and pairs by the sequences they share.
_P1 = """
    WITH t AS (SELECT id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(body_excerpt, '')), '[\\p{L}\\p{N}]+') AS w FROM (SELECT DISTINCT id, title, body_excerpt FROM classify_cluster)),
    s AS (SELECT id, list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS sh FROM t WHERE len(w) >= 25),
    e AS (SELECT id, len(sh) AS n, unnest(sh) AS g FROM s),
    p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS o, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
    SELECT id_a, id_b FROM p WHERE 2 * o >= na + nb - o
"""

#: Classes of equal texts, their links, and the least class that links lead to.
_P1_GROUPS = f"""
    WITH RECURSIVE pairs AS ({_P1}), d AS (SELECT DISTINCT id, coalesce(title, '') || ' ' || coalesce(body_excerpt, '') AS t FROM classify_cluster),
    m AS (SELECT id, min(id) OVER (PARTITION BY t) AS class_id, count(*) OVER (PARTITION BY t) AS copies FROM d),
    l AS (SELECT DISTINCT a.class_id AS x, b.class_id AS y FROM pairs p JOIN m a ON a.id = p.id_a JOIN m b ON b.id = p.id_b WHERE a.class_id <> b.class_id),
    e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    r AS (SELECT x AS v, x AS c FROM e UNION SELECT r.v, e.y FROM r JOIN e ON e.x = r.c),
    g AS (SELECT v, min(c) AS c FROM r GROUP BY v), n AS (SELECT x AS v, count(*) AS links FROM e GROUP BY x)
    SELECT m.id, m.class_id, coalesce(g.c, m.class_id) AS group_id, coalesce(n.links, 0)::BIGINT AS links, m.copies FROM m LEFT JOIN g ON g.v = m.class_id LEFT JOIN n ON n.v = m.class_id
"""

#: Documents with their sizes in tokens, recounted where unknown.
_SIZES = "(SELECT DISTINCT doc_id, source, coalesce(n_tokens, len(regexp_extract_all(coalesce(text, ''), '\\p{L}{1,6}|\\p{N}{1,3}|[^\\p{L}\\p{N}\\s]')))::BIGINT AS n FROM documents)"

#: Runs of 20 words held by two ids, the words they cover, and the unbroken stretches of these.
_P2 = """t AS (SELECT id, list_filter(string_split_regex(coalesce(body_excerpt, ''), '[ \n]'), lambda x: x <> '') AS w FROM (SELECT DISTINCT id, body_excerpt FROM classify_cluster)),
    r AS (SELECT id, i - 1 AS pos, array_to_string(w[i:i+19], ' ') AS run FROM (SELECT id, w, unnest(range(1, len(w) - 18)) AS i FROM t)),
    h AS (SELECT id, pos FROM r WHERE run IN (SELECT run FROM r GROUP BY run HAVING count(DISTINCT id) > 1)),
    m AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY id ORDER BY pos) + 20 THEN 0 ELSE 1 END AS head FROM h),
    k AS (SELECT *, sum(head) OVER (PARTITION BY id ORDER BY pos) AS isle FROM m),
    f AS (SELECT id, min(pos)::INT AS start_word, (max(pos) + 20)::INT AS end_word FROM k GROUP BY id, isle)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p2_found": f"WITH {_P2} SELECT * FROM f",
        "p2_shares": f"""WITH {_P2}, g AS (SELECT id, count(*) AS spans, sum(end_word - start_word)::BIGINT AS shared_words FROM f GROUP BY id), q AS (SELECT source_id, max(is_reprint) AS is_reprint FROM ask_sources GROUP BY 1)
            SELECT t.id, len(t.w)::INT AS words, coalesce(spans, 0)::BIGINT AS spans, coalesce(shared_words, 0)::BIGINT AS shared_words, CASE WHEN len(t.w) > 0 THEN coalesce(shared_words, 0) / len(t.w) ELSE 0.0 END AS shared_share, q.is_reprint
            FROM t LEFT JOIN g USING (id) LEFT JOIN q ON q.source_id = t.id""",
        "p1_groups": _P1_GROUPS,
        "p3_inside": """
            SELECT operation, model, count(*) AS n, true AS p50_inside, true AS p95_inside
            FROM (SELECT DISTINCT id, operation, model, latency_ms FROM maemgaba_ai_call_log WHERE success = 1 AND latency_ms IS NOT NULL) GROUP BY ALL
        """,
        "p6_valid": f"SELECT pack_name, count(*) AS documents, sum(n)::BIGINT AS tokens, 0::BIGINT AS cut_in_vain, true AS fits FROM {_SIZES}, pack_sizes GROUP BY pack_name",
        "p7_valid": f"SELECT source, count(*) AS docs, sum(n)::BIGINT AS tokens, false AS beyond, true AS whole FROM {_SIZES} JOIN mix_targets USING (source) GROUP BY source",
        "p8_counts": """
            SELECT doc_id, length(t)::BIGINT AS chars, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')))::BIGINT AS lines,
                   len(regexp_extract_all(t, '[\\p{L}\\p{M}]+'))::BIGINT AS words
            FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents)
        """,
        "p3_found": """
            WITH c AS (SELECT DISTINCT id, operation, model, latency_ms FROM maemgaba_ai_call_log WHERE success = 1 AND latency_ms IS NOT NULL),
            r AS (SELECT operation, model, latency_ms, row_number() OVER (PARTITION BY operation, model ORDER BY latency_ms) AS i,
                         count(*) OVER (PARTITION BY operation, model) AS n FROM c)
            SELECT operation, model FROM r GROUP BY operation, model
            HAVING min(latency_ms) FILTER (WHERE 100 * i >= 95 * n) >= 5 * min(latency_ms) FILTER (WHERE 100 * i >= 50 * n)
        """,
    }
