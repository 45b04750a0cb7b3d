"""More queries by name: the rest of the language's functions, and operators that the catalog doesn't show."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.functions import scores
from pressloom.functions import spectrum as sp
from pressloom.operators import dedup, evals, reports, retrieval, views
from pressloom.plans.catalog import CARDS, COS, EVENTS, FEEDS, PAIRS, STORIES, TODAY, _pairs, asked, query, words_sql
from pressloom.session import table
from pressloom.sources import feeds as feeds_
from pressloom.sources import pages
from pressloom.streaming import flows, pipeline

# The language

asked("sql_powers", "SELECT day, CEILING(sources / 7) AS c, POW(stories, 2) AS p2, POWER(stories, 3) AS p3, ROUND(EXP(stories / 100), 4) AS e, ROUND(LOG(sources + 1), 4) AS l, ROUND(LOG(2, sources + 1), 4) AS l2, ROUND(LOG10(sources + 1), 4) AS l10 FROM ask_daily ORDER BY day LIMIT 200", "SELECT day, CEIL(sources / 7)::BIGINT AS c, POW(stories, 2) AS p2, POW(stories, 3) AS p3, ROUND(EXP(stories / 100), 4) AS e, ROUND(LN(sources + 1), 4) AS l, ROUND(LN(sources + 1) / LN(2), 4) AS l2, ROUND(LOG10(sources + 1), 4) AS l10 FROM ask_daily ORDER BY day LIMIT 200")
asked("sql_aggregates", "SELECT topic, MIN(score) AS least_, MAX(day) AS latest, ROUND(STDDEV(score), 4) AS sd, ROUND(STDDEV_POP(score), 4) AS sp, ROUND(VAR_POP(score), 4) AS vp, ROUND(VAR_SAMP(score), 4) AS vs FROM ask_sources GROUP BY topic", "SELECT topic, MIN(score) AS least_, MAX(day) AS latest, ROUND(stddev_pop(score), 4) AS sd, ROUND(stddev_pop(score), 4) AS sp, ROUND(var_pop(score), 4) AS vp, ROUND(var_samp(score), 4) AS vs FROM ask_sources GROUP BY topic")
asked(
    "sql_text_functions",
    "SELECT DISTINCT COALESCE(prior_bucket, 'none') AS b, CONCAT(section, ':', outlet) AS c, INSTR(outlet, 'e') AS i, LCASE(outlet) AS lc, LOWER(section) AS lo, UCASE(section) AS uc, LTRIM(CONCAT('  ', section)) AS lt, RTRIM(CONCAT(section, '  ')) AS rt, RPAD(section, 9, '*') AS rp, SUBSTR(outlet, 2) AS sb, TRIM(CONCAT(' ', section, ' ')) AS t, TRIM(LEADING 'n' FROM section) AS tl, TRIM(TRAILING 's' FROM section) AS tt, TRIM(BOTH 'n' FROM section) AS tb FROM ask_outlets",
    "SELECT DISTINCT COALESCE(prior_bucket, 'none') AS b, section || ':' || outlet AS c, INSTR(outlet, 'e')::INT AS i, LOWER(outlet) AS lc, LOWER(section) AS lo, UPPER(section) AS uc, section AS lt, section AS rt, RPAD(section, 9, '*') AS rp, SUBSTRING(outlet, 2) AS sb, section AS t, LTRIM(section, 'n') AS tl, RTRIM(section, 's') AS tt, TRIM(section, 'n') AS tb FROM ask_outlets",
)
asked("sql_now", "SELECT COUNT(*) AS n, SUM(IF(published_at <= NOW(), 1, 0)) AS before_now, SUM(IF(published_at > CURRENT_TIMESTAMP, 1, 0)) AS after_, SUM(IF(day = CURRENT_DATE, 1, 0)) AS today_ FROM ask_sources", f"SELECT COUNT(*) AS n, SUM((published_at <= TIMESTAMP '{TODAY}')::INT)::BIGINT AS before_now, SUM((published_at > TIMESTAMP '{TODAY}')::INT)::BIGINT AS after_, SUM((day = DATE '{TODAY}')::INT)::BIGINT AS today_ FROM ask_sources")
asked(
    "sql_date_parts",
    "SELECT source_id, DATE(published_at) AS d, DATE_ADD(day, INTERVAL 1 MONTH) AS m, DAY(day) AS dd, DAYOFMONTH(day) AS dm, DAYOFYEAR(day) AS dy, HOUR(published_at) AS h, MINUTE(published_at) AS mi, MONTH(day) AS mo, YEAR(day) AS y, SUBDATE(day, 3) AS s, DATE(TIMESTAMPADD(DAY, 2, day)) AS t, DATE(STR_TO_DATE('2026-03-04', '%Y-%m-%d')) AS sd FROM ask_sources ORDER BY source_id LIMIT 200",
    "SELECT source_id, published_at::DATE AS d, (day + INTERVAL 1 MONTH)::DATE AS m, day(day)::INT AS dd, day(day)::INT AS dm, dayofyear(day)::INT AS dy, hour(published_at)::INT AS h, minute(published_at)::INT AS mi, month(day)::INT AS mo, year(day)::INT AS y, (day - 3)::DATE AS s, (day + 2)::DATE AS t, DATE '2026-03-04' AS sd FROM ask_sources ORDER BY source_id LIMIT 200",
)
asked(
    "sql_partitioned_frames",
    "SELECT topic, story_id, SUM(source_count) OVER (PARTITION BY topic ORDER BY story_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS a, LAST_VALUE(story_id) OVER (PARTITION BY topic ORDER BY story_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z, COUNT(*) OVER (PARTITION BY topic ORDER BY source_count RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near_ FROM ask_stories ORDER BY story_id LIMIT 200",
    "SELECT topic, story_id, SUM(source_count) OVER (PARTITION BY topic ORDER BY story_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING)::BIGINT AS a, LAST_VALUE(story_id) OVER (PARTITION BY topic ORDER BY story_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z, COUNT(*) OVER (PARTITION BY topic ORDER BY source_count RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near_ FROM ask_stories ORDER BY story_id LIMIT 200",
)
asked(
    "sql_casts",
    "SELECT source_id, CAST(CAST(score + 5 AS UNSIGNED) AS SIGNED) AS u, CAST(score AS CHAR) AS c, CAST(outlet AS CHAR(4)) AS c4, CAST(CAST(score AS DECIMAL(6,2)) AS CHAR) AS de, CAST(published_at AS DATE) AS d, DATE_FORMAT(CAST(published_at AS DATETIME), '%Y-%m-%d %H') AS dt, CAST(published_at AS TIME) AS t, CAST(score AS DOUBLE) AS f, CAST(CAST(score AS FLOAT) AS DOUBLE) AS g FROM ask_sources ORDER BY source_id LIMIT 200",
    "SELECT source_id, (score + 5)::BIGINT AS u, score::VARCHAR AS c, left(outlet, 4) AS c4, score::DECIMAL(6,2)::VARCHAR AS de, published_at::DATE AS d, strftime(published_at, '%Y-%m-%d %H') AS dt, strftime(published_at, '%H:%M:%S') AS t, score::DOUBLE AS f, score::DOUBLE AS g FROM ask_sources ORDER BY source_id LIMIT 200",
)
asked(
    "sql_compound_intervals",
    "SELECT SUM(IF(published_at >= NOW() - INTERVAL '10 12' DAY_HOUR, 1, 0)) AS a, SUM(IF(published_at >= DATE_SUB(NOW(), INTERVAL '1-2' YEAR_MONTH), 1, 0)) AS b, SUM(IF(published_at > NOW() - INTERVAL '20:30' HOUR_MINUTE, 1, 0)) AS c, SUM(IF(day >= CURDATE() - INTERVAL 1 QUARTER, 1, 0)) AS d, SUM(IF(published_at > NOW() - INTERVAL 3 WEEK - INTERVAL 500000 MICROSECOND, 1, 0)) AS e FROM ask_sources",
    f"SELECT SUM((published_at >= TIMESTAMP '{TODAY}' - INTERVAL 252 HOUR)::INT)::BIGINT AS a, SUM((published_at >= TIMESTAMP '{TODAY}' - INTERVAL 14 MONTH)::INT)::BIGINT AS b, SUM((published_at > TIMESTAMP '{TODAY}' - INTERVAL 1230 MINUTE)::INT)::BIGINT AS c, SUM((day >= DATE '{TODAY}' - INTERVAL 3 MONTH)::INT)::BIGINT AS d, SUM((published_at > TIMESTAMP '{TODAY}' - INTERVAL 21 DAY - INTERVAL 500000 MICROSECOND)::INT)::BIGINT AS e FROM ask_sources",
)

# What the gate says to statements of each kind: (statement, reason), the reason empty for those let through
GATED = [
    ("", "empty"), ("SELECT day FROM ask_daily WHERE day = '" + "9" * 4000 + "'", "too_long"), ("SELECT day FROM ask_daily WHERE stories ≠ 1", "non_ascii"), ("SELECT day -- all\nFROM ask_daily", "comment"),
    ('SELECT "day" FROM ask_daily', "double_quote"), ("SELECT `stories` FROM ask_daily", "backtick"), ("SELECT [day] FROM ask_daily", "brace"), ("SELECT @n FROM ask_daily", "variable"), ("SELECT day FROM ask_daily WHERE day = ?", "placeholder"),
    ("SELECT \\N FROM ask_daily", "backslash"), ("SELECT stories ^ 2 FROM ask_daily", "bad_char"), ("SELECT day FROM ask_daily WHERE 'x", "unterminated_string"), ("SELECT (day FROM ask_daily", "unbalanced_parens"), ("SELECT day FROM ask_daily; SELECT 1", "multiple_statements"),
    ("DELETE FROM ask_daily", "not_select"), ("WITH x SELECT 1", "not_select"), ("SELECT day FROM ask_daily FOR UPDATE", "denied_keyword"), ("SELECT RAND() FROM ask_daily", "function_not_allowed"), ("SELECT source_id FROM cards", "table_not_allowed"),
    ("SELECT day FROM ask_daily, feeds", "table_not_allowed"), ("WITH ask_daily AS (SELECT 1 AS n) SELECT n FROM ask_daily", "cte_shadows_view"), ("SELECT other.day FROM ask_daily", "qualified_name"), ("SELECT body FROM ask_daily", "unknown_identifier"),
    ("SELECT day FROM ask_daily LIMIT 9999", "limit_too_high"), ("SELECT day FROM ask_daily LIMIT 1 + 1", "limit_invalid"),
    ("SELECT day FROM ask_daily", ""), ("SELECT d.day AS x FROM ask_daily AS d JOIN ask_sources s ON s.day = d.day LIMIT 5", ""), ("WITH t (a) AS (SELECT day FROM ask_daily) SELECT a FROM t", ""), ("SELECT EXTRACT(YEAR FROM day) AS y FROM (SELECT day FROM ask_daily) q", ""),
]


@query("gate_reasons", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r}')" for i, (_, r) in enumerate(GATED)) + ") v(n, reason)")
def _(spark, d):
    from pressloom.plans.gate import Gate

    gate = Gate(views.columns(sp.FIVE))
    return spark.createDataFrame([(i, gate.check(s).reason) for i, (s, _) in enumerate(GATED)], "n int, reason string")


# Joins and lists


@query("store_item_feeds", f"SELECT item_id, min(feed_id) AS feed_id FROM (SELECT item_id, lower(regexp_extract(link, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS h FROM (SELECT DISTINCT * FROM ingestion_engine)) i JOIN (SELECT feed_id, array_to_string(list_slice(l, greatest(len(l) - 1, 1), len(l)), '.') AS domain FROM (SELECT feed_id, string_split(lower(regexp_extract(feed_url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '.') AS l FROM {FEEDS})) f ON domain <> '' AND domain NOT IN ('feedburner.com', 'feedblitz.com', 'rss.app') AND (h = domain OR ends_with(h, '.' || domain)) GROUP BY 1")
def _(spark, d):
    i, f = views.once(table(spark, d, "ingestion_engine"), "item_id"), views.once(table(spark, d, "feeds"), "feed_id")
    return feeds_.by_host(i, "link", f, "feed_url").groupBy("item_id").agg(F.min("_feed_id").alias("feed_id"))


@query("feed_extracted", f"SELECT item_id, CASE WHEN p >= 80 THEN 'page' WHEN f >= 80 THEN 'feed_body' ELSE 'abstract' END AS method, CASE WHEN p >= 80 OR f >= 80 THEN 0 ELSE 1 END AS is_partial, CASE WHEN p >= 80 THEN '' WHEN skip THEN 'feed is partial' WHEN NOT has THEN 'no article found' WHEN f >= 80 THEN '' ELSE 'page has ' || p || ' words' END AS note FROM (SELECT item_id, skip, has, CASE WHEN skip THEN 0 ELSE p END AS p, f FROM (SELECT i.item_id, coalesce(fd.partial_text, 0) = 1 AS skip, i.method IN ('page', 'legacy') AND coalesce(i.body, '') <> '' AS has, CASE WHEN i.method IN ('page', 'legacy') THEN len({words_sql('i.body')}) ELSE 0 END AS p, CASE WHEN i.method = 'feed_body' THEN len({words_sql('i.body')}) ELSE 0 END AS f FROM (SELECT DISTINCT * FROM ingestion_engine) i LEFT JOIN {FEEDS} fd USING (feed_id)))")
def _(spark, d):
    i = views.once(table(spark, d, "ingestion_engine"), "item_id").join(views.once(table(spark, d, "feeds"), "feed_id").select("feed_id", F.col("partial_text").alias("_p")), "feed_id", "left")
    items = i.select("item_id", F.when(F.col("method").isin("page", "legacy"), F.col("body")).alias("page"), F.when(F.col("method") == "feed_body", F.col("body")).alias("feed"), "abstract", (F.coalesce("_p", F.lit(0)) == 1).alias("skip_page"), F.lit(True).alias("allow"), F.lit(None).cast("string").alias("error"))
    return pages.extracted(items).select("item_id", "method", "is_partial", "note")


@query("report_top_members", f"SELECT story_id, (story_id IN (SELECT story_id FROM (SELECT s.story_id, count(c.source_id) AS n FROM {STORIES} s LEFT JOIN {CARDS} c USING (story_id) GROUP BY 1) ORDER BY n DESC, story_id LIMIT 20)) AS top FROM {STORIES}")
def _(spark, d):
    n = reports.story_card_counts(table(spark, d, "stories"), table(spark, d, "cards"))
    return reports.in_top(n, "story_id", "cards", 20).select("story_id", "top")


RATED = f"(SELECT c.story_id, c.relevance, c.outlet, c.topic, c.source_id, (c.syndicated_from IS NULL AND coalesce(c.section, 'news') <> 'opinion' AND c.score IS NOT NULL) AS perspective FROM (SELECT *, CASE WHEN score IS NULL THEN NULL WHEN abs(score) = 2 THEN 'relevant' WHEN score = 0 THEN 'maybe' ELSE 'irrelevant' END AS relevance FROM {CARDS}) c WHERE c.story_id IS NOT NULL AND c.status = 1)"


@query("report_relevance_rollup", f"WITH k AS {RATED}, g AS (SELECT story_id, count(*) AS n, count(relevance) AS rated, count(*) FILTER (WHERE relevance = 'relevant') AS r, count(*) FILTER (WHERE relevance = 'maybe') AS m, count(DISTINCT CASE WHEN perspective THEN outlet END) AS o FROM k GROUP BY 1), t AS (SELECT story_id, topic FROM (SELECT story_id, topic, row_number() OVER (PARTITION BY story_id ORDER BY count(*) DESC, min(source_id)) AS p FROM k WHERE topic IS NOT NULL AND relevance IS NOT NULL GROUP BY story_id, topic) WHERE p = 1) SELECT s.story_id, coalesce(g.n, 0)::BIGINT AS card_count, CASE WHEN coalesce(g.rated, 0) = 0 THEN s.relevance WHEN g.r > 0 OR g.m > 0 AND g.o >= 2 THEN 'relevant' WHEN g.m > 0 THEN 'maybe' ELSE 'irrelevant' END AS relevance, CASE WHEN coalesce(g.rated, 0) = 0 THEN s.topic ELSE coalesce(t.topic, s.topic) END AS topic FROM {STORIES} s LEFT JOIN g USING (story_id) LEFT JOIN t USING (story_id)")
def _(spark, d):
    # the tables have no relevance per card: the score stands in for it
    rated = F.when(F.abs("score") == 2, "relevant").when(F.col("score") == 0, "maybe").when(F.col("score").isNotNull(), "irrelevant")
    c = views.once(table(spark, d, "cards"), "source_id").filter("status = 1").withColumn("relevance", rated)
    return reports.relevance_rollup(views.once(table(spark, d, "stories"), "story_id"), c).select("story_id", "card_count", "relevance", "topic")


@query("report_eval_cost", "SELECT operation, count(*) AS attempts, count(DISTINCT call_group) AS calls, sum(CASE WHEN success = 0 THEN 1 ELSE 0 END)::BIGINT AS failures, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens FROM (SELECT DISTINCT * FROM maemgaba_ai_call_log) WHERE context_type = 'eval' GROUP BY 1")
def _(spark, d):
    return reports.context_cost(table(spark, d, "maemgaba_ai_call_log"), "eval", 0)


VIEWED = "(SELECT user_id % 400 AS story_id, count(*) AS views FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-10' GROUP BY 1)"
CLICKED = "(SELECT event_id % 3000 AS card_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10')"


@query("report_click_buckets", f"WITH c AS (SELECT source_id AS card_id, story_id, outlet, score FROM {CARDS} WHERE status = 1), k AS (SELECT outlet, score, count(*) AS clicks FROM {CLICKED} x JOIN c USING (card_id) GROUP BY 1, 2), i AS (SELECT outlet, score, sum(views) AS impressions FROM c JOIN {VIEWED} v USING (story_id) GROUP BY 1, 2) SELECT outlet, score, coalesce(clicks, 0)::BIGINT AS clicks, coalesce(impressions, 0)::BIGINT AS impressions, CASE WHEN impressions > 0 THEN floor((2000 * coalesce(clicks, 0) + impressions) / (2 * impressions)) / 10 END AS ctr FROM (SELECT coalesce(k.outlet, i.outlet) AS outlet, coalesce(k.score, i.score) AS score, clicks, impressions FROM k FULL JOIN i ON k.outlet IS NOT DISTINCT FROM i.outlet AND k.score IS NOT DISTINCT FROM i.score)")
def _(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    clicked = e.filter("event_type = 'click'").select((F.col("event_id") % 3000).alias("card_id"), "at")
    viewed = e.filter("event_type = 'view'").groupBy((F.col("user_id") % 400).alias("story_id"), F.to_date("at").alias("day")).agg(F.count("*").alias("views"))
    c = views.once(table(spark, d, "cards"), "source_id").filter("status = 1").select(F.col("source_id").alias("card_id"), "story_id", "outlet", "score")
    return reports.click_buckets(clicked, viewed, c, "2024-01-10")


@query("search_lookup", "SELECT vec_id AS id, label FROM embeddings WHERE label IN (SELECT label FROM embeddings WHERE vec_id % 97 = 0)")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return retrieval.rows_of(v, v.filter("id % 97 = 0").select("label"), "label").select("id", "label")


@query("search_log", f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT a.vec_id AS query_id, {COS} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS}, b.vec_id) AS p FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT query_id, count(*) AS results, round(1 - min(distance), 3) AS top_similarity FROM r WHERE p <= 10 GROUP BY 1")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.search_log(retrieval.nearest_join(v, v.filter("id % 50 = 0"))).select("query_id", "results", F.round("top_similarity", 3).alias("top_similarity"))


@query("search_recent", f"SELECT story_id, NULL::DOUBLE AS similarity FROM {STORIES} WHERE created > (SELECT max(created) FROM stories) - 86400")
def _(spark, d):
    s = views.once(table(spark, d, "stories"), "story_id")
    return retrieval.recent(s, s.agg(F.max("created")).first()[0] or 0).select("story_id", "similarity")


@query("dedup_wires", f"SELECT source_id, trim(outlet) AS wire FROM {CARDS} WHERE contains(lower(coalesce(outlet, '')), 'wire') AND syndicated_from IS NULL")
def _(spark, d):
    c = views.once(table(spark, d, "cards"), "source_id").withColumn("wire", F.when(F.contains(F.lower(F.coalesce("outlet", F.lit(""))), F.lit("wire")), F.trim("outlet")))
    return dedup.wires_of(c, c.filter("syndicated_from IS NULL").select("source_id"), "source_id", "wire")


@query("flow_queue", "SELECT item_id, place FROM (SELECT item_id, row_number() OVER (ORDER BY fetched_at DESC, item_id)::INT AS place FROM (SELECT DISTINCT * FROM ingestion_engine)) WHERE place <= 25")
def _(spark, d):
    return flows.queue(views.once(table(spark, d, "ingestion_engine"), "item_id"), 25, newest=True).select("item_id", "place")


@query("flow_synthesis_due", f"WITH k AS {RATED} SELECT s.story_id, (len(coalesce(s.common_points, [])) > 0 OR o.n >= 2) AS due FROM {STORIES} s LEFT JOIN (SELECT story_id, count(DISTINCT CASE WHEN perspective THEN outlet END) AS n FROM k GROUP BY 1) o USING (story_id) WHERE coalesce(len(coalesce(s.common_points, [])) > 0 OR o.n >= 2, false)")
def _(spark, d):
    c = views.once(table(spark, d, "cards"), "source_id").filter("status = 1")
    return flows.synthesis_due(views.once(table(spark, d, "stories"), "story_id"), c).select("story_id", F.lit(True).alias("due"))


@query("flow_second_review", f"SELECT count(*) AS reviewed, sum((score IS NOT DISTINCT FROM now)::INT)::BIGINT AS confirmed, sum((score IS DISTINCT FROM now)::INT)::BIGINT AS corrected FROM (SELECT score, CASE WHEN confidence < 0.5 THEN 0 ELSE score END AS now FROM {CARDS} WHERE score IS NOT NULL AND confidence IS NOT NULL)")
def _(spark, d):
    c = views.once(table(spark, d, "cards"), "source_id").filter("score IS NOT NULL AND confidence IS NOT NULL")
    again = c.select("source_id", F.when(F.col("confidence") < 0.5, 0).otherwise(F.col("score")).alias("score"))
    return flows.second_review(c, again, "source_id", "score")


@query("flow_answers", f"SELECT source_id, CASE WHEN partial_text = 1 AND confidence > 0.6 THEN 0.6 ELSE confidence::DOUBLE END AS confidence FROM {CARDS}")
def _(spark, d):
    c = views.once(table(spark, d, "cards"), "source_id")
    return c.select("source_id", scores.capped_confidence(F.col("confidence"), F.col("partial_text"), 0.6).cast("double").alias("confidence"))


# Evaluation


ANSWERS = "(SELECT id AS run, coalesce(success, 0) AS passed, CASE WHEN attempt = 0 THEN 1 ELSE 0 END AS refused, CASE WHEN coalesce(success, 0) = 0 AND attempt > 0 THEN 1 ELSE 0 END AS error, CASE WHEN context_type = 'eval' THEN 0 ELSE 1 END AS hostile, coalesce(latency_ms, 0) AS ms FROM (SELECT DISTINCT * FROM maemgaba_ai_call_log))"


@query("eval_ask_summary", f"SELECT sum((hostile = 0)::INT)::BIGINT AS questions, round(100 * sum(passed) FILTER (WHERE hostile = 0) / sum((hostile = 0)::INT), 1) AS exact_rate, sum(refused) FILTER (WHERE hostile = 0)::BIGINT AS refused, sum(error)::BIGINT AS errors, quantile_disc(ms, 0.5) AS median_ms, max(ms) AS max_ms, sum(refused) FILTER (WHERE hostile = 1)::BIGINT AS hostile_refused FROM {ANSWERS}")
def _(spark, d):
    c = views.once(table(spark, d, "maemgaba_ai_call_log"), "id")
    ok = F.coalesce("success", F.lit(0))
    runs = c.select(ok.alias("passed"), (F.col("attempt") == 0).cast("int").alias("refused"), ((ok == 0) & (F.col("attempt") > 0)).cast("int").alias("error"), F.when(F.col("context_type") == "eval", 0).otherwise(1).alias("hostile"), F.coalesce("latency_ms", F.lit(0)).alias("ms"), F.lit(0.0).alias("cost"))
    return evals.ask_summary(runs).select("questions", "exact_rate", "refused", "errors", F.col("median_ms").cast("long").alias("median_ms"), "max_ms", "hostile_refused")


SEARCHED = f"(WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT a.vec_id AS id, a.label AS want, b.label AS got, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS}, b.vec_id) AS p FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT id, bool_or(want = got AND p = 1) AS hit1, bool_or(want = got AND p <= 3) AS hit3, min(CASE WHEN want = got THEN p END)::INT AS raw_rank FROM r WHERE p <= 10 GROUP BY 1)"


def _searched(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    near = retrieval.nearest_join(v, v.filter("id % 50 = 0")).join(v.select("id", F.col("label").cast("long").alias("found")), "id")
    shown = near.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "found"))), lambda x: x["found"]).alias("raw"))
    runs = shown.join(v.select(F.col("id").alias("query_id"), F.col("label").cast("long").alias("expected")), "query_id")
    return evals.search_verdicts(runs.select(F.col("query_id").alias("id"), "expected", F.array().cast("array<bigint>").alias("also"), "raw", F.col("raw").alias("shown"), F.array().cast("array<bigint>").alias("keyword")))


@query("eval_search_verdicts", f"SELECT * FROM {SEARCHED}")
def _(spark, d):
    return _searched(spark, d).select("id", "hit1", "hit3", F.col("raw_rank").cast("int").alias("raw_rank"))


@query("eval_search_summary", f"SELECT count(*) AS questions, round(avg(hit1::INT), 4) AS hit1_rate, round(avg(hit3::INT), 4) AS hit3_rate FROM {SEARCHED}")
def _(spark, d):
    return evals.search_summary(_searched(spark, d)).select("questions", "hit1_rate", "hit3_rate")


@query("eval_misses", f"SELECT id, side, got_side FROM {PAIRS} WHERE side IS NOT NULL AND side IS DISTINCT FROM got_side ORDER BY id LIMIT 30")
def _(spark, d):
    return evals.misses(_pairs(spark, d), "side", "got_side", "id").select("id", "side", "got_side")


# Flows and their batch twins


@query("stream_flood", "SELECT user_id AS who, count(*) AS calls, sum((n <= 3)::INT)::BIGINT AS allowed FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error') GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("who"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return flows.flood_batch(e, 3, "hour").groupBy("who").agg(F.count("*").alias("calls"), F.sum(F.col("allowed").cast("int")).alias("allowed"))


@query("stream_lookback", "SELECT a.event_id AS id, b.event_id AS of FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id < a.event_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 48 HOUR WHERE a.event_type = 'purchase' AND b.event_type = 'signup'")
def _(spark, d):
    s = lambda kind: flows.read_files(spark, d, "events.parquet", EVENTS).filter(F.col("event_type") == kind).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return flows.run_to_end(flows.lookback_pairs(s("purchase"), s("signup"), 48))


@query("pipeline_counts", f"SELECT count(*) AS processed, count(*) - count(DISTINCT original_url) AS duplicates FROM {CARDS}")
def _(spark, d):
    c = views.once(table(spark, d, "cards"), "source_id").select(F.col("source_id").alias("id"), F.col("original_url").alias("url"), "title", "outlet", "section", "created", F.col("micro_summary").alias("text"))
    none = table(spark, d, "cards").limit(0)
    judge = lambda x: x.select("id", F.lit(0).alias("score"), F.lit(0.5).alias("confidence"), F.lit("general").alias("topic"), F.lit(None).cast("long").alias("story_id"))
    out = pipeline.run_batch(c, none, table(spark, d, "stories").limit(0), none.select("source_id", F.col("micro_summary").alias("text")), judge)
    return out.counts.select("processed", "duplicates")
