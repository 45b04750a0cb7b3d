"""Every query by name, with its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions import scores, text
from pressloom.functions import spectrum as sp
from pressloom.operators import dedup, evals, reports, retrieval, views
from pressloom.plans import ask
from pressloom.session import settle, table
from pressloom.sources import feeds as feeds_
from pressloom.sources import stores
from pressloom.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: The reports' time: all test rows lie before it.
NOW, TODAY = 1783000000, "2026-07-02"
#: Literals of wire bylines and the wires they name.
WIRES = [("Longacre Wire", "Longacre Wire"), ("Quarrel Wire", "Quarrel Wire"), ("Thornbury-on-Lea Wire", "Thornbury-on-Lea Wire")]
B5 = [b.key for b in sp.FIVE]

CARDS = "(SELECT DISTINCT * FROM cards)"
STORIES = "(SELECT DISTINCT * FROM stories)"
FEEDS = "(SELECT DISTINCT * FROM feeds)"
CALLS = "(SELECT DISTINCT * FROM maemgaba_ai_call_log)"


def bucket_sql(c: str) -> str:
    return f"CASE {c} WHEN -2 THEN 'left' WHEN -1 THEN 'lean_left' WHEN 0 THEN 'center' WHEN 1 THEN 'lean_right' WHEN 2 THEN 'right' END"


def counts_sql(p: str = "s.") -> str:
    return ", ".join(f"sum(CASE WHEN {p}is_perspective = 1 AND {p}bucket = '{k}' THEN 1 ELSE 0 END)::BIGINT AS {k}_count" for k in B5)


def _local(c: str) -> str:
    return f"(timezone('America/New_York', to_timestamp({c})))"


VIEWS = f"""ask_sources AS (
  SELECT c.source_id, c.story_id, c.outlet, coalesce(c.section, 'news') AS section, c.score, {bucket_sql("c.score")} AS bucket, c.confidence,
         coalesce(c.partial_text, 0) AS partial_text, (c.syndicated_from IS NOT NULL)::INT AS syndicated, (c.syndicated_from IS NOT NULL AND o.story_id = c.story_id)::INT AS is_reprint,
         (NOT (c.syndicated_from IS NOT NULL AND o.story_id = c.story_id) AND coalesce(c.section, 'news') = 'opinion')::INT AS is_opinion,
         (NOT (c.syndicated_from IS NOT NULL AND o.story_id = c.story_id) AND NOT coalesce(c.section, 'news') = 'opinion' AND c.score IS NOT NULL)::INT AS is_perspective,
         c.topic, {_local("c.created")} AS published_at, {_local("c.created")}::DATE AS day
  FROM {CARDS} c LEFT JOIN {CARDS} o ON o.source_id = c.syndicated_from WHERE c.status = 1),
ask_stories AS (
  SELECT e.story_id, e.title, {_local("e.created")} AS published_at, {_local("e.created")}::DATE AS day, e.topic, e.relevance,
         {", ".join(f"coalesce(a.{n}, 0)::BIGINT AS {n}" for n in ["source_count", "perspective_count", "opinion_count", "reprint_count", "outlet_count", *[f"{k}_count" for k in B5]])},
         (coalesce(e.neutral_summary, '') <> '')::INT AS has_summary, (coalesce(len(e.common_points), 0) > 0 OR coalesce(len(e.disputed_points), 0) > 0)::INT AS has_consensus
  FROM {STORIES} e LEFT JOIN (SELECT s.story_id, count(*) AS source_count, sum(s.is_perspective) AS perspective_count, sum(s.is_opinion) AS opinion_count, sum(s.is_reprint) AS reprint_count,
         count(DISTINCT CASE WHEN s.is_perspective = 1 THEN s.outlet END) AS outlet_count, {counts_sql()} FROM ask_sources s GROUP BY s.story_id) a ON a.story_id = e.story_id WHERE e.status = 1),
ask_outlets AS (
  SELECT outlet, coalesce(section, 'news') AS section, prior_score, {bucket_sql("prior_score")} AS prior_bucket, prior_source, coalesce(active, 0) AS active, coalesce(partial_text, 0) AS partial_text FROM {FEEDS} WHERE status = 1),
ask_daily AS (
  SELECT d.day, {", ".join(f"coalesce({p}, 0)::BIGINT AS {n}" for p, n in [("st.stories", "stories"), ("so.sources", "sources"), ("so.perspectives", "perspectives"), ("so.opinion", "opinion"), *[(f"so.{k}_count", f"{k}_count") for k in B5]])}
  FROM (SELECT day FROM ask_stories UNION SELECT day FROM ask_sources) d LEFT JOIN (SELECT day, count(*) AS stories FROM ask_stories GROUP BY day) st ON st.day = d.day
  LEFT JOIN (SELECT s.day, count(*) AS sources, sum(s.is_perspective) AS perspectives, sum(s.is_opinion) AS opinion, {counts_sql()} FROM ask_sources s GROUP BY s.day) so ON so.day = d.day)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return put


def asked(name: str, statement: str, sql: str | None = None) -> None:
    """An ad-hoc statement through the gate; sql, where the other dialect says it differently."""
    _queries[name] = lambda spark, d: ask.ask(spark, views.from_dir(spark, d), statement, today=TODAY)
    body = sql or statement
    if not body.lstrip().upper().startswith("WITH"):
        _sql[name] = f"WITH {VIEWS} {body}"
    else:
        _sql[name] = f"WITH {VIEWS}, {body.lstrip()[4:]}"


def _plain_types(df: DataFrame) -> DataFrame:
    """Times as text and decimals as doubles."""
    for f in df.schema.fields:
        if f.dataType.typeName() in ("timestamp", "timestamp_ntz"):
            df = df.withColumn(f.name, F.date_format(f.name, "yyyy-MM-dd HH:mm:ss"))
        elif f.dataType.typeName() == "decimal":
            df = df.withColumn(f.name, F.col(f.name).cast("double"))
    return df


# The views

TIME = "strftime(published_at, '%Y-%m-%d %H:%M:%S')"
for _v, _more in (("ask_sources", f"* REPLACE ({TIME} AS published_at, confidence::DOUBLE AS confidence)"), ("ask_stories", f"* REPLACE ({TIME} AS published_at)"), ("ask_outlets", "*"), ("ask_daily", "*")):
    _queries[f"view_{_v}"] = lambda spark, d, v=_v: _plain_types(views.from_dir(spark, d)[v])
    _sql[f"view_{_v}"] = f"WITH {VIEWS} SELECT {_more} FROM {_v}"

# Ad-hoc questions

asked("ask_story_count", "SELECT COUNT(*) AS n FROM ask_stories")
asked("ask_lines", "SELECT outlet, prior_bucket FROM ask_outlets WHERE section = 'news' ORDER BY outlet")
asked("ask_outlet_sections", "SELECT section, COUNT(*) AS n FROM ask_sources WHERE outlet = 'Longacre Wire' GROUP BY section ORDER BY section")
asked("ask_most_outlets", "SELECT title FROM ask_stories ORDER BY outlet_count DESC, story_id ASC LIMIT 1")
asked("ask_per_bucket", "SELECT bucket, COUNT(*) AS n FROM ask_sources WHERE is_perspective = 1 GROUP BY bucket ORDER BY bucket")
asked("ask_busiest_day", "SELECT day FROM ask_daily ORDER BY stories DESC, day ASC LIMIT 1")
asked("ask_consensus_titles", "SELECT title FROM ask_stories WHERE topic = 'economy' AND has_consensus = 1 ORDER BY source_count DESC, story_id LIMIT 50")
asked("ask_off_line", "SELECT COUNT(*) AS n FROM ask_sources s JOIN ask_outlets o ON o.outlet = s.outlet AND o.section = s.section WHERE s.outlet = 'Longacre Wire' AND s.bucket <> o.prior_bucket")
asked("ask_reprint_share", "SELECT SUM(is_reprint) AS reprints, COUNT(*) AS n FROM ask_sources", "SELECT SUM(is_reprint)::BIGINT AS reprints, COUNT(*) AS n FROM ask_sources")
asked("ask_topics", "SELECT topic, COUNT(*) AS n FROM ask_stories GROUP BY topic ORDER BY topic")

# The language: predicates, joins, aggregates, windows, set operators, functions

asked("sql_xor", "SELECT COUNT(*) AS n FROM ask_sources WHERE score > 0 XOR section = 'opinion'", "SELECT COUNT(*) AS n FROM ask_sources WHERE (score > 0) <> (section = 'opinion')")
asked("sql_null_safe", "SELECT COUNT(*) AS n FROM ask_sources WHERE score <=> NULL", "SELECT COUNT(*) AS n FROM ask_sources WHERE score IS NOT DISTINCT FROM NULL")
asked("sql_like_escape", "SELECT COUNT(*) AS n FROM ask_stories WHERE title LIKE '%grain quota%' OR title LIKE 'Why%' ESCAPE '!'")
asked("sql_between_in", "SELECT topic, COUNT(*) AS n FROM ask_sources WHERE score BETWEEN -1 AND 1 AND topic IN ('economy','health') GROUP BY topic")
asked("sql_div_mod", "SELECT 17 DIV 5 AS a, 17 MOD 5 AS b, 17 % 5 AS c, COUNT(*) AS n FROM ask_outlets", "SELECT 17 // 5 AS a, 17 % 5 AS b, 17 % 5 AS c, COUNT(*) AS n FROM ask_outlets")
asked("sql_case_cast", "SELECT CASE WHEN score < 0 THEN 'left' ELSE 'other' END AS side, COUNT(*) AS n, CAST(SUM(score) AS SIGNED) AS total FROM ask_sources GROUP BY side", "SELECT CASE WHEN score < 0 THEN 'left' ELSE 'other' END AS side, COUNT(*) AS n, SUM(score)::BIGINT AS total FROM ask_sources GROUP BY side")
asked("sql_any", "SELECT COUNT(*) AS n FROM ask_sources WHERE score = ANY (SELECT prior_score FROM ask_outlets WHERE section = 'opinion')")
asked("sql_some_greater", "SELECT COUNT(*) AS n FROM ask_sources WHERE score > SOME (SELECT prior_score FROM ask_outlets WHERE prior_score >= 0)", "SELECT COUNT(*) AS n FROM ask_sources WHERE score > ANY (SELECT prior_score FROM ask_outlets WHERE prior_score >= 0)")
asked("sql_exists", "SELECT COUNT(*) AS n FROM ask_stories st WHERE EXISTS (SELECT 1 FROM ask_sources s WHERE s.story_id = st.story_id AND s.is_opinion = 1)")
asked("sql_not_in", "SELECT COUNT(*) AS n FROM ask_stories WHERE story_id NOT IN (SELECT story_id FROM ask_sources WHERE story_id IS NOT NULL)")
asked("sql_scalar_subquery", "SELECT COUNT(*) AS n FROM ask_stories WHERE source_count > (SELECT AVG(source_count) FROM ask_stories)")
asked("sql_left_join", "SELECT o.section, COUNT(s.source_id) AS n FROM ask_outlets o LEFT JOIN ask_sources s ON s.outlet = o.outlet AND s.section = o.section GROUP BY o.section")
asked("sql_right_join", "SELECT COUNT(*) AS n, COUNT(o.outlet) AS known FROM ask_outlets o RIGHT JOIN ask_sources s ON s.outlet = o.outlet AND s.section = o.section")
asked("sql_using", "SELECT COUNT(*) AS n FROM ask_stories JOIN ask_daily USING (day) WHERE sources > 10")
asked("sql_comma_join", "SELECT COUNT(*) AS n FROM ask_sources s, ask_outlets o WHERE s.outlet = o.outlet AND s.section = o.section AND o.active = 1")
asked("sql_cross_join", "SELECT COUNT(*) AS n FROM ask_outlets a CROSS JOIN ask_outlets b WHERE a.prior_score < b.prior_score")
asked("sql_self_join", "SELECT COUNT(*) AS n FROM ask_outlets a JOIN ask_outlets b ON a.outlet = b.outlet WHERE a.section < b.section")
asked("sql_cte", "WITH per_topic (topic, n) AS (SELECT topic, COUNT(*) FROM ask_sources WHERE is_perspective = 1 GROUP BY topic) SELECT topic, n FROM per_topic ORDER BY n DESC, topic")
asked("sql_derived", "SELECT MAX(n) AS most FROM (SELECT story_id, COUNT(*) AS n FROM ask_sources WHERE story_id IS NOT NULL GROUP BY story_id) AS t")
asked("sql_sum_predicate", "SELECT CAST(SUM(bucket IN ('left','right')) AS SIGNED) AS poles, COUNT(*) AS n FROM ask_sources", "SELECT SUM((bucket IN ('left','right'))::INT)::BIGINT AS poles, COUNT(*) AS n FROM ask_sources")
asked("sql_group_concat", "SELECT day, GROUP_CONCAT(DISTINCT section ORDER BY section SEPARATOR '|') AS sections FROM ask_sources GROUP BY day ORDER BY day DESC LIMIT 30", "SELECT day, string_agg(DISTINCT section, '|' ORDER BY section) AS sections FROM ask_sources GROUP BY day ORDER BY day DESC LIMIT 30")
asked("sql_spread", "SELECT ROUND(STD(score), 4) AS sd, ROUND(VARIANCE(score), 4) AS va, ROUND(STDDEV_SAMP(score), 4) AS ss FROM ask_sources", "SELECT ROUND(stddev_pop(score), 4) AS sd, ROUND(var_pop(score), 4) AS va, ROUND(stddev_samp(score), 4) AS ss FROM ask_sources")
asked("sql_having", "SELECT outlet, COUNT(*) AS n FROM ask_sources WHERE outlet IS NOT NULL GROUP BY outlet HAVING COUNT(*) > 40 ORDER BY n DESC, outlet LIMIT 100")
asked("sql_windows", "SELECT day, sources, SUM(sources) OVER (ORDER BY day) AS running, LAG(sources, 1) OVER (ORDER BY day) AS before_, RANK() OVER (ORDER BY sources DESC) AS place, NTILE(4) OVER (ORDER BY day) AS quarter_ FROM ask_daily ORDER BY day LIMIT 200", "SELECT day, sources, SUM(sources) OVER (ORDER BY day)::BIGINT AS running, LAG(sources, 1) OVER (ORDER BY day) AS before_, RANK() OVER (ORDER BY sources DESC) AS place, NTILE(4) OVER (ORDER BY day) AS quarter_ FROM ask_daily ORDER BY day LIMIT 200")
asked("sql_window_frames", "SELECT day, SUM(stories) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS week_, FIRST_VALUE(sources) OVER (ORDER BY day) AS first_, ROW_NUMBER() OVER (ORDER BY day DESC) AS rn, DENSE_RANK() OVER (ORDER BY stories) AS dr, ROUND(PERCENT_RANK() OVER (ORDER BY sources), 4) AS pr, ROUND(CUME_DIST() OVER (ORDER BY sources), 4) AS cd, LEAD(day) OVER (ORDER BY day) AS next_ FROM ask_daily ORDER BY day LIMIT 200", "SELECT day, SUM(stories) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS week_, FIRST_VALUE(sources) OVER (ORDER BY day) AS first_, ROW_NUMBER() OVER (ORDER BY day DESC) AS rn, DENSE_RANK() OVER (ORDER BY stories) AS dr, ROUND(PERCENT_RANK() OVER (ORDER BY sources), 4) AS pr, ROUND(CUME_DIST() OVER (ORDER BY sources), 4) AS cd, LEAD(day) OVER (ORDER BY day) AS next_ FROM ask_daily ORDER BY day LIMIT 200")
asked("sql_union", "SELECT outlet FROM ask_outlets WHERE prior_bucket = 'left' UNION SELECT outlet FROM ask_outlets WHERE prior_bucket = 'right'")
asked("sql_intersect", "SELECT outlet FROM ask_outlets WHERE section = 'news' INTERSECT SELECT outlet FROM ask_outlets WHERE section = 'opinion'")
asked("sql_except", "SELECT outlet FROM ask_outlets WHERE section = 'news' EXCEPT SELECT outlet FROM ask_outlets WHERE section = 'opinion'")
asked("sql_limit_offset", "SELECT story_id, source_count FROM ask_stories ORDER BY source_count DESC, story_id LIMIT 10, 20", "SELECT story_id, source_count FROM ask_stories ORDER BY source_count DESC, story_id LIMIT 20 OFFSET 10")
asked("sql_math", "SELECT day, ROUND(SQRT(sources), 3) AS r, FLOOR(sources / 7) AS f, CEIL(sources / 7) AS c, ABS(stories - sources) AS a, SIGN(stories - 3) AS s, ROUND(LN(sources + 1), 3) AS l, GREATEST(stories, sources) AS g, LEAST(stories, sources) AS m FROM ask_daily ORDER BY day LIMIT 200", "SELECT day, ROUND(SQRT(sources), 3) AS r, FLOOR(sources / 7)::BIGINT AS f, CEIL(sources / 7)::BIGINT AS c, ABS(stories - sources) AS a, SIGN(stories - 3)::DOUBLE AS s, ROUND(LN(sources + 1), 3) AS l, GREATEST(stories, sources) AS g, LEAST(stories, sources) AS m FROM ask_daily ORDER BY day LIMIT 200")
asked("sql_greatest_null", "SELECT COUNT(GREATEST(score, 0)) AS n, COUNT(*) AS all_ FROM ask_sources", "SELECT COUNT(score) AS n, COUNT(*) AS all_ FROM ask_sources")
asked("sql_strings", "SELECT DISTINCT UPPER(LEFT(outlet, 3)) AS a, LENGTH(outlet) AS bytes, CHAR_LENGTH(outlet) AS chars, LOCATE('a', outlet) AS at_, LPAD(RIGHT(outlet, 2), 4, '*') AS pad, CONCAT_WS('-', section, prior_bucket) AS cw, SUBSTRING(outlet, 2, 3) AS sub FROM ask_outlets ORDER BY a, bytes, chars, at_, pad, cw, sub LIMIT 100", "SELECT DISTINCT UPPER(LEFT(outlet, 3)) AS a, strlen(outlet)::INT AS bytes, length(outlet)::INT AS chars, instr(outlet, 'a')::INT AS at_, LPAD(RIGHT(outlet, 2), 4, '*') AS pad, CONCAT_WS('-', section, prior_bucket) AS cw, SUBSTRING(outlet, 2, 3) AS sub FROM ask_outlets ORDER BY a, bytes, chars, at_, pad, cw, sub LIMIT 100")
asked("sql_conditionals", "SELECT IF(score > 0, 'plus', 'else') AS side, IFNULL(topic, 'none') AS t, COUNT(NULLIF(section, 'news')) AS not_news FROM ask_sources GROUP BY side, t ORDER BY side, t", "SELECT CASE WHEN score > 0 THEN 'plus' ELSE 'else' END AS side, COALESCE(topic, 'none') AS t, COUNT(NULLIF(section, 'news')) AS not_news FROM ask_sources GROUP BY side, t ORDER BY side, t")
asked("sql_dates", "SELECT day, DATE_FORMAT(day, '%Y-%m') AS ym, DAYOFWEEK(day) AS dow, WEEKDAY(day) AS wd, WEEKOFYEAR(day) AS wk, WEEK(day) AS w0, YEARWEEK(day) AS yw, DAYNAME(day) AS dn, MONTHNAME(day) AS mn, QUARTER(day) AS q, LAST_DAY(day) AS ld, TO_DAYS(day) AS td, DATEDIFF('2026-07-02', day) AS age FROM ask_daily ORDER BY day LIMIT 200", "SELECT day, strftime(day, '%Y-%m') AS ym, (dayofweek(day) + 1)::INT AS dow, ((dayofweek(day) + 6) % 7)::INT AS wd, weekofyear(day)::INT AS wk, strftime(day, '%U')::INT AS w0, (year(day - dayofweek(day)::INT) * 100 + strftime(day - dayofweek(day)::INT, '%U')::INT)::INT AS yw, dayname(day) AS dn, monthname(day) AS mn, quarter(day)::INT AS q, last_day(day) AS ld, (datediff('day', DATE '1970-01-01', day) + 719528)::INT AS td, datediff('day', day, DATE '2026-07-02')::INT AS age FROM ask_daily ORDER BY day LIMIT 200")
asked("sql_intervals", "SELECT COUNT(*) AS week_, (SELECT COUNT(*) FROM ask_sources WHERE day > CURDATE() - INTERVAL 30 DAY) AS month_, (SELECT COUNT(*) FROM ask_sources WHERE day >= DATE_SUB(CURDATE(), INTERVAL 2 MONTH)) AS two_months FROM ask_sources WHERE day >= CURDATE() - INTERVAL WEEKDAY(CURDATE()) DAY", f"SELECT COUNT(*) AS week_, (SELECT COUNT(*) FROM ask_sources WHERE day > DATE '{TODAY}' - INTERVAL 30 DAY) AS month_, (SELECT COUNT(*) FROM ask_sources WHERE day >= DATE '{TODAY}' - INTERVAL 2 MONTH) AS two_months FROM ask_sources WHERE day >= DATE '2026-06-29'")
asked("sql_hours", "SELECT EXTRACT(HOUR FROM published_at) AS hour_of_day, COUNT(*) AS sources FROM ask_sources GROUP BY hour_of_day ORDER BY hour_of_day")
asked("sql_makedate", "SELECT MAKEDATE(2026, 32) AS a, ADDDATE('2026-01-30', 3) AS b, TIMESTAMPDIFF(DAY, '2026-01-01', '2026-03-01') AS c, COUNT(*) AS n FROM ask_outlets", "SELECT DATE '2026-02-01' AS a, DATE '2026-02-02' AS b, 59::BIGINT AS c, COUNT(*) AS n FROM ask_outlets")

# Reports


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


ELIGIBLE = f"SELECT * FROM {STORIES} WHERE status = 1 AND created >= {NOW} - 33 * 86400 AND relevance = 'relevant'"


@query("report_ranking", f"SELECT e.story_id, coalesce(n.cards, 0)::BIGINT AS cards, round(coalesce(n.cards, 0)::DOUBLE / pow(({NOW} - e.created)::DOUBLE / 86400 + 2, 1.5), 6) AS score FROM ({ELIGIBLE}) e LEFT JOIN (SELECT story_id, count(*) AS cards FROM {CARDS} WHERE status = 1 GROUP BY 1) n USING (story_id)")
def _(spark, d):
    s, c = _t(spark, d, "stories", "cards")
    return reports.ranking(s, c, NOW).select("story_id", "cards", F.round("score", 6).alias("score"))


@query("report_eligible", f"SELECT count(*) AS n FROM ({ELIGIBLE})")
def _(spark, d):
    return reports.eligible(table(spark, d, "stories"), NOW).agg(F.count("*").alias("n"))


TALLY = f"""SELECT trim(outlet) AS outlet, {", ".join(f"sum(CASE WHEN score = {b.low} THEN 1 ELSE 0 END)::BIGINT AS {b.key}_count" for b in sp.FIVE)}, count(*) AS total, max(created) AS last
  FROM {CARDS} WHERE status = 1 AND syndicated_from IS NULL AND (section IS NULL OR section <> 'opinion') AND outlet IS NOT NULL AND score BETWEEN -2 AND 2 GROUP BY trim(outlet)"""


@query("report_outlet_tally", TALLY)
def _(spark, d):
    return reports.outlet_tally(table(spark, d, "cards"))


@query(
    "report_outlets",
    f"""WITH t AS ({TALLY}), p AS (SELECT lower(trim(outlet)) AS o, arg_min(prior_score, feed_id) AS ps FROM {FEEDS} WHERE status = 1 AND outlet IS NOT NULL AND coalesce(section, 'news') = 'news' AND prior_score IS NOT NULL GROUP BY 1),
    j AS (SELECT t.*, coalesce({bucket_sql("p.ps")}, CASE {" ".join(f"WHEN {k}_count = greatest({', '.join(f'{x}_count' for x in B5)}) THEN '{k}'" for k in B5)} END) AS main FROM t LEFT JOIN p ON lower(t.outlet) = p.o),
    i AS (SELECT *, total - CASE main {" ".join(f"WHEN '{k}' THEN {k}_count" for k in B5)} END AS off FROM j)
    SELECT outlet, main, total, ((200 * off + total) // (2 * total))::BIGINT AS strays, CASE WHEN (200 * off + total) // (2 * total) >= 25 THEN 'high' WHEN (200 * off + total) // (2 * total) >= 15 THEN 'moderate' ELSE 'low' END AS level FROM i""",
)
def _(spark, d):
    c, f = _t(spark, d, "cards", "feeds")
    return reports.outlet_report(c, f).select("outlet", "main", "total", "strays", "level")


PCT = ", ".join(f"((200 * {k}_count + total) // (2 * total))::BIGINT AS {k}_p" for k in B5[:-1])


@query(
    "report_topic_spectrum",
    f"""WITH {VIEWS}, t AS (SELECT coalesce(topic, 'none') AS topic, {counts_sql("")}, sum(CASE WHEN is_perspective = 1 THEN 1 ELSE 0 END) AS total FROM ask_sources GROUP BY 1), p AS (SELECT *, {PCT} FROM t WHERE total > 0),
    q AS (SELECT *, 100 - {" - ".join(f"{k}_p" for k in B5[:-1])} AS right_p FROM p)
    SELECT topic, {", ".join(f"{k}_count, {k}_p AS {k}_percent" for k in B5)}, floor(100 - ({" + ".join(f"abs({k}_p - 20)" for k in B5)}) / 2.0 + 0.5)::BIGINT AS balance FROM q""",
)
def _(spark, d):
    s = views.from_dir(spark, d)["ask_sources"].filter("is_perspective = 1").withColumn("topic", F.coalesce("topic", F.lit("none")))
    return reports.distribution(s, ["topic"]).drop("level")


@query("report_tracked", f"WITH top AS (SELECT story_id, title, created FROM {STORIES} WHERE status = 1 ORDER BY created DESC, story_id LIMIT 10) SELECT top.story_id, {', '.join(f'count(CASE WHEN c.score = {b.low} THEN 1 END) AS {b.key}_count' for b in sp.FIVE)} FROM top LEFT JOIN (SELECT * FROM {CARDS} WHERE status = 1 AND syndicated_from IS NULL AND coalesce(section, 'news') <> 'opinion') c USING (story_id) GROUP BY top.story_id")
def _(spark, d):
    s, c = _t(spark, d, "stories", "cards")
    return reports.tracked(s, c).drop("title", "created")


@query("report_perspectives", f"SELECT {bucket_sql('score')} AS bucket, count(*)::INT AS n, string_agg(source_id::VARCHAR, ',' ORDER BY created DESC, source_id) AS ids FROM {CARDS} WHERE status = 1 AND story_id = 90000001 GROUP BY 1")
def _(spark, d):
    p = reports.perspectives(table(spark, d, "cards"), 90000001)
    return p.select("bucket", "n", F.array_join(F.transform("cards", lambda x: x.source_id.cast("string")), ",").alias("ids"))


@query("report_story_page", f"WITH c AS (SELECT * FROM {CARDS} WHERE story_id IS NOT NULL), j AS (SELECT c.source_id, c.story_id, c.score, c.syndicated_from, CASE WHEN o.source_id IS NOT NULL THEN 'reprint' WHEN coalesce(c.section, 'news') = 'opinion' THEN 'opinion' ELSE 'perspective' END AS role FROM c LEFT JOIN c o ON o.source_id = c.syndicated_from AND o.story_id = c.story_id) SELECT j.source_id, j.story_id, j.role, j.score, coalesce(r.n, 0)::BIGINT AS reprints FROM j LEFT JOIN (SELECT syndicated_from AS o, count(*) AS n FROM j WHERE role = 'reprint' GROUP BY 1) r ON r.o = j.source_id")
def _(spark, d):
    return reports.story_page(views.once(table(spark, d, "cards"), "source_id"))


@query("report_story_divergence", f"WITH p AS (SELECT lower(trim(outlet)) AS o, coalesce(section, 'news') AS s, arg_min_null(prior_score, feed_id) AS ps FROM {FEEDS} WHERE outlet IS NOT NULL GROUP BY 1, 2) SELECT c.source_id, c.score, p.ps AS prior_score, c.score - p.ps AS delta FROM {CARDS} c JOIN p ON lower(trim(c.outlet)) = p.o AND coalesce(c.section, 'news') = p.s WHERE c.status = 1 AND abs(c.score - p.ps) >= 1 AND c.score BETWEEN -2 AND 2 AND p.ps BETWEEN -2 AND 2 AND c.score <> p.ps")
def _(spark, d):
    c, f = _t(spark, d, "cards", "feeds")
    return reports.story_divergence(c, f).select("source_id", "score", "prior_score", "delta")


@query("report_dominant_topic", f"SELECT story_id, topic, n FROM (SELECT story_id, topic, count(*) AS n, row_number() OVER (PARTITION BY story_id ORDER BY count(*) DESC, min(source_id)) AS r FROM {CARDS} WHERE status = 1 AND story_id IS NOT NULL AND topic IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def _(spark, d):
    return reports.dominant_topic(table(spark, d, "cards"))


@query("report_story_cards", f"SELECT s.story_id, count(c.source_id) AS cards FROM {STORIES} s LEFT JOIN {CARDS} c USING (story_id) GROUP BY 1")
def _(spark, d):
    s, c = _t(spark, d, "stories", "cards")
    return reports.story_card_counts(s, c)


@query("report_counters", f"SELECT 'cards' AS counter, count(*) AS n FROM {CARDS} UNION ALL SELECT 'cards_published', count(*) FROM {CARDS} WHERE status = 1 UNION ALL SELECT 'cards_unrated', count(*) FROM {CARDS} WHERE score IS NULL UNION ALL SELECT 'stories', count(*) FROM {STORIES} UNION ALL SELECT 'feeds_active', count(*) FROM {FEEDS} WHERE status = 1 AND active = 1")
def _(spark, d):
    c, s, f = _t(spark, d, "cards", "stories", "feeds")
    return reports.content_counts(c, s, f)


@query("report_relevance", f"SELECT l AS relevance, count(s.story_id) AS n FROM (VALUES ('relevant'), ('maybe'), ('irrelevant')) v(l) LEFT JOIN {STORIES} s ON s.relevance = l GROUP BY 1")
def _(spark, d):
    return reports.label_counts(views.once(table(spark, d, "stories"), "story_id"), "relevance", ["relevant", "maybe", "irrelevant"]).select("relevance", "n")


@query("report_recent_median", f"SELECT count(*) AS calls, quantile_cont(latency_ms, 0.5) AS median_ms FROM (SELECT * FROM {CALLS} WHERE operation = 'ask_sql' AND success = 1 ORDER BY created DESC, id DESC LIMIT 30)")
def _(spark, d):
    return reports.recent_median(table(spark, d, "maemgaba_ai_call_log"), "ask_sql")


@query("report_calls", f"SELECT operation, count(*) AS attempts, count(DISTINCT call_group) AS calls, count(*) - count(DISTINCT call_group) AS retries, sum(CASE WHEN success = 0 THEN 1 ELSE 0 END)::BIGINT AS errors, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens, sum(coalesce(reasoning_tokens, 0))::BIGINT AS reasoning_tokens, sum(coalesce(cached_tokens, 0))::BIGINT AS cached_tokens, sum(coalesce(estimated, 0))::BIGINT AS estimated FROM {CALLS} WHERE created >= {NOW - 90 * 86400} GROUP BY 1")
def _(spark, d):
    return reports.call_stats(table(spark, d, "maemgaba_ai_call_log"), NOW - 90 * 86400).drop("error_percent", "latency_avg")


DAILY = f"""SELECT coalesce(a.day, b.day) AS day, coalesce(ra, 0)::BIGINT AS regular_attempts, coalesce(rt, 0)::BIGINT AS regular_tokens, coalesce(ea, 0)::BIGINT AS eval_attempts, coalesce(et, 0)::BIGINT AS eval_tokens, coalesce(b.cards, 0)::BIGINT AS cards FROM
  (SELECT DATE '1970-01-01' + ((created - 14400) // 86400)::INT AS day, count(*) FILTER (WHERE context_type IS DISTINCT FROM 'eval') AS ra, sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) FILTER (WHERE context_type IS DISTINCT FROM 'eval') AS rt,
   count(*) FILTER (WHERE context_type = 'eval') AS ea, sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) FILTER (WHERE context_type = 'eval') AS et FROM {CALLS} GROUP BY 1) a
  FULL JOIN (SELECT DATE '1970-01-01' + ((created - 14400) // 86400)::INT AS day, count(*) AS cards FROM {CARDS} GROUP BY 1) b ON a.day = b.day"""


@query("report_daily_tokens", DAILY)
def _(spark, d):
    return reports.daily_tokens(*_t(spark, d, "maemgaba_ai_call_log", "cards"), -14400)


@query("report_monthly_tokens", f"SELECT strftime(day, '%Y-%m') AS month, {', '.join(f'sum({n})::BIGINT AS {n}' for n in ('regular_attempts', 'regular_tokens', 'eval_attempts', 'eval_tokens', 'cards'))} FROM ({DAILY}) GROUP BY 1")
def _(spark, d):
    return reports.monthly_tokens(reports.daily_tokens(*_t(spark, d, "maemgaba_ai_call_log", "cards"), -14400))


DAY0 = 1777593600


@query("report_day_detail", f"SELECT call_group, min(created) AS first_created, max(operation) AS operation, max(model) AS model, count(*) AS attempts, max(success) AS success, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(latency_ms, 0))::BIGINT AS latency_ms FROM {CALLS} WHERE created >= {DAY0} AND created < {DAY0 + 86400} GROUP BY 1")
def _(spark, d):
    return reports.day_detail(table(spark, d, "maemgaba_ai_call_log"), DAY0)


@query("report_group_cost", f"SELECT call_group, count(*) AS attempts, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens FROM {CALLS} WHERE success = 1 AND call_group IN (SELECT call_group FROM maemgaba_ai_call_log WHERE attempt > 1) GROUP BY 1")
def _(spark, d):
    calls = table(spark, d, "maemgaba_ai_call_log")
    return reports.group_cost(calls, calls.filter("attempt > 1"))


CLICK_CARDS = "(SELECT user_id AS card_id, user_id % 40 AS story_id, 'outlet ' || (user_id % 7) AS outlet FROM (SELECT DISTINCT user_id FROM events))"


@query("report_clicks", f"WITH c AS (SELECT * FROM {CLICK_CARDS}), k AS (SELECT outlet, count(*) AS clicks FROM events e JOIN c ON c.card_id = e.user_id WHERE event_type = 'click' GROUP BY 1), v AS (SELECT user_id % 40 AS story_id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1), i AS (SELECT outlet, sum(views)::BIGINT AS impressions FROM c JOIN v USING (story_id) GROUP BY 1) SELECT coalesce(k.outlet, i.outlet) AS outlet, coalesce(clicks, 0)::BIGINT AS clicks, coalesce(impressions, 0)::BIGINT AS impressions, CASE WHEN impressions > 0 THEN ((2000 * clicks + impressions) // (2 * impressions)) / 10.0 END::DOUBLE AS ctr FROM k FULL JOIN i ON k.outlet = i.outlet")
def _(spark, d):
    e = table(spark, d, "events")
    cards = e.select(F.col("user_id").alias("card_id")).distinct().select("card_id", (F.col("card_id") % 40).alias("story_id"), F.concat(F.lit("outlet "), (F.col("card_id") % 7).cast("string")).alias("outlet"))
    v = e.filter("event_type = 'view'").groupBy((F.col("user_id") % 40).alias("story_id")).agg(F.count("*").alias("views"))
    return reports.clicks(e.filter("event_type = 'click'").select(F.col("user_id").alias("card_id")), v, cards)


@query("report_partial_share", f"SELECT count(*) AS classified, sum(CASE WHEN partial_text = 1 THEN 1 ELSE 0 END)::BIGINT AS partial, ((200 * sum(CASE WHEN partial_text = 1 THEN 1 ELSE 0 END) + count(*)) // (2 * count(*)))::BIGINT AS percent FROM {CARDS} WHERE status = 1 AND score IS NOT NULL")
def _(spark, d):
    return reports.partial_share(table(spark, d, "cards"))


@query("report_story_list", f"WITH {VIEWS} SELECT story_id, source_count FROM ask_stories WHERE relevance = 'relevant' ORDER BY source_count DESC, story_id LIMIT 24")
def _(spark, d):
    return reports.story_list(views.from_dir(spark, d)["ask_stories"], "relevant", "source_count").select("story_id", "source_count")


@query("report_card_list", f"SELECT source_id, topic FROM {CARDS} WHERE topic IN ('economy', 'health') ORDER BY created DESC, source_id LIMIT 50")
def _(spark, d):
    return reports.card_list(table(spark, d, "cards"), ["economy", "health"]).select("source_id", "topic")


@query("report_ages", f"""SELECT story_id, n::VARCHAR || ' ' || CASE WHEN unit IN ('min', 'wk') OR n = 1 THEN unit ELSE unit || 's' END AS age, CASE WHEN a < 3600 THEN greatest(a // 60, 1) || ' min ago' WHEN a < 86400 THEN (a // 3600) || ' h ago' ELSE (a // 86400) || ' d ago' END AS short
    FROM (SELECT *, CASE unit WHEN 'min' THEN greatest(a // 60, 1) WHEN 'hour' THEN a // 3600 WHEN 'day' THEN a // 86400 WHEN 'wk' THEN a // 604800 ELSE a // 2592000 END AS n
      FROM (SELECT *, CASE WHEN a < 3600 THEN 'min' WHEN a < 86400 THEN 'hour' WHEN a < 604800 THEN 'day' WHEN a < 2592000 THEN 'wk' ELSE 'month' END AS unit FROM (SELECT story_id, greatest({NOW} - created, 0) AS a FROM {STORIES})))""")
def _(spark, d):
    return views.once(table(spark, d, "stories"), "story_id").select("story_id", text.relative_time(F.col("created"), F.lit(NOW)).alias("age"), text.relative_time(F.col("created"), F.lit(NOW), compact=True).alias("short"))


@query("report_rollup_relevance", f"SELECT story_id, count(*) AS cards, count(score) AS rated, count(DISTINCT CASE WHEN syndicated_from IS NULL AND coalesce(section, 'news') <> 'opinion' THEN outlet END) AS outlets FROM {CARDS} WHERE status = 1 AND story_id IS NOT NULL GROUP BY 1")
def _(spark, d):
    c = views.once(table(spark, d, "cards"), "source_id").filter("status = 1 AND story_id IS NOT NULL")
    own = F.col("syndicated_from").isNull() & (F.coalesce("section", F.lit("news")) != "opinion")
    return c.groupBy("story_id").agg(F.count("*").alias("cards"), F.count("score").alias("rated"), F.countDistinct(F.when(own, F.col("outlet"))).alias("outlets"))


# Text

WORDS = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')"
#: White space in the SQL's patterns.
BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def plain_sql(c: str) -> str:
    """The text without markup. The tables have no entities, so the SQL decodes none; tests show that part."""
    parted = rf"regexp_replace(coalesce({c}, ''), '<br[^>]*>|</p[^>]*>|</div[^>]*>|</li[^>]*>|</h[0-9][^>]*>', ' ', 'gi')"
    return rf"trim(regexp_replace(regexp_replace({parted}, '<!--(?s:.)*?(-->|$)|<[a-zA-Z/!?][^>]*(>|$)', '', 'g'), '{BLANK}+', ' ', 'g'))"


def words_sql(c: str) -> str:
    return rf"regexp_extract_all(lower({plain_sql(c)}), '[\p{{L}}\p{{N}}]+')"


@query("text_word_counts", f"SELECT doc_id, len(w)::INT AS words, len(list_distinct(w))::INT AS different, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)")
def _(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.array(text.words(F.col("text")))).alias("w"))
    return w.select("doc_id", F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("different"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("text_plain", f"SELECT item_id, md5({plain_sql('body')}) AS digest FROM (SELECT DISTINCT * FROM ingestion_engine)")
def _(spark, d):
    return views.once(table(spark, d, "ingestion_engine"), "item_id").select("item_id", F.md5(text.plain(F.col("body"))).alias("digest"))


@query("text_shingle_counts", f"WITH w AS (SELECT doc_id, {words_sql('text')} AS w FROM documents) SELECT doc_id, greatest(len(w) - 4, 0)::INT AS all_, len(list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]))::INT AS different FROM w")
def _(spark, d):
    s = dedup.shingled(table(spark, d, "documents"), "doc_id", F.col("text"))
    return s.select(F.col("id").alias("doc_id"), F.greatest(F.col("words") - 4, F.lit(0)).alias("all_"), F.size("sh").alias("different"))


@query("text_capped", rf"""WITH t AS (SELECT source_id, regexp_replace(coalesce(micro_summary, ''), '^[ \t\n\r\x0b]+|[ \t\n\r\x0b]+$', '', 'g') AS t FROM {CARDS}),
    w AS (SELECT source_id, t, list_filter(string_split_regex(t, '{BLANK}+'), lambda x: x <> '') AS w FROM t),
    e AS (SELECT *, list_max(list_filter(range(2, 26), lambda i: regexp_matches(w[i], '[.!?][\"'')\]]?$'))) AS cut_at FROM w)
    SELECT source_id, CASE WHEN len(w) <= 25 THEN t WHEN cut_at IS NOT NULL THEN array_to_string(w[1:cut_at], ' ') ELSE rtrim(array_to_string(w[1:25], ' '), ' ,;:') || '…' END AS capped FROM e""")
def _(spark, d):
    c = views.once(table(spark, d, "cards"), "source_id")
    return c.select("source_id", text.cap_words(F.col("micro_summary"), 25).alias("capped"))


@query("text_quotations", "SELECT id, len(list_filter(regexp_extract_all(coalesce(body_excerpt, ''), '[\"“„«]([^\"“”„«»]*)[\"”“»]', 1), lambda x: len(regexp_extract_all(x, '[\\p{L}\\p{N}]+')) >= 6)) > 0 AS quoted FROM (SELECT DISTINCT id, body_excerpt FROM classify_cluster)")
def _(spark, d):
    c = views.once(table(spark, d, "classify_cluster"), "id")
    return c.select("id", text.long_quotation(F.col("body_excerpt"), 6).alias("quoted"))


#: The SQL has no way to look behind: what stands around a name is kept, and neighbours that share a sign are met by a second turn.
REDACTED = rf"""WITH f AS (SELECT DISTINCT feed_id, outlet, feed_url FROM feeds), h AS (SELECT *, lower(trim(coalesce(outlet, ''))) AS k, string_split(lower(regexp_extract(coalesce(feed_url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '.') AS l FROM f),
    n AS (SELECT k, trim(outlet) AS term FROM h UNION SELECT k, regexp_replace(trim(outlet), '^the\s+', '', 'i') FROM h
      UNION SELECT k, array_to_string(l[greatest(len(l) - 1, 1):], '.') AS x FROM h WHERE array_to_string(l[greatest(len(l) - 1, 1):], '.') NOT IN ('feedburner.com', 'feedblitz.com', 'rss.app')),
    p AS (SELECT k, '(^|[^\p{{L}}\p{{N}}])(?:' || string_agg(regexp_escape(term), '|' ORDER BY len(term) DESC, term) || ')($|[^\p{{L}}\p{{N}}])' AS pat FROM n WHERE k <> '' AND len(term) >= 3 GROUP BY k),
    i AS (SELECT i.item_id, coalesce(i.body, '') AS body, p.pat FROM (SELECT DISTINCT * FROM ingestion_engine) i LEFT JOIN h USING (feed_id) LEFT JOIN p USING (k))
    SELECT item_id, md5(CASE WHEN pat IS NULL THEN body ELSE regexp_replace(regexp_replace(body, pat, '\1[outlet]\2', 'gi'), pat, '\1[outlet]\2', 'gi') END) AS digest FROM i"""


@query("text_redacted", REDACTED)
def _(spark, d):
    f = feeds_.outlet_patterns(views.once(table(spark, d, "feeds"), "feed_id"))
    i = views.once(table(spark, d, "ingestion_engine"), "item_id").join(f, "feed_id", "left")
    return i.select("item_id", F.md5(text.redact_by(F.col("body"), F.col("pattern"))).alias("digest"))


@query("text_terms", "SELECT story_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(trim(lower(coalesce(title, ''))), '\\s+'), lambda x: regexp_replace(x, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda x: len(x) >= 3))), ' ') AS terms FROM (SELECT DISTINCT * FROM stories)")
def _(spark, d):
    return views.once(table(spark, d, "stories"), "story_id").select("story_id", F.array_join(F.array_sort(text.search_terms(F.col("title"))), " ").alias("terms"))


@query("text_token_estimate", "SELECT doc_id, ceil(len(coalesce(text, '')) / 4)::BIGINT AS estimate FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("estimate"))


@query("text_bylines", rf"""WITH w AS (SELECT item_id, list_filter(string_split_regex(coalesce(body, ''), '{BLANK}+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT * FROM ingestion_engine)),
    e AS (SELECT item_id, lower(array_to_string(w[1:60], ' ')) AS a, lower(array_to_string(w[greatest(len(w) - 59, 1):], ' ')) AS z FROM w)
    SELECT item_id, CASE {" ".join(f"WHEN contains(a, '{x.lower()}') OR contains(z, '{x.lower()}') THEN '{y}'" for x, y in WIRES)} END AS wire FROM e""")
def _(spark, d):
    return views.once(table(spark, d, "ingestion_engine"), "item_id").select("item_id", text.byline(F.col("body"), WIRES).alias("wire"))


@query("text_partial", f"SELECT item_id, (len({words_sql('abstract')}) < 15)::INT AS is_short FROM (SELECT DISTINCT * FROM ingestion_engine)")
def _(spark, d):
    return views.once(table(spark, d, "ingestion_engine"), "item_id").select("item_id", text.partial(F.col("abstract"), 15).alias("is_short"))


@query("text_scores", f"SELECT source_id, CASE WHEN score IS NOT NULL THEN greatest(-2, least(2, score * 2)) END AS clamped, CASE WHEN score < 0 THEN 'left' WHEN score = 0 THEN 'center' WHEN score > 0 THEN 'right' END AS legacy, CASE WHEN topic IN ('economy', 'health', 'politics') THEN topic ELSE 'general' END AS topic FROM {CARDS}")
def _(spark, d):
    c = views.once(table(spark, d, "cards"), "source_id")
    return c.select("source_id", scores.clamped(F.col("score") * 2).alias("clamped"), scores.to_legacy(F.col("score")).alias("legacy"), scores.allowed(F.col("topic"), ["economy", "health", "politics"], "general").alias("topic"))


# Reprints


def _texts(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    g = views.once(table(spark, d, "classify_cluster"), "id")
    g = g if only is None else g.join(only, "id", "left_semi")
    c = views.once(table(spark, d, "cards"), "source_id").select(F.col("source_id").alias("id"), "created")
    t = g.join(c, "id").withColumn("wire", text.byline(text.plain(F.col("body_excerpt")), WIRES))
    return dedup.shingled(t, "id", F.concat_ws(" ", "title", "body_excerpt"), keep=("created", "wire"))


@query("dedup_signatures", f"WITH s AS (SELECT id, list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS sh FROM (SELECT id, {words_sql('body_excerpt')} AS w FROM (SELECT DISTINCT id, body_excerpt FROM classify_cluster))), e AS (SELECT id, unnest(sh) AS g FROM s), h AS (SELECT id, ('0x' || substr(md5(g), 1, 8))::UBIGINT AS x FROM e), m AS (SELECT id, k, min((x * (((k + 1) * 1103515245 + 12345) % 2147483647)::UBIGINT + (((k + 1) * 69069 + 1) % 2147483647)::UBIGINT) % 2147483647) AS v FROM h, range(128) r(k) GROUP BY 1, 2) SELECT id, string_agg(v::VARCHAR, ',' ORDER BY k) AS signature FROM m GROUP BY 1")
def _(spark, d):
    g = views.once(table(spark, d, "classify_cluster"), "id")
    sig = dedup.signatures(dedup.shingled(g, "id", F.col("body_excerpt")).select("id", "sh"))
    return sig.filter("size > 0").select("id", F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").alias("signature"))


MATCH = f"""WITH t AS (SELECT g.id, c.created, {words_sql("concat_ws(' ', g.title, g.body_excerpt)")} AS w FROM (SELECT DISTINCT id, title, body_excerpt FROM classify_cluster) g JOIN {CARDS} c ON c.source_id = g.id),
 s AS (SELECT id, created, list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS sh FROM t WHERE len(w) >= 80), e AS (SELECT id, created, len(sh) AS n, unnest(sh) AS g FROM s),
 p AS (SELECT a.id, b.id AS o, count(*) AS shared, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.g = b.g AND (b.created, b.id) < (a.created, a.id) AND a.created - b.created <= 172800 GROUP BY 1, 2)
 SELECT id, o AS of, shared::INT AS shared, n::INT AS size, m::INT AS size_of FROM p WHERE 5 * shared >= 4 * (n + m - shared) OR 20 * shared >= 17 * least(n, m)"""


@query("dedup_matches", MATCH)
def _(spark, d):
    return dedup.matches(_texts(spark, d))


#: Signatures of all texts, and of each match the share of equal places and what it makes of the smaller set.
ESTIMATE = f"""{MATCH.rsplit("SELECT id, o AS of", 1)[0].rstrip()},
 m AS (SELECT id, o AS of, shared::INT AS shared, n, m FROM p WHERE 5 * shared >= 4 * (n + m - shared) OR 20 * shared >= 17 * least(n, m)),
 h AS (SELECT id, ('0x' || substr(md5(g), 1, 8))::UBIGINT AS x FROM e WHERE id IN (SELECT id FROM m UNION SELECT of FROM m)),
 v AS (SELECT id, k, min((x * (((k + 1) * 1103515245 + 12345) % 2147483647)::UBIGINT + (((k + 1) * 69069 + 1) % 2147483647)::UBIGINT) % 2147483647) AS v FROM h, range(128) r(k) GROUP BY 1, 2),
 j AS (SELECT m.id, m.of, m.shared, m.n, m.m, count(*) FILTER (WHERE x.v = y.v) / 128.0 AS jaccard FROM m JOIN v x ON x.id = m.id JOIN v y ON y.id = m.of AND y.k = x.k GROUP BY ALL)
 SELECT id, of, shared, jaccard::DOUBLE AS jaccard, least(1.0, jaccard::DOUBLE * (n + m) / (1 + jaccard::DOUBLE) / least(n, m))::DOUBLE AS containment FROM j"""


@query("dedup_estimates", ESTIMATE)
def _(spark, d):
    m = settle(dedup.matches(_texts(spark, d)), "matches")
    # only texts with a match need a signature; shingling them again is cheaper than keeping all shingles
    sig = dedup.signatures(_texts(spark, d, m.select("id").union(m.select("of")).distinct()).select("id", "sh"))
    j = m.join(sig.select("id", F.col("sig").alias("sa")), "id").join(sig.select(F.col("id").alias("of"), F.col("sig").alias("sb")), "of")
    j = j.withColumn("jaccard", dedup.estimate(F.col("sa"), F.col("sb")))
    return j.select("id", "of", "shared", "jaccard", dedup.containment(F.col("jaccard"), F.col("size"), F.col("size_of")).alias("containment"))


@query("dedup_roots", f"WITH RECURSIVE b AS (SELECT * FROM {CARDS}), r AS (SELECT b.source_id, o.source_id AS root, o.syndicated_from AS nxt, 1 AS hops FROM b JOIN b o ON o.source_id = b.syndicated_from AND o.status = 1 UNION ALL SELECT r.source_id, o.source_id, o.syndicated_from, hops + 1 FROM r JOIN b o ON o.source_id = r.nxt AND o.status = 1 WHERE hops < 5) SELECT source_id, arg_max(root, hops) AS root, max(hops)::INT AS hops FROM r GROUP BY 1")
def _(spark, d):
    return dedup.roots(table(spark, d, "cards"))


@query("dedup_reprint_cards", f"SELECT n.source_id, n.syndicated_from, o.story_id, o.score, o.topic FROM {CARDS} n JOIN {CARDS} o ON o.source_id = n.syndicated_from")
def _(spark, d):
    c = views.once(table(spark, d, "cards"), "source_id")
    return dedup.reprint_cards(c, c).select("source_id", "syndicated_from", "story_id", "score", "topic")


@query("dedup_copied_run", f"WITH p AS (SELECT c.source_id AS key, {words_sql('c.micro_summary')} AS a, {words_sql('o.micro_summary')} AS b FROM {CARDS} c JOIN {CARDS} o ON o.source_id = c.syndicated_from), x AS (SELECT key, unnest(range(1, len(a) - 6)) AS at, a FROM p), y AS (SELECT DISTINCT key, array_to_string(b[i:i+7], ' ') AS run FROM (SELECT key, b, unnest(range(1, len(b) - 6)) AS i FROM p)), z AS (SELECT x.key, x.at - 1 AS at, array_to_string(x.a[x.at:x.at+7], ' ') AS run FROM x) SELECT z.key, min(z.at)::INT AS at FROM z JOIN y USING (key, run) GROUP BY 1")
def _(spark, d):
    c = views.once(table(spark, d, "cards"), "source_id")
    o = c.select(F.col("source_id").alias("_o"), F.col("micro_summary").alias("source"))
    p = c.join(o, F.col("syndicated_from") == F.col("_o")).select(F.col("source_id").alias("key"), F.col("micro_summary").alias("candidate"), "source")
    return dedup.first_copied_run(p).select("key", "at")


# Retrieval


COS = "1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"


@query("search_nearest", f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT query_id, id, rank, round(distance, 4) AS distance FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {COS} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS}, b.vec_id)::INT AS rank FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 10")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.nearest_join(v, v.filter("id % 50 = 0")).select("query_id", "id", "rank", F.round("distance", 4).alias("distance"))


_Q = [1.0 if i % 3 == 0 else -0.5 if i % 3 == 1 else 0.25 for i in range(64)]


@query("search_owner", f"WITH q AS (SELECT {_Q}::DOUBLE[] AS e), d AS (SELECT b.vec_id, b.label, 1 - list_dot_product(b.e, q.e) / (sqrt(list_dot_product(b.e, b.e)) * sqrt(list_dot_product(q.e, q.e))) AS distance FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) b, q ORDER BY distance, vec_id LIMIT 100) SELECT label, vec_id AS id, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS r FROM d WHERE distance <= 0.95) WHERE r = 1")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return retrieval.nearest(v, _Q, 100, 0.95, "label").select("label", "id", F.round("distance", 4).alias("distance"))


@query("search_truncated", "SELECT vec_id, round(list_sum(list_transform(embedding[1:16]::DOUBLE[], lambda x: x * x)) / sqrt(list_sum(list_transform(embedding[1:16]::DOUBLE[], lambda x: x * x))) / sqrt(list_sum(list_transform(embedding[1:16]::DOUBLE[], lambda x: x * x))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding[1:16]::DOUBLE[], lambda x: x * x))), 5) AS first_ FROM embeddings")
def _(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", retrieval.truncated(F.col("embedding").cast("array<double>"), 16).alias("t"))
    return t.select("vec_id", F.round(retrieval.dot(F.col("t"), F.col("t")), 6).alias("norm"), F.round(F.col("t")[0], 5).alias("first_"))


@query("search_keyword", f"SELECT story_id FROM {STORIES} WHERE (contains(lower(coalesce(title, '')), 'grain') OR contains(lower(coalesce(neutral_summary, '')), 'grain')) AND (contains(lower(coalesce(title, '')), 'quota') OR contains(lower(coalesce(neutral_summary, '')), 'quota'))")
def _(spark, d):
    s = views.once(table(spark, d, "stories"), "story_id").withColumn("summary", F.col("neutral_summary"))
    return retrieval.keyword(s, ["grain", "quota"]).select("story_id")


BM = f"""w AS (SELECT doc_id AS id, {WORDS.format("text")} AS w FROM documents), d AS (SELECT id, len(w) AS len, len(list_filter(w, lambda x: x = 'budget')) AS t0, len(list_filter(w, lambda x: x = 'dispute')) AS t1 FROM w),
 s AS (SELECT count(*) AS n, avg(len) AS a, count(*) FILTER (WHERE t0 > 0) AS d0, count(*) FILTER (WHERE t1 > 0) AS d1 FROM d), b AS (SELECT id, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * len / a)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * len / a)) AS bm25 FROM d, s)"""


@query("search_bm25", f"WITH {BM} SELECT id, round(bm25, 4) AS bm25 FROM b WHERE bm25 > 0")
def _(spark, d):
    return retrieval.bm25(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), ["budget", "dispute"]).select("id", F.round("bm25", 4).alias("bm25"))


@query("search_hybrid", f"WITH {BM}, q AS (SELECT {_Q}::DOUBLE[] AS e), v AS (SELECT vec_id AS id, (1 + list_dot_product(x.e, q.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(q.e, q.e)))) / 2 AS sim FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) x, q) SELECT coalesce(b.id, v.id) AS id, round(coalesce(b.bm25, 0) + 10 * coalesce(v.sim, 0), 4) AS score FROM (SELECT * FROM b WHERE bm25 > 0) b FULL JOIN (SELECT * FROM v WHERE sim >= 0.55) v ON b.id = v.id")
def _(spark, d):
    words = retrieval.bm25(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), ["budget", "dispute"])
    q = F.array(*[F.lit(x) for x in _Q])
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), retrieval.cosine_distance(F.col("embedding"), q).alias("distance"))
    return retrieval.hybrid(words, v, floor=0.55).select("id", F.round("score", 4).alias("score"))


@query("search_facets", f"SELECT score, count(*) AS n FROM {CARDS} WHERE score IS NOT NULL GROUP BY 1")
def _(spark, d):
    return retrieval.facets(views.once(table(spark, d, "cards"), "source_id"), "score")


# Evaluation

PAIRS = f"(SELECT g.id, g.expected.topic AS wanted, c.topic AS got, g.expected.bias AS side, CASE WHEN c.score < 0 THEN 'left' WHEN c.score = 0 THEN 'center' WHEN c.score > 0 THEN 'right' END AS got_side FROM (SELECT DISTINCT id, expected FROM classify_cluster) g JOIN {CARDS} c ON c.source_id = g.id)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    g = views.once(table(spark, d, "classify_cluster"), "id").select("id", F.col("expected.topic").alias("wanted"), F.col("expected.bias").alias("side"))
    c = views.once(table(spark, d, "cards"), "source_id").select(F.col("source_id").alias("id"), F.col("topic").alias("got"), scores.to_legacy(F.col("score")).alias("got_side"))
    return g.join(c, "id")


@query("eval_fields", f"WITH p AS {PAIRS}, l AS (SELECT wanted AS label FROM p WHERE wanted IS NOT NULL UNION SELECT got FROM p WHERE got IS NOT NULL), m AS (SELECT label, count(*) FILTER (WHERE wanted = label AND got = label) AS tp, count(*) FILTER (WHERE got = label AND wanted IS DISTINCT FROM label) AS fp, count(*) FILTER (WHERE wanted = label AND got IS DISTINCT FROM label) AS fn FROM l, p GROUP BY 1) SELECT label, tp, fp, fn, tp + fn AS support, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 3) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 3) END AS recall FROM m")
def _(spark, d):
    return evals.field_metrics(_pairs(spark, d), "wanted", "got")


@query("eval_accuracy", f"SELECT 'topic' AS field, count(*) AS items, sum(CASE WHEN wanted = got THEN 1 ELSE 0 END)::BIGINT AS correct FROM {PAIRS} UNION ALL SELECT 'bias', count(*), sum(CASE WHEN side = got_side THEN 1 ELSE 0 END)::BIGINT FROM {PAIRS}")
def _(spark, d):
    return evals.accuracy(_pairs(spark, d), [("topic", "wanted", "got"), ("bias", "side", "got_side")])


@query("eval_confusion", f"SELECT l AS side, {', '.join(f'''count(*) FILTER (WHERE got_side = '{x}') AS \"{x}\"''' for x in ('left', 'center', 'right'))} FROM (VALUES ('left'), ('center'), ('right')) v(l) LEFT JOIN {PAIRS} p ON p.side = l GROUP BY 1")
def _(spark, d):
    return evals.confusion(_pairs(spark, d), "side", "got_side", ["left", "center", "right"])


AGREE = f"(SELECT c.outlet, c.score AS a, p.ps AS b FROM {CARDS} c JOIN (SELECT lower(trim(outlet)) AS o, arg_min_null(prior_score, feed_id) AS ps FROM {FEEDS} WHERE outlet IS NOT NULL GROUP BY 1) p ON lower(trim(c.outlet)) = p.o)"


@query("eval_agreement", f"SELECT count(*) AS n, round(avg((a = b)::INT), 3) AS exact, round(avg((abs(a - b) <= 1)::INT), 3) AS within_one, round(avg(a - b), 3) AS mean_delta FROM {AGREE} WHERE a IS NOT NULL AND b IS NOT NULL")
def _(spark, d):
    w = Window.partitionBy("_o").orderBy("feed_id")
    p = views.once(table(spark, d, "feeds"), "feed_id").filter("outlet IS NOT NULL").withColumn("_o", F.lower(F.trim("outlet"))).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("_o", F.col("prior_score").alias("b"))
    c = views.once(table(spark, d, "cards"), "source_id").select(F.lower(F.trim("outlet")).alias("_o"), F.col("score").alias("a"))
    return evals.agreement(c.join(p, "_o"), "a", "b")


@query("eval_sample", f"SELECT outlet, source_id FROM (SELECT outlet, source_id, row_number() OVER (PARTITION BY outlet ORDER BY source_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY original_url ORDER BY source_id) AS u FROM {CARDS} WHERE coalesce(section, 'news') <> 'opinion') WHERE u = 1) WHERE r <= 3")
def _(spark, d):
    c = views.once(table(spark, d, "cards"), "source_id").filter("coalesce(section, 'news') <> 'opinion'")
    return evals.sample_per_group(c, "outlet", ["source_id"], 3, "original_url").select("outlet", "source_id")


@query("eval_export", f"SELECT id, bias FROM (SELECT id, expected.bias AS bias, row_number() OVER (PARTITION BY expected.bias ORDER BY id DESC) AS r FROM (SELECT DISTINCT id, expected FROM classify_cluster)) WHERE bias IN ('left', 'center', 'right') AND r <= 20")
def _(spark, d):
    g = views.once(table(spark, d, "classify_cluster"), "id").select("id", F.col("expected.bias").alias("bias"))
    return evals.balanced_export(g, "bias", "id", 60, ["left", "center", "right"]).select("id", "bias")


# Stores and feeds


@query("store_active_feeds", f"SELECT feed_id, coalesce(nullif(trim(outlet), ''), feed_url) AS name FROM {FEEDS} WHERE status = 1 AND active = 1 AND trim(coalesce(feed_url, '')) <> ''")
def _(spark, d):
    return feeds_.active(table(spark, d, "feeds")).select("feed_id", "name")


@query("store_latest", f"SELECT call_group, id, attempt FROM (SELECT *, row_number() OVER (PARTITION BY call_group ORDER BY created DESC, id DESC) AS r FROM {CALLS}) WHERE r = 1")
def _(spark, d):
    return stores.latest(views.once(table(spark, d, "maemgaba_ai_call_log"), "id"), "call_group", "created", "id").select("call_group", "id", "attempt")


@query("store_purged", f"SELECT count(*) AS kept FROM {CALLS} WHERE created >= {NOW} - 60 * 86400")
def _(spark, d):
    return stores.purge(views.once(table(spark, d, "maemgaba_ai_call_log"), "id"), NOW, 60).agg(F.count("*").alias("kept"))


@query("store_cascade", f"SELECT source_id FROM {CARDS} c WHERE NOT EXISTS (SELECT 1 FROM {STORIES} s WHERE s.story_id = c.story_id AND s.status = 0)")
def _(spark, d):
    s, c = views.once(table(spark, d, "stories"), "story_id"), views.once(table(spark, d, "cards"), "source_id")
    return stores.cascade_delete(s, c, s.filter("status = 0"))[1].select("source_id")


@query("store_backfill", f"SELECT source_id, topic FROM {CARDS} WHERE topic IS NOT NULL UNION ALL SELECT c.source_id, s.topic FROM {CARDS} c JOIN {STORIES} s USING (story_id) WHERE c.topic IS NULL AND s.topic IS NOT NULL")
def _(spark, d):
    c = views.once(table(spark, d, "cards"), "source_id")
    s = views.once(table(spark, d, "stories"), "story_id").select("story_id", F.col("topic").alias("st"))
    have = c.filter("topic IS NOT NULL").select("source_id", "topic")
    return stores.backfill(have, c.join(s, "story_id").filter("st IS NOT NULL").select("source_id", F.col("st").alias("topic")), "source_id")


@query("store_harvest", f"SELECT item_id, feed_id FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY fetched_at DESC, item_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY fetched_at, item_id) AS u FROM (SELECT DISTINCT * FROM ingestion_engine) i WHERE trim(coalesce(link, '')) <> '' AND NOT EXISTS (SELECT 1 FROM cards c WHERE c.original_url = i.link)) WHERE u = 1) WHERE r <= 8")
def _(spark, d):
    i = views.once(table(spark, d, "ingestion_engine"), "item_id")
    return flows.harvest(i, table(spark, d, "cards").select(F.col("original_url").alias("link"))).select("item_id", "feed_id")


@query("store_registry_changes", f"SELECT feed_id, CASE WHEN prior_score IS NOT DISTINCT FROM coalesce(prior_score, 0) THEN 'unchanged' ELSE 'updated' END AS change FROM {FEEDS}")
def _(spark, d):
    f = views.once(table(spark, d, "feeds"), "feed_id")
    new = f.withColumn("prior_score", F.coalesce("prior_score", F.lit(0)))
    return feeds_.upsert(f, new, "feed_id", ["outlet", "section", "prior_score"]).select("feed_id", "change")


# Streams, run to their end


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("stream_views", "SELECT user_id, strftime(ts, '%Y%m%d')::INT AS day, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1, 2")
def _(spark, d):
    s = flows.read_files(spark, d, "events.parquet", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.run_updates(flows.view_counter(s), ["user_id", "day"])


@query("stream_first_links", "SELECT DISTINCT link FROM ingestion_engine WHERE link IS NOT NULL")
def _(spark, d):
    schema = table(spark, d, "ingestion_engine").schema
    raw = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d}/ingestion_engine.parquet")
    return flows.run_to_end(flows.first_by_url(raw.filter("link IS NOT NULL"), "3650 days").select("link"))


def queries() -> dict[str, Query]:
    from pressloom.plans import wider  # noqa: F401 - puts more queries here

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
