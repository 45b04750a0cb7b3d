"""What the statement gate lets through, and why not."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pressloom.operators.views import columns
from pressloom.plans.ask import Rejected, normal_question, translate
from pressloom.plans.dialect import date_pattern
from pressloom.plans.gate import MAX_BYTES, REASONS, Gate

GATE = Gate(columns())

REFUSED = {
    "empty": ["", " \n\t ", ";"],
    "too_long": ["SELECT outlet FROM ask_outlets WHERE outlet = '" + "x" * MAX_BYTES + "'"],
    "non_ascii": ["SELECT outlet FROM ask_outlets WHERE prior_score ≥ 1"],
    "comment": ["SELECT 1 -- one", "SELECT 1 # one", "SELECT /* one */ 1", "SELECT day FROM ask_daily /*! UNION SELECT 1 */"],
    "double_quote": ['SELECT outlet FROM ask_outlets WHERE section = "news"'],
    "backtick": ["SELECT `day` FROM ask_daily"],
    "brace": ["SELECT day FROM {ask_daily}", "SELECT day FROM ask_daily WHERE '[x]' = 'y'"],
    "variable": ["SELECT @x", "SELECT @@port"],
    "placeholder": ["SELECT day FROM ask_daily WHERE stories > ?", "SELECT day FROM ask_daily WHERE stories > :n"],
    "backslash": ["SELECT day FROM ask_daily WHERE stories = \\N"],
    "bad_char": ["SELECT stories | 1 FROM ask_daily", "SELECT ~stories FROM ask_daily"],
    "unterminated_string": ["SELECT day FROM ask_daily WHERE 'a = 1", "SELECT day FROM ask_daily WHERE 'a\\' = 1"],
    "unbalanced_parens": ["SELECT MAX(day FROM ask_daily", "SELECT MAX(day)) FROM ask_daily"],
    "multiple_statements": ["SELECT 1; SELECT 2", "SELECT day FROM ask_daily WHERE 'a;b' = 'c'"],
    "not_select": ["REPLACE INTO ask_daily VALUES (1)", "(SELECT 1)", "WITH AS (SELECT 1) SELECT 2", "WITH t AS SELECT 1", "WITH t AS (SELECT 1 AS n) DELETE_ t"],
    "denied_keyword": ["SELECT SLEEP (9)", "SELECT 1 FROM mysql.db", "SELECT day FROM ask_daily FOR UPDATE", "WITH RECURSIVE t AS (SELECT 1 AS n) SELECT n FROM t", "SELECT day INTO OUTFILE 'x' FROM ask_daily", "SELECT VERSION()"],
    "function_not_allowed": ["SELECT RAND() FROM ask_daily", "SELECT SHA1 (day) FROM ask_daily"],
    "table_not_allowed": ["SELECT 1 FROM cards", "SELECT 1 FROM ask_daily, cards", "SELECT 1 FROM ask_daily JOIN cards ON 1 = 1", "SELECT 1 FROM ask_daily WHERE day IN (SELECT day FROM cards)", "SELECT 1 FROM other.ask_daily", "SELECT 1 FROM"],
    "cte_shadows_view": ["WITH ask_daily AS (SELECT 1 AS day) SELECT day FROM ask_daily"],
    "qualified_name": ["SELECT other.day FROM ask_daily", "SELECT 1 FROM ask_daily.x"],
    "unknown_identifier": ["SELECT secret FROM ask_daily", "SELECT d.secret FROM ask_daily d", "SELECT COUNT(*) c FROM ask_daily", "SELECT 0x1F FROM ask_daily"],
    "limit_too_high": ["SELECT day FROM ask_daily LIMIT 201", "SELECT day FROM ask_daily LIMIT 3, 500", "SELECT day FROM ask_daily LIMIT 500 OFFSET 3"],
    "limit_invalid": ["SELECT day FROM ask_daily LIMIT 2.5", "SELECT day FROM ask_daily LIMIT 1 + 1", "SELECT day FROM ask_daily LIMIT 1, 2, 3"],
}

PASSED = {
    "SELECT day FROM ask_daily": "SELECT day FROM ask_daily LIMIT 200",
    "SELECT day FROM ask_daily ; ": "SELECT day FROM ask_daily LIMIT 200",
    "select D.day as d2 from ASK_DAILY D limit 7": "select D.day as d2 from ASK_DAILY D limit 7",
    "SELECT day FROM ask_daily LIMIT 5, 10": "SELECT day FROM ask_daily LIMIT 5, 10",
    "SELECT day FROM ask_daily UNION SELECT day FROM ask_sources": "SELECT day FROM ask_daily UNION SELECT day FROM ask_sources LIMIT 200",
    "SELECT day FROM ask_daily WHERE day IN (SELECT day FROM ask_sources LIMIT 900)": "SELECT day FROM ask_daily WHERE day IN (SELECT day FROM ask_sources LIMIT 900) LIMIT 200",
    "WITH a (x) AS (SELECT day FROM ask_daily), b AS (SELECT x FROM a) SELECT MAX(x) AS count FROM b": "WITH a (x) AS (SELECT day FROM ask_daily), b AS (SELECT x FROM a) SELECT MAX(x) AS count FROM b LIMIT 200",
    "SELECT EXTRACT(YEAR FROM day) AS y, TRIM(LEADING 'a' FROM outlet) AS t FROM ask_sources": "SELECT EXTRACT(YEAR FROM day) AS y, TRIM(LEADING 'a' FROM outlet) AS t FROM ask_sources LIMIT 200",
    "SELECT outlet FROM ask_outlets WHERE outlet = 'El País' OR outlet = 'a''b\\'c'": "SELECT outlet FROM ask_outlets WHERE outlet = 'El País' OR outlet = 'a''b\\'c' LIMIT 200",
    "SELECT SUM(stories) OVER (ORDER BY day ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM ask_daily": "SELECT SUM(stories) OVER (ORDER BY day ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM ask_daily LIMIT 200",
}


@pytest.mark.parametrize(("reason", "sql"), [(r, s) for r, ss in REFUSED.items() for s in ss])
def test_refused(reason, sql):
    v = GATE.check(sql)
    assert (v.ok, v.reason, v.sql) == (False, reason, ""), v.detail


def test_every_reason_has_a_case():
    assert set(REFUSED) == set(REASONS)


@pytest.mark.parametrize(("sql", "shown"), PASSED.items())
def test_passed(sql, shown):
    v = GATE.check(sql)
    assert v.ok, (v.reason, v.detail)
    assert v.sql == shown


def test_lower_cap():
    g = Gate({"ask_daily": ["day"]}, 50)
    assert g.check("SELECT day FROM ask_daily").sql.endswith("LIMIT 50")
    assert g.check("SELECT day FROM ask_daily LIMIT 51").reason == "limit_too_high"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="SELECTFROMask_daily'(),.;*-#\\ 0123456789@{}é", max_size=60))
def test_never_breaks(sql):
    v = GATE.check(sql)
    assert v.ok or v.reason in REASONS


@pytest.mark.parametrize(
    ("sql", "part"),
    [
        ("SELECT STD(stories) AS s FROM ask_daily", "STDDEV_POP"),
        ("SELECT day FROM ask_daily LIMIT 5, 10", "LIMIT 10 OFFSET 5"),
        ("SELECT SUM(stories > 1) AS s FROM ask_daily", "CAST((stories > 1) AS INT)"),
        ("SELECT SUM(CASE WHEN stories > 1 THEN 1 ELSE 0 END) AS s FROM ask_daily", "SUM(CASE"),
        ("SELECT 7 MOD 2 AS m FROM ask_daily", "7 % 2"),
        ("SELECT DATE_ADD(day, INTERVAL 2 WEEK) AS m FROM ask_daily", "* 7 * INTERVAL '1' DAY"),
        ("SELECT CAST(score AS UNSIGNED) AS m FROM ask_sources", "DECIMAL(20,0)"),
        ("SELECT LENGTH(outlet) AS m FROM ask_sources", "OCTET_LENGTH"),
        ("SELECT CURDATE() AS m FROM ask_sources", "DATE'2026-01-02'"),
        ("SELECT day FROM ask_daily WHERE stories <= ANY (SELECT stories FROM ask_daily)", "SELECT MAX(v)"),
    ],
)
def test_dialect(sql, part):
    assert part in translate(sql, today="2026-01-02")


@pytest.mark.parametrize("sql", ["SELECT day FROM ask_daily FULL JOIN ask_sources", "SELECT day FROM ask_daily WHERE stories <> ANY (SELECT 1 FROM ask_daily)", "SELECT DATE_FORMAT(day, '%V') AS x FROM ask_daily"])
def test_unsupported_is_refused(sql):
    with pytest.raises(Rejected):
        translate(sql)


def test_date_pattern_and_question():
    assert date_pattern("'%Y-%m-%d %H:%i'") == "'yyyy-MM-dd HH:mm'"
    q, key = normal_question("  How   many\nStories? ")
    assert q == "How many Stories?" and key == normal_question("how many stories?")[1]
