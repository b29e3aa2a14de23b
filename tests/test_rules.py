"""Rules as rows give what rules as expressions give."""

import json

import pytest

from tidewatch import constants as K
from tidewatch.operators import rule_rows, rules
from tidewatch.plans import explain_tree

STATEMENTS = [
    "select * from t", "SELECT a FROM t WHERE YEAR(d) = 1", "SELECT a FROM t WHERE b LIKE '%x'", "SELECT a FROM t ORDER BY RAND()", "select a from t limit 100000, 5",
    "UPDATE t SET a = 1", "UPDATE t SET a = 1 WHERE b = 2", "SELECT a FROM t CROSS JOIN u", "DELETE FROM t WHERE a = '12'", "SELECT a /* SELECT * */ FROM t", "", None,
    "SELECT a FROM t WHERE a = '12'",
]
PLANS = [
    {"table_name": "t", "access_type": "ALL", "key": None, "rows_examined_per_scan": 6000, "filtered": "10.0", "Extra": "Using filesort"},
    {"table_name": "t", "access_type": "ref", "key": "i", "rows_examined_per_scan": 1000, "filtered": 100, "Extra": "Using temporary; Using filesort"},
    {"table_name": "t", "access_type": "all"},
]


@pytest.fixture()
def tables(spark):
    rows = [(i * 10 + j, s) for i, s in enumerate(STATEMENTS) for j in range(4)]
    plans = [(i * 10 + j, json.dumps({"query_block": {"table": PLANS[j]}})) for i in range(len(STATEMENTS)) for j in range(3)]
    statements = spark.createDataFrame(rows, "plan_id bigint, sql_text string")
    return statements, explain_tree.with_accesses(spark.createDataFrame(plans, "plan_id bigint, plan string"))


def pairs(frame):
    return sorted((r["plan_id"], r["rule_no"], r["rule_id"], r["title"], r["suggestion"]) for r in frame.collect())


def test_rows_equal_expressions(spark, tables):
    statements, plans = tables
    data = rule_rows.rule_rows(spark, K.RULES)
    assert pairs(rules.join_rules(statements, data)) == pairs(rules.join_rules(statements))
    with_plan = pairs(rules.join_rules_with_plan(statements, plans, data))
    assert with_plan == pairs(rules.join_rules_with_plan(statements, plans)) and len({p[1] for p in with_plan}) > 10


def test_conditions_of_all_kinds(spark, tables, tmp_path):
    own = [
        ("A", "c", "no conditions", (), "s"), ("B", "c", "short", (("sql_contains", "t"),), "s"), ("C", "c", "absent", (("sql_not_contains", "from"),), "s"),
        ("D", "c", "two fragments", (("sql_contains", "select a"), ("sql_contains", "where")), "s"), ("E", "c", "unknown", (("nothing", "x"),), "s"),
        ("F", "c", "bounds", (("explain_rows", ">= 6000"), ("explain_filtered", "<= 10")), "s"), ("G", "c", "equal", (("explain_rows", "1000"),), "s"),
        ("H", "c", "nowhere", (("sql_contains", "zzzzzz"),), "s"),
    ]
    statements, plans = tables
    path = str(tmp_path / "rules")
    rule_rows.rule_rows(spark, own).coalesce(1).write.json(path)
    data = rule_rows.read_rules(spark, path)
    assert pairs(rules.join_rules(statements, data)) == pairs(rules.join_rules(statements, own))
    assert pairs(rules.join_rules_with_plan(statements, plans, data)) == pairs(rules.join_rules_with_plan(statements, plans, own))
    assert rules.join_rules(statements, data.limit(0)).count() == 0 and rules.join_rules(statements.limit(0), data).count() == 0


def test_ten_thousand_rules_are_no_plan_of_ten_thousand_branches(spark):
    many = spark.sql("""select cast(id as int) rule_no, concat('R', id) rule_id, 'c' category, 't' title, 's' suggestion,
        array(named_struct('key', 'sql_contains', 'value', concat('table_', lpad(id, 5, '0'), ' '))) conditions from range(10000)""")
    statements = spark.sql("select id plan_id, concat('SELECT a FROM table_', lpad(id * 7 % 20000, 5, '0'), ' WHERE b = 1') sql_text from range(3000)")
    found = rules.join_rules(statements, many)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    got = {(r["plan_id"], r["rule_no"]) for r in found.collect()}
    assert got == {(i, i * 7 % 20000) for i in range(3000) if i * 7 % 20000 < 10_000}


def test_rules_meet_words_where_the_statements_are(spark):
    """Fragments with inner words, without any, short and long, of equal conditions, NULL numbers and NULL values."""
    values = ["from t1 x", "from t12 x", "from t1 x", "t12", "1 x where", "id", " t1 ", "elect `a", "ORDER BY RAND()", None, "ß y", "t1 x wherever"]
    rows = [(i if i != 1 else None, f"R{i}", "c", "t", "s", [("sql_contains", v)]) for i, v in enumerate(values)]
    data = spark.createDataFrame(rows, rule_rows.RULES)
    texts = ["SELECT a FROM t1 x WHERE id = 1", "select `a` from t12 x", "select a from t12 x order by rand()", "SELECT STRASSE t1 y", "aß y t1", None, "from t1 x", "from t1 xy /* from t12 x */"]
    statements = spark.createDataFrame(list(enumerate(texts)), "plan_id bigint, sql_text string")
    upper = [" ".join((t or "").split("/*")[0].split()).upper() for t in texts]
    want = sorted((i, f"R{j}") for i, t in enumerate(upper) for j, v in enumerate(values) if (v or "").upper() in t)
    found = rules.join_rules(statements, data)
    assert sorted((r["plan_id"], r["rule_id"]) for r in found.collect()) == want
    only = rules.join_rules(statements, data.where("length(conditions[0].value) > 3"))
    assert "hashpartitioning" not in only._jdf.queryExecution().executedPlan().toString()
