"""Golden values of the statement functions."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import structure as S
from tidewatch.functions import text as X
from tidewatch.operators import knowledge, metadata, statements
from tidewatch.sources import readers


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("seconds, rows, grade", [
    (15.0, 2_000_000, "P0"), (1.0, 1_000_000, "P0"), (10.0, 100, "P0"),
    (3.5, 200_000, "P1"), (0.5, 100_000, "P1"), (2.0, 500, "P1"), (0.1, 100, "P2"),
])
def test_severity(spark, seconds, rows, grade):
    assert one(spark, X.severity(F.col("s"), F.col("r")), s=seconds, r=rows) == grade


def test_severity_without_metrics(spark):
    assert one(spark, X.severity(F.lit(None).cast("double"), F.lit(None).cast("bigint")), a=1) == "P2"


def test_fingerprint_ignores_case_and_blanks_but_not_instance(spark):
    def mark(sql, instance="i1"):
        return one(spark, X.fingerprint(F.col("i"), F.col("s")), i=instance, s=sql)

    assert mark("SELECT * FROM orders WHERE id=1") == mark("select *  from orders\nwhere id = 1 ")
    assert mark("SELECT a, b, c FROM t") == mark("SELECT a,b,c FROM t")
    assert mark("SELECT 1 FROM t") != mark("SELECT 1 FROM t", "i2")
    assert mark("SELECT 1 FROM t") != mark("SELECT 2 FROM t")


@pytest.mark.parametrize("sql, masked, count", [
    ("x WHERE phone = '15900001111'", "x WHERE phone = '159****1111'", 1),
    ("x WHERE id_card = '440303198507154321'", "x WHERE id_card = '440***********4321'", 1),
    ("x WHERE id_card = '44030319850715432X'", "x WHERE id_card = '440***********432X'", 1),
    ("x WHERE email = 'mira@post.example'", "x WHERE email = 'mi***@post.example'", 1),
    ("x WHERE email = 'm@x'", "x WHERE email = '***'", 1), ("x WHERE password = 'hunter7'", "x WHERE password = '***'", 1),
    ("x WHERE state = 'open'", "x WHERE state = 'open'", 0),
    ("x WHERE `Mobile`='15900001111' AND pwd = '' AND tel='7'", "x WHERE `Mobile`='159****1111' AND pwd = '' AND tel='***'", 3),
    ("x WHERE telephone = '15900001111'", "x WHERE telephone = '159****1111'", 1), ("phone = 'k$2\\\\'", "phone = '***'", 1),
    ("password = 'it''s me' AND a = 1", "password = '***' AND a = 1", 1), ("pwd = 'a\\'b' OR 1", "pwd = '***' OR 1", 1),
    ('SET password = "open sesame", b = 2', 'SET password = "***", b = 2', 1), ("phone = 15900001111 AND tel <> -5", "phone = 159****1111 AND tel <> ***", 2),
    ("mobile IN ('15900001111', \"15900002222\", 7) AND x IN (1)", "mobile IN ('159****1111', \"159****2222\", ***) AND x IN (1)", 3),
    ("email LIKE 'mira@%' AND phone = ? AND tel = t.tel AND pwd IS NULL", "email LIKE 'mi***@%' AND phone = ? AND tel = t.tel AND pwd IS NULL", 1),
    (None, None, None),
])
def test_mask(spark, sql, masked, count):
    row = spark.createDataFrame([(sql,)], "s string").select(X.mask_sql(F.col("s")), X.sensitive_count(F.col("s"))).first()
    assert (row[0], row[1]) == (masked, count)


@pytest.mark.parametrize("template, parameters, bound", [
    ("SELECT n FROM parcels WHERE no = ? AND place = ?", "7(Long), Lund(String)", "SELECT n FROM parcels WHERE no = 7 AND place = 'Lund'"),
    ("no = ?", None, "no = ?"), ("no = ?", "null", "no = null"), ("no = ? AND p = ?", "null, 3(Integer)", "no = null AND p = 3"),
    ("d = ? AND n = ?", "2023-11-30 08:15:00.0(Timestamp), 4.50(BigDecimal)", "d = '2023-11-30 08:15:00.0' AND n = 4.50"),
    ("a = ? AND b = ? AND c = ?", "d'Arc(String), y", "a = 'd''Arc' AND b = y AND c = ?"),
    ("a = ?", "5(Long), 6(Long)", "a = 5"), ("a = 'x'", "5(Long)", "a = 'x'"),
    ("a = ? AND b = ?", "one, two (three), four(String), 9(Short)", "a = 'one, two (three), four' AND b = 9"),
    ("a = ? AND b = ?", "(String), null(String)", "a = '' AND b = null"), ("a = ?", "[1, 2](byte[])", "a = [1, 2]"),
])
def test_bind(spark, template, parameters, bound):
    assert one(spark, X.bind_sql(F.col("t"), F.col("p")), t=template, p=parameters) == bound


def test_bind_parameters_pairs_within_a_thread(spark):
    lines = [
        (1, "a", "==>  Preparing: SELECT ?"), (2, "b", "==>  Preparing: UPDATE t SET x = ?"), (3, "a", "noise"),
        (4, "a", "==> Parameters: 1(Long)"), (5, "b", "==>  Preparing: DELETE ?"), (6, "b", "==> Parameters: z(String)"),
        (200_000, "c", "Preparing: SELECT ?"), (400_000, "c", "Parameters: 7(Integer)"),
    ]
    df = spark.createDataFrame(lines, "line_no bigint, thread string, line string")
    got = {(r["thread"], r["line_no"]): r["sql_text"] for r in statements.bind_parameters(df).collect()}
    assert got == {("a", 1): "SELECT 1", ("b", 2): "UPDATE t SET x = ?", ("b", 5): "DELETE 'z'", ("c", 200_000): "SELECT 7"}


@pytest.mark.parametrize("sql, kind", [
    ("SELECT a FROM t", "select"), ("SELECT 1; SELECT 2", "multi"), ("INSERT INTO t VALUES (1)", "other"), ("DELETE FROM t", "other"),
    ("UPDATE t SET a = 1", "other"), ("DROP TABLE t", "other"), ("", "empty"), ("  ", "empty"), (None, "empty"), ("SELECT ';' FROM t;", "select"),
    ("-- x; y\nSELECT 1", "select"), ("WITH c AS (SELECT 1) SELECT * FROM c", "select"), ("WITH c AS (SELECT 1) DELETE FROM t", "other"),
    ("(SELECT 1) UNION (SELECT 2)", "select"), ("SELECT 'it''s; ok', \"a;b\"", "select"),
])
def test_classes(spark, sql, kind):
    assert one(spark, X.statement_class(F.col("s")), s=sql) == kind


@pytest.mark.parametrize("sql, tables", [
    ("SELECT * FROM orders o JOIN users u ON o.uid = u.id", ["orders", "users"]),
    ("SELECT * FROM orders JOIN archive_db.old_orders a ON 1 = 1", ["orders", "old_orders"]),
    ("select * from a, `b` x, c.d as y where a.id = 'from ghost'", ["a", "b", "d"]),
    ("WITH r AS (SELECT * FROM base), s (n) AS (SELECT 1) SELECT * FROM r, s, t", ["base", "t"]),
    ("SELECT EXTRACT(YEAR FROM ts), (SELECT 1 FROM inner_t) FROM outer_t LIMIT 1, 2", ["inner_t", "outer_t"]),
    ("SELECT * FROM t1 NATURAL JOIN t2 STRAIGHT_JOIN t3 /* FROM t4 */", ["t1", "t2", "t3"]), ("SELECT 1", []), (None, []),
    ("SELECT * FROM t PARTITION (p0, p1), u", ["t", "u"]), ("SELECT * FROM t FORCE INDEX (i, j), u IGNORE INDEX FOR ORDER BY (k) JOIN v", ["t", "u", "v"]),
    ("SELECT * FROM (t1, t2 AS b) JOIN ((t3)) ON 1", ["t1", "t2", "t3"]), ("SELECT * FROM t JOIN LATERAL (SELECT 1 FROM u WHERE u.a = t.a) l ON true, w", ["t", "u", "w"]),
    ("SELECT * FROM t, JSON_TABLE(t.doc, '$' COLUMNS (a INT PATH '$.a')) j, u", ["t", "u"]), ("SELECT a FROM t WHERE b IN (SELECT c FROM d, e) ORDER BY f, g", ["t", "d", "e"]),
    ("SELECT a IS DISTINCT FROM b FROM t", ["t"]), ("SELECT TRIM(BOTH 'x' FROM name) FROM `my db`.`my, table`", ["my, table"]),
    ("SELECT a FROM t GROUP BY a WITH ROLLUP; SELECT b FROM u", ["t", "u"]), ("SELECT STRAIGHT_JOIN a FROM t FOR UPDATE", ["t"]),
    ("INSERT INTO t (a, b) SELECT c, d FROM u LEFT OUTER JOIN v USING (x), w", ["u", "v", "w"]), ("SELECT 1 FROM t -- , ghost\n, u # FROM x", ["t", "u"]),
    ("SELECT 'unclosed FROM t", []), ("((SELECT a FROM t) UNION ALL (SELECT a FROM u))", ["t", "u"]), ("SELECT f(a, (b)) FROM t x, u y WHERE (x.a, y.b) IN ((1, 2))", ["t", "u"]),
])
def test_tables(spark, sql, tables):
    assert [t for t in dict.fromkeys(t for t, _ in S.table_refs(S.tokens(sql or "")))] == tables


def test_aliases():
    refs = S.table_refs(S.tokens("SELECT 1 FROM a AS x FORCE INDEX (i), b y PARTITION (p), s.c, (SELECT 1) d JOIN e USING (k) LEFT JOIN `f` `z`"))
    assert refs == [("a", "x"), ("b", "y"), ("c", ""), ("e", ""), ("f", "z")]


def test_used_columns_and_literals():
    sql = "SELECT x FROM t a JOIN u ON a.id = u.tid WHERE a.n NOT IN (1, 2) AND s = 'q = 5' AND f(z) > 3 AND g IS NOT NULL ORDER BY a.k DESC, m, h(w), `o`"
    assert set(S.used_columns(S.tokens(sql))) == {("a", "id"), ("u", "tid"), ("a", "n"), ("", "s"), ("", "g"), ("a", "k"), ("", "m"), ("", "o")}
    tests = S.literal_tests(S.tokens("WHERE a.x = 5 AND `y` >= '7' -- z = 1\n AND w <> -2.5 AND v = 'it''s' AND q = r AND d.e.f < 1e3"))
    assert tests == [("a", "x", "5"), ("", "y", "'7'"), ("", "w", "-2.5"), ("", "v", "'it''s'"), ("e", "f", "1e3")]


def test_each_distinct_text_is_analysed_once(spark):
    rows = spark.createDataFrame([(i, f"SELECT a FROM t{i % 3}" if i % 4 else None) for i in range(400)], "statement_id bigint, sql_text string")
    found = statements.referenced_tables(rows)
    assert found.count() == 300 and found.select("table_name").distinct().count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.rindex("HashAggregate") > plan.index("ArrowEvalPython")


def test_noise(spark):
    rows = ["SHOW GLOBAL VARIABLES LIKE 'x'", "SELECT * FROM orders WHERE status = 'pending'", "SELECT a", "  select 1 from dual", "UPDATE t SET a = 1",
            "SELECT * FROM mysql.user", "WITH a AS (SELECT b FROM c) SELECT * FROM a", "set names utf8mb4", "\n SELECT x FROM captured_sql"]
    df = spark.createDataFrame([(r,) for r in rows], "sql_text string")
    kept = [r[0] for r in df.filter(~X.is_noise(F.col("sql_text"))).collect()]
    assert kept == [rows[1], rows[6]]


def test_slow_log_file(spark, tmp_path):
    (tmp_path / "slow.log").write_text(
        "mysqld, Version: 8.0\nTcp port: 3306\nuse early;\n# Time: 2024-05-01T10:00:00.123456Z\n# User@Host: a[a] @ h\n"
        "# Query_time: 1.5  Lock_time: 0.25 Rows_sent: 3  Rows_examined: 400\nSET timestamp=1;\nSELECT *\n  FROM t\nWHERE a = 1;\n"
        "# Time: 2024-05-01T10:00:05Z\n# Query_time: 2  Lock_time: 0 Rows_sent: 0  Rows_examined: 5\nuse shop;\nSELECT 2;\n"
        "# Time: 2024-05-01T10:00:06Z\n# Query_time: 0.1  Lock_time: 0 Rows_sent: 0  Rows_examined: 5\nSELECT fast;\n"
        "# Time: 2024-05-01T10:00:07Z\n# Query_time: 7.25  Lock_time: 0 Rows_sent: 1  Rows_examined: 9\nSELECT 3;\n"
    )
    events, rejects = readers.src_slow_log(spark, str(tmp_path), instance_id="i")
    got = events.orderBy("captured_at").collect()
    assert rejects.count() == 0
    assert [(r["database_name"], r["sql_text"], r["query_time_sec"], r["lock_time_sec"], r["rows_examined"], r["rows_sent"]) for r in got] == [
        ("early", "SELECT *\n  FROM t\nWHERE a = 1;", 1.5, 0.25, 400, 3), ("shop", "SELECT 2;", 2.0, 0.0, 5, 0), ("shop", "SELECT 3;", 7.25, 0.0, 9, 1),
    ]
    strict = readers.src_slow_log(spark, str(tmp_path), instance_id="i", strict=True)[0].orderBy("captured_at").collect()
    assert [r["database_name"] for r in strict] == ["early", "early", "shop"]


def test_index_coverage_uses_aliases(spark):
    stmts = spark.createDataFrame([(1, "i", "SELECT * FROM orders o JOIN users u ON o.uid = u.id WHERE o.state = 1 AND u.mail = 'x'")],
                                  "statement_id bigint, instance_id string, sql_text string")
    idx = spark.createDataFrame([("i", "orders", "uid"), ("i", "users", "id")], "instance_id string, table_name string, column_name string")
    got = {r["table_name"]: (r["indexed_columns"], r["missing_columns"]) for r in metadata.index_coverage(stmts, idx).collect()}
    assert got == {"orders": ("uid", "state"), "users": ("id", "mail")}


def test_texts_of_one_shape_have_their_own_digits():
    one = "WITH r1 AS (SELECT 1) SELECT * FROM r{}, t{} x, `a%{}` WHERE x.k = -{}.5 AND c{} IN ('\\{}') AND d = '{}' ORDER BY k{}"
    texts = [one.format(*n) for n in ([1] * 8, range(8), range(100, 108), [1, 2, 1, 2, 1, 2, 1, 2], [7, 7, 7, 0, 0, 10, 10, 7])] + [None, "", "9 a9 = 99"]
    walked = [(S.table_refs(t), S.used_columns(t), S.literal_tests(t)) for t in map(S.tokens, (t or "" for t in texts))]
    got = [tuple([tuple(r.values()) for r in row[p]] for p in ("refs", "used", "tests")) for row in S.parts_array(texts).to_pylist()]
    assert got == walked


def test_audits_leave_statements_where_they_are(spark):
    stmts = spark.createDataFrame([(1, "i", "SELECT * FROM orders2 o WHERE o.state = 1")], "statement_id bigint, instance_id string, sql_text string")
    columns = spark.createDataFrame([("i", "orders2", "state", "text")], "instance_id string, table_name string, column_name string, data_type string")
    coverage, mismatch = metadata.index_coverage(stmts, columns.drop("data_type")), metadata.type_mismatch(stmts, F.broadcast(columns))
    for found in (coverage, mismatch):
        assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in coverage.collect()] == [(1, "i", "orders2", "state", "")] and mismatch.count() == 1


def test_masks_search_a_text_once(spark):
    texts = ["phone = '13812345678' and \x01 pwd in ('a', 12) or email='ab@c.d'", None, "", "Mail LIKE 'x' -- \x01"]
    found = statements.mask_statements(spark.createDataFrame(list(enumerate(texts)), "id int, sql_text string"))
    assert [tuple(r)[2:] for r in found.orderBy("id").collect()] == [
        ("phone = '138****5678' and \x01 pwd in ('***', ***) or email='ab***@c.d'", 4, True), (None, None, None), ("", 0, False), ("Mail LIKE '***' -- \x01", 1, True)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("social_security") <= 10


def test_manual_contexts_are_made_once_per_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["SELECT a FROM t WHERE pwd = 'x'"] * 3 + [None])], "event_id bigint, sql_text string")
    documents = spark.createDataFrame([(1, "t", "c", "军规", "t", True)], "id bigint, title string, content string, category string, tags string, enabled boolean")
    found = knowledge.build_manual_context(rows, documents)
    got = [r["context"] for r in found.orderBy("event_id").collect()]
    assert got[0] == got[1] == got[2] and "pwd = '***'" in got[0] and "**规则1**" in got[0] and got[3] is None
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("social_security")
