"""Match statements, and optionally their plans, with a rule set.

A small rule set is configuration: (id, category, title, conditions, suggestion), all conditions must hold. It is turned into
one array expression per statement, so matching is a projection without a join or shuffle. Rule sets of any size are tables (`rule_rows`).
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions.text import preview, severity, strip_comments, unnest
from tidewatch.operators.rule_rows import join_rule_rows

_COMPARISONS = (
    (">=", lambda a, b: a >= b), ("<=", lambda a, b: a <= b), (">", lambda a, b: a > b), ("<", lambda a, b: a < b),
)


def _compare(actual: Column, bound: str) -> Column:
    text = bound.strip()
    for sign, test in _COMPARISONS:
        if text.startswith(sign):
            return test(actual, float(text[len(sign):]))
    return actual == float(text)


def _text_condition(upper: Column, key: str, value: str) -> Column | None:
    if key == "sql_contains":
        return F.contains(upper, F.lit(value.upper()))
    if key == "sql_not_contains":
        return ~F.contains(upper, F.lit(value.upper()))
    if key == "sql_pattern":
        return upper.rlike(f"(?i){value}")
    return None


def _plan_condition(access: Column, key: str, value: str) -> Column:
    if key == "explain_access_type":
        return F.lower(F.coalesce(access["access_type"], F.lit(""))) == value.lower()
    if key == "explain_key_is_null":
        return access["key_is_null"] if value == "true" else F.lit(False)
    if key == "explain_rows":
        return _compare(F.coalesce(access["rows"], F.lit(0)), value)
    if key == "explain_filtered":
        return _compare(F.coalesce(access["filtered"], F.lit(0.0)), value)
    if key == "explain_extra_contains":
        return F.contains(F.coalesce(access["extra"], F.lit("")), F.lit(value))
    return F.lit(False)  # an unknown condition never holds


def _all_on_plan(conditions):
    return lambda access: reduce(lambda x, y: x & y, [_plan_condition(access, k, v) for k, v in conditions])


def matched_rules(upper: Column, rules, accesses: Column | None = None) -> Column:
    """Array of the matching rules in rule order. Plan conditions hold if one table access meets all of them."""
    hits = []
    for number, (rule_id, category, title, conditions, suggestion) in enumerate(rules, 1):
        holds, on_plan = [], []
        for key, value in conditions:
            text = _text_condition(upper, key, value)
            if text is None:
                on_plan.append((key, value))
            else:
                holds.append(text)
        if on_plan:
            if accesses is None:
                continue
            holds.append(F.exists(accesses, _all_on_plan(on_plan)))
        rule = F.struct(
            F.lit(number).alias("rule_no"), F.lit(rule_id).alias("rule_id"), F.lit(category).alias("category"),
            F.lit(title).alias("title"), F.lit(suggestion).alias("suggestion"),
        )
        hits.append(F.when(reduce(lambda x, y: x & y, holds, F.lit(True)), rule))
    empty = "array<struct<rule_no:int,rule_id:string,category:string,title:string,suggestion:string>>"
    return F.array_compact(F.array(*hits)) if hits else F.array().cast(empty)


def with_rules(statements: DataFrame, rules=K.RULES, *, accesses: str | None = None) -> DataFrame:
    """Add `matched`, the array of matching rules."""
    upper = statements.withColumn("_upper", F.upper(strip_comments(F.col("sql_text"))))
    plan = F.col(accesses) if accesses else None
    return upper.withColumn("matched", matched_rules(F.col("_upper"), rules, plan)).drop("_upper")


def _per_rule(rows: DataFrame, columns) -> DataFrame:
    return unnest(rows, "matched", "_rule", *columns).select(*columns, "_rule.*")


def join_rules(statements: DataFrame, rules=K.RULES) -> DataFrame:
    """One row per statement and matching rule, without plans. `rules` may be a table of any size (see `rule_rows`)."""
    if isinstance(rules, DataFrame):
        return join_rule_rows(statements, rules)
    return _per_rule(with_rules(statements, rules), statements.columns)


def join_rules_with_plan(statements: DataFrame, plan_accesses: DataFrame, rules=K.RULES, *, key="plan_id") -> DataFrame:
    """The same with the statement's plan; `plan_accesses` has one row per plan with the array `accesses`."""
    if isinstance(rules, DataFrame):
        return join_rule_rows(statements, rules, plan_accesses, key=key)
    both = statements.join(plan_accesses.select(key, "accesses"), key, "left")
    return _per_rule(with_rules(both, rules, accesses="accesses"), statements.columns)


def rules_text(matched: Column) -> Column:
    """The matched rules as one text, empty without a match."""
    blocks = F.transform(matched, lambda r: F.concat(
        F.lit("**规则 #"), r["rule_id"], F.lit("** ["), r["category"], F.lit("]: "), r["title"],
        F.lit("\n> "), r["suggestion"], F.lit("\n\n"),
    ))
    return F.when(F.size(matched) > 0, F.concat(F.lit("\n" + K.KNOWLEDGE_HEADER), F.array_join(blocks, ""))).otherwise("")


def rules_report(statements: DataFrame, rules=K.RULES) -> DataFrame:
    """Add the text of the matching rules."""
    return with_rules(statements, rules).withColumn("rules_report", rules_text(F.col("matched"))).drop("matched")


def context_text(has_metrics: Column, rules: Column) -> Column:
    metrics = F.format_string("- 耗时: %.2f 秒\n- 扫描: %d 行\n", F.col("query_time_sec"), F.col("rows_examined"))
    return F.concat(
        F.lit(K.CONTEXT_HEADER), F.when(has_metrics, metrics).otherwise(""),
        F.lit("- 来源: "), F.coalesce("source", F.lit("null")), F.lit("\n- 库: "),
        F.coalesce("database_name", F.lit("unknown")), F.lit("\n\n" + K.STATEMENT_HEADER),
        F.coalesce("sql_text", F.lit("null")), F.when(rules != "", F.concat(F.lit("\n"), rules)).otherwise(""),
    )


def build_context(events: DataFrame, rules=K.RULES) -> DataFrame:
    """Add the diagnosis context of captured events."""
    has_metrics = F.col("query_time_sec").isNotNull() & F.col("rows_examined").isNotNull()
    return (
        with_rules(events, rules).withColumn("context", context_text(has_metrics, rules_text(F.col("matched"))))
        .drop("matched")
    )


def _by_grade(grade: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])[grade]


def alert_text(events: DataFrame, *, content: Column | None = None, statement_cut=100, content_cut=300) -> DataFrame:
    """Add the alert line with the statement and the content, both cut. The content says by default that the statement is new; a
    report may be given instead."""
    seconds = F.coalesce("query_time_sec", F.lit(0.0))
    rows = F.coalesce("rows_examined", F.lit(0).cast("bigint"))
    grade = severity(seconds, rows)
    mark = _by_grade(grade, K.SEVERITY_MARKS)
    new = F.concat(mark, F.lit(" ["), _by_grade(grade, K.SEVERITY_LABELS), F.lit(f"] {K.NEW_STATEMENT}"))
    body = new if content is None else content
    return events.withColumn("alert", F.concat(
        mark, F.lit(f" {K.ALERT_TITLE}\n库: "), F.coalesce("database_name", F.lit("unknown")),
        F.format_string("\n耗时: %.1fs | 扫描: %d行\nSQL: ", seconds, rows),
        preview(F.col("sql_text"), statement_cut), F.lit("\n\n"), preview(body, content_cut),
    ))
