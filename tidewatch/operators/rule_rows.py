"""Rules as rows, for rule sets of any size.

A rule is a row of RULES; all its conditions must hold. Thousands of rules as expressions would be a plan of thousands of branches, and every
statement would be compared with all of them. Here each set of conditions that requires a fragment of text is indexed under one key of it:
a word that stands inside the fragment with other characters on both sides, so that a text with the fragment has it as a whole word; where a fragment has
none, a substring of eight characters, or of three if it is shorter. Of several keys it is the one that the fewest statements have. Statements
meet the index on their own words (and substrings, if a key is one) in an equality join, in which they carry their text along, and only the rules met
there are checked, with their conditions as data. Rules that require no fragment (patterns, plans, absence of a text) are checked for every statement,
as one array; they are expected to be few.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions.text import strip_comments, unnest
from tidewatch.session import settled

RULES = "rule_no int, rule_id string, category string, title string, suggestion string, conditions array<struct<key: string, value: string>>"
_GRAMS = (8, 3)  # lengths of substrings that are keys, longest first
_SHOWN = ("rule_no", "rule_id", "category", "title", "suggestion")
_TEXT_KEYS = ("sql_contains", "sql_not_contains", "sql_pattern")
_SIGN = r"^\s*(>=|<=|>|<|)\s*(.*?)\s*$"


def rule_rows(spark: SparkSession, rules=K.RULES) -> DataFrame:
    """A rule set of the shape in `constants` as rows, numbered from one."""
    rows = [(n, i, c, t, s, list(conditions)) for n, (i, c, t, conditions, s) in enumerate(rules, 1)]
    return spark.createDataFrame(rows, RULES)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines with the fields of RULES."""
    return spark.read.schema(RULES).json(path)


def _text_holds(upper: Column, c: Column) -> Column:
    value = F.coalesce(c["value"], F.lit(""))
    return (
        F.when(c["key"] == "sql_contains", F.contains(upper, F.upper(value)))
        .when(c["key"] == "sql_not_contains", ~F.contains(upper, F.upper(value)))
        .when(c["key"] == "sql_pattern", F.rlike(upper, F.concat(F.lit("(?i)"), value)))
        .otherwise(F.lit(True))
    )


def _compared(actual: Column, text: Column) -> Column:
    sign, bound = F.regexp_extract(text, _SIGN, 1), F.regexp_extract(text, _SIGN, 2).try_cast("double")
    test = (
        F.when(sign == ">=", actual >= bound).when(sign == "<=", actual <= bound).when(sign == ">", actual > bound)
        .when(sign == "<", actual < bound).otherwise(actual == bound)
    )
    return F.coalesce(test, F.lit(False))


def _plan_holds(access: Column, c: Column) -> Column:
    key, value = c["key"], F.coalesce(c["value"], F.lit(""))
    return (
        F.when(key == "explain_access_type", F.lower(F.coalesce(access["access_type"], F.lit(""))) == F.lower(value))
        .when(key == "explain_key_is_null", (value == "true") & access["key_is_null"])
        .when(key == "explain_rows", _compared(F.coalesce(access["rows"], F.lit(0)).cast("double"), value))
        .when(key == "explain_filtered", _compared(F.coalesce(access["filtered"], F.lit(0.0)), value))
        .when(key == "explain_extra_contains", F.contains(F.coalesce(access["extra"], F.lit("")), value))
        .otherwise(F.lit(False))  # an unknown condition never holds
    )


def _is_text(c: Column) -> Column:
    return c["key"].isin(*_TEXT_KEYS)


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of `size` characters; the sign in front tells them from words."""
    spots = F.sequence(F.lit(1), F.length(text) - (size - 1))
    found = F.transform(spots, lambda i: F.concat(F.lit(":"), F.substring(text, i, F.lit(size))))
    return F.when(F.length(text) >= size, F.array_distinct(found))


def _fragment_keys(fragment: Column) -> Column:
    inside = F.array_distinct(F.regexp_extract_all(fragment, F.lit(r"(?<=\W)\w+(?=\W)"), F.lit(0)))
    return F.when(F.size(inside) > 0, inside).otherwise(F.coalesce(*[_grams(fragment, n) for n in _GRAMS]))


def _text_keys(text: Column, sizes) -> Column:
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0)))
    none = F.array().cast("array<string>")
    return F.concat(words, *[F.coalesce(_grams(text, n), none) for n in sizes]) if sizes else words


def text_matches(statements: DataFrame, rules: DataFrame) -> DataFrame:
    """The columns of the statements and those of RULES with `_` in front: one row per statement and rule whose conditions on the text hold; a
    NULL text is an empty one."""
    spark = rules.sparkSession
    rules = rules.withColumn("conditions", F.coalesce("conditions", F.array().cast("array<struct<key: string, value: string>>")))
    rules = rules.withColumn("_set", F.to_json("conditions"))  # rules with equal conditions share a key
    named = rules.select("_set", *[F.col(n).alias(f"_{n}") for n in _SHOWN])
    sets = rules.groupBy("_set").agg(F.first("conditions").alias("conditions"))
    fragments = unnest(sets, "conditions", "c", "_set").filter((F.col("c.key") == "sql_contains") & (F.length("c.value") >= min(_GRAMS)))
    # Written, so that their measured size decides whether they go to every task: the statements then need no shuffle.
    keys = settled(
        unnest(fragments.select("_set", _fragment_keys(F.upper("c.value")).alias("_all")), "_all", "_key", "_set").distinct(), "rule-keys")
    gram = F.when(F.substring("_key", 1, 1) == ":", F.length("_key") - 1)
    sizes = sorted(r[0] for r in keys.select(gram.alias("n")).distinct().collect() if r[0])
    texts = statements.withColumn("_upper", F.upper(strip_comments(F.col("sql_text"))))
    held = unnest(texts.withColumn("_keys", _text_keys(F.col("_upper"), sizes)), "_keys", "_key", *statements.columns, "_upper")
    # Only where there is a choice the statements are counted.
    several = keys.groupBy("_set").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    open_ = keys.join(several, "_set", "left_semi").select("_key").distinct()
    counts = held.select("_key").join(open_, "_key").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    rarest = keys.join(counts, "_key", "left").groupBy("_set").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_key").alias("key"))).alias("_least"))
    index = settled(rarest.join(sets, "_set").select(F.col("_least.key").alias("_key"), F.col("conditions").alias("_conditions")), "rule-index")
    met = held.join(index, "_key").filter(F.forall("_conditions", lambda c: _text_holds(F.col("_upper"), c)))
    columns = [*statements.columns, *[f"_{n}" for n in _SHOWN], "_conditions"]
    found = met.withColumn("_set", F.to_json("_conditions")).join(settled(named, "rules"), "_set").select(*columns)
    # What has no fragment is configuration of a few rows and travels as one literal.
    others = [r.asDict(recursive=True) for r in rules.join(keys, "_set", "left_anti").drop("_set").orderBy("rule_no").collect()]
    if others:
        literal = F.from_json(F.lit(json.dumps(others)), f"array<{spark.createDataFrame([], RULES).schema.simpleString()}>")
        holds = F.filter(literal, lambda r: F.forall(r["conditions"], lambda c: _text_holds(F.col("_upper"), c)))
        plain = unnest(texts.withColumn("_rules", holds), "_rules", "_r", *statements.columns)
        found = found.unionByName(plain.select(*statements.columns, *[F.col(f"_r.{n}").alias(f"_{n}") for n in (*_SHOWN, "conditions")]))
    return found


def join_rule_rows(statements: DataFrame, rules: DataFrame, plan_accesses: DataFrame | None = None, *, key="plan_id") -> DataFrame:
    """One row per statement and matching rule. With `plan_accesses` (one row per plan with the array `accesses`) plan conditions hold if
    one table access meets all of them; without it rules with such conditions match nothing."""
    both = statements
    if plan_accesses is not None:
        both = both.join(plan_accesses.select(key, F.col("accesses").alias("_accesses")), key, "left")
    met = text_matches(both, rules)
    on_plan = F.filter("_conditions", lambda c: ~_is_text(c))
    if plan_accesses is None:
        kept = met.filter(F.size(on_plan) == 0)
    else:
        one = F.exists("_accesses", lambda a: F.forall(on_plan, lambda c: _plan_holds(a, c)))
        kept = met.filter((F.size(on_plan) == 0) | F.coalesce(one, F.lit(False)))
    return kept.select(*statements.columns, *[F.col(f"_{n}").alias(n) for n in _SHOWN])
