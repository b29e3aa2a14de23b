"""Column expressions over statement text. All of them stay inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import constants as K

# Possessive, so long literals do not backtrack. Matched as alternatives, whichever starts first counts.
_LITERAL = r"""'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'|"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+\""""
_COMMENT = r"/\*.*?\*/|--[^\n]*+|#[^\n]*+"


def any_of(words, prefix: str = "", suffix: str = "") -> str:
    """A regex that matches one of the given literal words."""
    return prefix + "(?:" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + ")" + suffix


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def normalize_sql(sql: Column) -> Column:
    """Collapse blanks, lower-case, drop blanks around punctuation; literals are kept."""
    text = F.lower(F.trim(F.regexp_replace(F.coalesce(sql, F.lit("")), r"\s+", " ")))
    for pattern, mark in ((r"\s*,\s*", ","), (r"\s*=\s*", "="), (r"\s*\(", "("), (r"\)\s*", ")")):
        text = F.regexp_replace(text, pattern, mark)
    return text


def fingerprint(instance: Column, sql: Column) -> Column:
    """Identity of a statement on one instance."""
    # never NULL, and said so: a join on it needs no NULL test, which would compute the text again in the scan
    return F.coalesce(F.md5(F.concat(F.coalesce(instance, F.lit("null")), F.lit(":"), normalize_sql(sql))), F.lit(""))


def fingerprint_global(sql: Column) -> Column:
    """Identity of a statement over all instances."""
    return F.coalesce(F.md5(normalize_sql(sql)), F.lit(""))


def severity(seconds: Column, rows: Column) -> Column:
    """Grade by run time or examined rows; statements without metrics get the mildest grade."""
    return (
        F.when((seconds >= K.P0_SECONDS) | (rows >= K.P0_ROWS), "P0")
        .when((seconds >= K.P1_SECONDS) | (rows >= K.P1_ROWS), "P1")
        .otherwise("P2")
    )


def strip_comments(sql: Column) -> Column:
    """Drop block and line comments, then collapse blanks."""
    text = F.regexp_replace(F.coalesce(sql, F.lit("")), r"(?s)/\*.*?\*/", "")
    text = F.regexp_replace(text, r"--[^\n]*", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_comments(sql: Column) -> Column:
    """The statement with its literals, but without comments; text inside literals is no comment."""
    return F.regexp_replace(sql, f"(?s)({_LITERAL})|{_COMMENT}", "$1 ")


def bare_code(sql: Column, mark: str = " ") -> Column:
    """The statement without comments and with `mark` for literals, so that only code is left to match."""
    if mark == " ":
        return F.regexp_replace(sql, f"(?s){_LITERAL}|{_COMMENT}", " ")
    return F.regexp_replace(without_comments(sql), f"(?s){_LITERAL}", mark)


def is_noise(sql: Column) -> Column:
    """Housekeeping and metadata statements, and everything that does not read."""
    start = r"^[\x00-\x20]*"

    def of(upper):
        fragments = [F.contains(upper, F.lit(f)) for f in K.NOISE_FRAGMENTS]
        return (
            upper.rlike(any_of(K.NOISE_PREFIXES, start)) | ~upper.rlike(any_of(K.KEPT_PREFIXES, start))
            | reduce(lambda x, y: x | y, fragments)
        )

    return (F.length(sql) < K.NOISE_MIN_LENGTH) | let(F.upper(sql), of)


def has_write_word(sql: Column) -> Column:
    return sql.rlike(any_of(K.WRITE_WORDS, r"(?i)\b", r"\b"))


def mask_value(value: Column) -> Column:
    """Keep the ends of phone and id numbers, the start and domain of addresses, nothing of the rest."""
    at = F.locate("@", value)
    return (
        F.when(value == "", value)
        .when(value.rlike(r"^\d{11}$"), F.concat(F.substring(value, 1, 3), F.lit("****"), F.right(value, F.lit(4))))
        .when(
            value.rlike(r"^(?:\d{15}|\d{17}[\dXx])$"),
            F.concat(F.substring(value, 1, 3), F.lit("*" * 11), F.right(value, F.lit(4))),
        )
        .when(
            (F.length(value) > 3) & (at >= 3),
            F.concat(F.substring(value, 1, 2), F.lit("***"), F.substring(value, at, F.length(value))),
        )
        .otherwise("***")
    )


_VALUE = rf"(?:{_LITERAL}|-?\d+(?:\.\d+)?\b)"


def _sensitive(names) -> str:
    """A sensitive name with what it is compared with or set to: one value (group 2) or a list in brackets (group 4)."""
    longest_first = sorted(names, key=lambda n: (-len(n), n))
    name = any_of(longest_first, "[`\"]?", "[`\"]?")
    one = rf"{name}\s*(?:=|<=>|<>|!=|\blike\b)\s*"
    many = rf"{name}\s+(?:not\s+)?in\s*\(\s*"
    # A look at one letter spares most places the list of names.
    begins = "".join(sorted({re.escape(n[0]) for n in names if n}))
    ahead = rf"(?=[`\"]?[{begins}])" if names and all(names) else ""
    return rf"(?is){ahead}(?:({one})({_VALUE})|({many})({_VALUE}(?:\s*,\s*{_VALUE})*))"


def _between(text: Column, pattern: str) -> Column:
    """What stands between the matches of a pattern. `split` would compile its pattern for every row, so matches become a mark first; a text
    that has the mark itself is split."""
    mark = "\x01"
    marked = F.split(F.regexp_replace(text, pattern, mark), mark)
    return F.when(F.contains(text, F.lit(mark)), F.split(text, pattern)).otherwise(marked)


def _masked_values(values: Column) -> Column:
    """Literals of a list text masked in their places, quotes kept."""
    def masked(literal):
        quote = F.when(literal.rlike("^['\"]"), F.substring(literal, 1, 1)).otherwise("")
        inner = F.when(quote == "", literal).otherwise(F.substring(literal, F.lit(2), F.length(literal) - 2))
        return F.concat(quote, let(inner, mask_value), quote)

    pattern = f"(?s){_VALUE}"
    return interleave(_between(values, pattern), F.transform(F.regexp_extract_all(values, F.lit(pattern), F.lit(0)), masked))


def _found(sql: Column, names, body) -> Column:
    """`body(head, values)` of every sensitive name with its constants. The text is searched once, the groups are cut from the short matches."""
    pattern = _sensitive(names)

    def parts(match):
        head = F.concat(F.regexp_extract(match, pattern, 1), F.regexp_extract(match, pattern, 3))
        return let(head, lambda h: let(F.substring(match, F.length(h) + 1, F.length(match)), lambda v: body(h, v)))

    return F.transform(F.regexp_extract_all(sql, F.lit(pattern), F.lit(0)), parts)


def masked_parts(sql: Column, names=K.SENSITIVE_NAMES) -> Column:
    """(text, n) of what `mask_sql` puts in place of every sensitive name with its constants, and how many constants that masks."""
    def part(head, values):
        return F.struct(
            F.concat(head, _masked_values(values)).alias("text"), F.size(F.regexp_extract_all(values, F.lit(f"(?s){_VALUE}"), F.lit(0))).alias("n"))

    return _found(sql, names, part)


def masked_count(parts: Column) -> Column:
    return F.aggregate(F.transform(parts, lambda p: p["n"]), F.lit(0), lambda n, k: n + k)


def masked_text(sql: Column, parts: Column, names=K.SENSITIVE_NAMES) -> Column:
    return interleave(_between(sql, _sensitive(names)), F.transform(parts, lambda p: p["text"]))


def sensitive_count(sql: Column, names=K.SENSITIVE_NAMES) -> Column:
    """How many values `mask_sql` masks."""
    return masked_count(masked_parts(sql, names))


def mask_sql(sql: Column, names=K.SENSITIVE_NAMES) -> Column:
    """Mask the constants that sensitive names are set to, compared with or looked for among; the rest of the text stays as it is."""
    return masked_text(sql, masked_parts(sql, names), names)


def interleave(pieces: Column, fillers: Column) -> Column:
    """pieces[0] + fillers[0] + pieces[1] + ...; a missing filler adds nothing."""
    return F.array_join(
        F.zip_with(pieces, fillers, lambda p, f: F.concat(F.coalesce(p, F.lit("")), F.coalesce(f, F.lit("")))), ""
    )


# One parameter of a log line: `null`, a value with its type in brackets, or a bare rest; ", " stands between two.
_PARAMETER = r"(?s)\G(?:, )?(?:(null)(?=, |\s*$)|(.*?)\(([A-Z]\w*+(?:\[\])?|[a-z]+\[\])\)(?=, |\s*$)|([^,\s][^,]*?)(?=, |\s*$))"


def parameter_list(text: Column) -> Column:
    """`1(Long), done(String), null` -> SQL literals in order; values of text and time types are quoted."""
    def group(n):
        return F.regexp_extract_all(F.trim(text), F.lit(_PARAMETER), F.lit(n))

    found = F.arrays_zip(group(2).alias("value"), group(3).alias("type"), group(4).alias("bare"))

    def literal(p):
        value = F.trim(p["value"])
        quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
        return (
            F.when(p["type"] == "", F.when(p["bare"] == "", "null").otherwise(p["bare"]))
            .when(F.lower(value) == "null", "null")
            .when(F.lower(p["type"]).rlike(any_of(K.QUOTED_TYPES)), quoted).otherwise(value)
        )

    return F.transform(found, literal)


def bind_sql(template: Column, parameters: Column) -> Column:
    """Fill the question marks of a template in order; surplus marks stay."""
    def filled(pieces, values):
        marks = F.size(pieces) - 1
        fillers = F.concat(
            F.slice(values, F.lit(1), F.least(F.size(values), marks)),
            F.array_repeat(F.lit("?"), F.greatest(marks - F.size(values), F.lit(0))),
        )
        return interleave(pieces, fillers)

    return F.when(parameters.isNull() | (F.trim(parameters) == ""), template).otherwise(
        let(F.split(template, r"\?"), lambda p: let(parameter_list(parameters), lambda v: filled(p, v)))
    )


def statement_class(sql: Column) -> Column:
    """empty, multi, other or select. Syntax is not judged."""
    def of(code):
        parts = F.filter(F.split(code, ";"), lambda p: F.trim(p) != "")
        return (
            F.when(F.size(parts) > 1, "multi")
            .when(code.rlike(r"(?i)^[(\s]*with\b") & code.rlike(r"(?i)\)\s*(?:update|delete|insert)\b"), "other")
            .when(code.rlike(r"(?i)^[(\s]*(?:select|with)\b"), "select")
            .otherwise("other")
        )

    blank = sql.isNull() | sql.rlike(r"^\s*$")
    return F.when(blank, "empty").otherwise(let(F.trim(F.regexp_replace(bare_code(sql), r"\s+", " ")), of))


def refusal(statement_class_: Column) -> Column:
    return (
        F.when(statement_class_ == "empty", K.EMPTY_STATEMENT)
        .when(statement_class_ == "multi", K.MULTI_STATEMENT)
        .when(statement_class_ == "other", K.NOT_A_SELECT)
    )


def unnest(rows, array: str, name: str, *others):
    """`others` and one row per element of `array`.

    A plain explode lets the optimizer test the array for emptiness below, which computes a derived array
    a second time; the outer form with a filter above computes it once.
    """
    return rows.select(*others, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def micros(ts: Column) -> Column:
    """Microseconds since 1970, the same for both timestamp types."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def preview(text: Column, length: int) -> Column:
    """The text, cut with an ellipsis where it is longer than `length`."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def contains_text(text: Column, keyword: str) -> Column:
    """Case-insensitive search for a literal keyword."""
    return F.contains(F.lower(text), F.lit(keyword.lower()))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)
