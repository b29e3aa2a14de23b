"""What a statement is made of: its tables, the columns it compares or sorts by, the constants it compares with.

A text is cut into tokens once, and one walk over them keeps a stack with a state for every open bracket, so that subqueries, lists in
brackets, index hints and `FROM` inside functions are told apart. Texts come in Arrow batches. Texts that differ only in the digits of their
numbers and names have one shape, which is walked once; the digits are then put in their places.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = r"(?:`[^`]+`|[^\W\d][\w$]*)"
#: Groups: string, name, number, comparison, punctuation; comments have none.
TOKEN = re.compile(
    r"/\*.*?(?:\*/|\Z)|--[^\n]*|\#[^\n]*"
    r"|('(?:[^'\\]|\\.|'')*'?|\"(?:[^\"\\]|\\.|\"\")*\"?)"
    rf"|({_PART}(?:\s*\.\s*{_PART})*)"
    r"|(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(<=>|<>|!=|<=|>=|[=<>])|(\S)", re.DOTALL,
)
STRING, NAME, NUMBER, COMPARISON, OTHER = range(1, 6)

_JOIN_KINDS = frozenset("left right inner outer full cross natural".split())
_HINTS = frozenset("partition force use ignore index key tablesample".split())
_ENDS = frozenset("where group order having limit window union intersect except into for lock procedure set values offset fetch".split())
_SORT_ENDS = frozenset("limit for union intersect except into lock offset fetch rows range groups".split())
_NO_COLUMN = frozenset(
    "not null and or true false select case when then else end exists any all some interval binary distinct where on having set is in like "
    "between by unknown default".split()
)

PARTS = T.StructType([
    T.StructField("refs", T.ArrayType(T.StructType([T.StructField("table", T.StringType()), T.StructField("alias", T.StringType())]))),
    T.StructField("used", T.ArrayType(T.StructType([T.StructField("qualifier", T.StringType()), T.StructField("column", T.StringType())]))),
    T.StructField("tests", T.ArrayType(T.StructType([
        T.StructField("qualifier", T.StringType()), T.StructField("column", T.StringType()), T.StructField("literal", T.StringType())]))),
])
_FIELDS = {"refs": ("table", "alias"), "used": ("qualifier", "column"), "tests": ("qualifier", "column", "literal")}


def tokens(sql: str) -> list[tuple[int, str]]:
    return [(m.lastindex, m[m.lastindex]) for m in TOKEN.finditer(sql) if m.lastindex]


def _split(name: str) -> tuple[str, str]:
    """(qualifier, last part) of a dotted name, without quoting."""
    parts = [p.strip().strip("`") for p in re.findall(r"`[^`]+`|[^\s.`]+", name)] if "`" in name or "." in name else [name]
    return (parts[-2] if len(parts) > 1 else ""), parts[-1]


def table_refs(found: list[tuple[int, str]]) -> list[tuple[str, str]]:
    """(table, alias) of the physical tables in FROM and JOIN, without quoting, schema and names of common table expressions.

    States of an open bracket: select (no table list yet or any more), inside (an expression), expect (a table comes next), named (a table came,
    its alias may follow), as (its alias must follow), derived (a subquery or function came, its alias belongs to no table), done (a
    table with all that belongs to it), on (a join condition), cte (the name of a table expression comes next), body (its text follows).
    """
    stack, refs, ctes = ["select"], [], set()
    hint, before, earlier = False, "", ""
    for kind, text in found:
        state = stack[-1]
        word = text.lower() if kind == NAME else text if kind == OTHER else ""
        if kind == OTHER:
            if text == "(":
                if hint:
                    hint = False
                elif state == "named":  # a table function
                    refs.pop()
                    stack[-1] = "derived"
                elif state == "expect":
                    stack[-1] = "derived"
                stack.append("expect" if state == "expect" else "inside")
            elif text == ")":
                if len(stack) > 1:
                    stack.pop()
            elif text == ",":
                if state in ("named", "as", "derived", "done", "on"):
                    stack[-1] = "expect"
                elif state == "body":
                    stack[-1] = "cte"
            elif text == ";":
                stack, ctes = ["select"], set()
        elif kind == NAME and not hint:
            if word == "select":
                stack[-1] = "select"
            elif word == "from":
                if state == "select" and not (before == "distinct" and earlier in ("is", "not")):
                    stack[-1] = "expect"
            elif word in ("join", "straight_join"):
                if state in ("named", "as", "derived", "done", "on"):
                    stack[-1] = "expect"
            elif word == "with" and state in ("select", "inside", "expect"):
                stack[-1] = "cte"
            elif state == "cte":
                if word in ("rollup", "ties", "check", "query", "parser"):
                    stack[-1] = "select"
                elif word != "recursive":
                    ctes.add(_split(text)[1].lower())
                    stack[-1] = "body"
            elif state == "body":
                if word in ("update", "delete", "insert", "replace"):
                    stack[-1] = "done" if word == "update" else "select"
            elif word in ("on", "using") and state in ("named", "as", "derived", "done"):
                stack[-1] = "on"
            elif word in _ENDS:
                if state != "inside":
                    stack[-1] = "select"
            elif word == "update" and state == "select" and before != "for":
                stack[-1] = "done"
            elif state == "expect":
                if word not in ("lateral", "only"):
                    refs.append((_split(text)[1], ""))
                    stack[-1] = "named"
            elif state in ("named", "as", "derived", "done"):
                if word == "as":
                    stack[-1] = "as" if state == "named" else state
                elif word in _JOIN_KINDS or word in _HINTS:
                    hint = word in ("index", "key") and before in ("use", "force", "ignore") or word == "partition"
                    stack[-1] = "done"
                else:
                    if state in ("named", "as"):
                        refs[-1] = (refs[-1][0], _split(text)[1])
                    stack[-1] = "done"
        before, earlier = word, before
    return list(dict.fromkeys(r for r in refs if r[0].lower() not in ctes))


def _column(found: list[tuple[int, str]], at: int) -> tuple[str, str] | None:
    if 0 <= at < len(found) and found[at][0] == NAME and found[at][1].lower() not in _NO_COLUMN:
        return _split(found[at][1])
    return None


def used_columns(found: list[tuple[int, str]]) -> list[tuple[str, str]]:
    """(qualifier, column) that are compared or sorted by; the qualifier may be empty."""
    used = []
    for i, (kind, text) in enumerate(found):
        if kind == COMPARISON:
            used.append(_column(found, i - 1))
            if i + 2 >= len(found) or found[i + 2][1] != "(":
                used.append(_column(found, i + 1))
        elif kind == NAME:
            word = text.lower()
            if word in ("in", "like", "between", "is"):
                used.append(_column(found, i - 2 if i and found[i - 1][1].lower() == "not" else i - 1))
            elif word == "by" and i and found[i - 1][1].lower() == "order":
                used += _sorted_by(found, i + 1)
    return list(dict.fromkeys(u for u in used if u))


def _sorted_by(found: list[tuple[int, str]], at: int) -> list[tuple[str, str]]:
    """Plain columns of a sort list that starts at a token."""
    out, depth, start = [], 0, at
    while True:
        kind, text = found[at] if at < len(found) else (OTHER, ";")
        word = text.lower()
        depth += (text == "(") - (text == ")")
        over = depth < 0 or text == ";" or (kind == NAME and depth == 0 and word in _SORT_ENDS)
        if over or (text == "," and depth == 0):
            item = [t for t in found[start:at] if t[1].lower() not in ("asc", "desc")]
            if len(item) == 1 and (column := _column(item, 0)):
                out.append(column)
            start = at + 1
        if over:
            return out
        at += 1


def literal_tests(found: list[tuple[int, str]]) -> list[tuple[str, str, str]]:
    """(qualifier, column, literal) of comparisons of a column with a constant."""
    out = []
    for i, (kind, text) in enumerate(found):
        if kind != COMPARISON or text == "<=>" or not (column := _column(found, i - 1)):
            continue
        sign = "-" if i + 1 < len(found) and found[i + 1][1] == "-" else ""
        value = found[i + 1 + len(sign)] if i + 1 + len(sign) < len(found) else (OTHER, "")
        if value[0] == NUMBER or (value[0] == STRING and not sign and value[1][0] == "'"):
            out.append((*column, sign + value[1]))
    return out


_DIGITS = re.compile(r"([0-9]+)")
_SHAPES, _SHAPE_CHARACTERS = 4096, 4096  # at most so many shapes of at most so many characters are kept
_shapes: dict[tuple, list] = {}


def _shape_parts(marked: str) -> list:
    """For each list of PARTS its length and columns; a column is all its strings, and (place, format, digit runs) of those with digits."""
    found = tokens(marked)
    out = []
    for rows, names in zip((table_refs(found), used_columns(found), literal_tests(found)), _FIELDS.values()):
        columns = []
        for i in range(len(names)):
            values, open_ = [r[i] for r in rows], []
            for place, value in enumerate(values):
                pieces = _DIGITS.split(value)
                if len(pieces) > 1:
                    form = "%s".join(p.replace("%", "%%") for p in pieces[::2])
                    open_.append((place, form, [int(p) for p in pieces[1::2]]))
            columns.append((values, open_))
        out.append((len(rows), columns))
    return out


def _parts_of(sql: str) -> tuple[list, list[str]]:
    """The shape of a text and its distinct runs of digits.

    Tokens end where kinds of characters change and hold runs of digits whole, no keyword has a digit, and tokens are equal if their letters and
    runs are. So the walk takes the same way over two texts that differ in digits only, as long as the same runs of each are equal. It
    goes over the text with every run replaced by its number among the distinct ones.
    """
    pieces = _DIGITS.split(sql)
    runs: dict[str, int] = {}
    order = tuple([runs.setdefault(run, len(runs)) for run in pieces[1::2]])
    key = ("0".join(pieces[::2]), order)
    shape = _shapes.get(key)
    if shape is None:
        pieces[1::2] = map(str, order)
        shape = _shape_parts("".join(pieces))
        if len(sql) <= _SHAPE_CHARACTERS:
            if len(_shapes) >= _SHAPES:
                _shapes.clear()
            _shapes[key] = shape
    return shape, list(runs)


def parts_array(texts: list[str | None]) -> pa.StructArray:
    """PARTS of each text; None has empty ones."""
    sizes = [[0] for _ in _FIELDS]
    flat = [[[] for _ in names] for names in _FIELDS.values()]
    for text in texts:
        shape, runs = _parts_of(text or "")
        for (size, columns), ends, lists in zip(shape, sizes, flat):
            ends.append(size)
            for (values, open_), into in zip(columns, lists):
                base = len(into)
                into += values
                for place, form, at in open_:
                    into[base + place] = form % (runs[at[0]] if len(at) == 1 else tuple([runs[i] for i in at]))
    arrays = []
    for names, ends, lists in zip(_FIELDS.values(), sizes, flat):
        rows = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in lists], names)
        arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), rows))
    return pa.StructArray.from_arrays(arrays, list(_FIELDS))


@F.arrow_udf(PARTS)
def statement_parts(texts: pa.Array) -> pa.Array:
    """Column of PARTS; NULL texts have empty ones."""
    return parts_array(texts.to_pylist())
