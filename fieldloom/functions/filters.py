"""Filter trees of map styles, and table expressions, as columns.

Trees are {"all": [...]}, {"any": [...]}, {"not": tree} or {"field", "op", "value"}. Missing values compare as in web
maps: never equal to anything, so that != and notIn hold for null, and every other comparison with null is false.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import ContractError, require

_COMPARE = {"==": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}


def compile_filter(tree: dict[str, Any], columns: list[str] | None = None) -> Column:
    """A two-valued boolean column. With columns, unknown fields are refused."""
    for joiner, fold, start in (("all", lambda a, b: a & b, True), ("any", lambda a, b: a | b, False)):
        if joiner in tree:
            require(set(tree) == {joiner} and isinstance(tree[joiner], list), f"'{joiner}' takes a list alone")
            return reduce(fold, (compile_filter(t, columns) for t in tree[joiner]), F.lit(start))
    if "not" in tree:
        return ~compile_filter(tree["not"], columns)
    require({"field", "op"} <= set(tree), "a condition needs field and op")
    name, op, value = tree["field"], tree["op"], tree.get("value")
    require(columns is None or name in columns, f"unknown field {name}")
    c = F.col(f"`{name}`")
    if op == "isNull":
        return c.isNull()
    if op == "notNull":
        return c.isNotNull()
    if op in ("in", "notIn"):
        require(isinstance(value, list), f"{op} takes a list")
        inside = F.coalesce(c.isin(*value), F.lit(False)) if value else F.lit(False)
        return inside if op == "in" else ~inside
    if op == "!=":
        return ~F.coalesce(c == F.lit(value), F.lit(False))
    if op in _COMPARE:
        compared = {"==": c == value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]
        return F.coalesce(compared, F.lit(False))
    raise ContractError(f"unknown operator {op}")


def first_match(rules: list[dict[str, Any]], default: Any = None) -> Column:
    """The label of the first rule whose filter holds."""
    out = None
    for rule in rules:
        hit = compile_filter(rule["filter"]) if rule.get("filter") else F.lit(True)
        out = F.when(hit, F.lit(rule["label"])) if out is None else out.when(hit, F.lit(rule["label"]))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def class_rules(field: str, ranges: list[tuple[float, float, str]]) -> list[dict[str, Any]]:
    """Rules of a graduated style: lower bound inside, upper outside, but for the last class, which is closed."""
    last = len(ranges) - 1
    return [
        {"label": label, "filter": {"all": [{"field": field, "op": ">=", "value": lo}, {"field": field, "op": "<=" if k == last else "<", "value": hi}]}}
        for k, (lo, hi, label) in enumerate(ranges)
    ]


_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>`[^`]+`|[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|\*\*|[<>&|~()+\-*/%,\[\]])|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?))")
_WORDS = {"and": "AND", "or": "OR", "not": "NOT", "in": "IN", "True": "TRUE", "False": "FALSE", "None": "NULL"}
_SIGNS = {"==": "=", "&": "AND", "|": "OR", "~": "NOT", "[": "(", "]": ")", "//": "DIV"}


def where(expression: str) -> Column:
    """A row expression in Python's notation (and, or, not, in, ==) as a column; unknown counts as false."""
    out, at = [], 0
    text = expression.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        require(m is not None and m.end() > at, f"can't read the expression at {text[at:at + 12]!r}")
        at = m.end()
        if m["text"]:
            body = re.sub(r"\\(.)", r"\1", m["text"][1:-1])
            out.append("'" + body.replace("\\", "\\\\").replace("'", "\\'") + "'")
        elif m["name"]:
            name = m["name"].strip("`")
            out.append(_WORDS.get(name) or f"`{name}`")
        elif m["op"]:
            require(m["op"] != "**", "powers aren't supported in expressions")
            out.append(_SIGNS.get(m["op"], m["op"]))
        else:
            out.append(m["number"])
    return F.coalesce(F.expr(" ".join(out)), F.lit(False))
