"""The sink filter language: ``$var <op> type(value)``, ``isset($var)``, ``&& || !`` and parentheses.

A comparison with a missing variable or another type is false before any negation applies, so the
compiled column never is NULL.  Precedence is the usual one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork.functions.scalar import ip_order
from siltwork.functions.types import NUMERIC, TEXTUAL, Field
from siltwork.plans.text import Scanner, SyntaxProblem, glob_pattern
from siltwork.plans.values import Literal, typed_literal

Lookup = Callable[[str], Field | None]


@dataclass(frozen=True)
class Compare:
    name: str
    op: str
    value: Literal

    def __str__(self):
        return f"${self.name} {self.op} {self.value}"


@dataclass(frozen=True)
class IsSet:
    name: str

    def __str__(self):
        return f"isset(${self.name})"


@dataclass(frozen=True)
class Not:
    inner: object

    def __str__(self):
        return f"!({self.inner})"


@dataclass(frozen=True)
class Both:
    op: str
    left: object
    right: object

    def __str__(self):
        return f"({self.left} {self.op} {self.right})"


_NAME = r"[A-Za-z_][\w./\[\]-]*"


def parse(text: str):
    s = Scanner(text, comments=None)
    out = _either(s)
    if not s.done():
        raise SyntaxProblem(f"unexpected text in the condition: {text[s.at :]!r}")
    return out


def _either(s: Scanner):
    left = _all(s)
    while s.take(r"\|\|"):
        left = Both("||", left, _all(s))
    return left


def _all(s: Scanner):
    left = _one(s)
    while s.take("&&"):
        left = Both("&&", left, _one(s))
    return left


def _one(s: Scanner):
    if s.take(r"!(?!=)"):
        return Not(_one(s))
    if s.take(r"\("):
        inner = _either(s)
        s.need(r"\)", ")")
        return inner
    if s.take(r"isset\s*\("):
        name = s.need(rf"\$({_NAME})", "a variable")[1]
        s.need(r"\)", ")")
        return IsSet(name)
    name = s.need(rf"\$({_NAME})", "a variable")[1]
    op = s.need(r"==|!=|>=|<=|=\*|>|<", "a comparison")[0]
    value = typed_literal(s)
    if value is None:
        raise SyntaxProblem(f"expected a typed value at: {s.text[s.at : s.at + 40]!r}")
    return Compare(name, op, value)


def _compare(field: Field, op: str, value: Literal) -> Column:
    kind, x = value.kind, field.column
    same = kind == field.kind or kind in NUMERIC and field.kind in NUMERIC and kind == field.kind or kind in TEXTUAL and field.kind in TEXTUAL
    if not same:
        return F.lit(False)
    y = value.field().column
    if op == "=*":
        if kind in TEXTUAL or kind == "ip":
            return x.rlike(glob_pattern(str(value.value)))
        return F.abs(x - y) < 1e-4 if kind == "float" else x == y
    if kind in ("ipnet", "bool") and op not in ("==", "!="):
        return F.lit(False)
    if kind == "ip" and op not in ("==", "!="):
        x, y = ip_order(x), ip_order(y)
    return {"==": x == y, "!=": x != y, ">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[op]


def compile_condition(node, lookup: Lookup) -> Column:
    if isinstance(node, str):
        node = parse(node)
    if isinstance(node, Both):
        left, right = compile_condition(node.left, lookup), compile_condition(node.right, lookup)
        return left & right if node.op == "&&" else left | right
    if isinstance(node, Not):
        return ~compile_condition(node.inner, lookup)
    field = lookup(node.name)
    if field is None:
        return F.lit(False)
    if isinstance(node, IsSet):
        return field.column.isNotNull()
    return F.coalesce(_compare(field, node.op, node.value), F.lit(False))
