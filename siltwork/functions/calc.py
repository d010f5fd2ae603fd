"""Checked arithmetic: what overflows, divides by zero or is not a number becomes absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork.functions.types import NUMERIC, Field, widen


def _finite(column: Column) -> Column:
    return F.when(~F.isnan(column) & (F.abs(column) < float("inf")), column)


def _absent(kind: str = "float") -> Field:
    return Field(F.lit(None).cast("double" if kind == "float" else "bigint"), kind)


def binary(op: str, a: Field, b: Field) -> Field:
    if a.kind not in NUMERIC or b.kind not in NUMERIC:
        return _absent()
    x, y = widen(a.column, a.kind), widen(b.column, b.kind)
    if op == "/":
        return Field(_finite(F.try_divide(x.cast("double"), y.cast("double"))), "float")
    if op == "%":
        return Field(F.try_mod(x, y), "digit") if a.kind == b.kind == "digit" else _absent("digit")
    if a.kind == b.kind == "digit":
        return Field({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y), "digit")
    x, y = x.cast("double"), y.cast("double")
    return Field(_finite({"+": x + y, "-": x - y, "*": x * y}[op]), "float")


def negate(a: Field) -> Field:
    return binary("-", Field(F.lit(0).cast("bigint"), "digit"), a)


def unary(name: str, a: Field) -> Field:
    """abs keeps the type; round (half away from zero), floor and ceil give integers."""
    if a.kind not in NUMERIC:
        return _absent()
    x = widen(a.column, a.kind)
    if name == "abs":
        if a.kind == "float":
            return Field(F.abs(x), "float")
        return Field(F.when(x != -(2**63), F.abs(F.when(x != -(2**63), x))), "digit")
    if a.kind == "digit":
        return a.with_column(x)
    whole = {"round": F.when(x < 0, -F.floor(-x + 0.5).cast("double")).otherwise(F.floor(x + 0.5).cast("double")), "floor": F.floor(x).cast("double"), "ceil": F.ceil(x).cast("double")}[name]
    inside = (x > -9.2233720368547e18) & (x < 9.2233720368547e18)
    return Field(F.when(inside, whole).try_cast("bigint"), "digit")
