"""Typed literals such as ``digit(10)`` or ``ip(10.0.0.1)``."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import functions as F

from siltwork.functions.types import SPARK, Field
from siltwork.plans.text import Scanner, SyntaxProblem

TYPES = "|".join(sorted((*SPARK, "auto", "obj", "array"), key=len, reverse=True))


@dataclass(frozen=True)
class Literal:
    kind: str
    value: object

    def field(self) -> Field:
        if self.kind == "time":
            return Field(F.lit(str(self.value)).cast("timestamp_ntz"), "time")
        return Field(F.lit(self.value).cast(SPARK[self.kind]), self.kind)

    def __str__(self) -> str:
        if self.kind in ("digit", "float", "bool", "time", "ip"):
            return f"{self.kind}({str(self.value).lower() if self.kind == 'bool' else self.value})"
        return f"{self.kind}({quote(str(self.value))})"


def quote(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'


def make(kind: str, raw: str) -> Literal:
    try:
        value = {"digit": int, "float": float, "bool": lambda x: {"true": True, "false": False}[x.lower()], "time": lambda x: datetime.datetime.fromisoformat(x)}.get(kind, str)(raw.strip() if kind in ("digit", "float", "bool", "time", "ip") else raw)
    except (KeyError, ValueError) as problem:
        raise SyntaxProblem(f"{raw!r} is no {kind}") from problem
    return Literal(kind, value)


def typed_literal(s: Scanner) -> Literal | None:
    found = s.take(rf"({TYPES})\s*\(")
    if not found:
        return None
    raw = s.quoted()
    if raw is None:
        raw = s.need(r"([^()]*)", "a value")[1].strip()
    s.need(r"\)", ")")
    return make(found[1], raw)
