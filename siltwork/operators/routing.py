"""Rule to group routing, sink filters with fan-out, tags, and error records.

Routing is decided when the plan is made; a group's sinks are filters over one DataFrame.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.functions.types import Field, kind_of
from siltwork.plans.conditions import compile_condition, parse
from siltwork.plans.text import glob_pattern


@dataclass
class Sink:
    name: str
    condition: str | None = None
    expect: bool = True
    tags: dict[str, str] = field(default_factory=dict)
    fmt: str = "json"
    params: dict = field(default_factory=dict)


@dataclass
class Group:
    name: str
    rules: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    sinks: list[Sink] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)


def parse_tags(items: list[str]) -> dict[str, str]:
    """``k:v``, ``k=v`` or a flag; at most four, with checked keys and values."""
    out = {}
    for item in items:
        key, _, value = re.sub("=", ":", item, count=1).partition(":") if ":" not in item.split("=")[0] else item.partition(":")
        out[key.strip()] = value.strip() or "true"
    if len(out) > 4:
        raise ValueError("at most four tags")
    for key, value in out.items():
        if not re.fullmatch(r"[A-Za-z0-9_.-]{1,32}", key) or len(value) > 64:
            raise ValueError(f"bad tag {key}:{value}")
    return out


def merged_tags(*levels: dict[str, str]) -> dict[str, str]:
    """Defaults, group, sink: later levels win; sorted by key."""
    out: dict[str, str] = {}
    for level in levels:
        out |= level
    return dict(sorted(out.items()))


def merge_params(defaults: dict, overrides: dict, allowed: set[str]) -> dict:
    for key, value in overrides.items():
        if key not in allowed:
            raise ValueError(f"parameter {key} may not be overridden")
        if isinstance(value, dict):
            raise ValueError(f"parameter {key} may not be a table")
    return defaults | overrides


def route(rule_key: str, groups: list[Group], models: dict[str, tuple[str, ...]] | None = None) -> str:
    """The one group of a rule: the longest matcher wins, the earlier of equals; none is ``default``."""
    best: tuple[int, str] | None = None
    for g in groups:
        for m in g.rules:
            if re.match(glob_pattern(m), rule_key) and (best is None or len(m) > best[0]):
                best = (len(m), g.name)
    if best is None:
        for g in groups:
            for m in g.models:
                for name, rules in (models or {}).items():
                    if re.match(glob_pattern(m), name) and any(re.match(glob_pattern(r), rule_key) for r in rules) and (best is None or len(m) > best[0]):
                        best = (len(m), g.name)
    return best[1] if best else "default"


def choose_model(rule_key: str, models: dict[str, tuple[str, ...]]) -> str | None:
    """The first model whose rule list matches; None passes records through."""
    return next((name for name, rules in models.items() if any(re.match(glob_pattern(r), rule_key) for r in rules)), None)


def fields_of(df: DataFrame, kinds: dict[str, str] | None = None):
    kinds = kinds or {}
    known = {f.name: Field(F.col(f"`{f.name}`"), kinds.get(f.name) or kind_of(f.dataType)) for f in df.schema.fields}
    return known.get


def fan_out(df: DataFrame, group: Group, defaults: dict[str, str] | None = None, kinds: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Per sink the records whose filter gives what it expects, with its tags as columns after the others."""
    lookup, out = fields_of(df, kinds), {}
    for sink in group.sinks:
        rows = df
        if sink.condition is not None:
            rows = rows.where(compile_condition(parse(sink.condition), lookup) == F.lit(sink.expect))
        tags = merged_tags(defaults or {}, group.tags, sink.tags)
        out[sink.name] = rows.select("*", *[F.lit(v).alias(k) for k, v in tags.items()])
    return out


def deliveries(df: DataFrame, group: Group, kinds: dict[str, str] | None = None) -> DataFrame:
    """Every record once per sink that gets it, in one pass: columns of ``df`` and ``sink``."""
    lookup = fields_of(df, kinds)
    hits = [F.when(F.lit(True) if s.condition is None else compile_condition(parse(s.condition), lookup) == F.lit(s.expect), F.lit(s.name)) for s in group.sinks]
    return df.select("*", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("sink"))


def error_records(transformed: DataFrame, *, rule: str, group: str, model: str, source_fields: int, kind: str = "oml_transform_empty") -> DataFrame:
    """Rows whose transform left nothing, as records of the error sink."""
    columns = transformed.columns
    empty = F.lit(True)
    for c in columns:
        empty = empty & F.col(f"`{c}`").isNull()
    return transformed.where(empty).select(
        F.lit(kind).alias("__err_kind"), F.lit(rule).alias("__wpl_rule"), F.lit(group).alias("__sink_group"), F.lit(model).alias("__oml_model"),
        F.lit(source_fields).alias("__src_field_count"), F.lit(0).alias("__out_field_count"), F.lit("no output field").alias("__diag"), F.lit("check the model against the rule's fields").alias("__hint"),
    )


def non_empty(transformed: DataFrame) -> DataFrame:
    return transformed.dropna("all")
