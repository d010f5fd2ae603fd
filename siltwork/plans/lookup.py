"""Lookups into reference tables: ``select cols from table where cond ;`` as joins.

Where every parameter is compared by ``=`` with a column of its own type, the table is made unique by
these columns and joined to the records once, left outer.  Otherwise only the distinct parameter
tuples are looked up, and the answers, one row per tuple, are joined back.  Spark picks broadcast or
shuffle by the tables' sizes.  Equalities are the join keys; ``or`` is a union of disjoint lookups.
A condition with neither equality, list nor range compares every tuple with every row: it is refused
for tables of more than ``MOST_COMPARED`` rows.
A range ``low <= x and high >= x`` becomes an equality too: each range is filed under the one or two
aligned blocks of its own power-of-two size, and a value probes the block of every size in use.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions import scalar
from siltwork.functions.types import Field, kind_of
from siltwork.plans.text import Scanner, SyntaxProblem
from siltwork.plans.values import Literal, quote

MOST_PARAMETERS = 5
MOST_COMPARED = 100_000
_WORD = r"[A-Za-z_]\w*"
_AGGREGATES = frozenset("count sum avg min max group_concat string_agg".split())


@dataclass(frozen=True)
class Item:
    column: str
    function: str | None = None
    distinct: bool = False
    separator: str = ","

    def __str__(self):
        if not self.function:
            return self.column
        extra = f", {quote(self.separator)}" if self.function == "string_agg" else ""
        return f"{self.function}({'distinct ' if self.distinct else ''}{self.column}{extra})"

    @property
    def name(self) -> str:
        return self.column if not self.function else f"{self.function}({'distinct ' if self.distinct else ''}{self.column})"


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str
    where: tuple

    def __str__(self):
        return f"select {', '.join(map(str, self.items))} from {self.table} where {_text(self.where)}"


def _text(c) -> str:
    if c[0] in ("and", "or"):
        return f"({_text(c[1])} {c[0]} {_text(c[2])})"
    if c[0] == "not":
        return f"not ({_text(c[1])})"
    if c[0] == "in":
        return f"{c[1]} in ({', '.join(map(_operand, c[2]))})"
    if c[0] == "between":
        return f"ip4_between({_operand(c[1])}, {c[2]}, {c[3]}) = 1"
    return f"{c[1]} {c[0]} {_operand(c[2])}"


def _operand(x) -> str:
    return quote(x.value) if isinstance(x, Literal) and x.kind == "chars" else str(x.value) if isinstance(x, Literal) else str(x)


def parse_select(s: Scanner, value) -> Select:
    s.need("select")
    items = [_item(s)]
    while s.take(","):
        items.append(_item(s))
    s.need("from")
    table = s.need(_WORD, "a table")[0]
    s.need("where")
    where = _or(s, value)
    node = Select(tuple(items), table, where)
    n = len(_parameters(where))
    if n > MOST_PARAMETERS:
        raise SyntaxProblem(f"a lookup takes at most {MOST_PARAMETERS} parameters, not {n}")
    return node


def _item(s: Scanner) -> Item:
    name = s.need(rf"\*|{_WORD}", "a column")[0]
    if name == "*" or not s.take(r"\("):
        return Item(name)
    if name not in _AGGREGATES:
        raise SyntaxProblem(f"{name} is not allowed in a lookup")
    distinct = bool(s.take(r"distinct\b"))
    column = s.need(rf"\*|{_WORD}")[0]
    separator = s.quoted() if s.take(",") else ","
    s.need(r"\)")
    return Item(column, name, distinct, separator)


def _or(s, value):
    left = _and(s, value)
    while s.take(r"or\b"):
        left = ("or", left, _and(s, value))
    return left


def _and(s, value):
    left = _not(s, value)
    while s.take(r"and\b"):
        left = ("and", left, _not(s, value))
    return left


def _not(s, value):
    if s.take(r"not\b"):
        return ("not", _not(s, value))
    if s.take(r"\("):
        inner = _or(s, value)
        s.need(r"\)")
        return inner
    if s.take(r"ip4_between\s*\("):
        x = _bound(s, value)
        s.need(",")
        low = s.need(_WORD)[0]
        s.need(",")
        high = s.need(_WORD)[0]
        s.need(r"\)\s*=\s*1", ") = 1")
        return ("between", x, low, high)
    column = s.peek(rf"({_WORD})\s*(=|!=|<>|>=|<=|>|<|in\b)")
    if column and column[1] not in ("read", "take"):
        s.take(_WORD)
        if s.take(r"in\s*\("):
            bound = [_bound(s, value)]
            while s.take(","):
                bound.append(_bound(s, value))
            s.need(r"\)")
            return ("in", column[1], tuple(bound))
        op = s.need(r"!=|<>|>=|<=|=|>|<")[0]
        return ("!=" if op == "<>" else op, column[1], _bound(s, value))
    x = _bound(s, value)
    op = s.need(r"!=|>=|<=|=|>|<", "a comparison")[0]
    return ({">": "<", "<": ">", ">=": "<=", "<=": ">="}.get(op, op), s.need(_WORD, "a column")[0], x)


def _bound(s, value):
    text = s.quoted()
    if text is not None:
        return Literal("chars", text)
    number = s.take(r"-?\d+(\.\d+)?\b")
    if number:
        return Literal("float" if "." in number[0] else "digit", float(number[0]) if "." in number[0] else int(number[0]))
    return value(s)


def _parameters(c) -> list:
    if c[0] in ("and", "or"):
        return _parameters(c[1]) + _parameters(c[2])
    if c[0] == "not":
        return _parameters(c[1])
    found = c[2] if c[0] == "in" else (c[1],) if c[0] == "between" else (c[2],)
    return [x for x in found if not isinstance(x, Literal)]


def _conjuncts(c) -> list:
    return _conjuncts(c[1]) + _conjuncts(c[2]) if c[0] == "and" else [c]


def join(df: DataFrame, scope, node: Select, table: DataFrame, targets, evaluate):
    """(df with the answers, [(target, field)])."""
    wanted = [Item(c) for c in table.columns] if node.items[0].column == "*" and not node.items[0].function else list(node.items)
    tag = f"__q{sum(c.startswith('__q') for c in df.columns)}"
    dim = table.select(*[F.col(f"`{c}`").alias(f"{tag}_t_{c}") for c in table.columns])
    column = lambda c: F.col(f"`{tag}_t_{c}`")
    bound: dict[int, tuple[str, Field]] = {}
    for k, p in enumerate(_parameters(node.where)):
        f = evaluate(p)
        if f is None:
            f = Field(F.lit(None).cast("string"), "chars")
        if p is not None and id(p) not in bound:
            bound[id(p)] = (f"{tag}_p{k}", f)
    df = df.select("*", *[f.column.alias(n) for n, f in bound.values()])
    names = [n for n, _ in bound.values()]

    def operand(x) -> Column:
        return F.lit(x.value) if isinstance(x, Literal) else F.col(bound[id(x)][0])

    def compiled(c) -> Column:
        if c[0] == "and":
            return compiled(c[1]) & compiled(c[2])
        if c[0] == "or":
            return compiled(c[1]) | compiled(c[2])
        if c[0] == "not":
            return ~compiled(c[1])
        if c[0] == "in":
            return reduce(lambda a, b: a | b, [F.coalesce(column(c[1]) == operand(x), F.lit(False)) for x in c[2]])
        if c[0] == "between":
            x = scalar.ip4_int(operand(c[1]))
            return (column(c[2]) <= x) & (column(c[3]) >= x)
        left, right = column(c[1]), operand(c[2])
        return {"=": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[c[0]]

    plain = [c for c in _conjuncts(node.where) if not _parameters(c)]
    equal = [c for c in _conjuncts(node.where) if _parameters(c)]
    if equal and all(c[0] == "=" and _same_kind(dim.schema[f"{tag}_t_{c[1]}"].dataType, df.schema[bound[id(c[2])][0]].dataType) for c in equal) and len({c[1] for c in equal}) == len(equal):
        rows = dim.where(reduce(lambda x, y: x & y, map(compiled, plain))) if plain else dim
        unique = rows.groupBy(*[column(c[1]).alias(f"{tag}_k{k}") for k, c in enumerate(equal)]).agg(*_answers(wanted, column, tag))
        on = reduce(lambda x, y: x & y, [operand(c[2]) == F.col(f"{tag}_k{k}") for k, c in enumerate(equal)])
        return _targets(df.join(_unpacked(unique, [f"{tag}_k{k}" for k in range(len(equal))], wanted, tag), on, "left").drop(*[f"{tag}_k{k}" for k in range(len(equal))]), wanted, targets, tag)

    asked = df.select(*names).distinct() if names else df.sparkSession.range(1).select(F.lit(True).alias(f"{tag}_one"))
    keys = names or [f"{tag}_one"]

    def hits_of(where, without) -> DataFrame:
        """Pairs of tuples and rows that meet the condition, and none of those before it."""
        parts = _conjuncts(where)
        test = reduce(lambda x, y: x & ~F.coalesce(compiled(y), F.lit(False)), without, compiled(where))
        ranged = next((c for c in parts if c[0] == "between"), None) or _plain_range(parts)
        lists = [c for c in parts if c[0] == "in"]
        if any(c[0] == "=" for c in parts):
            return asked.join(dim, test)
        if ranged is not None:
            probe, filed = _blocks(asked, dim, ranged, operand, column, tag)
            return probe.join(filed, [f"{tag}_size", f"{tag}_block"]).where(test)
        if lists:
            probe = asked.withColumn(f"{tag}_k", F.explode(F.array_distinct(F.filter(F.array(*[operand(x).cast("string") for x in lists[0][2]]), lambda x: x.isNotNull()))))
            return probe.join(dim, F.col(f"{tag}_k") == column(lists[0][1]).cast("string")).where(test)
        either = next((c for c in parts if c[0] == "or"), None)
        if either is not None:
            rest = [c for c in parts if c is not either]
            first, second = (reduce(lambda x, y: ("and", x, y), [c, *rest]) for c in either[1:])
            columns = [*keys, *dim.columns]
            return hits_of(first, without).select(*columns).unionByName(hits_of(second, [*without, first]).select(*columns))
        if dim.limit(MOST_COMPARED + 1).count() > MOST_COMPARED:
            raise SyntaxProblem(f"a lookup by lone comparisons takes tables of at most {MOST_COMPARED} rows: {node}")
        return asked.join(F.broadcast(dim), test)

    hits = hits_of(node.where, [])
    answers = _unpacked(hits.groupBy(*keys).agg(*_answers(wanted, column, tag)), keys, wanted, tag)
    if names:
        other = answers.select(*[F.col(n).alias(f"{n}_") for n in names], *[f"{tag}_a{k}" for k in range(len(wanted))])
        on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names])
        df = df.join(other, on, "left").drop(*[f"{n}_" for n in names])
    else:
        df = df.withColumn(keys[0], F.lit(True)).join(answers, keys, "left").drop(*keys)
    return _targets(df, wanted, targets, tag)


def _same_kind(a, b) -> bool:
    whole = ("tinyint", "smallint", "int", "bigint")
    return a == b or a.simpleString() in whole and b.simpleString() in whole


def _answers(wanted: list[Item], column, tag: str) -> list[Column]:
    """Aggregates, or the smallest row."""
    if any(i.function for i in wanted):
        return [_aggregate(i, column).alias(f"{tag}_a{k}") for k, i in enumerate(wanted)]
    return [F.min(F.struct(*[column(i.column).alias(f"a{k}") for k, i in enumerate(wanted)])).alias(f"{tag}_r")]


def _unpacked(answers: DataFrame, keys: list[str], wanted: list[Item], tag: str) -> DataFrame:
    if any(i.function for i in wanted):
        return answers
    return answers.select(*keys, *[F.col(f"{tag}_r.a{k}").alias(f"{tag}_a{k}") for k in range(len(wanted))])


def _targets(df: DataFrame, wanted: list[Item], targets, tag: str):
    out = []
    for k, (item, target) in enumerate(zip(wanted, list(targets) + ["_"] * (len(wanted) - len(targets)))):
        c = F.col(f"{tag}_a{k}")
        kind = kind_of(df.schema[f"{tag}_a{k}"].dataType)
        if item.function == "count":
            c = F.coalesce(c, F.lit(0).cast("bigint"))
        out.append((item.name if target == "_" else target, Field(c, kind)))
    return df, out[: len(targets)]


def _aggregate(item: Item, column) -> Column:
    if item.column == "*":
        return F.count(F.lit(1))
    c = column(item.column)
    if item.function in ("group_concat", "string_agg"):
        text = c.cast("string")
        listed = F.array_sort(F.collect_set(text) if item.distinct else F.collect_list(text))
        return F.nullif(F.array_join(listed, item.separator), F.lit(""))
    if item.function == "count":
        return F.count_distinct(c) if item.distinct else F.count(c)
    if item.distinct and item.function in ("sum", "avg"):
        return F.sum_distinct(c) if item.function == "sum" else F.try_divide(F.sum_distinct(c), F.count_distinct(c))
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[item.function](c)


def _plain_range(parts):
    """low <= @x and high >= @x of the same integer parameter, as a between."""
    low = {str(c[2]): c for c in parts if c[0] == "<="}
    for c in parts:
        if c[0] == ">=" and str(c[2]) in low:
            return ("range", c[2], low[str(c[2])][1], c[1], low[str(c[2])][2])
    return None


def _blocks(asked: DataFrame, dim: DataFrame, ranged, operand, column, tag: str):
    low, high = column(ranged[2]).cast("bigint"), column(ranged[3]).cast("bigint")
    x = scalar.ip4_int(operand(ranged[1])) if ranged[0] == "between" else F.floor(operand(ranged[1])).cast("bigint")
    size = F.ceil(F.log2((high - low + 1).cast("double"))).cast("int")
    sized = dim.where((high >= low) & low.isNotNull()).withColumn(f"{tag}_size", F.greatest(F.lit(0), size))
    shift = lambda v: F.expr(f"shiftright({v}, {tag}_size)")
    filed = sized.withColumn(f"{tag}_low", low).withColumn(f"{tag}_high", high).withColumn(f"{tag}_block", F.explode(F.sequence(shift(f"{tag}_low"), shift(f"{tag}_high")))).drop(f"{tag}_low", f"{tag}_high")
    sizes = sorted(r[0] for r in sized.select(f"{tag}_size").distinct().collect())  # at most 64
    probe = asked.withColumn(f"{tag}_x", x).withColumn(f"{tag}_size", F.explode(F.array(*[F.lit(s) for s in sizes] or [F.lit(0)])))
    return probe.withColumn(f"{tag}_block", shift(f"{tag}_x")).drop(f"{tag}_x"), filed
