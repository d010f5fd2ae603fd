"""The object-model language: text to statements to one Spark projection.

A model is a list of assignments.  Compiling it walks the statements in order over a scope, the
destination's fields before the source's, and ends in a single select; lookups into reference
tables become joins in between.  A statement's printed form parses to the same statement.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.functions import calc, scalar, words
from siltwork.functions.types import NUMERIC, TEXTUAL, Field, as_text, convert, kind_of, widen
from siltwork.plans import lookup as lookups
from siltwork.plans.text import Scanner, SyntaxProblem
from siltwork.plans.values import TYPES, Literal, quote, typed_literal

_NAME = r"[A-Za-z_*][\w.*/\[\]-]*"
_PLAIN = r"[A-Za-z_][\w.]*"


# statements


@dataclass(frozen=True)
class Access:
    """read / take / @name, with alternatives, key patterns and a default."""

    verb: str
    name: str | None = None
    option: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    default: object = None

    def __str__(self):
        inner = self.name or ""
        if self.option:
            inner = ", ".join(filter(None, (inner, f"option : [{', '.join(self.option)}]")))
        if self.keys:
            inner = f"keys : [{', '.join(self.keys)}]"
        return f"{self.verb}({inner})" + (f" {{ _ : {self.default} }}" if self.default is not None else "")


@dataclass(frozen=True)
class Now:
    what: str

    def __str__(self):
        return f"Now::{self.what}()"


@dataclass(frozen=True)
class Static:
    name: str

    def __str__(self):
        return self.name


@dataclass(frozen=True)
class Make:
    """object { name : type = value ; }"""

    members: tuple

    def __str__(self):
        return "object { " + " ".join(f"{', '.join(n)} : {t} = {v} ;" for n, t, v in self.members) + " }"


@dataclass(frozen=True)
class Collect:
    source: Access

    def __str__(self):
        return f"collect {self.source}"


@dataclass(frozen=True)
class Format:
    template: str
    args: tuple

    def __str__(self):
        return f"fmt({quote(self.template)}{''.join(f', {a}' for a in self.args)})"


@dataclass(frozen=True)
class Pipe:
    source: object
    steps: tuple

    def __str__(self):
        return f"pipe {self.source}" + "".join(f" | {n}({', '.join(map(_arg, a))})" if a else f" | {n}" for n, a in self.steps)


def _arg(x) -> str:
    return quote(x) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


@dataclass(frozen=True)
class Calc:
    tree: tuple

    def __str__(self):
        return f"calc({_calc_text(self.tree)})"


def _calc_text(t) -> str:
    if t[0] == "num":
        return repr(t[1])
    if t[0] == "get":
        return str(t[1])
    if t[0] == "call":
        return f"{t[1]}({_calc_text(t[2])})"
    if t[0] == "neg":
        return f"-({_calc_text(t[1])})"
    return f"({_calc_text(t[1])} {t[0]} {_calc_text(t[2])})"


@dataclass(frozen=True)
class Match:
    sources: tuple
    arms: tuple  # (conditions per source or None for the default, result)
    tuple_form: bool = False

    def __str__(self):
        src = f"({', '.join(map(str, self.sources))})" if self.tuple_form else str(self.sources[0])
        arms = []
        for conds, result in self.arms:
            left = "_" if conds is None else f"({', '.join(map(_cond_text, conds))})" if self.tuple_form else _cond_text(conds[0])
            arms.append(f"{left} => {result} ;")
        return f"match {src} {{ {' '.join(arms)} }}"


def _cond_text(c) -> str:
    kind, *args = c
    if kind == "or":
        return " | ".join(map(_cond_text, args[0]))
    if kind == "not":
        return f"!{args[0]}"
    if kind == "in":
        return f"in ({args[0]}, {args[1]})"
    if kind == "eq":
        return str(args[0])
    if kind == "any":
        return "_"
    return f"{args[0]}({', '.join(map(_arg, args[1]))})"


@dataclass(frozen=True)
class Lookup:
    table: str
    key: object
    default: object

    def __str__(self):
        return f"lookup_nocase({self.table}, {self.key}, {self.default})"


@dataclass(frozen=True)
class Assign:
    targets: tuple[str, ...]
    kind: str
    value: object

    def __str__(self):
        return f"{', '.join(self.targets)}{'' if self.kind == 'auto' else ' : ' + self.kind} = {self.value} ;"


@dataclass
class Model:
    name: str
    rules: tuple[str, ...] = ()
    enabled: bool = True
    statics: dict = field(default_factory=dict)
    items: list[Assign] = field(default_factory=list)

    def __str__(self):
        head = [f"name : {self.name}"]
        if self.rules:
            head.append(f"rule : {' '.join(self.rules)}")
        if not self.enabled:
            head.append("enable : false")
        head.append("---")
        if self.statics:
            head.append("static { " + " ".join(f"{k} = {v} ;" for k, v in self.statics.items()) + " }")
        return "\n".join([*head, *map(str, self.items)]) + "\n"


# parser


def parse_model(text: str) -> Model:
    s = Scanner(text, comments=r"//[^\n]*")
    s.need(r"name\s*:", "name")
    model = Model(s.need(r"[\w./*-]+", "a name")[0])
    while not s.take("---"):
        if s.take(r"rule\s*:"):
            found = s.need(r"[^\n]*", "rules")[0]
            model.rules = tuple(re.split(r"[\s,]+", found.strip()))
        elif s.take(r"enable\s*:"):
            model.enabled = s.need("true|false")[0] == "true"
        else:
            s.need("---", "rule, enable or ---")
    while s.take(r"static\s*\{"):
        while not s.take(r"\}"):
            name = s.need(_PLAIN, "a static name")[0]
            if name in model.statics:
                raise SyntaxProblem(f"static {name} is defined twice")
            s.need("=")
            value = _value(s, {})
            if not isinstance(value, (Literal, Make, Calc)):
                raise SyntaxProblem(f"static {name} is no constant")
            s.need(";")
            model.statics[name] = value
    while not s.done() and not s.take("---"):
        model.items.append(_assign(s, model.statics))
    if not model.items:
        raise SyntaxProblem("a model needs a statement")
    return model


def _assign(s: Scanner, statics) -> Assign:
    targets = [s.need(_NAME, "a target")[0]]
    while s.take(","):
        targets.append(s.need(_NAME, "a target")[0])
    kind = s.need(rf"({TYPES})\b", "a type")[1] if s.take(":") else "auto"
    s.need("=")
    value = _value(s, statics)
    s.need(";", ";")
    return Assign(tuple(targets), kind, value)


def _access(s: Scanner, statics=None) -> Access | None:
    if s.take("@"):
        return Access("read", s.need(r"[\w.\[\]/*-]+", "a name")[0])
    found = s.take(r"(read|take)\s*\(")
    if not found:
        return None
    name, option, keys = None, (), ()
    while not s.take(r"\)"):
        kind = s.take(r"(option|keys|in|get)\s*:")
        if kind and kind[1] == "get":
            name = s.need(r"[\w./\[\]*-]+")[0]
        elif kind:
            s.need(r"\[")
            listed = tuple(x.strip() for x in s.need(r"((?:[^\[\]]|\[[^\[\]]*\])*)\]", "a list")[1].split(","))
            option, keys = (listed, keys) if kind[1] == "option" else (option, listed)
        else:
            name = s.quoted() or s.need(r"[\w./\[\]*-]+", "a name")[0]
        s.take(",")
    default = None
    if s.take(r"\{\s*_\s*:"):
        default = _value(s, statics or {})
        s.take(";")
        s.need(r"\}", "}")
    return Access(found[1], name, option, keys, default)


def _simple(s: Scanner, statics):
    found = _access(s, statics)
    if found is not None:
        return found
    if s.take(r"Now::"):
        what = s.need("time|date|hour")[0]
        s.need(r"\(\s*\)")
        return Now(what)
    literal = typed_literal(s)
    if literal is not None:
        return literal
    name = s.peek(_PLAIN)
    if name and name[0] in statics:
        s.take(_PLAIN)
        return Static(name[0])
    raise SyntaxProblem(f"expected a value at: {s.text[s.at : s.at + 40]!r}")


def _value(s: Scanner, statics):
    if s.take(r"object\s*\{"):
        members = []
        while not s.take(r"\}"):
            names = [s.need(_PLAIN, "a member")[0]]
            while s.take(","):
                names.append(s.need(_PLAIN)[0])
            kind = s.need(rf"({TYPES})\b")[1] if s.take(":") else "auto"
            s.need("=")
            members.append((tuple(names), kind, _simple(s, statics)))
            s.take(";")
        return Make(tuple(members))
    if s.take(r"collect\b"):
        return Collect(_access(s, statics))
    if s.take(r"fmt\s*\("):
        template, args = s.quoted(), []
        while s.take(","):
            args.append(_access(s, statics))
        s.need(r"\)")
        return Format(template, tuple(args))
    if s.take(r"calc\s*\("):
        tree = _calc_sum(s, statics)
        s.need(r"\)", ")")
        return Calc(tree)
    if s.take(r"match\b"):
        return _match(s, statics)
    if s.take(r"lookup_nocase\s*\("):
        table = s.need(_PLAIN)[0]
        s.need(",")
        key = _simple(s, statics)
        s.need(",")
        default = _simple(s, statics)
        s.need(r"\)")
        return Lookup(table, key, default)
    if s.peek(r"select\b"):
        return lookups.parse_select(s, lambda sc: _simple(sc, statics))
    piped = s.take(r"pipe\b")
    source = _simple(s, statics)
    steps = []
    while s.take(r"\|(?!\|)"):
        steps.append(_step(s))
    if piped and not steps:
        raise SyntaxProblem("a pipe needs a function")
    return Pipe(source, tuple(steps)) if steps else source


_STEPS = frozenset("base64_encode base64_decode html_escape html_unescape str_escape json_escape json_unescape to_json to_str Time::to_ts Time::to_ts_ms Time::to_ts_us Time::to_ts_zone nth get skip_empty starts_with map_to path url ip4_to_int extract_main_word extract_subject_object".split())


_ADDED: dict[str, Callable] = {}


def register_function(name: str, function: Callable[..., Field]) -> None:
    """Adds a pipe function: from a field and the arguments in the model to a field; built-in names stay as they are."""
    if name in _STEPS:
        raise ValueError(f"{name} is built in")
    _ADDED[name] = function


def _step(s: Scanner) -> tuple:
    name = s.need(r"[A-Za-z_][\w]*(?:::\w+)?", "a function")[0]
    if name not in _STEPS and name not in _ADDED:
        raise SyntaxProblem(f"no such function: {name}")
    args = []
    if s.take(r"\("):
        while not s.take(r"\)"):
            text = s.quoted()
            args.append(text if text is not None else _bare(s.need(r"[^,()]+", "an argument")[0].strip()))
            s.take(",")
    return name, tuple(args)


def _bare(raw: str):
    if raw in ("true", "false"):
        return raw == "true"
    if re.fullmatch(r"[+-]?\d+", raw):
        return int(raw)
    if re.fullmatch(r"[+-]?\d*\.\d+(?:[eE][+-]?\d+)?", raw):
        return float(raw)
    return raw


def _calc_sum(s: Scanner, statics):
    left = _calc_product(s, statics)
    while found := s.take(r"[+-]"):
        left = (found[0], left, _calc_product(s, statics))
    return left


def _calc_product(s: Scanner, statics):
    left = _calc_atom(s, statics)
    while found := s.take(r"[*/%]"):
        left = (found[0], left, _calc_atom(s, statics))
    return left


def _calc_atom(s: Scanner, statics):
    if s.take("-"):
        return ("neg", _calc_atom(s, statics))
    if s.take(r"\("):
        inner = _calc_sum(s, statics)
        s.need(r"\)")
        return inner
    if found := s.take(r"(abs|round|floor|ceil)\s*\("):
        inner = _calc_sum(s, statics)
        s.need(r"\)")
        return ("call", found[1], inner)
    if found := s.take(r"\d+\.\d+(?:[eE][+-]?\d+)?|\d+"):
        return ("num", float(found[0]) if "." in found[0] else int(found[0]))
    return ("get", _simple(s, statics))


_FUNCTIONS = "starts_with|ends_with|contains|regex_match|is_empty|iequals_any|iequals|gt|lt|eq|in_range"


def _match(s: Scanner, statics) -> Match:
    many = s.take(r"\(")
    sources = [_access(s, statics)]
    while many and s.take(","):
        sources.append(_access(s, statics))
    if many:
        s.need(r"\)")
    s.need(r"\{")
    arms = []
    while not s.take(r"\}"):
        if arms and arms[-1][0] is None:
            raise SyntaxProblem("the default case must be the last")
        if s.take(r"_\s*=>"):
            conditions = None
        elif many:
            s.need(r"\(")
            conditions = [_conditions(s, statics)]
            while s.take(","):
                conditions.append(_conditions(s, statics))
            s.need(r"\)")
            if len(conditions) != len(sources):
                raise SyntaxProblem("a case has another number of conditions than sources")
            s.need("=>")
        else:
            conditions = [_conditions(s, statics)]
            s.need("=>")
        result = Collect(_access(s, statics)) if s.take(r"collect\b") else _simple(s, statics)
        s.take("[,;]")
        arms.append((None if conditions is None else tuple(conditions), result))
    return Match(tuple(sources), tuple(arms), bool(many))


def _conditions(s: Scanner, statics):
    found = [_condition(s, statics)]
    while s.take(r"\|"):
        found.append(_condition(s, statics))
    return found[0] if len(found) == 1 else ("or", tuple(found))


def _condition(s: Scanner, statics):
    if s.take(r"_(?!\w)"):
        return ("any",)
    if s.take(r"in\s*\("):
        low = _constant(s, statics)
        s.need(",")
        high = _constant(s, statics)
        s.need(r"\)")
        return ("in", low, high)
    if s.take("!"):
        return ("not", _constant(s, statics))
    if found := s.take(rf"({_FUNCTIONS})\s*\("):
        args = []
        while not s.take(r"\)"):
            text = s.quoted()
            args.append(text if text is not None else _bare(s.need(r"[^,()]+")[0].strip()))
            s.take(",")
        return ("fn", found[1], tuple(args))
    return ("eq", _constant(s, statics))


def _constant(s: Scanner, statics) -> Literal:
    value = _simple(s, statics)
    if isinstance(value, Static):
        value = statics[value.name]
    if not isinstance(value, Literal):
        raise SyntaxProblem("a condition needs a constant")
    return value


# compiler


class Scope:
    """Fields by name: what the model has made, then what is left of the source."""

    def __init__(self, source: dict[str, Field]):
        self.source = dict(source)
        self.made: dict[str, Field] = {}

    def find(self, name: str, take: bool = False) -> Field | None:
        found = self.made.get(name) or self.source.get(name)
        if take:
            self.made.pop(name, None)
            self.source.pop(name, None)
        return found

    def put(self, name: str, value: Field) -> None:
        self.made.setdefault(name, value)  # readers see the first of a repeated name


class Compiler:
    """``diagnostics`` adds ``__diag``: what went wrong in a record, as ``missing_field: name`` and the like."""

    def __init__(self, model: Model, tables: dict[str, DataFrame] | None = None, dictionary: words.Dictionary | None = None, diagnostics: bool = False):
        self.model, self.tables, self.dictionary = model, tables or {}, dictionary
        self.diagnostics, self.issues = diagnostics, []

    def apply(self, df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
        """The model's output columns for every row of ``df``; kinds give types that Spark does not have, such as ip."""
        if not self.model.enabled:
            return df
        kinds = kinds or {}
        scope = Scope({f.name: self._leaf(f, kinds.get(f.name)) for f in df.schema.fields})
        for item in self.model.items:
            if isinstance(item.value, lookups.Select):
                df, values = self._select(df, scope, item)
                for target, value in values:
                    scope.put(target, convert(value, item.kind))
                continue
            self._statement(scope, item)
        out = [f.column.alias(n) for n, f in scope.made.items() if not n.startswith("__")]
        if self.diagnostics:
            issues = self.issues or [F.lit(None).cast("string")]
            out.append(F.filter(F.array(*issues), lambda x: x.isNotNull()).alias("__diag"))
        return df.select(*out)

    def _note(self, kind: str, detail: str, test: Column | None = None) -> None:
        """An issue of every record, or of those that pass the test."""
        text = F.lit(f"{kind}: {detail}")
        self.issues.append(text if test is None else F.when(test, text))

    def _diagnose(self, item: Assign, value: Field | None, made: Field | None) -> None:
        node, target = item.value, item.targets[0]
        source = node.source if isinstance(node, Pipe) else node
        if isinstance(source, Access):
            name = None if source.keys or source.option or source.default is not None else source.name or target
            if name is not None and value is None:
                self._note("missing_field", name)
            elif name is not None and isinstance(node, Access):
                self._note("missing_field", name, value.column.isNull())
        elif isinstance(node, Calc) and value is not None:
            self._note("math_eval_fail", target, value.column.isNull())
        if value is not None and made is not None and item.kind not in ("auto", value.kind):
            self._note("parse_fail", target, value.column.isNotNull() & made.column.isNull())

    @staticmethod
    def _leaf(f: T.StructField, kind: str | None) -> Field:
        known = kind or kind_of(f.dataType)
        return Field(widen(F.col(f"`{f.name.replace('`', '``')}`"), known), known)

    def _statement(self, scope: Scope, item: Assign) -> None:
        if "*" in item.targets[0] and isinstance(item.value, Access):
            before = len(scope.made)
            for name, f in list(scope.source.items()):
                glob = fnmatch.fnmatchcase(name, item.targets[0])
                if (glob and item.kind == "auto") or (item.kind != "auto" and f.kind == item.kind):
                    if name not in scope.made:
                        scope.put(name, f)
                    scope.source.pop(name, None)
            if len(scope.made) == before:
                self._note("batch_no_match", item.targets[0])
            return
        value = self._eval(scope, item.value, item.targets[0])
        made = None if value is None else convert(value, item.kind)
        if self.diagnostics:
            self._diagnose(item, value, made)
        if made is not None:
            scope.put(item.targets[0], made)

    def _eval(self, scope: Scope, node, target: str) -> Field | None:
        if isinstance(node, Static):
            node = self.model.statics[node.name]
        if isinstance(node, Literal):
            return node.field()
        if isinstance(node, Now):
            return {"time": Field(F.localtimestamp(), "time"), "date": Field(F.date_format(F.localtimestamp(), "yyyyMMdd").cast("bigint"), "digit"), "hour": Field(F.date_format(F.localtimestamp(), "yyyyMMddHH").cast("bigint"), "digit")}[node.what]
        if isinstance(node, Access):
            return self._access(scope, node, target)
        if isinstance(node, Make):
            return self._object(scope, node)
        if isinstance(node, Collect):
            return self._collect(scope, node)
        if isinstance(node, Format):
            return self._format(scope, node)
        if isinstance(node, Pipe):
            value = self._eval(scope, node.source, target)
            return None if value is None else reduce(self._step, node.steps, value)
        if isinstance(node, Calc):
            return self._calc(scope, node.tree, target)
        if isinstance(node, Match):
            return self._match(scope, node, target)
        if isinstance(node, Lookup):
            return self._lookup(scope, node, target)
        raise TypeError(f"no such expression: {node}")

    def _access(self, scope: Scope, node: Access, target: str) -> Field | None:
        if node.keys:
            collected = self._collect(scope, Collect(node))
            return collected
        take = node.verb == "take"
        name = node.name or (None if node.option else target)
        options = [scope.find(name, take)] if name else []
        for other in node.option:
            f = scope.find(other, take)
            if f is not None:
                empty = F.nullif(f.column, F.lit("")) if f.kind in TEXTUAL else f.column
                options.append(f.with_column(empty))
        if node.default is not None:
            default = self._eval(scope, node.default, target)
            if default is not None:
                options.append(default)
        found = [f for f in options if f is not None]
        return _first_present(found)

    def _collect(self, scope: Scope, node: Collect) -> Field | None:
        access = node.source
        names = access.keys or ((access.name,) if access.name else ())
        found: list[Field] = []
        for pattern in names:
            rx = re.compile(fnmatch.translate(pattern.replace("[", "[[]")))
            pools = (scope.source, scope.made) if access.verb == "take" else (scope.made, scope.source)
            hits = [f for pool in pools for n, f in pool.items() if rx.match(n)]
            found += hits if access.verb == "take" else hits[:1]
        if not found:
            return None
        same = len({f.kind for f in found}) == 1 and found[0].kind not in ("obj", "array")
        items = F.array(*[f.column if same else as_text(f) for f in found])
        items = F.filter(items, lambda x: x.isNotNull())
        return Field(F.when(F.size(items) > 0, items), "array")

    def _object(self, scope: Scope, node: Make) -> Field:
        members = []
        for names, kind, value in node.members:
            for name in names:
                f = self._eval(scope, value, name)
                if f is not None:
                    members.append(convert(f, kind).column.alias(name))
        return Field(F.struct(*members), "obj")

    def _format(self, scope: Scope, node: Format) -> Field:
        fields = {}
        for arg in node.args:
            f = self._access(scope, arg, arg.name or "")
            fields[arg.name] = as_text(f) if f is not None else F.lit(None).cast("string")
            self._note("fmt_var_missing", arg.name or "", fields[arg.name].isNull())
        parts = []
        for text, name in re.findall(r"([^{}]+)|\{([^{}]*)\}", node.template):
            parts.append(F.lit(text) if text else fields.get(name, F.lit(None).cast("string")))
        joined = F.concat(*parts) if parts else F.lit("")
        return Field(F.coalesce(joined, F.lit("")), "chars")

    def _step(self, f: Field, step: tuple) -> Field:
        name, args = step
        if name in _ADDED:
            return _ADDED[name](f, *args)
        simple = {"base64_encode": scalar.base64_encode, "base64_decode": scalar.base64_decode, "html_escape": scalar.html_escape, "html_unescape": scalar.html_unescape, "str_escape": scalar.str_escape, "json_escape": scalar.json_escape, "json_unescape": scalar.json_unescape, "to_json": scalar.to_json, "to_str": scalar.to_str, "nth": scalar.nth, "get": scalar.member, "skip_empty": scalar.skip_empty, "starts_with": scalar.starts_with, "map_to": scalar.map_to, "path": scalar.path, "url": scalar.url, "ip4_to_int": scalar.ip4_to_int}
        if name in simple:
            return simple[name](f, *args)
        if name == "extract_main_word":
            return words.extract_main_word(f, self.dictionary)
        if name == "extract_subject_object":
            return words.extract_subject_object(f, self.dictionary)
        if name == "Time::to_ts_zone":
            return scalar.to_timestamp_number(f, int(args[0]), args[1])
        return scalar.to_timestamp_number(f, unit={"Time::to_ts": "s", "Time::to_ts_ms": "ms", "Time::to_ts_us": "us"}[name])

    def _calc(self, scope: Scope, tree, target: str) -> Field:
        kind = tree[0]
        if kind == "num":
            return Field(F.lit(tree[1]).cast("bigint" if isinstance(tree[1], int) else "double"), "digit" if isinstance(tree[1], int) else "float")
        if kind == "get":
            f = self._eval(scope, tree[1], target)
            return f if f is not None else Field(F.lit(None).cast("double"), "float")
        if kind == "neg":
            return calc.negate(self._calc(scope, tree[1], target))
        if kind == "call":
            return calc.unary(tree[1], self._calc(scope, tree[2], target))
        return calc.binary(kind, self._calc(scope, tree[1], target), self._calc(scope, tree[2], target))

    def _match(self, scope: Scope, node: Match, target: str) -> Field | None:
        sources = [self._access(scope, s, s.name or target) for s in node.sources]
        chain, default, results = [], None, []
        for conditions, result in node.arms:
            value = self._eval(scope, result, target)
            value = value or Field(F.lit(None).cast("string"), "chars")
            results.append(value)
            if conditions is None:
                default = value
                continue
            tests = [match_condition(f, c) if f is not None else F.lit(False) for f, c in zip(sources, conditions)]
            present = reduce(lambda a, b: a & b, [F.lit(False) if f is None else f.column.isNotNull() for f in sources])
            chain.append((present & F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)), value))
        same = len({v.kind for v in results}) == 1
        pick = (lambda v: v.column) if same else as_text
        kind = results[0].kind if same else "chars"
        if not chain:
            return default
        out = F.when(chain[0][0], pick(chain[0][1]))
        for test, value in chain[1:]:
            out = out.when(test, pick(value))
        return Field(out.otherwise(pick(default)) if default is not None else out, kind)

    def _lookup(self, scope: Scope, node: Lookup, target: str) -> Field:
        table = self.model.statics.get(node.table)
        if not isinstance(table, Make):
            raise SyntaxProblem(f"{node.table} is no static object")
        pairs = {name.strip().lower(): v for names, _, v in table.members for name in names}
        key, default = self._eval(scope, node.key, target), self._eval(scope, node.default, target)
        if key is None or key.kind not in TEXTUAL or not pairs:
            return default
        same = len({v.kind for v in pairs.values()} | {default.kind}) == 1
        text = lambda f: f.column if same else as_text(f)
        literal = F.create_map(*[x for k, v in sorted(pairs.items()) for x in (F.lit(k), text(v.field()))])
        return Field(F.coalesce(F.try_element_at(literal, F.lower(F.trim(key.column))), text(default)), default.kind if same else "chars")

    def _select(self, df: DataFrame, scope: Scope, item: Assign):
        node = item.value
        table = self.tables.get(node.table)
        if table is None:
            raise SyntaxProblem(f"no reference table {node.table}")
        return lookups.join(df, scope, node, table, item.targets, lambda n: self._eval(scope, n, ""))


def _first_present(found: list[Field]) -> Field | None:
    if not found:
        return None
    if len(found) == 1:
        return found[0]
    same = len({f.kind for f in found}) == 1
    return Field(F.coalesce(*[f.column if same else as_text(f) for f in found]), found[0].kind if same else "chars")


def match_condition(f: Field, condition: tuple) -> Column:
    kind, *args = condition
    x = f.column
    if kind == "any":
        return F.lit(True)
    if kind == "or":
        return reduce(lambda a, b: a | b, [F.coalesce(match_condition(f, c), F.lit(False)) for c in args[0]])
    if kind in ("eq", "not", "in"):
        if any(v.kind != f.kind for v in args):
            return F.lit(False)  # another type never matches, not even a negation
        values = [v.field().column for v in args]
        if kind == "eq":
            return x == values[0]
        if kind == "not":
            return x != values[0]
        if f.kind == "ip":
            x, values = scalar.ip_order(x), [scalar.ip_order(v) for v in values]
        return x.between(*values)
    name, given = args
    number = widen(x, f.kind).cast("double") if f.kind in NUMERIC else x.try_cast("double") if f.kind in TEXTUAL else None
    if name in ("gt", "lt", "eq", "in_range"):
        if number is None:
            return F.lit(False)
        nums = [float(g) for g in given]
        return {"gt": lambda: number > nums[0], "lt": lambda: number < nums[0], "eq": lambda: F.abs(number - nums[0]) < 1e-10, "in_range": lambda: number.between(*nums)}[name]()
    if f.kind not in TEXTUAL:
        return F.lit(False)
    if name == "starts_with":
        return F.startswith(x, F.lit(given[0]))
    if name == "ends_with":
        return F.endswith(x, F.lit(given[0]))
    if name == "contains":
        return F.contains(x, F.lit(given[0]))
    if name == "regex_match":
        return x.rlike(given[0])
    if name == "is_empty":
        return x == ""
    return F.lower(x).isin([str(g).lower() for g in given])


def apply_model(df: DataFrame, text: str, tables: dict[str, DataFrame] | None = None, kinds: dict[str, str] | None = None) -> DataFrame:
    return Compiler(parse_model(text), tables).apply(df, kinds)
