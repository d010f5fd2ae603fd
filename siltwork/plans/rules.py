"""Parse rules: text layouts compiled to one regular expression and typed columns.

``package /p { rule r { |decode/base64| (ip:sip, 2*_, time/clf<[,]>, http/request", digit)\\, } }``
Fields follow each other, separated by blanks or the group's separator; a rule gives a struct of
its fields and what is left of the text, or NULL where it does not match.  The text is matched once:
one replacement puts the groups side by side, parted by a noncharacter that Unicode keeps for such
internal use, and the fields are typed from the pieces.  A text that holds it matches no rule.
Unknown constructs raise; unknown pre-processors are stubs that leave the text as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork.functions.types import Field
from siltwork.plans.text import Scanner, SyntaxProblem

_VALUES = {
    "ip": r"[0-9a-fA-F:.]*[0-9a-fA-F:]", "digit": r"[+-]?[0-9]+", "float": r"[+-]?[0-9]+(?:\.[0-9]+)?", "bool": r"true|false", "sn": r"[A-Za-z0-9_-]+",
    "http/status": r"[0-9]{3}", "http/method": r"[A-Z]+", "hex": r"(?:0x)?[0-9a-fA-F]+", "email": r"[^\s@]+@[^\s@]+", "domain": r"[A-Za-z0-9.-]+",
    "time": r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}|[A-Z][a-z]{2} +[0-9]{1,2} (?:[0-9]{4} )?[0-9]{2}:[0-9]{2}:[0-9]{2}|[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2}(?: [+-][0-9]{4})?",
    "time/clf": r"[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2}(?: [+-][0-9]{4})?",
}
_KINDS = {"ip": "ip", "digit": "digit", "float": "float", "bool": "bool", "http/status": "digit", "time": "time", "time/clf": "time", "json": "json", "kv": "obj", "kvarr": "obj"}
_FREE = frozenset(("chars", "http/request", "http/agent", "url", "symbol", "_", "kv", "json", "obj"))
_TYPE = r"_|[a-z]+(?:/[a-z]+)?"


@dataclass(frozen=True)
class Sub:
    """A sub-field ``type@key:name +function(argument)`` of json, kv and kvarr; type ``_`` drops the key."""

    kind: str
    key: str
    name: str
    enrich: tuple[str, str] | None = None


@dataclass(frozen=True)
class Part:
    """One field of a layout."""

    kind: str
    name: str
    open: str = ""
    close: str = ""
    separator: str | None = None
    literal: str | None = None
    subs: tuple[Sub, ...] = ()
    times: int | None = 1  # None: any number
    checks: tuple = ()


@dataclass(frozen=True)
class Group:
    mode: str  # seq, alt, opt, not
    parts: tuple[Part, ...]
    separator: str = " "


@dataclass
class Rule:
    key: str
    pre: tuple[str, ...] = ()
    groups: list[Group] = field(default_factory=list)
    annotations: dict[str, str] = field(default_factory=dict)


def separator_pattern(pattern: str) -> str:
    """``{...}`` separators: ``*`` shortest text, ``?`` one sign, \\s \\h blanks, \\S \\H others, ``(...)`` kept."""
    out, i, stars = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append({"s": r"[ \t\r\n]+", "h": r"[ \t]+", "S": r"[^ \t\r\n]+", "H": r"[^ \t]+"}.get(pattern[i], re.escape(pattern[i])))
        elif c == "*":
            stars += 1
            if stars > 1:
                raise SyntaxProblem("a separator pattern has at most one *")
            out.append(".*?")
        elif c == "?":
            out.append(".")
        elif c == "(":
            end = pattern.index(")", i)
            if end != len(pattern) - 1:
                raise SyntaxProblem("the kept group must come last")
            out.append(f"(?={separator_pattern(pattern[i + 1 : end])})")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def parse_rules(text: str, package: str = "") -> list[Rule]:
    s, rules = Scanner(text), []
    while not s.done():
        if s.take(r"package\s+([\w/.-]+)\s*\{"):
            name = re.search(r"package\s+([\w/.-]+)", text[: s.at])[1] if not rules else re.findall(r"package\s+([\w/.-]+)", text[: s.at])[-1]
            while not s.take(r"\}"):
                rules.append(_rule(s, name))
        else:
            rules.append(_rule(s, package))
    return rules


def split_rules(text: str) -> list[tuple[str, str]]:
    """(package, text of one rule) of each rule, so that a bad one can be skipped alone."""
    out, package, at = [], "", 0
    head = re.compile(r"(?:\s+|//[^\n]*|#(?!\[)[^\n]*|\})*(?:package\s+([\w/.-]+)\s*\{)?")
    while at < len(text):
        found = head.match(text, at)
        if found[1] or "}" in re.sub(r"//[^\n]*|#[^\n]*", "", found[0]):
            package = found[1] or ""
        begin = found.end()
        if begin >= len(text):
            break
        if found.end() == at and found[1] is None and "{" not in text[at:]:
            out.append((package, text[at:]))
            break
        depth, k = 0, begin
        while k < len(text):
            c = text[k]
            if c == "\\":
                k += 1
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append((package, text[begin : k + 1]))
        at = k + 1
    return out


def _rule(s: Scanner, package: str) -> Rule:
    notes = {}
    while s.take(r"#\["):
        body = s.need(r"([^\]]*)\]")[1]
        notes |= dict(re.findall(r"(\w+)\s*[:=]\s*\"([^\"]*)\"", body))
    name = s.need(r"rule\s+([\w/.-]+)\s*\{", "a rule")[1]
    rule = Rule(f"{package}/{name}" if package else name, annotations=notes)
    if s.take(r"\|"):
        rule.pre = tuple(x.strip() for x in s.need(r"([^(]*)\|\s*(?=\(|alt|opt|not)")[1].split("|"))
    while not s.take(r"\}"):
        mode = s.take(r"(alt|opt|not|seq)\b")
        s.need(r"\(", "a group")
        parts = _repeated(_part(s))
        while s.take(",") or (parts[-1].separator is not None and not s.peek(r"\)")):
            parts += _repeated(_part(s))
        s.need(r"\)", ")")
        rule.groups.append(Group(mode[1] if mode else "seq", tuple(parts), _separator(s) or " "))
        s.take(",")
    return rule


def _separator(s: Scanner) -> str | None:
    if s.at < len(s.text) and s.text[s.at] == "{":
        found = s.need(r"\{((?:[^{}\\]|\\.)*)\}")
        return "\0" + separator_pattern(found[1])
    found = re.compile(r"\\(.)").match(s.text, s.at)
    if not found:
        return None
    s.at = found.end()
    return {"t": "\t", "s": " ", "S": "\0[ ]+"}.get(found[1], found[1])


def _repeated(p: Part) -> list[Part]:
    """``2*digit`` is two fields, the later ones named ``digit[1]``...; pairs and ignored fields stay together."""
    return [p] if p.times is None or p.kind in ("_", "kv") else [replace(p, times=1)] * p.times


def _call(s: Scanner) -> tuple:
    """(name, arguments) of a field function; ``not(...)`` has a call as its argument."""
    name = s.need(r"!?[a-z_0-9]+", "a field function")[0]
    if name == "not":
        s.need(r"\(")
        inner = _call(s)
        s.need(r"\)")
        return name, inner
    return name, tuple(x.strip().strip("'\"") for x in s.need(r"\(([^()]*)\)")[1].split(",")) if s.peek(r"\(") else ()


def _sub(text: str) -> Sub:
    found = re.fullmatch(rf"({_TYPE})?\s*@([^\s:+]+)(?::([\w./-]+))?\s*(?:\+(\w+)\((\w+)\))?", text)
    if not found or (found[1] and found[1] != "_" and found[1] not in _VALUES and found[1] not in _FREE):
        raise SyntaxProblem(f"no sub-field: {text!r}")
    return Sub(found[1] or "chars", found[2], found[3] or found[2], (found[4], found[5]) if found[4] else None)


def _part(s: Scanner) -> Part:
    times = s.take(r"(\d*)\*(?=[a-z_])")
    kind = s.need(_TYPE, "a field type")[0]
    if kind != "_" and kind not in _VALUES and kind not in _FREE and kind != "kvarr":
        raise SyntaxProblem(f"no such field type: {kind}")
    literal, subs = None, ()
    if s.take(r"\("):
        inside = s.need(r"((?:[^()]|\([^()]*\))*)\)")[1]
        if kind == "symbol":
            literal = inside
        else:
            subs = tuple(_sub(x.strip()) for x in inside.split(",") if x.strip())
    length = s.take(r"\[(\d+)\]")
    name = s.take(r":([A-Za-z_][\w./-]*)")
    opened = closed = ""
    wrap = re.compile(r"<((?:[^,<>]|<)*),((?:[^<>]|>(?=>))*)>").match(s.text, s.at)
    if wrap:

        opened, closed = wrap[1].lstrip('"') if wrap[1].startswith('"') and len(wrap[1]) > 1 else wrap[1], wrap[2].rstrip('"') if wrap[2].endswith('"') and len(wrap[2]) > 1 else wrap[2]
        s.at = wrap.end()
    elif s.at < len(s.text) and s.text[s.at] == '"':
        opened = closed = '"'
        s.at += 1
    separator = _separator(s)
    checks = []
    while s.take(r"\|(?!\|)"):
        checks.append(_call(s))
    del length
    return Part(kind, name[1] if name else kind, opened, closed, separator, literal, subs, (int(times[1]) if times and times[1] else None if times else 1), tuple(checks))


def _value_pattern(p: Part, separator: str) -> str:
    if p.literal is not None:
        return re.escape(p.literal)
    if p.kind in _VALUES:
        return _VALUES[p.kind]
    if p.kind == "json":
        return r"(?s:\{.*\})"
    if p.kind == "kvarr":
        return r"(?s:\S.*?)(?=\s*$)" if p.separator is None else r"(?s:\S.*?)"
    if p.close:
        return f"[^{re.escape(p.close[0])}]*"
    if separator.startswith("\0"):
        return ".*?"
    return f"[^{re.escape(separator)}]+" if separator != " " else r"\S+"


def layout_pattern(rule: Rule) -> tuple[str, list[tuple[Part, str]]]:
    """The anchored expression with one group per kept field and a last one for the rest, and these fields with their separators."""
    out, fields, first = [], [], True
    for g in rule.groups:
        body, inside = [], []
        for p in g.parts:
            separator = p.separator or g.separator
            one = re.escape(p.open) + ("(" if p.kind != "_" and p.times == 1 else "(?:") + _value_pattern(p, separator) + ")" + re.escape(p.close)
            gap = separator[1:] if separator.startswith("\0") else (r" *" if p.close else r" +") if separator == " " else re.escape(separator) + " *"
            if p.times is None:
                one = f"(?:{one}(?:{gap}|$))*" if p.kind == "_" else f"({one}(?:{gap}{one})*)"
            elif p.times > 1:
                one = rf"{one}(?:{gap}{one}){{{p.times - 1}}}" if p.kind == "_" else f"({one}(?:{gap}{one}){{{p.times - 1}}})"
            body.append((one, gap, p.times is None and p.kind == "_"))
            if p.kind != "_":
                inside.append((p, separator))
        if g.mode == "alt":
            text = "(?:" + "|".join(b for b, _, _ in body) + ")"
        else:
            text = ""
            for k, (b, _, _) in enumerate(body):
                gap_before = body[k - 1][1] if k and not body[k - 1][2] else ""
                text += gap_before + b
        lead = "" if first else body[0][1] if body else ""
        if g.mode == "not":
            out.append(f"(?!{lead}{re.sub(r'[(](?![?])', '(?:', text)})")
            continue
        out.append(f"(?:{lead}{text})?" if g.mode == "opt" else lead + text)
        fields += inside
        first = False
    return r"(?s)^\s*" + "".join(out) + r"\s*(.*)$", fields


_CLF = "dd/MMM/yyyy:HH:mm:ss"


def typed(text: Column, kind: str) -> Column:
    if kind in ("digit", "http/status"):
        return text.try_cast("bigint")
    if kind == "float":
        return text.try_cast("double")
    if kind == "bool":
        return text.try_cast("boolean")
    clf = F.try_to_timestamp(F.substring(text, 1, 20), F.lit(_CLF)).cast("timestamp_ntz")
    if kind == "time/clf":
        return clf
    if kind == "time":
        named = F.try_to_timestamp(F.regexp_replace(text, " +", " "), F.lit("MMM d yyyy HH:mm:ss")).cast("timestamp_ntz")
        digit = F.substring(text, 1, 1).between("0", "9")
        return F.when(digit & (F.substring(text, 3, 1) == "/"), clf).when(digit, text.try_cast("timestamp_ntz")).otherwise(named)
    return text


def _entries(text: Column, rx: str) -> Column:
    """(key, place, value) of every pair; the expression is matched once a group."""
    keys, values = F.regexp_extract_all(text, F.lit(rx), F.lit(1)), F.regexp_extract_all(text, F.lit(rx), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    return F.transform(pairs, lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), F.regexp_replace(F.trim(e["v"]), '^"|"$', "").alias("v")))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as a lambda's argument."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last_of_each(entries: Column) -> Column:
    """Map of the last value of each key: entries sorted by key and place, so n log n."""
    last = lambda a: F.filter(a, lambda x, i: (i == F.size(a) - 1) | (F.get(a, i + 1)["k"] != x["k"]))
    return F.map_from_entries(F.transform(_bound(F.sort_array(entries), last), lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value"))))


def key_values(text: Column, pair: str = ",", sign: str = "=") -> Column:
    """Map of key=value (or key: value) pairs; the last of a repeated key stays, quotes are stripped."""
    rx = rf"([^\s{re.escape(pair)}=:\"]+)\s*[{sign}]\s*(\"[^\"]*\"|[^{re.escape(pair)}]*)"
    return _last_of_each(_entries(text, rx))


def key_value_array(text: Column) -> Column:
    """kvarr: pairs by = or :, repeated keys become key[0], key[1], ...; a key that is so named already gives way to the later one."""

    def named(a: Column) -> Column:
        # place of the first entry of each key: a running maximum by doubling
        first = F.transform(a, lambda x, i: F.when((i == 0) | (F.get(a, i - 1)["k"] != x["k"]), i).otherwise(F.lit(0)))
        steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda p: p < F.size(a))
        starts = F.aggregate(steps, first, lambda acc, p: F.transform(acc, lambda x, i: F.when(i >= p, F.greatest(x, F.get(acc, i - p))).otherwise(x)))

        def one(x: Column, i: Column, at: Column) -> Column:
            many = (F.get(at, i) < i) | (F.get(at, i + 1) == F.get(at, i))
            return F.struct(F.when(many, F.concat(x["k"], F.lit("["), (i - F.get(at, i)).cast("string"), F.lit("]"))).otherwise(x["k"]).alias("k"), x["i"].alias("i"), x["v"].alias("v"))

        return _bound(starts, lambda at: F.transform(a, lambda x, i: one(x, i, at)))

    rx = r"([^\s,=:\"]+)\s*[=:]\s*(\"[^\"]*\"|[^\s,]*)"
    return _last_of_each(_bound(F.sort_array(_entries(text, rx)), named))


def _unescaped(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(raw), '^"|"$', ""), r'\\"', '"'), r"\\\\", r"\\")


Pipe = Callable[[Column], Column]
_PIPES: dict[str, Pipe] = {
    "DECODE/BASE64": lambda raw: F.try_to_binary(raw, F.lit("base64")).cast("string"),
    "DECODE/HEX": lambda raw: F.unhex(raw).cast("string"),
    "UNQUOTE/UNESCAPE": _unescaped,
    "STRIP/BOM": lambda raw: F.regexp_replace(raw, "^\ufeff", ""),
}
_PIPES["BASE64"] = _PIPES["DECODE/BASE64"]


def register_pipe(name: str, pipe: Pipe) -> None:
    """Adds a pre-processor, a function from column to column, under its upper-cased name."""
    _PIPES[name.upper()] = pipe


def prepare(raw: Column, steps: tuple[str, ...]) -> Column:
    """Pre-processors run on the raw text before the layout; a name that nobody registered is a stub."""
    for step in steps:
        raw = _PIPES.get(step.upper(), lambda c: c)(raw)
    return raw


def _check(column: Column, check: tuple) -> Column:
    name, args = check
    if name == "not":
        return ~_check(column, args)
    if name.startswith("!"):
        return ~_check(column, (name[1:], args))
    if name in ("chars_has", "f_chars_has"):
        return F.coalesce(column == args[-1], F.lit(False))
    if name in ("chars_not_has", "f_chars_not_has"):
        return ~column.eqNullSafe(F.lit(args[-1]))
    if name == "chars_in":
        return F.coalesce(column.isin(*args), F.lit(False))
    if name in ("has", "f_has"):
        return column.isNotNull()
    if name == "digit_range":
        return F.coalesce(column.try_cast("bigint").between(int(args[0]), int(args[1])), F.lit(False))
    if name == "regex_match":
        return F.coalesce(column.rlike(args[0]), F.lit(False))
    if name == "starts_with":
        return F.coalesce(F.startswith(column, F.lit(args[0])), F.lit(False))
    raise SyntaxProblem(f"no such field function: {name}")


_CHANGES = {
    "chars_replace": lambda c, a: F.replace(c, F.lit(a[0]), F.lit(a[1])),
    "json_unescape": lambda c, a: F.coalesce(F.get_json_object(F.concat(F.lit('{"x":"'), c, F.lit('"}')), "$.x"), c),
    "base64_decode": lambda c, a: F.try_to_binary(c, F.lit("base64")).cast("string"),
}


_APART = "\ufdd0"


def matched(rule: Rule, raw: Column) -> Column:
    """Array of one empty piece, the layout's groups and the rest; of another size where the text does not match."""
    pattern, parts = layout_pattern(rule)
    text = prepare(raw, rule.pre)
    pieces = "".join(f"{_APART}${k}" for k in range(1, len(parts) + 2))
    found = F.split(F.regexp_replace(text, pattern, pieces), _APART, -1)
    return F.when(~F.contains(text, F.lit(_APART)), found)


def _sub_fields(p: Part, value: Column, separator: str) -> list[tuple[Sub, Column]]:
    """Texts of a part's declared sub-fields."""
    if p.kind == "json":
        path = lambda key: "$." + ".".join(f"['{x}']" for x in key.split("/")) if "/" in key else f"$['{key}']"
        return [(x, F.get_json_object(value, path(x.key).replace(".[", "["))) for x in p.subs if x.kind != "_"]
    if p.kind == "kv" and p.times == 1 and len(p.subs) == 1:
        return [(p.subs[0], F.regexp_replace(F.regexp_replace(value, r"^[^=:]*[=:]\s*", ""), '^"|"$', ""))]
    return [(x, F.try_element_at(value, F.lit(x.key))) for x in p.subs if x.kind != "_"]


def typed_fields(rule: Rule, pieces: Column) -> tuple[Column, dict[str, Field]]:
    """(struct of the fields and ``left`` from the matched pieces, or NULL; the fields' types)."""
    _, parts = layout_pattern(rule)
    ok = F.coalesce(F.size(pieces) == len(parts) + 2, F.lit(False))
    columns, kinds, used = [], {}, set()

    def keep(name: str, value: Column, kind: str) -> None:
        n, base = 0, name
        while name in used:
            n += 1
            name = f"{base}[{n}]"
        used.add(name)
        kinds[name] = kind
        columns.append(value.alias(name))

    for k, (p, separator) in enumerate(parts, 1):
        value = F.nullif(F.get(pieces, F.lit(k)), F.lit(""))
        if p.kind in ("kv", "kvarr", "json"):
            pair = separator if len(separator) == 1 else " "
            if p.kind == "kvarr":
                value = key_value_array(value)
            elif p.kind == "kv" and not (p.times == 1 and len(p.subs) == 1):
                value = key_values(value, pair, "=:")
            for sub, text in _sub_fields(p, value, separator):
                changed = typed(text, sub.kind)
                if sub.kind in ("digit", "float", "bool", "http/status", "time", "time/clf"):
                    ok = ok & (text.isNull() | changed.isNotNull())
                keep(sub.name, changed, _KINDS.get(sub.kind, "chars"))
            if p.kind == "json" and p.subs or p.kind == "kv" and p.times == 1 and len(p.subs) == 1:
                continue
            if p.kind != "json" and p.subs:
                value = _without(value, [x.key for x in p.subs])
            keep(p.name, value, "json" if p.kind == "json" else "obj")
            continue
        for check in p.checks:
            if check[0] in _CHANGES:
                value = _CHANGES[check[0]](value, check[1])
            else:
                ok = ok & _check(value, check)
        keep(p.name, typed(value, p.kind), _KINDS.get(p.kind, "chars"))
    columns += [F.lit(v).alias(k) for k, v in rule.annotations.items() if k not in used]
    left = F.get(pieces, F.lit(len(parts) + 1))
    return F.when(ok, F.struct(*columns, left.alias("left"))), {k: Field(F.col(f"`{k}`"), v) for k, v in kinds.items()}


def _without(value: Column, keys: list[str]) -> Column:
    return F.map_filter(value, lambda key, _: ~key.isin(*keys))


def enrichments(rule: Rule) -> list[tuple[str, str, str]]:
    """(field, table, column) of the sub-fields that ask for an enrichment, as ``@ip +geo(city)``."""
    return [(x.name, *x.enrich) for g in rule.groups for p in g.parts for x in p.subs if x.enrich]


def compile_rule(rule: Rule, raw: Column) -> tuple[Column, dict[str, Field]]:
    """Both steps over a raw column; dispatch keeps the pieces in a projection of their own."""
    return typed_fields(rule, matched(rule, raw))
