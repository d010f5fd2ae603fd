"""Scalar functions of the pipe language as pure column expressions.

A function applied to a type it does not handle returns the field unchanged, as its contract says;
the type is known when the plan is made, so no branch remains in the expression.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork.functions.types import TEXTUAL, Field, as_text

CHINA_HOURS = 8


def base64_encode(f: Field) -> Field:
    if f.kind not in TEXTUAL:
        return f
    return Field(F.regexp_replace(F.base64(F.encode(f.column, "UTF-8")), "[\r\n]", ""), "chars")


_DECODERS = {"utf8": "UTF-8", "utf-8": "UTF-8", "utf16le": "UTF-16LE", "utf16be": "UTF-16BE", "iso88591": "ISO-8859-1", "ascii": "UTF-8", "hz": "UTF-8"}


def base64_decode(f: Field, encoding: str = "Utf8") -> Field:
    """Text of the decoded bytes; invalid base64 gives the empty string."""
    if f.kind not in TEXTUAL:
        return f
    raw = F.try_to_binary(f.column, F.lit("base64"))
    name = encoding.lower()
    if name == "iso88591":
        return _decode_in_python(f, "cp1252")
    if name in _DECODERS and name not in ("utf16le", "utf16be"):
        text = F.when(raw.isNotNull() & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.make_valid_utf8(raw.cast("string")))
    elif name in _DECODERS:
        text = F.decode(raw, _DECODERS[name])
    else:
        return _decode_in_python(f, "imap" if name == "imap" else {"gbk": "gb18030", "gb2312": "gb18030", "windows949": "gb18030"}.get(name, encoding))
    return Field(F.when(f.column.isNotNull(), F.coalesce(text, F.lit(""))), "chars")


def _decode_in_python(f: Field, codec: str) -> Field:
    """Charsets that Spark has no decoder for, in Arrow batches."""
    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        import base64
        import binascii

        def one(text):
            if text is None:
                return None
            try:
                raw = base64.b64decode(text, validate=True)
            except (binascii.Error, ValueError):
                return ""
            if codec == "imap":
                return "".join(chr(b) if 32 <= b < 127 and b not in (34, 39, 92) else {9: "\\t", 10: "\\n", 13: "\\r", 34: '\\"', 39: "\\'", 92: "\\\\"}.get(b, f"\\x{b:02x}") for b in raw)
            return raw.decode(codec, "replace")

        return values.map(one)

    return Field(decode(f.column), "chars")


def _replace_each(column: Column, pairs) -> Column:
    for old, new in pairs:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def html_escape(f: Field) -> Field:
    if f.kind not in TEXTUAL:
        return f
    return Field(_replace_each(f.column, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;"))), "chars")


def html_unescape(f: Field) -> Field:
    if f.kind not in TEXTUAL:
        return f
    @F.pandas_udf("string")
    def unescape(values: pd.Series) -> pd.Series:
        import html

        return values.map(lambda x: None if x is None else html.unescape(x))

    return Field(F.when(f.column.contains("&"), unescape(f.column)).otherwise(f.column), "chars")


def str_escape(f: Field) -> Field:
    if f.kind not in TEXTUAL:
        return f
    plain = _replace_each(f.column, (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n"), ("'", "\\'"), ('"', '\\"')))

    @F.pandas_udf("string")
    def escape(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else "".join(c if " " <= c <= "~" else f"\\u{{{ord(c):x}}}" for c in x))

    return Field(F.when(plain.rlike("[^ -~]"), escape(plain)).otherwise(plain), "chars")


def json_escape(f: Field) -> Field:
    """RFC 8259 escapes of the text, without the quotes."""
    if f.kind not in TEXTUAL:
        return f
    quoted = F.to_json(F.struct(f.column.alias("x")))
    return Field(F.when(f.column.isNotNull(), F.substring(quoted, 7, F.length(quoted) - 8)), "chars")


def json_unescape(f: Field) -> Field:
    if f.kind not in TEXTUAL:
        return f
    value = F.get_json_object(F.concat(F.lit('{"x":"'), f.column, F.lit('"}')), "$.x")
    return Field(F.when(f.column.contains("\\"), F.coalesce(value, f.column)).otherwise(f.column), "chars")


def to_json(f: Field) -> Field:
    if f.kind in ("obj", "array"):
        return Field(F.to_json(f.column), "json")
    if f.kind in ("digit", "float", "bool"):
        return Field(f.column.cast("string"), "json")
    if f.kind == "json":
        return f
    quoted = F.to_json(F.struct(as_text(f).alias("x")))
    return Field(F.when(f.column.isNotNull(), F.substring(quoted, 6, F.length(quoted) - 6)), "json")


def to_str(f: Field) -> Field:
    return Field(as_text(f), "chars")


def to_timestamp_number(f: Field, hours: int = CHINA_HOURS, unit: str = "s") -> Field:
    """Epoch seconds, milliseconds or microseconds of a zoneless time read in a fixed offset."""
    if f.kind != "time":
        return f
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), f.column.cast("timestamp_ntz")) - F.lit(hours * 3_600_000_000).cast("bigint")
    scale = {"s": 1_000_000, "ss": 1_000_000, "ms": 1000, "us": 1}[unit]
    return Field(micros if scale == 1 else F.floor(micros / scale).cast("bigint") if scale == 1000 else F.floor(micros / scale).cast("bigint"), "digit")


def nth(f: Field, index: int) -> Field:
    return Field(F.get(f.column, F.lit(index)), "chars") if f.kind == "array" else f


def member(f: Field, path: str) -> Field:
    """Nested member of an object, or of JSON text, by ``a/b``."""
    parts = [p for p in path.split("/") if p]
    if f.kind == "obj":
        column = f.column
        for p in parts:
            column = column[p]
        return Field(column, "chars")
    if f.kind in ("json", "chars"):
        return Field(F.coalesce(F.get_json_object(f.column, "$" + "".join(f"['{p}']" for p in parts)), f.column), f.kind)
    return f


def skip_empty(f: Field) -> Field:
    """Empty arrays and objects, zeros and empty strings become absent."""
    if f.kind == "array":
        return f.with_column(F.when(F.size(f.column) > 0, f.column))
    if f.kind in ("digit", "float"):
        return f.with_column(F.when(f.column != 0, f.column))
    if f.kind in TEXTUAL or f.kind == "ip":
        return f.with_column(F.nullif(f.column, F.lit("")))
    return f


def starts_with(f: Field, prefix: str) -> Field:
    """The value where it begins so, else absent; never present for other types."""
    if f.kind not in TEXTUAL:
        return Field(F.lit(None).cast("string"), "chars")
    return f.with_column(F.when(F.startswith(f.column, F.lit(prefix)), f.column))


def map_to(f: Field, value) -> Field:
    kind = "bool" if isinstance(value, bool) else "digit" if isinstance(value, int) else "float" if isinstance(value, float) else "chars"
    literal = F.lit(value).cast("bigint") if kind == "digit" else F.lit(value)
    return Field(F.when(f.column.isNotNull(), literal), kind)


def path(f: Field, part: str = "default") -> Field:
    """File name or folder of a path with either separator; what has none stays whole."""
    if f.kind not in TEXTUAL:
        return f
    whole = F.replace(f.column, F.lit("\\"), F.lit("/"))
    if part == "name":
        bare = F.regexp_replace(whole, "/+$", "")
        name = F.regexp_extract(bare, "([^/]+)$", 1)
        return Field(F.when((name == "") | (name == ".."), whole).otherwise(name), "chars")
    if part == "path":
        bare = F.regexp_replace(whole, "(?<=.)/+$", "")
        folder = F.regexp_replace(F.regexp_extract(bare, "^(.*/)[^/]*$", 1), "(?<=.)/+$", "")
        return Field(F.when((bare == "/") | (bare == ""), whole).otherwise(folder), "chars")
    return Field(whole, "chars")


_DEFAULT_PORTS = {"http": "80", "ws": "80", "https": "443", "wss": "443", "ftp": "21"}


def url(f: Field, part: str) -> Field:
    """domain, host, uri, path or params of a URL; text that is none stays as it is."""
    if f.kind not in TEXTUAL:
        return f
    x = f.column
    host = F.lower(F.try_parse_url(x, F.lit("HOST")))
    ok = host.isNotNull() & (host != "")
    if part == "domain":
        return Field(F.when(ok & ~host.rlike(r"^[0-9.]+$|^\["), host).otherwise(x), "chars")
    if part == "host":
        port = F.regexp_extract(F.try_parse_url(x, F.lit("AUTHORITY")), r":([0-9]+)$", 1)
        scheme = F.lower(F.try_parse_url(x, F.lit("PROTOCOL")))
        usual = F.coalesce(*[F.when((scheme == s) & (port == p), True) for s, p in _DEFAULT_PORTS.items()], F.lit(False))
        return Field(F.when(ok, F.when((port == "") | usual, host).otherwise(F.concat(host, F.lit(":"), port))).otherwise(x), "chars")
    folder = F.coalesce(F.nullif(F.try_parse_url(x, F.lit("PATH")), F.lit("")), F.lit("/"))
    query = F.try_parse_url(x, F.lit("QUERY"))
    if part == "path":
        return Field(F.when(ok, folder).otherwise(x), "chars")
    if part == "params":
        return Field(F.when(ok, F.coalesce(query, F.lit(""))).otherwise(x), "chars")
    fragment = F.try_parse_url(x, F.lit("REF"))
    tail = F.concat(folder, F.coalesce(F.concat(F.lit("?"), query), F.lit("")), F.coalesce(F.concat(F.lit("#"), fragment), F.lit("")))
    return Field(F.when(ok, tail).otherwise(x), "chars")


def ip4_number(text: Column) -> Column:
    """The 32-bit number of a dotted IPv4 address, NULL for anything else."""
    parts = F.split(text, r"\.")
    number = F.aggregate(F.transform(parts, lambda p: p.try_cast("bigint")), F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p)
    return F.when(text.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"), number)


def ip4_to_int(f: Field) -> Field:
    return Field(ip4_number(f.column), "digit") if f.kind == "ip" else f


def ip_order(text: Column) -> Column:
    """A text key that sorts IPv4 before IPv6, each by its bytes."""
    groups = F.split(F.regexp_replace(F.lower(text), "::", ":*:"), ":")
    groups = F.filter(groups, lambda g: g != "")
    given = F.size(F.filter(groups, lambda g: g != "*"))
    full = F.flatten(F.transform(groups, lambda g: F.when(g == "*", F.array_repeat(F.lit("0000"), F.greatest(F.lit(0), 8 - given))).otherwise(F.array(F.lpad(g, 4, "0")))))
    return F.when(text.contains(":"), F.concat(F.lit("6"), F.array_join(full, ""))).otherwise(F.concat(F.lit("4"), F.lpad(ip4_number(text).cast("string"), 10, "0")))


# functions of the reference-table language


def ip4_int(text: Column) -> Column:
    return F.coalesce(ip4_number(F.trim(text)), F.lit(0).cast("bigint"))


def ip4_between(text: Column, low: Column, high: Column) -> Column:
    return ip4_int(text).between(ip4_int(low), ip4_int(high)).cast("int")


def ip4_text(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftrightunsigned(number.cast("bigint"), k).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for k in (24, 16, 8, 0)])


def _cidr(text: Column) -> tuple[Column, Column]:
    bits = F.coalesce(F.regexp_extract(text, r"/([0-9]+)$", 1).try_cast("int"), F.lit(32))
    size = F.pow(F.lit(2), 32 - bits).cast("bigint")
    base = ip4_int(F.substring_index(text, "/", 1))
    low = base - base % size
    return low, low + size - 1


def cidr4_min(text: Column) -> Column:
    return _cidr(text)[0]


def cidr4_max(text: Column) -> Column:
    return _cidr(text)[1]


def cidr4_contains(ip: Column, cidr: Column) -> Column:
    low, high = _cidr(cidr)
    return ip4_int(ip).between(low, high).cast("int")


def trim_quotes(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "^[\"']|[\"']$", "")
