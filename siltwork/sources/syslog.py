"""Syslog headers: RFC 5424, else strict RFC 3164, else the line as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp audit alert clock local0 local1 local2 local3 local4 local5 local6 local7".split()
SEVERITIES = "emerg alert crit err warning notice info debug".split()
_5424 = r"(?s)^<([0-9]{1,3})>([0-9]{1,2}) (\S+) (\S+) (\S+) (\S+) (\S+) (?:-|(?:\[(?:[^\]\\]|\\.)*\])+)(?: (.*))?$"
_3164 = r"(?s)^<([0-9]{1,3})>((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ 0-9][0-9]? ?(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]) (\S+) (.*)$"


def header(raw: Column) -> Column:
    """struct(format, pri, facility, severity, time, host, app, message)."""
    rfc5424, rfc3164 = raw.rlike(_5424), raw.rlike(_3164)
    pick = lambda a, b: F.when(rfc5424, F.regexp_extract(raw, _5424, a) if a else F.lit(None)).when(rfc3164, F.regexp_extract(raw, _3164, b) if b else F.lit(None))
    pri = pick(1, 1).cast("int")
    rfc5424, rfc3164 = rfc5424 & (pri <= 191), rfc3164 & (pri <= 191)
    names = lambda listed, at: F.get(F.array(*[F.lit(x) for x in listed]), at.cast("int"))
    tag = F.regexp_extract(F.regexp_extract(raw, _3164, 4), r"^([\w./-]+)(?:\[[0-9]+\])?:", 1)
    ok = F.coalesce(rfc5424 | rfc3164, F.lit(False))
    return F.struct(
        F.when(rfc5424, "rfc5424").when(rfc3164, "rfc3164").otherwise("raw").alias("format"),
        F.when(ok, pri).alias("pri"), F.when(ok, names(FACILITIES, F.floor(pri / 8))).alias("facility"), F.when(ok, names(SEVERITIES, pri % 8)).alias("severity"),
        F.when(ok, pick(3, 2)).alias("time"), F.when(ok, pick(4, 3)).alias("host"), F.when(rfc5424, F.regexp_extract(raw, _5424, 5)).when(rfc3164, F.nullif(tag, F.lit(""))).alias("app"),
        F.when(ok, pick(8, 4)).otherwise(raw).alias("message"),
    )


def normalise(events: DataFrame, mode: str = "skip", raw: str = "raw") -> DataFrame:
    """``raw``/``keep`` leave the line; ``skip``/``strip`` (the default) cut the header off; any other also tags."""
    if mode in ("raw", "keep"):
        return events
    h = header(F.col(raw))
    out = events.withColumn("__h", h).withColumn(raw, F.col("__h.message"))
    if mode in ("skip", "strip"):
        return out.drop("__h")
    known = F.col("__h.format") != "raw"
    named = F.when(known, F.map_filter(F.map_from_arrays(F.array(*[F.lit(f"syslog.{k}") for k in ("pri", "facility", "severity", "time", "host", "app")]), F.array(F.col("__h.pri").cast("string"), *[F.col(f"__h.{k}") for k in ("facility", "severity", "time", "host", "app")])), lambda k, v: v.isNotNull())).otherwise(F.create_map().cast("map<string,string>"))
    tags = F.map_concat(F.map_filter("tags", lambda k, v: ~k.startswith("syslog.")), named) if "tags" in events.columns else named
    return out.withColumn("tags", tags).drop("__h")
