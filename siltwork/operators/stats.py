"""Stage statistics, top-N, reporting windows, expectations and alerts as plain aggregations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions.types import Field
from siltwork.operators.routing import fields_of
from siltwork.plans.conditions import compile_condition, parse

EPSILON = 1e-12


@dataclass
class StatItem:
    """``[stat.<stage>] key, target, fields, top_n``."""

    stage: str
    key: str
    target: str = "all"
    fields: tuple[str, ...] = ()
    top_n: int = 20


def measures(rows: DataFrame, item: StatItem, success: Column, ts: str | None = None, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Totals, success rate and speed per target and dimension values; missing dimensions are a group."""
    dims = [F.col(f).cast("string").alias(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in item.fields]
    begin, end = (F.min(ts), F.max(ts)) if ts else (F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"))
    base = rows.select(F.lit(item.stage).alias("stage"), F.lit(item.key).alias("name"), F.lit(item.target).alias("target"), *extra, *dims, success.alias("__ok"), *([F.col(ts)] if ts else []))
    keys = ["stage", "name", "target", *[c for c in base.columns if c not in ("stage", "name", "target", "__ok", ts)]]
    out = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if("__ok").alias("success"), begin.alias("beg_time"), end.alias("end_time"))
    return rated(out)


def rated(out: DataFrame) -> DataFrame:
    ms = F.coalesce(F.timestamp_diff("MILLISECOND", F.col("beg_time"), F.col("end_time")), F.lit(0).cast("bigint"))
    return out.withColumns({"suc_rate": F.when(F.col("total") > 0, F.col("success") * 100.0 / F.col("total")).otherwise(F.lit(0.0)), "speed": F.col("total") * 1000.0 / (ms + 1)})


def top_n(stats: DataFrame, n: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """The 2 n largest totals, exactly; ties by the dimension values."""
    return stats.orderBy(F.desc("total"), *[F.col(t).asc_nulls_first() for t in ties]).limit(2 * n)


def merge(partials: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Reports of several workers into one: sums, earliest begin, latest end."""
    return rated(partials.groupBy("stage", "name", "target", *dims).agg(F.sum("total").alias("total"), F.sum("success").alias("success"), F.min("beg_time").alias("beg_time"), F.max("end_time").alias("end_time")))


def windowed(rows: DataFrame, item: StatItem, success: Column, ts: str, window: str = "60 seconds") -> DataFrame:
    """Measures per reporting window; on a stream set a watermark on ``ts`` first."""
    return measures(rows, item, success, None, (F.window(ts, window)["start"].alias("window_start"),)) if not rows.isStreaming else rows.groupBy(F.window(ts, window).alias("w"), *item.fields).agg(F.count(F.lit(1)).alias("total"), F.count_if(success).alias("success")).select(F.col("w.start").alias("window_start"), *item.fields, "total", "success")


@dataclass
class Expect:
    ratio: float | None = None
    tol: float = 0.0
    low: float | None = None
    high: float | None = None


@dataclass
class GroupExpect:
    basis: str = "group_input"  # or total_input, model
    min_samples: int = 0
    others_max: float | None = None
    sum_tol: float | None = None
    sinks: dict[str, Expect] = field(default_factory=dict)


def check_expectations(lines: DataFrame, expects: dict[str, GroupExpect], total_input: int | None = None) -> DataFrame:
    """(group, sink, lines, share, status, problem) from rows (group, sink, lines); a zero base is a warning."""
    spark = lines.sparkSession
    rows = [(g, s, e.basis, e.min_samples, x.ratio, x.tol, x.low, x.high) for g, e in expects.items() for s, x in e.sinks.items()]
    wanted = spark.createDataFrame(rows, "group string, sink string, basis string, min_samples long, ratio double, tol double, low double, high double")
    sums = lines.groupBy("group").agg(F.sum("lines").alias("group_input"))
    total = lines.agg(F.sum("lines").alias("total_input")) if total_input is None else spark.range(1).select(F.lit(total_input).cast("long").alias("total_input"))
    base = F.when(F.col("basis") == "total_input", F.col("total_input")).otherwise(F.col("group_input"))
    joined = lines.join(wanted, ["group", "sink"], "left").join(sums, "group").join(F.broadcast(total)).withColumn("base", base)
    share = F.try_divide(F.col("lines").cast("double"), F.col("base").cast("double"))
    far = F.abs(F.col("share") - F.col("ratio")) > F.col("tol") + EPSILON
    outside = (F.col("low").isNotNull() & (F.col("share") < F.col("low") - EPSILON)) | (F.col("high").isNotNull() & (F.col("share") > F.col("high") + EPSILON))
    out = joined.withColumn("share", share)
    problem = F.when(F.col("basis").isNull(), F.lit(None)).when(F.col("base") == 0, "no input").when(F.col("base") < F.col("min_samples"), "too few samples").when(F.col("ratio").isNotNull() & far, "ratio").when(outside, "range")
    out = out.withColumn("problem", problem)
    status = F.when(F.col("problem").isNull(), "ok").when(F.col("problem").isin("no input", "too few samples"), "warn").otherwise("fail")
    checked = out.select("group", "sink", "lines", "share", status.alias("status"), "problem")
    limits = spark.createDataFrame([(g, e.others_max, e.sum_tol, list(e.sinks)) for g, e in expects.items()], "group string, others_max double, sum_tol double, named array<string>")
    grouped = checked.join(F.broadcast(limits), "group").groupBy("group", "others_max", "sum_tol").agg(F.sum(F.when(~F.array_contains("named", F.col("sink")), F.col("share")).otherwise(0.0)).alias("others"), F.sum("share").alias("all"), F.sum("lines").alias("lines"))
    whole = grouped.select("group", F.lit("*").alias("sink"), "lines", F.col("all").alias("share"), F.when(F.col("others") > F.col("others_max") + EPSILON, "fail").when(F.abs(F.col("all") - 1) > F.col("sum_tol") + EPSILON, "fail").otherwise("ok").alias("status"), F.when(F.col("others") > F.col("others_max") + EPSILON, "others").when(F.abs(F.col("all") - 1) > F.col("sum_tol") + EPSILON, "sum").alias("problem"))
    return checked.unionByName(whole)


def alerts(stats: DataFrame, condition: str, notify: str, prompt: str) -> DataFrame:
    """Statistics rows that fulfil a condition, with whom to tell and what."""
    lookup = fields_of(stats)

    def find(name: str) -> Field | None:
        return lookup(name)

    return stats.where(compile_condition(parse(condition), find)).select("*", F.lit(notify).alias("notify"), F.lit(prompt).alias("prompt"))


def record_form(measured: DataFrame) -> DataFrame:
    """Measures as the statistics sink writes them: speed in units of ten thousand a second."""
    return measured.withColumn("speed", F.col("speed") / 10_000)
