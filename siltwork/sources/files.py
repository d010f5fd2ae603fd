"""File, rescue and generated sources.

Events are rows (event_id, src_key, raw, tags); ids are hashes of where a line stands, so that a
repeated read gives the same ids.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _decoded(line: Column, encode: str) -> Column:
    if encode == "text":
        return line
    if encode == "base64":
        raw = F.try_to_binary(line, F.lit("base64"))
    elif encode == "hex":
        raw = F.try_to_binary(line, F.lit("hex"))
    else:
        raise ValueError(f"no such encoding: {encode}")
    text = raw.cast("string")
    return F.when(raw.isNotNull() & F.is_valid_utf8(text), text)


def read_files(spark: SparkSession, base: str, file: str, *, encode: str = "text", key: str = "file", on_error: str = "raise", stream: bool = False) -> DataFrame:
    """One event per line, trailing CR and LF gone; ``file`` may be a glob, ``base`` may not; none is an error.

    A line that does not decode fails the read (``raise``), or stays with a null raw (``keep``).
    """
    if any(c in base for c in "*?["):
        raise ValueError("a glob is allowed in the file, not in the base folder")
    path = f"{base.rstrip('/')}/{file}"
    if stream:
        lines = spark.readStream.format("text").option("pathGlobFilter", os.path.basename(file)).load(base)
    else:
        lines = spark.read.option("lineSep", "\n").text(path)  # an unmatched path raises
    line = F.regexp_replace("value", "[\r\n]+$", "")
    raw = _decoded(line, encode)
    if on_error == "raise" and encode != "text":
        raw = F.coalesce(raw, F.when(line.isNotNull(), F.raise_error(F.concat(F.lit("line is not valid " + encode + ": "), F.substring(line, 1, 80))).cast("string")))
    where = F.col("_metadata.file_path")
    # a stream can't number lines before its batches are made; the engine tells equal lines apart there
    place = F.xxhash64(where, F.col("_metadata.file_block_start"), "value") if stream else F.xxhash64(where, F.monotonically_increasing_id())
    return lines.select(place.alias("event_id"), F.lit(key).alias("src_key"), raw.alias("raw"), F.create_map(F.lit("access_source"), where).alias("tags"))


def with_tags(events: DataFrame, record: DataFrame | None = None, tags: tuple[str, ...] = ()) -> DataFrame:
    """Tags become text columns where the record has none of that name."""
    rows = record if record is not None else events
    return rows.select("*", *[F.try_element_at("tags", F.lit(t)).alias(t) for t in tags if t not in rows.columns])


def with_provenance(records: DataFrame) -> DataFrame:
    """Adds wp_src_key, and wp_src_ip where the upstream address is known."""
    out = records.withColumn("wp_src_key", F.col("src_key"))
    return out.withColumn("wp_src_ip", F.col("ups_ip")) if "ups_ip" in records.columns else out


# rescue files: one JSON object a line, {"version": 1, "kind": "record" | "raw", "payload": text}

RESCUE_SCHEMA = "version int, kind string, payload string"


def rescue_entries(rows: DataFrame, raw: str | None = None) -> DataFrame:
    payload = F.col(raw) if raw else F.to_json(F.struct("*"))
    return rows.select(F.to_json(F.struct(F.lit(1).alias("version"), F.lit("raw" if raw else "record").alias("kind"), payload.alias("payload"))).alias("value"))


def write_rescue(rows: DataFrame, folder: str, sink: str, raw: str | None = None) -> None:
    rescue_entries(rows, raw).write.mode("append").text(f"{folder}/{sink}")


def read_rescue(spark: SparkSession, folder: str, sink: str, schema: str | None = None) -> DataFrame:
    """Payloads of a sink's rescue files, with the file and its time in ``at``; records parsed where a schema is given."""
    lines = spark.read.text(f"{folder}/{sink}").select(F.from_json("value", RESCUE_SCHEMA).alias("e"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at"))
    rows = lines.where("e.version = 1").select("e.kind", "e.payload", "file", "at")
    return rows.select("*", F.from_json("payload", schema).alias("record")) if schema else rows


def recovered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(file): rescue files that the checkpoint folder names as sent; none where there is no folder yet."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(checkpoint)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "file string")
    return spark.read.text(checkpoint).select(F.col("value").alias("file"))


def rescue_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Files, lines and bytes per sink."""
    sized = spark.read.text(f"{folder}/*").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("sink"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), "value")
    per_file = sized.groupBy("sink", "file", "size").agg(F.count(F.lit(1)).alias("lines"))
    return per_file.groupBy("sink").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("size").alias("bytes"))


# generated events

Rate = Callable[[Column], Column]


def constant(rate: float) -> Rate:
    return lambda t: F.lit(float(rate)) + t * 0


def sinusoidal(base: float, amplitude: float, period: float) -> Rate:
    return lambda t: F.greatest(F.lit(0.0), base + amplitude * F.sin(2 * F.pi() * t / period))


def stepped(steps: list[tuple[float, float]], loop: bool = False) -> Rate:
    """(seconds, rate) in order; the last rate stays unless it loops."""
    def at(t: Column) -> Column:
        total = sum(s for s, _ in steps)
        x = t % total if loop else t
        out, until = None, 0.0
        for seconds, rate in steps:
            until += seconds
            out = F.when(x < until, float(rate)) if out is None else out.when(x < until, float(rate))
        return out.otherwise(float(steps[-1][1]))

    return at


def burst(base: float, peak: float, every: float, length: float) -> Rate:
    return lambda t: F.when(t % every < length, float(peak)).otherwise(float(base))


def ramp(start: float, end: float, seconds: float) -> Rate:
    return lambda t: start + (end - start) * F.least(F.lit(1.0), t / seconds)


def random_walk(base: float, spread: float, seed: int = 0) -> Rate:
    """Bounded noise around the base that is a function of the second, so that runs repeat."""
    return lambda t: F.greatest(F.lit(0.0), base * (1 + spread * (F.pmod(F.xxhash64(F.floor(t), F.lit(seed)), F.lit(2001)) / 1000.0 - 1)))


def composite(profiles: list[Rate], how: str = "avg") -> Rate:
    def at(t: Column) -> Column:
        each = [p(t) for p in profiles]
        if how in ("max", "min"):
            return F.greatest(*each) if how == "max" else F.least(*each)
        total = sum(each[1:], each[0])
        return total / len(each) if how == "avg" else total

    return at


def profile_table(spark: SparkSession, seconds: int, rate: Rate) -> DataFrame:
    """(t, rate) for each second."""
    t = F.col("id").cast("double")
    return spark.range(seconds).select(F.col("id").alias("t"), rate(t).alias("rate"))


def generate(spark: SparkSession, samples: list[str], n: int, *, seed: int = 1, key: str = "generator") -> DataFrame:
    """n events drawn evenly from sample lines."""
    pool = F.array(*[F.lit(s) for s in samples])
    pick = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(samples))).cast("int")
    return spark.range(n).select(F.col("id").alias("event_id"), F.lit(key).alias("src_key"), F.get(pool, pick).alias("raw"), F.create_map(F.lit("access_source"), F.lit("generator")).alias("tags"))


def generate_by_rule(spark: SparkSession, fields: dict[str, str], n: int, *, separator: str = " ", seed: int = 1) -> DataFrame:
    """n lines with a random value per field type, in order."""
    h = lambda k: F.xxhash64("id", F.lit(seed), F.lit(k))
    make = {
        "ip": lambda k: F.concat_ws(".", *[F.pmod(h(k * 8 + j), F.lit(254)).cast("string") for j in range(4)]),
        "digit": lambda k: F.pmod(h(k), F.lit(100_000)).cast("string"),
        "float": lambda k: F.format_number(F.pmod(h(k), F.lit(10_000)) / 100.0, "0.00"),
        "time": lambda k: F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(h(k), F.lit(86_400))), "yyyy-MM-dd HH:mm:ss"),
        "chars": lambda k: F.substring(F.hex(h(k)), 1, 8),
    }
    parts = [make.get(kind, make["chars"])(k) for k, kind in enumerate(fields.values())]
    return spark.range(n).select(F.col("id").alias("event_id"), F.lit("rule").alias("src_key"), F.concat_ws(separator, *parts).alias("raw"))
