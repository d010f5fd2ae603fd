"""Reference tables for lookups: CSV files described by a TOML file, or a database by JDBC.

``[[tables]]`` has name, dir, columns.by_header or columns.by_index, on_error (fail, skip) and
expected_rows (min, max); ``create.sql`` gives types and NOT NULL, ``insert.sql`` the order of the
columns.  A bad row, of too few columns or a value that does not convert, fails the load or is left out.
"""

from __future__ import annotations

import re
import tomllib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPES = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean"}


def columns_of(create: str) -> dict[str, tuple[str, bool]]:
    """Column name to (Spark type, NOT NULL) of a CREATE TABLE statement."""
    body = re.search(r"\((.*)\)", create, re.S)
    if not body:
        raise ValueError("create.sql has no column list")
    out = {}
    for item in re.split(r",(?![^()]*\))", body[1]):
        found = re.match(r"\s*(\w+)\s+(\w+)(.*)", item, re.S)
        if found and found[1].upper() not in ("PRIMARY", "UNIQUE", "FOREIGN", "CHECK", "CONSTRAINT"):
            out[found[1]] = _TYPES.get(found[2].upper(), "string"), "NOT NULL" in found[3].upper()
    return out


def inserted(insert: str) -> list[str]:
    """Columns that insert.sql fills, in the order of its parameters ?1, ?2, ..."""
    found = re.search(r"\(([^()]*)\)\s*VALUES\s*\(([^()]*)\)", insert, re.S | re.I)
    if not found:
        raise ValueError("insert.sql names no columns")
    names, places = ([x.strip() for x in part.split(",")] for part in found.groups())
    return [name for _, name in sorted(zip((int(p.lstrip("?")) for p in places), names))]


def load_table(spark: SparkSession, folder: str, create: str, insert: str, *, data_file: str = "data.csv", has_header: bool = True, by_header: list[str] | None = None, by_index: list[int] | None = None, on_error: str = "fail", expected: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """One table from its CSV file; columns that are not inserted are NULL."""
    kinds, names = columns_of(create), inserted(insert)
    lines = spark.read.option("header", has_header).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(f"{folder}/{data_file}")
    if not has_header and by_index is None:
        raise ValueError("a table without a header needs by_index")
    picked = [F.col(lines.columns[i]) for i in by_index] if by_index is not None else [F.col(f"`{c}`") for c in by_header or names]
    values: dict[str, Column] = dict(zip(names, picked))
    out = lines.select(*[values[n].alias(n) if n in values else F.lit(None).cast("string").alias(n) for n in kinds])
    bad = [F.col(n).isNotNull() & F.col(n).try_cast(kind).isNull() for n, (kind, _) in kinds.items() if kind != "string"]
    bad += [F.col(n).isNull() for n, (_, required) in kinds.items() if required and n in values]
    wrong = reduce(lambda a, b: a | b, bad) if bad else F.lit(False)
    good = out.where(~wrong).select(*[F.col(n).try_cast(kind).alias(n) for n, (kind, _) in kinds.items()])
    counts = out.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(wrong, 1)).alias("bad")).first()
    if counts["bad"] and on_error != "skip":
        raise ValueError(f"{folder}: {counts['bad']} bad rows")
    n, (least, most) = counts["all"] - counts["bad"], expected
    if (least is not None and n < least) or (most is not None and n > most):
        raise ValueError(f"{folder}: {n} rows, expected {least} to {most}")
    return good


def load_tables(spark: SparkSession, config: str, read=None) -> dict[str, DataFrame]:
    """All tables that a TOML description lists; ``read`` gives a file's text (by default through Spark)."""
    read = read or (lambda path: spark.read.option("wholetext", True).text(path).first()[0])
    spec = tomllib.loads(read(config))
    base = spec.get("base_dir", ".")
    base = base if re.match(r"\w+:|/", base) else f"{config.rpartition('/')[0]}/{base.removeprefix('./')}".rstrip("./")
    out = {}
    for t in spec.get("tables", ()):
        folder, columns, rows = f"{base}/{t.get('dir', t['name'])}", t.get("columns", {}), t.get("expected_rows", {})
        out[t["name"]] = load_table(
            spark, folder, read(f"{folder}/create.sql"), read(f"{folder}/insert.sql"), data_file=t.get("data_file", "data.csv"), has_header=t.get("has_header", True),
            by_header=columns.get("by_header"), by_index=columns.get("by_index"), on_error=t.get("on_error", "fail"), expected=(rows.get("min"), rows.get("max")),
        )
    return out


def jdbc_table(spark: SparkSession, url: str, table: str, *, key: str | None = None, bounds: tuple[int, int] = (0, 1), parts: int = 16, **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of a numeric key where one is named; filters are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key is not None:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()
