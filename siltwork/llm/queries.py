"""The driver's thin queries over the operators of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siltwork.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltwork.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltwork.llm.leaks import contamination

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, _table(spark, sf_dir, "benchmark")).drop("text")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltwork.llm.html import extract

    return extract(_table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltwork.llm.warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages")).drop("archive")


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltwork.llm.vectors import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltwork.llm.near_duplicates import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltwork.llm.quality import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are files below their source; one whose source is the path of a licence file is that file.

    A licence file is named LICENSE, COPYING, NOTICE or UNLICENSE, with any ending, and lies in a
    directory, for which it speaks.  A source without a directory is the name of a collection, whose
    documents do not speak for each other.
    """
    from pyspark.sql import functions as F

    from siltwork.llm.licenses import licences

    names_file = F.col("source").rlike(r"(?i)[^/]/+(?:licen[cs]e|copying|notice|unlicense)(?:[-_.?#][^/]*)?$")
    below = F.concat_ws("/", "source", F.format_string("%d.txt", F.col("doc_id").cast("long")))
    path = F.when(names_file, F.col("source")).otherwise(below)
    files = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), path.alias("path"), "text")
    return licences(files).withColumnRenamed("id", "doc_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltwork.llm.pii import find_personal_data

    return find_personal_data(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))
