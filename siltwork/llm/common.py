"""Shared plumbing of the training-data operators: the shared scratch folder and Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_CLEARED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir`` as the session names it.

    Where that is unset, the context's checkpoint folder; in local mode only (tests) a temporary
    folder, removed at exit.  On a cluster without either this raises.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="siltwork-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[app] = folder
    return f"file://{_LOCAL[app]}"


def _clear(spark: SparkSession, folder: str) -> None:
    """At exit: the tables that returned DataFrames read are of no more use; a JVM that is gone left them to the folder's owner."""
    try:
        remove_path(spark, folder)
    except Exception:
        pass


def scratch_path(spark: SparkSession, label: str) -> str:
    folder = f"{shared_folder(spark)}/siltwork-{spark.sparkContext.applicationId}"
    if folder not in _CLEARED:
        _CLEARED.add(folder)
        atexit.register(_clear, spark, folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through the Hadoop file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written once to the shared folder; ``drop`` removes those that no later read needs.

    A written table cuts the lineage, survives lost executors and gives the planner true sizes.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def save(self, name: str, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, f"{self.label}-{name}")
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove_path(self.spark, self.paths.pop(name))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))




def record(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
