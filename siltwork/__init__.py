"""Siltwork: a Spark-first log ETL engine (parse, transform, enrich, route) built on DataFrames."""

__version__ = "0.1.0"
