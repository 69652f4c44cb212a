"""Logs of one JSON object a line; lines that aren't are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
