"""Change requests: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The body stays text here: a missing key and a null differ in it, and a struct would lose that.
REQUEST_SCHEMA = "requestId STRING, seq BIGINT, id STRING, body STRING"
CORRUPT = "_corrupt_record"


def read_requests(spark: SparkSession, path: str, schema: str = REQUEST_SCHEMA) -> DataFrame:
    """Requests with an explicit schema; the raw text of a line that is not JSON is in ``_corrupt_record``."""
    return (
        spark.read.schema(f"{schema}, {CORRUPT} STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def rejected_lines(spark: SparkSession, path: str, schema: str = REQUEST_SCHEMA) -> DataFrame:
    """The lines kept aside. Read as text: the JSON reader refuses to give the corrupt column alone."""
    parsed = F.from_json("value", f"{schema}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT})
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(parsed[CORRUPT].isNotNull()).select(F.col("value").alias("line"))
