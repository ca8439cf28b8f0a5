"""Catalog of uploaded documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caretrail.functions.text import base_name, file_ext


def document_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Path, name, extension, size, stored name and URL of each file; file contents are not read. Spark leaves out empty files.

    The stored name is a hash of path and time (in microseconds since 1970) in the form of a UUID: unique, and the same on
    every run, whatever the session's time zone.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    digest = F.sha2(F.concat_ws("/", "path", F.unix_micros("modificationTime").cast("string")), 256)
    uuid = F.concat_ws("-", *[F.substring(digest, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    name = base_name(F.try_url_decode(F.col("path")))
    stored = F.concat(uuid, F.lit("."), file_ext(name))
    return files.select(
        "path",
        name.alias("originalName"),
        file_ext(name).alias("extension"),
        F.col("length").alias("size"),
        stored.alias("storedName"),
        F.concat(F.lit("/uploads/"), stored).alias("url"),
    )
