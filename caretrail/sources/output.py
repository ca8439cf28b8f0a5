"""Results as nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame


# How moments are written for the pages, UTC with milliseconds.
MOMENT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def write_json(df: DataFrame, path: str) -> None:
    """One object per row; null fields are written, as the pages expect every key."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    writer.option("timestampNTZFormat", MOMENT_FORMAT).json(path)
