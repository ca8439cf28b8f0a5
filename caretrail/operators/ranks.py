"""Places of rows in an order over a whole table, worked out by ranges of it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caretrail.session import shared_folder


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``_pos``: the row's place from 0 in ascending order of the columns ``order``, nulls first, gapless.

    Each task sorts one range of rows and writes it down in the shared folder, so that places no longer depend on how a
    range was computed; the sizes of the ranges before are added when it is read. Their table has a row for each range,
    which is what bounds its broadcast.
    """
    path = shared_folder(df.sparkSession, f"numbered-{uuid.uuid4().hex}")
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges.withColumn("_at", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    rows = df.sparkSession.read.schema(df.schema.add("_at", "long")).parquet(path)
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("_part")).count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return rows.join(F.broadcast(before), part == F.col("_part")).select(*df.columns, (F.col("_before") + at).alias("_pos"))
