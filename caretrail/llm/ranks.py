"""Gapless numbers over a whole table in a given order, without a task that sees more than its range of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caretrail.llm.common import stored


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``_pos``, from 0 in ascending order of the columns ``order`` (nulls first).

    Rows are range-partitioned and sorted, their places within the partitions written down, and offset by the sizes of
    the partitions before; that table has a row for each partition, which bounds what is broadcast. A value that stands
    in many rows is split only as far as the rest of ``order`` tells its rows apart.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("_part")).count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return rows.join(F.broadcast(before), part == F.col("_part")).select(
        *df.columns, (F.col("_before") + at).alias("_pos"))
