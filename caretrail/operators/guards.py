"""Guards before a change: rows split into those that may go on and those that may not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrail.operators.joins import rekeyed

DUPLICATE_CLINIC = "A clinic location with this name already exists"


def guard_exists(req: DataFrame, table: DataFrame, on: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(requests whose key is in the table, the others); ``on`` is a key of the table."""
    on = [on] if isinstance(on, str) else on
    keys = table.select(*on)
    return req.join(keys, on, "left_semi"), req.join(keys, on, "left_anti")


def flag_duplicate_name(req: DataFrame, clinic: DataFrame) -> DataFrame:
    """``req`` (requestId, seq, id?, name) with ``duplicate``: the name belongs to another clinic already, or an
    earlier request of the batch takes it. ``id`` is null for a new clinic; a clinic may keep its own name.

    What a name's fate depends on is worked out per name, from rows combined before they move; only then do the
    requests meet it, so a name asked for very often can be split.
    """
    asked = req if "id" in req.columns else req.withColumn("id", F.lit(None).cast("string"))
    owners = clinic.select("name", F.col("id").alias("_owner"))
    firsts = asked.where(F.col("name").isNotNull()).groupBy("name").agg(
        F.min_by(F.struct("requestId", "id"), F.struct("seq", "requestId")).alias("_first")
    )
    fate = rekeyed(firsts.join(owners, "name", "left"), "name")
    own = F.coalesce(F.col("_owner") == F.col("id"), F.lit(False))
    first = (F.col("_first.requestId") == F.col("requestId")) | F.coalesce(F.col("_first.id") == F.col("id"), F.lit(False))
    duplicate = F.when(F.col("_owner").isNotNull(), ~own).otherwise(F.coalesce(~first, F.lit(False)))
    return asked.join(fate, "name", "left").select(*req.columns, duplicate.alias("duplicate"))


def guard_unique_name(req: DataFrame, clinic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with a free name, the duplicates)."""
    flagged = flag_duplicate_name(req, clinic)
    return (
        flagged.where(~F.col("duplicate")).drop("duplicate"),
        flagged.where(F.col("duplicate")).drop("duplicate"),
    )
