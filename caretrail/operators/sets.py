"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrail.operators.joins import key_set
from caretrail.schemas import LINK_KEY


def append_pages(*pages: DataFrame) -> DataFrame:
    """All pages, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages)


def recipient_changes(current: DataFrame, requested: DataFrame) -> DataFrame:
    """Pairs of campaign and source with ``change``: add, remove or keep. One join; the pair is unique on both sides."""
    wanted = key_set(requested, *LINK_KEY).withColumn("_wanted", F.lit(True))
    have = current.select(*LINK_KEY, F.lit(True).alias("_have"))
    change = F.when(F.col("_have").isNull(), "add").when(F.col("_wanted").isNull(), "remove").otherwise("keep")
    return have.join(wanted, LINK_KEY, "full").select(*LINK_KEY, change.alias("change"))


def recipient_diff(current: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(to add, to remove, kept) for pairs of campaign and source."""
    changes = recipient_changes(current, requested)
    add, remove, keep = (changes.where(F.col("change") == c).drop("change") for c in ("add", "remove", "keep"))
    return add, remove, keep


def update_selection(
    selected: DataFrame, filtered: DataFrame, action: str, ids: DataFrame | None = None
) -> DataFrame:
    """Selected ids after ``all`` (the filtered set), ``clear`` (none) or ``toggle`` (each of ``ids`` in or out)."""
    if action == "all":
        return filtered.select("id")
    if action == "clear":
        return selected.select("id").limit(0)
    if action != "toggle":
        raise ValueError(f"unknown action {action!r}")
    toggled, chosen = key_set(ids, "id"), key_set(selected, "id")
    return chosen.join(toggled, "id", "left_anti").unionByName(toggled.join(chosen, "id", "left_anti"))
