"""Bulk deletion. Requests are (requestId, id); ``delta`` of a result holds the ids that go."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrail.operators.aggregates import linked_counts
from caretrail.operators.joins import key_set, rekeyed
from caretrail.plans.change import Change, mark_known
from caretrail.plans.patches import CAMPAIGN_MISSING, CLINIC_MISSING, INTERACTION_MISSING, SOURCE_MISSING

SOURCE_FAILED = "Failed to delete referral source"


class LinkedDelete(NamedTuple):
    """Rows and their links, deleted together."""

    table: DataFrame
    links: DataFrame
    delta: DataFrame
    rejects: DataFrame


def _without(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    gone = rekeyed(ids.select(F.col("id").alias(key)), key)
    return table.join(gone, key, "left_anti").select(*table.columns)


def _ids(req: DataFrame, table: DataFrame) -> DataFrame:
    """Distinct ids asked for that are in the table. Repeats are dropped before anything moves."""
    return key_set(req, "id").join(table.select("id"), "id", "left_semi")


def missing(req: DataFrame, table: DataFrame, reason: str) -> DataFrame:
    marked = mark_known(req.select("requestId", "id"), table, "id", "_known")
    return marked.where(~F.col("_known")).select("requestId", F.lit(reason).alias("reason"))


def delete_interactions(req: DataFrame, inter: DataFrame) -> Change:
    ids = _ids(req, inter)
    return Change(_without(inter, ids), ids, missing(req, inter, INTERACTION_MISSING))


def delete_campaigns(req: DataFrame, camp: DataFrame, link: DataFrame) -> LinkedDelete:
    """Campaigns with all their links."""
    ids = _ids(req, camp)
    return LinkedDelete(
        _without(camp, ids), _without(link, ids, "campaignId"), ids, missing(req, camp, CAMPAIGN_MISSING)
    )


def delete_sources(req: DataFrame, src: DataFrame, link: DataFrame, inter: DataFrame) -> LinkedDelete:
    """Sources with their links; one that has interactions is refused, and then nothing of it is removed."""
    known = _ids(req, src)
    used = known.join(key_set(inter, F.col("referralSourceId").alias("id")), "id", "left_semi")
    ids = known.join(used, "id", "left_anti")
    refused = req.select("requestId", "id").join(rekeyed(used, "id"), "id", "left_semi")
    rejects = missing(req, src, SOURCE_MISSING).unionByName(
        refused.select("requestId", F.lit(SOURCE_FAILED).alias("reason"))
    )
    return LinkedDelete(_without(src, ids), _without(link, ids, "referralSourceId"), ids, rejects)


def delete_clinics(req: DataFrame, clinic: DataFrame, src: DataFrame) -> Change:
    """Clinics no source belongs to; the others are refused with the number of their sources."""
    counts = linked_counts(clinic, src, "clinicLocationId")
    ids = _ids(req, clinic).join(counts, "id", "left_anti")
    refusal = F.concat(
        F.lit("Cannot delete clinic location. "), F.col("count").cast("string"),
        F.lit(" referral source(s) are linked to this location."),
    )
    refused = req.select("requestId", "id").join(rekeyed(counts, "id"), "id").select("requestId", refusal.alias("reason"))
    return Change(_without(clinic, ids), ids, missing(req, clinic, CLINIC_MISSING).unionByName(refused))
