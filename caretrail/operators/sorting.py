"""Sorts, limits, top-k. The last sort key is unique, so equal dates cannot change a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrail.functions.text import address_line
from caretrail.operators.aggregates import campaign_recipient_counts
from caretrail.operators.joins import interactions_enriched

SORT_FIELDS = ("name", "clinicLocation", "address", "expectedMonthlyReferrals", "numberOfProviders")


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("createdAt"), "id")


def latest_interactions(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("date"), "id")


def clinics_by_name(df: DataFrame) -> DataFrame:
    return df.orderBy("name", "id")


def limit_interactions(df: DataFrame, n: int | None = None) -> DataFrame:
    """The first ``n`` of the list; all of it without ``n``."""
    ordered = latest_interactions(df)
    return ordered.limit(n) if n else ordered


def sort_sources(df: DataFrame, field: str = "name", direction: str = "asc") -> DataFrame:
    """User sort of the source list (see :func:`sources_enriched`); null counts as '' or 0, ties stay newest first."""
    text = F.lit("")
    if field == "clinicLocation":
        key = F.coalesce(F.col("clinicLocation.name"), text)
    elif field == "address":
        key = address_line("address", "city")
    elif field in ("expectedMonthlyReferrals", "numberOfProviders"):
        key = F.coalesce(F.col(field), F.lit(0))
    else:
        key = F.coalesce(F.col("name"), text)
    return df.orderBy(key.asc() if direction == "asc" else key.desc(), F.desc("createdAt"), "id")


def recent_interactions(inter: DataFrame, src: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` latest, with their source's name. Cut first: only ``k`` rows meet the sources, as the broadcast side.

    The closing limit drops nothing; with it the order is kept by a top-k instead of a range exchange.
    """
    return limit_interactions(interactions_enriched(limit_interactions(inter, k), src), k)


def recent_campaigns(camp: DataFrame, link: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` newest with their number of recipients. Links are narrowed to those ``k`` before they are counted."""
    newest = newest_first(camp).limit(k)
    ids = newest.select(F.col("id").alias("campaignId"))
    counted = campaign_recipient_counts(newest, link.select("campaignId").join(ids, "campaignId"))
    return newest_first(counted).limit(k)
