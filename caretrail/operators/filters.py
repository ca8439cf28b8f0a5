"""Filters, predicates, projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.functions.defaults import col, is_missing

NO_FAX = "No fax number provided"
NO_DOCUMENT = "Campaign does not have a document to send"


def interactions_of(df: DataFrame, source_id: str | None = None) -> DataFrame:
    """Interactions of one source; all of them without an id."""
    return df.where(F.col("referralSourceId") == source_id) if source_id else df


def active_clinics(df: DataFrame) -> DataFrame:
    return df.where(F.col("isActive"))


def sources_of_clinic(df: DataFrame, clinic_id: str | None = None) -> DataFrame:
    """Sources of one clinic; all of them without an id."""
    return df.where(F.col("clinicLocationId") == clinic_id) if clinic_id else df


def search_sources(df: DataFrame, query: str | None) -> DataFrame:
    """The query, in any case, is part of the name or of the contact person."""
    if not query:
        return df
    wanted = F.lower(F.lit(query))
    contact = F.coalesce(F.lower(F.col("contactPerson")).contains(wanted), F.lit(False))
    return df.where(F.lower(F.col("name")).contains(wanted) | contact)


def campaign_candidates(df: DataFrame, clinic_id: str | None = None, query: str | None = None) -> DataFrame:
    return search_sources(sources_of_clinic(df, clinic_id), query)


def project_relation(df: DataFrame, cols: Sequence[str], into: str | None = None) -> DataFrame:
    """Only the named columns, on request as one struct column."""
    return df.select(F.struct(*cols).alias(into)) if into else df.select(*cols)


def min_rating(df: DataFrame, r: float = 0) -> DataFrame:
    """Rows rated at least ``r``; unrated ones never pass."""
    return df.where(F.col("rating") >= r)


def is_state_search(components: Column | str) -> Column:
    """The place is a whole state: it names one, and neither a town nor a zip code."""

    def some(kind: str) -> Column:
        return F.exists(col(components), lambda c: F.array_contains(c["types"], kind))

    return some("administrative_area_level_1") & ~(some("locality") | some("postal_code"))


def valid_details(df: DataFrame) -> DataFrame:
    """Listings whose detail record was answered."""
    return df.where(F.col("status") == "OK")


def split_sendable(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(with a fax number, without one and the reason)."""
    missing = is_missing("faxNumber")
    return links.where(~missing), links.where(missing).withColumn("error", F.lit(NO_FAX))


def has_document(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(campaigns with a document, the others and the reason)."""
    missing = is_missing("documentUrl")
    return df.where(~missing), df.where(missing).withColumn("reason", F.lit(NO_DOCUMENT))
