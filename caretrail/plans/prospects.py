"""Prospect import: listings of a search become referral sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrail.functions.defaults import null_if_empty
from caretrail.functions.text import import_note, parse_address
from caretrail.operators.filters import min_rating, valid_details
from caretrail.operators.places import enrich_listings, match_clinic
from caretrail.plans.change import Change
from caretrail.plans.creates import insert_sources


def search_results(places: DataFrame, details: DataFrame, rating: float = 0) -> DataFrame:
    """Listings of at least the given rating, with their answered detail record."""
    return valid_details(enrich_listings(min_rating(places, rating), details)).drop("status")


def import_rows(found: DataFrame, clinics: DataFrame) -> DataFrame:
    """Search results (id, name, address, rating, userRatingsTotal, phone, website, types) as rows to insert."""
    parsed = found.withColumn("_a", parse_address("address"))
    placed = match_clinic(
        parsed.select(
            F.concat(F.lit("place/"), "id").alias("requestId"),
            "name",
            *[F.col(f"_a.{k}").alias(k) for k in ("address", "city", "state", "zipCode")],
            null_if_empty("phone").alias("contactPhone"),
            null_if_empty("website").alias("website"),
            import_note("rating", "userRatingsTotal", "types").alias("notes"),
            # a listing without address or types cannot be imported
            (F.col("address").isNull() | F.col("types").isNull()).alias("_wrong"),
        ),
        clinics,
        "city",
    )
    return placed.withColumns({k: null_if_empty(k) for k in ("address", "city", "state", "zipCode")})


def import_prospects(
    places: DataFrame, details: DataFrame, clinics: DataFrame, src: DataFrame, as_of: datetime | str,
    rating: float = 0,
) -> Change:
    """Search results added to the sources. A listing makes one source: on a second page it counts once, stored it is refused."""
    return insert_sources(import_rows(search_results(places, details, rating), clinics), src, as_of)
