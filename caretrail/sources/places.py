"""Place search pages and geocoder answers as the remote services return them, one JSON object per page or answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = """
    status STRING,
    next_page_token STRING,
    results ARRAY<STRUCT<
        place_id: STRING, name: STRING, formatted_address: STRING, rating: DOUBLE, user_ratings_total: INT,
        types: ARRAY<STRING>, geometry: STRUCT<location: STRUCT<lat: DOUBLE, lng: DOUBLE>>>>
"""

# the geocoder's answer, with the place it was asked for
GEOCODE_SCHEMA = """
    place STRING,
    status STRING,
    results ARRAY<STRUCT<
        formatted_address: STRING, address_components: ARRAY<STRUCT<types: ARRAY<STRING>>>,
        geometry: STRUCT<location: STRUCT<lat: DOUBLE, lng: DOUBLE>>>>
"""

# Page states that are not errors.
GOOD_PAGES = ("OK", "ZERO_RESULTS")


def _pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).json(path)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """One row per listing of every good page."""
    return (
        _pages(spark, path)
        .where(F.col("status").isin(*GOOD_PAGES))
        .select("next_page_token", F.explode("results").alias("r"))
        .select(
            "r.place_id", "r.name", "r.formatted_address", "r.rating", "r.user_ratings_total", "r.types",
            F.col("r.geometry.location").alias("location"),
            F.col("r.geometry.location.lat").alias("lat"),
            F.col("r.geometry.location.lng").alias("lng"),
            "next_page_token",
        )
    )


def place_page_errors(spark: SparkSession, path: str) -> DataFrame:
    """Pages the service refused, with the message shown for them."""
    status = F.coalesce(F.col("status"), F.lit("undefined"))
    return (
        _pages(spark, path)
        .where(~status.isin(*GOOD_PAGES))
        .select(F.concat(F.lit("Failed to search businesses: "), status).alias("reason"))
    )


def read_geocodes(spark: SparkSession, path: str) -> DataFrame:
    """place, status and of the first result address, components, lat, lng, for every answer that names its place.

    ``found`` is true if the answer is good and has a location. Lines that are no JSON have no place, so they are left out.
    """
    first = F.get("results", F.lit(0))
    at = first["geometry"]["location"]
    return spark.read.schema(GEOCODE_SCHEMA).json(path).where(F.col("place").isNotNull()).select(
        "place",
        "status",
        first["formatted_address"].alias("formatted_address"),
        first["address_components"].alias("components"),
        at["lat"].alias("lat"),
        at["lng"].alias("lng"),
        (F.coalesce(F.col("status") == "OK", F.lit(False)) & at["lat"].isNotNull() & at["lng"].isNotNull()).alias("found"),
    )
