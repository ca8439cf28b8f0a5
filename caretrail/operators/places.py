"""Place listings: details, surroundings, the clinic a city belongs to."""

from __future__ import annotations

from math import cos, degrees, radians

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrail.operators.joins import rekeyed

EARTH_RADIUS = 6_371_000.0
RADIUS = 50_000
NO_GEOCODE = "Failed to geocode location"


def enrich_listings(places: DataFrame, details: DataFrame) -> DataFrame:
    """Listings with their detail record (place_id, status, result); the shown values come from the detail."""
    found = details.select("place_id", "status", "result")
    return places.select("place_id").join(found, "place_id").select(
        F.col("place_id").alias("id"),
        "status",
        F.col("result.name").alias("name"),
        F.col("result.formatted_address").alias("address"),
        F.col("result.location").alias("location"),
        F.col("result.rating").alias("rating"),
        F.col("result.user_ratings_total").alias("userRatingsTotal"),
        F.col("result.formatted_phone_number").alias("phone"),
        F.col("result.website").alias("website"),
        F.col("result.types").alias("types"),
    )


def match_clinic(df: DataFrame, clinics: DataFrame, city_col: str) -> DataFrame:
    """``df`` with ``clinicLocationId``: the first active clinic, by name, whose name is part of the city.

    Containment is turned into equality: each distinct city, in lower case, is cut into its pieces of the lengths that
    clinic names have, and pieces meet names in a hash join. So no pair of city and clinic is tried, nothing is fetched,
    and the work per city is its length times the number of different name lengths. A clinic with an empty name is part
    of every city but an empty one.
    """
    names = clinics.where(F.col("isActive")).select("id", "name", F.lower("name").alias("_piece"))
    kept = df.drop("clinicLocationId")
    lengths = F.coalesce(names.agg(F.collect_set(F.length("_piece"))).scalar(), F.array().cast("array<int>"))
    cities = kept.where(F.col(city_col) != "").select(F.col(city_col).alias("_city")).distinct().select(
        "_city", F.lower("_city").alias("_lower"))
    sizes = cities.select("_city", "_lower", F.explode(lengths).alias("_n")).where(F.col("_n") <= F.length("_lower"))
    last = F.when(F.col("_n") == 0, F.lit(1)).otherwise(F.length("_lower") - F.col("_n") + 1)
    pieces = sizes.select("_city", "_lower", "_n", F.explode(F.sequence(F.lit(1), last)).alias("_at")).select(
        "_city", F.substring("_lower", F.col("_at"), F.col("_n")).alias("_piece"))
    # an outer join, so that only the names may be broadcast: the pieces are many more than their plan suggests
    first = (
        pieces.join(names, "_piece", "left")
        .groupBy("_city")
        .agg(F.min_by("id", F.when(F.col("id").isNotNull(), F.struct("name", "id"))).alias("clinicLocationId"))
    )
    first = rekeyed(first, "_city")
    return kept.join(first, kept[city_col] == first["_city"], "left").drop("_city")


def places_near(
    listings: DataFrame, gazetteer: DataFrame, location: str, keyword: str, radius: float = RADIUS
) -> DataFrame:
    """Listings within ``radius`` metres of a named place that mention the keyword, with their distance.

    The place is looked up first (one row), so its box of latitudes and longitudes reaches the scan as plain numbers
    and whole files are skipped; the exact distance is computed for what is left.
    """
    here = gazetteer.where(F.col("place") == location).select("lat", "lng").orderBy("lat", "lng").first()
    if here is None:
        raise LookupError(NO_GEOCODE)
    lat, lng = here
    reach = degrees(radius / EARTH_RADIUS)
    near = F.col("lat").between(lat - reach, lat + reach)
    if abs(lat) + reach < 89.9:
        width = reach / cos(radians(abs(lat) + reach))
        west, east = lng - width, lng + width
        inside = F.col("lng").between(west, east)
        if west < -180:
            inside |= F.col("lng") >= west + 360
        if east > 180:
            inside |= F.col("lng") <= east - 360
        near &= inside
    dlat, dlng = F.radians(F.col("lat") - lat) / 2, F.radians(F.col("lng") - lng) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians("lat")) * cos(radians(lat)) * F.pow(F.sin(dlng), 2)
    distance = F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    wanted = F.lower(F.lit(keyword))
    mentions = F.lower("name").contains(wanted) | F.coalesce(
        F.lower("primary_type").contains(wanted), F.lit(False)
    )
    return listings.where(near & mentions).withColumn("distance", distance).where(F.col("distance") <= radius)
