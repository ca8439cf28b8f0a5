"""Searches around places, any number at once: checks, geocoding, and the listings of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.functions.defaults import is_missing
from caretrail.operators.filters import is_state_search
from caretrail.operators.joins import rekeyed
from caretrail.operators.places import EARTH_RADIUS, NO_GEOCODE, RADIUS

# The messages of refused searches.
INCOMPLETE = "Location and business type are required"
SEARCH_FAILED = "Failed to search businesses"

NEAR_POLE = 89.9  # degrees: beyond, a circle holds every longitude
MIN_LEVEL, MAX_LEVEL = -8, 4  # exponents of the smallest and largest cells, in degrees
MARGIN = 1e-6  # degrees: more than rounding can move a box's edge


def located_searches(searches: DataFrame, geocodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(searches with their place, refused ones with the reason).

    ``searches``: requestId, location, businessType, minRating, radius; the last two may be null and are then 0 and
    50,000 metres. ``geocodes`` is what :func:`caretrail.sources.read_geocodes` gives; of several answers for a place a
    good one counts, the first by content. An answer without address components, or with one without types, fails.
    Searches for one place may be many: they are on the left, where adaptive execution can split them.
    """
    answer = F.min(F.struct(
        (~F.col("found")).alias("lost"), "formatted_address", "components", "lat", "lng")).alias("answer")
    answers = rekeyed(geocodes.groupBy("place").agg(answer), "place")
    incomplete = is_missing("location") | is_missing("businessType")
    asked = searches.withColumn("_place", F.when(~incomplete, F.col("location")))
    known = asked.join(answers, F.col("_place") == F.col("place"), "left")
    parts = F.col("answer.components")
    broken = parts.isNull() | F.exists(parts, lambda c: c["types"].isNull())
    reason = (
        F.when(F.col("_place").isNull(), INCOMPLETE)
        .when(F.coalesce("answer.lost", F.lit(True)), NO_GEOCODE)
        .when(broken, SEARCH_FAILED)
    )
    judged = known.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull()).select(
        "requestId", "businessType",
        F.coalesce("minRating", F.lit(0.0)).alias("minRating"),
        F.coalesce("radius", F.lit(RADIUS)).cast("double").alias("radius"),
        F.col("answer.formatted_address").alias("location"),
        F.col("answer.lat").alias("lat"), F.col("answer.lng").alias("lng"),
        is_state_search(parts).alias("isStateSearch"))
    return good, judged.where(F.col("reason").isNotNull()).select("requestId", "reason")


def search_metadata(located: DataFrame) -> DataFrame:
    """What is shown about each search: location, coordinates, radius in whole metres, whether it is for a state."""
    return located.select(
        "requestId", "location", F.struct("lat", "lng").alias("coordinates"),
        F.floor("radius").cast("int").alias("radius"), "isStateSearch")


def distance(lat: Column, lng: Column, to_lat: Column, to_lng: Column) -> Column:
    """Metres between two points on the sphere."""
    dlat, dlng = F.radians(to_lat - lat) / 2, F.radians(to_lng - lng) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(to_lat)) * F.pow(F.sin(dlng), 2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _level(reach: Column) -> Column:
    """Exponent of the cells' size for circles of that many degrees: four to eight cells across, 1/256 to 16 degrees."""
    fits = F.floor(F.log2(F.greatest(reach, F.lit(1e-9)))) - 1
    return F.least(F.greatest(fits, F.lit(MIN_LEVEL)), F.lit(MAX_LEVEL)).cast("int")


def _size(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _columns_of(row: Column, level: Column) -> Column:
    """Number of cells around the globe in a row: as wide as high where the row is widest, fewer towards the poles."""
    edge = F.least(F.when(row >= 0, row).otherwise(-row - 1) * _size(level), F.lit(90.0))
    return F.greatest(F.ceil(F.lit(360.0) / _size(level) * F.cos(F.radians(edge))), F.lit(1))


def _column_at(lng: Column, row: Column, level: Column) -> Column:
    return F.floor((lng + 180) / 360 * _columns_of(row, level))


def _cells(located: DataFrame) -> DataFrame:
    """Every search once for each cell that its circle's box touches, with the cells' ``_level``, row and column."""
    reach = F.degrees(F.col("radius") / EARTH_RADIUS)
    polar = F.abs("lat") + reach >= NEAR_POLE
    ratio = F.sin(F.least(F.radians(reach), F.lit(1.5))) / F.cos(F.radians("lat"))
    width = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + MARGIN)
    level, row = F.col("_level"), F.col("_row")
    rows = F.sequence(F.floor(F.greatest(F.col("lat") - reach - MARGIN, F.lit(-90.0)) / _size(level)),
                      F.floor(F.least(F.col("lat") + reach + MARGIN, F.lit(90.0)) / _size(level)))
    west = _column_at(F.col("lng") - width, row, level)
    east = _column_at(F.col("lng") + width, row, level)
    columns = F.sequence(west, F.least(east, west + _columns_of(row, level) - 1))
    return located.where(F.col("radius") >= 0).withColumn("_level", _level(reach)).withColumn("_row", F.explode(rows)).withColumn(
        "_at", F.explode(columns)).withColumn("_column", F.pmod(F.col("_at"), _columns_of(row, level))).drop("_at")


def _pieces(text: Column, lengths: Column) -> Column:
    """The pieces of a text that have these lengths; none of null."""
    return F.coalesce(F.flatten(F.transform(
        F.filter(lengths, lambda n: n <= F.length(text)),
        lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda at: F.substring(text, at, n)))),
        F.array().cast("array<string>"))


def searched_listings(located: DataFrame, listings: DataFrame) -> DataFrame:
    """requestId, minRating's and keyword's listings within each search's radius, and their distance in metres.

    Circles and keywords become equal keys. Listings are cut into their pieces of the lengths that keywords have, and
    those that hold a keyword lie in one cell of each size its searches use; a search is sent to the cells of its box,
    which are as large as its radius asks, so their number is bounded at any radius and latitude. Both meet in a hash join:
    a search is tried only against listings near it that hold its keyword, and crowded places are spread over many keys.
    Listings without coordinates or rating are in no search. Listings are on the left, where adaptive execution can split
    a crowded cell.

    The keywords are broadcast (each distinct one once, with the sizes its searches use), as the pieces are many more than
    their plan suggests; for the same reason neither side of the join by cells may be.
    """
    asked = _cells(located.where(F.col("businessType").isNotNull()).select(
        "requestId", "minRating", "radius", F.lower("businessType").alias("_word"), "lat", "lng"))
    asked = asked.select(
        "requestId", "_word", "_level", "_row", "_column", "minRating", "radius",
        F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    reach = F.degrees(F.col("radius") / EARTH_RADIUS)
    words = located.where(F.col("businessType").isNotNull()).groupBy(F.lower("businessType").alias("_word")).agg(
        F.collect_set(_level(reach)).alias("_levels"))
    lengths = F.coalesce(words.agg(F.collect_set(F.length("_word"))).scalar(), F.array().cast("array<int>"))
    texts = [_pieces(F.lower(c), F.col("_lengths")) for c in ("name", "primary_type")]
    there = (
        listings.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("rating").isNotNull())
        .withColumn("_lengths", lengths)
        .select(*listings.columns, F.explode(F.array_distinct(F.concat(*texts))).alias("_word"))
        .join(F.broadcast(words), "_word")
        .select(*listings.columns, "_word", F.explode("_levels").alias("_level"))
        .withColumn("_row", F.floor(F.col("lat") / _size(F.col("_level"))))
    )
    level, row = F.col("_level"), F.col("_row")
    there = there.withColumn("_column", F.pmod(_column_at(F.col("lng"), row, level), _columns_of(row, level)))
    met = there.join(asked.hint("merge"), ["_word", "_level", "_row", "_column"]).where(F.col("rating") >= F.col("minRating"))
    metres = distance(F.col("_lat"), F.col("_lng"), F.col("lat"), F.col("lng"))
    return met.withColumn("distance", metres).where(F.col("distance") <= F.col("radius")).select(
        "requestId", *listings.columns, "distance")
