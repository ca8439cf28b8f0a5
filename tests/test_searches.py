"""Searches around places: answers of the geocoder, refusals, listings of many searches at once."""

import json
import random
from math import asin, cos, radians, sin, sqrt

from caretrail.operators.searches import INCOMPLETE, SEARCH_FAILED, located_searches, search_metadata, searched_listings
from caretrail.operators.places import EARTH_RADIUS, NO_GEOCODE
from caretrail.sources import read_geocodes

SEARCH = "requestId string, location string, businessType string, minRating double, radius int"
STATE, TOWN = [{"types": ["administrative_area_level_1", "political"]}], [{"types": ["locality"]}]


def answer(place, status="OK", at=(34.5, -78.5), components=TOWN, **more):
    result = {"formatted_address": f"{place}, USA", "geometry": {"location": at and dict(zip(("lat", "lng"), at))}}
    if components is not None:
        result["address_components"] = components
    return json.dumps({"place": place, "status": status, "results": [result], **more})


def test_answers_and_refusals(spark, tmp_path):
    lines = [
        answer("town"), answer("state", components=STATE), answer("both", components=STATE + TOWN),
        answer("nothing", "ZERO_RESULTS", results=[]), answer("refused", "REQUEST_DENIED"), answer("nowhere", at=None),
        answer("bare", components=None), answer("untyped", components=[{}]), answer("empty", components=[]),
        answer("null", results=None), answer("twice", "OVER_QUERY_LIMIT"), answer("twice", at=(1.0, 2.0)), "{broken",
        json.dumps({"status": "OK"})]
    (tmp_path / "a.json").write_text("\n".join(lines))
    geocodes = read_geocodes(spark, str(tmp_path))
    assert geocodes.count() == 12
    places = ["town", "state", "both", "nothing", "refused", "nowhere", "bare", "untyped", "empty", "null", "twice", "unknown"]
    rows = [(p, p, "clinic", None, None) for p in places]
    rows += [("a", "", "clinic", None, None), ("b", "town", None, None, None), ("c", None, "", None, None),
             ("d", "town", "x", 2.0, 900), ("town", "town", "clinic", None, None)]
    good, bad = located_searches(spark.createDataFrame(rows, SEARCH), geocodes)
    shown = sorted((r.requestId, r.location, tuple(r.coordinates), r.radius, r.isStateSearch)
                   for r in search_metadata(good).collect())
    here = (34.5, -78.5)
    assert shown == [
        ("both", "both, USA", here, 50_000, False), ("d", "town, USA", here, 900, False),
        ("empty", "empty, USA", here, 50_000, False), ("state", "state, USA", here, 50_000, True),
        ("town", "town, USA", here, 50_000, False), ("town", "town, USA", here, 50_000, False),
        ("twice", "twice, USA", (1.0, 2.0), 50_000, False)]
    assert {r.requestId: r.reason for r in bad.collect()} == {
        **dict.fromkeys(["nothing", "refused", "nowhere", "null", "unknown"], NO_GEOCODE),
        **dict.fromkeys(["bare", "untyped"], SEARCH_FAILED), **dict.fromkeys("abc", INCOMPLETE)}


def test_listings_against_all_pairs(spark):
    rng = random.Random(4)
    spots = [(89.95, 10.0), (-89.5, 170.0), (0.0, 179.99), (10.0, -180.0), (51.0, 0.0), (60.0, 90.0)]

    def around(lat, lng, by):
        lat = max(-90.0, min(90.0, lat + rng.uniform(-by, by)))
        return lat, (lng + rng.uniform(-by, by) / max(cos(radians(lat)), 0.01) + 180) % 360 - 180

    listings = [(f"l{i}", "Clinic" if i % 3 else "Shop", "Doctor" if i % 2 else None, None if i % 11 == 0 else i % 5 * 1.0,
                 *around(*rng.choice(spots), 1.5)) for i in range(600)]
    listings += [("none", "Clinic", None, 4.0, None, 0.0), ("edge", "Clinic", None, 4.0, 0.0, 180.0)]
    searches = [(f"s{i}", rng.choice(["CLINIC", "doc", "shop"]), rng.choice([0.0, 2.0]),
                 rng.choice([0.0, 3_000.0, 50_000.0, 300_000.0, 25_000_000.0]), *around(*spots[i % 6], 0.5)) for i in range(60)]

    def metres(a, o, b, p):
        h = sin(radians(b - a) / 2) ** 2 + cos(radians(a)) * cos(radians(b)) * sin(radians(p - o) / 2) ** 2
        return 2 * EARTH_RADIUS * asin(sqrt(min(h, 1.0)))

    want = sorted((s, x) for s, word, least, radius, a, o in searches for x, name, kind, rating, b, p in listings
                  if b is not None and rating is not None and rating >= least and metres(a, o, b, p) <= radius
                  and (word.lower() in name.lower() or word.lower() in (kind or "").lower()))
    df = spark.createDataFrame(searches, "requestId string, businessType string, minRating double, radius double, lat double, lng double")
    places = spark.createDataFrame(listings, "place_id string, name string, primary_type string, rating double, lat double, lng double")
    found = searched_listings(df, places)
    assert sorted((r.requestId, r.place_id) for r in found.collect()) == want and len(want) > 1_000
    assert found.columns == ["requestId", *places.columns, "distance"]
    assert searched_listings(df.limit(0), places).count() == 0


def test_crowded_place_is_met_by_keyword_in_small_cells(spark):
    """Searches of one degree: only listings that hold the keyword, in cells as small as the circles, meet a search."""
    df = spark.range(40).selectExpr(
        "concat('s', id) AS requestId", "concat('word', id % 8) AS businessType", "0.0D AS minRating", "2000.0D AS radius",
        "34.01D + id * 0.02D AS lat", "-78.01D - id * 0.02D AS lng")
    places = spark.range(400).selectExpr(
        "concat('p', id) AS place_id", "concat('A word', id % 8, ' word', id % 8) AS name", "CAST(NULL AS STRING) AS primary_type",
        "3.0D AS rating", "34.01D + id DIV 10 * 0.02D AS lat", "-78.01D - id DIV 10 * 0.02D AS lng")
    found = searched_listings(df, places.unionByName(places.where("place_id = 'p0'")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_word" in plan.replace("\n", " ")
    hits = sorted((r.requestId, r.place_id) for r in found.collect())
    want = [(f"s{i}", f"p{j}") for i in range(40) for j in range(400) if i == j // 10 and i % 8 == j % 8]
    assert hits == sorted([*want, ("s0", "p0")])
