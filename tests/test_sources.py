"""Files: snapshots and commits, requests, places, documents, JSON."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from caretrail.operators.filters import min_rating, valid_details
from caretrail.operators.places import enrich_listings, match_clinic, places_near
from caretrail.operators.sets import append_pages
from caretrail.plans.migration import seed_clinics
from caretrail.plans.prospects import import_prospects
from caretrail.schemas import TABLES
from caretrail.sources import (
    commit, document_catalog, lookup, place_page_errors, read_entity, read_places, read_requests, rejected_lines,
    table_paths, write_json, write_snapshot,
)

AS_OF = "2024-09-01 12:00:00"
CATEGORY = TABLES["referral_category"]


def categories(spark, *names):
    return spark.createDataFrame([(n, n, None, None, None) for n in names], CATEGORY)


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_snapshots_switch_and_keep_history(spark, tmp_path):
    root = str(tmp_path)
    assert read_entity(spark, root, "referral_category").count() == 0
    write_snapshot(categories(spark, "a"), root, "referral_category", 1)
    write_snapshot(categories(spark, "b", "c"), root, "referral_category", 2, cluster=True)
    assert names(read_entity(spark, root, "referral_category")) == ["b", "c"]
    assert names(read_entity(spark, root, "referral_category", version=1)) == ["a"]
    assert read_entity(spark, root, "referral_category").schema == CATEGORY


def test_a_new_version_may_be_made_from_the_current_one(spark, tmp_path):
    root = str(tmp_path)
    write_snapshot(categories(spark, "a"), root, "referral_category", 1)
    more = read_entity(spark, root, "referral_category").unionByName(categories(spark, "b"))
    write_snapshot(more, root, "referral_category", 2)
    assert names(read_entity(spark, root, "referral_category")) == ["a", "b"]


def test_append_adds_a_folder_only(spark, tmp_path):
    root = str(tmp_path)
    commit(spark, root, {"referral_category": categories(spark, "a")}, "t1")
    commit(spark, root, {"referral_category": categories(spark, "b")}, "t2", append=["referral_category"])
    assert table_paths(spark, root, "referral_category") == ["referral_category/t1", "referral_category/t2"]
    assert names(read_entity(spark, root, "referral_category")) == ["a", "b"]


def test_a_repeated_commit_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    for _ in range(2):
        version = commit(spark, root, {"referral_category": categories(spark, "a")}, "t1", append=["referral_category"])
    assert version == 1 and names(read_entity(spark, root, "referral_category")) == ["a"]


def test_a_failed_job_leaves_all_tables_as_they_were(spark, tmp_path):
    root = str(tmp_path)
    commit(spark, root, {"referral_category": categories(spark, "a"), "clinic_location": seed_clinics(spark, AS_OF)}, "t1")
    broken = categories(spark, "b").withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        commit(spark, root, {"clinic_location": seed_clinics(spark, AS_OF).limit(1), "referral_category": broken}, "t2")
    assert read_entity(spark, root, "clinic_location").count() == 5
    assert names(read_entity(spark, root, "referral_category")) == ["a"]
    commit(spark, root, {"clinic_location": seed_clinics(spark, AS_OF).limit(1), "referral_category": categories(spark, "b")}, "t2")
    assert read_entity(spark, root, "clinic_location").count() == 1


def test_lookup(spark):
    df = categories(spark, "a", "b", "c")
    keys = spark.createDataFrame([("a",), ("a",), ("z",)], "id string")
    assert names(lookup(df, keys, "id")) == ["a"]
    assert names(lookup(df, "b", "id")) == ["b"]


def test_requests_keep_malformed_lines_apart(spark, tmp_path):
    lines = ['{"requestId":"r1","seq":1,"id":"a","body":{"x":null,"y":[1]}}', "{oops", '{"requestId":"r2","seq":2,"body":{}}']
    (tmp_path / "req.json").write_text("\n".join(lines))
    rows = {r.requestId: r for r in read_requests(spark, str(tmp_path)).collect() if r.requestId}
    assert json.loads(rows["r1"].body) == {"x": None, "y": [1]} and rows["r2"].id is None
    assert [r.line for r in rejected_lines(spark, str(tmp_path)).collect()] == ["{oops"]


def page(status, *results, token=None):
    return json.dumps({"status": status, "next_page_token": token, "results": list(results), "html_attributions": []})


def listing(place, rating=None, lat=34.0, lng=-78.0):
    made = {"place_id": place, "name": place, "types": ["doctor"], "geometry": {"location": {"lat": lat, "lng": lng}}}
    return made if rating is None else {**made, "rating": rating}


def test_places_pages(spark, tmp_path):
    pages = [page("OK", listing("p1", 4.5), listing("p2"), token="t"), page("ZERO_RESULTS"), page("OVER_QUERY_LIMIT"),
             page("OK", listing("p1", 4.5), listing("p3", 0))]
    for n, text in enumerate(pages):
        (tmp_path / f"{n}.json").write_text(text)
    rows = read_places(spark, str(tmp_path))
    assert sorted(r.place_id for r in rows.collect()) == ["p1", "p1", "p2", "p3"]
    assert rows.where("place_id = 'p2'").select("lat", "location.lng", "next_page_token").first() == (34.0, -78.0, "t")
    assert sorted(r.place_id for r in min_rating(rows).collect()) == ["p1", "p1", "p3"], "unrated ones never pass"
    assert [r.reason for r in place_page_errors(spark, str(tmp_path)).collect()] == [
        "Failed to search businesses: OVER_QUERY_LIMIT"]
    assert append_pages(rows, rows).count() == 8


DETAIL = """place_id string, status string, result struct<name:string,formatted_address:string,rating:double,
    user_ratings_total:int,formatted_phone_number:string,website:string,types:array<string>,
    location:struct<lat:double,lng:double>>"""


def test_import_prospects(spark):
    def detail(place, address, status="OK", types=("doctor",)):
        return (place, status, (place.upper(), address, 4.0, 10, "", "", list(types) if types is not None else None, None))

    details = spark.createDataFrame([
        detail("a", "1 Main St, North Wilmington, NC 28401, USA"), detail("b", "x", "NOT_FOUND"),
        detail("c", "2 Oak St, Durham, NC 27701, USA"), detail("d", None), detail("e", "3 Elm", types=None)], DETAIL)
    places = spark.createDataFrame([(p, 4.0) for p in "abcdef"] + [("a", 1.0)], "place_id string, rating double")
    src = spark.createDataFrame([], TABLES["referral_source"])
    clinics = seed_clinics(spark, AS_OF)
    found = valid_details(enrich_listings(places, details))
    assert sorted(r.id for r in found.collect()) == ["a", "a", "c", "d", "e"]
    change = import_prospects(places, details, clinics, src, AS_OF, 2)
    got = {r["name"]: r for r in change.delta.collect()}
    assert got["A"].clinicLocationId == "clm2" and got["C"].clinicLocationId is None
    assert (got["A"].address, got["A"].city, got["A"].state, got["A"].zipCode) == ("1 Main St", "North Wilmington", "NC", "28401")
    assert (got["A"].contactPhone, got["A"].website, got["A"].faxNumber) == (None, None, None)
    assert got["A"].notes == "Google Rating: 4 (10 reviews)\nBusiness Types: doctor"
    assert {r.requestId for r in change.rejects.collect()} == {"place/d", "place/e"}


CITIES = ["north ALPHA city", "beta", "alphabeta", "", None, "gamma", "a", "ÄLPHA"]


@pytest.mark.parametrize("more", [0, 195, 196, 1995])
def test_match_clinic_is_one_rule_for_any_number_of_clinics(spark, more):
    clinics = spark.createDataFrame(
        [("1", "Beta", True), ("2", "Alpha", True), ("3", "Alph", False), ("4", "Gam", True), ("5", "äl", True)]
        + [(f"x{i}", f"{i:04d} elsewhere", True) for i in range(more)],
        "id string, name string, isActive boolean")
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CITIES)], "n int, city string")
    got = {r.n: r.clinicLocationId for r in match_clinic(df, clinics, "city").collect()}
    assert [got[i] for i in range(len(CITIES))] == ["2", "1", "2", None, None, "4", None, "5"]


def test_match_clinic_where_lower_case_is_longer(spark):
    clinics = spark.createDataFrame([("1", "İzmir", True), ("2", "mir", True)], "id string, name string, isActive boolean")
    df = spark.createDataFrame([("İzmir",), ("Greater İzmir area",), ("Izmir",), ("",), (None,)], "city string")
    got = {r.city: r.clinicLocationId for r in match_clinic(df, clinics, "city").collect()}
    assert got == {"İzmir": "2", "Greater İzmir area": "2", "Izmir": "2", "": None, None: None}
    only = clinics.where("id = '1'")
    got = {r.city: r.clinicLocationId for r in match_clinic(df, only, "city").collect()}
    assert got == {"İzmir": "1", "Greater İzmir area": "1", "Izmir": None, "": None, None: None}


def test_match_clinic_without_clinics(spark):
    none = spark.createDataFrame([], "id string, name string, isActive boolean")
    df = spark.createDataFrame([("x",)], "city string")
    assert match_clinic(df, none, "city").first().clinicLocationId is None


def test_places_near(spark):
    gazetteer = spark.createDataFrame([("Here", 0.0, 179.9), ("Pole", 89.8, 0.0)], "place string, lat double, lng double")
    rows = spark.createDataFrame(
        [("east", 0.0, -179.9), ("west", 0.0, 179.6), ("far", 1.0, 179.9), ("pole", 89.9, 180.0)],
        "name string, lat double, lng double").withColumn("primary_type", F.lit("Doctor"))
    near = lambda place, word, **kw: {r["name"] for r in places_near(rows, gazetteer, place, word, **kw).collect()}
    assert near("Here", "doc") == {"east", "west"}, "the date line is crossed"
    assert near("Here", "ea") == {"east"}
    assert near("Here", "doc", radius=120_000) == {"east", "west", "far"}
    assert near("Pole", "doc") == {"pole"}
    with pytest.raises(LookupError, match="Failed to geocode location"):
        near("Nowhere", "doc")


def test_document_catalog(spark, tmp_path):
    for name, text in (("a.pdf", "12345"), ("b.tar.gz", "12"), ("noext", "1"), ("dot.", "1"), ("with space.pdf", "1")):
        (tmp_path / name).write_text(text)
    rows = {r.originalName: r for r in document_catalog(spark, str(tmp_path)).collect()}
    assert {k: (r.extension, r.size) for k, r in rows.items()} == {
        "a.pdf": ("pdf", 5), "b.tar.gz": ("gz", 2), "noext": ("noext", 1), "dot.": ("", 1), "with space.pdf": ("pdf", 1)}
    assert len({r.storedName for r in rows.values()}) == 5
    assert rows["a.pdf"].url == "/uploads/" + rows["a.pdf"].storedName and rows["a.pdf"].storedName.endswith(".pdf")
    again = {r.originalName: r.storedName for r in document_catalog(spark, str(tmp_path)).collect()}
    assert again == {k: r.storedName for k, r in rows.items()}
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        elsewhere = {r.originalName: r.storedName for r in document_catalog(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert elsewhere == again


def test_write_json_keeps_nulls_and_nesting(spark, tmp_path):
    path = str(tmp_path / "out")
    schema = "id string, note string, items array<struct<k:string,v:int>>, at timestamp_ntz"
    write_json(spark.createDataFrame([("a", None, [("x", 1)], datetime(2024, 1, 2, 3))], schema), path)
    assert json.loads(spark.read.text(path).first()[0]) == {
        "id": "a", "note": None, "items": [{"k": "x", "v": 1}], "at": "2024-01-02T03:00:00.000Z"}


def test_interleaved_commits_keep_every_row(spark, tmp_path):
    """A second writer commits while the first one writes: additions of both stay, a replace of a moved table is refused."""
    from caretrail.sources.tables import Conflict

    root = str(tmp_path / "db")

    class Late:
        """A frame whose writing lets another commit in."""

        def __init__(self, df, other):
            self.df, self.other = df, other

        @property
        def write(self):
            self.other()
            return self.df.write

    write_snapshot(categories(spark, "a"), root, "referral_category", 1)
    other = lambda: commit(spark, root, {"referral_category": categories(spark, "c")}, "other", append=["referral_category"])
    commit(spark, root, {"referral_category": Late(categories(spark, "b"), other)}, "mine", append=["referral_category"])
    names = lambda: sorted(r.id for r in read_entity(spark, root, "referral_category").collect())
    assert len(names()) == 3
    again = lambda: commit(spark, root, {"referral_category": categories(spark, "e")}, "third", append=["referral_category"])
    with pytest.raises(Conflict):
        commit(spark, root, {"referral_category": Late(categories(spark, "x"), again)}, "replace")
    assert len(names()) == 4


def test_snapshots_of_two_tables_may_have_one_number(spark, tmp_path):
    root = str(tmp_path / "db")
    write_snapshot(categories(spark, "a"), root, "referral_category", 1)
    write_snapshot(spark.createDataFrame([], TABLES["clinic_location"]), root, "clinic_location", 1)
    assert table_paths(spark, root, "clinic_location") and table_paths(spark, root, "referral_category")


def test_an_empty_commit_file_stops_nobody(spark, tmp_path):
    """A writer that died over its commit file: its number counts as taken, the state before it holds."""
    root = str(tmp_path / "db")
    write_snapshot(categories(spark, "a"), root, "referral_category", 1)
    (tmp_path / "db" / "commits" / f"{2:012d}.json").write_text("")
    assert names(read_entity(spark, root, "referral_category")) == ["a"]
    version = commit(spark, root, {"referral_category": categories(spark, "b")}, "next", append=["referral_category"])
    assert version == 3 and names(read_entity(spark, root, "referral_category")) == ["a", "b"]
    assert names(read_entity(spark, root, "referral_category", version=2)) == ["a"]
    assert not [p for p in (tmp_path / "db" / "commits").iterdir() if p.name.startswith("_")]


def test_a_commit_whose_writer_died_before_its_marker_is_done(spark, tmp_path):
    root = str(tmp_path / "db")
    add = lambda name, txn: commit(spark, root, {"referral_category": categories(spark, name)}, txn, append=["referral_category"])
    add("a", "t1")
    (tmp_path / "db" / "txns" / "t1").unlink()
    add("a", "t1")
    add("b", "t2")
    add("a", "t1")
    assert names(read_entity(spark, root, "referral_category")) == ["a", "b"]


def test_only_one_writer_gets_a_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "db")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: commit(
            spark, root, {"referral_category": categories(spark, f"n{i}")}, f"t{i}", append=["referral_category"]), range(8)))
    assert names(read_entity(spark, root, "referral_category")) == [f"n{i}" for i in range(8)]


def test_a_table_made_from_an_older_version_is_refused(spark, tmp_path):
    from caretrail.sources.tables import Conflict, latest_version

    root = str(tmp_path / "db")
    write_snapshot(categories(spark, "a"), root, "referral_category", 1)
    base = latest_version(spark, root)
    more = read_entity(spark, root, "referral_category", base).unionByName(categories(spark, "b"))
    commit(spark, root, {"referral_category": categories(spark, "c")}, "other", append=["referral_category"])
    with pytest.raises(Conflict):
        commit(spark, root, {"referral_category": more}, "mine", base=base)
    commit(spark, root, {"referral_category": more}, "rebased", base=base, rebase=["referral_category"])
    assert names(read_entity(spark, root, "referral_category")) == ["a", "b", "c"]
