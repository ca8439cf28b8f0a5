"""Bulk changes on hand-written requests: reject reasons in order, presence, nulls, batches."""

import json
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caretrail.operators.keys import all_key_audits
from caretrail.operators.sets import recipient_diff, update_selection
from caretrail.plans import creates, deletes, dispatch, migration, patches
from caretrail.schemas import LINK_KEY, TABLES, conform

AS_OF = "2024-09-01 12:00:00"


def table(spark, name, rows):
    """Rows given as dicts, completed to the schema of the table."""
    if not rows:
        return spark.createDataFrame([], TABLES[name])
    return spark.createDataFrame([tuple(r.get(f.name) for f in TABLES[name].fields) for r in rows], TABLES[name])


def requests(spark, *bodies):
    """(id, body) or body; the body is JSON text or an object."""
    rows = []
    for n, item in enumerate(bodies):
        key, body = item if isinstance(item, tuple) else (None, item)
        rows.append((f"r{n}", n, key, body if isinstance(body, str) else json.dumps(body)))
    return spark.createDataFrame(rows, "requestId string, seq long, id string, body string")


def reasons(df):
    return {r[0]: r[1] for r in df.collect()}


# ---- creation ------------------------------------------------------------------------------------------------------


def test_create_sources(spark):
    src = table(spark, "referral_source", [{"id": "s0", "name": "Old"}])
    clinics = table(spark, "clinic_location", [{"id": "cl1", "name": "One"}])
    req = requests(
        spark,
        {"name": "New", "address": "", "faxNumber": "", "rating": 0, "numberOfProviders": 3, "clinicLocationId": "cl1"},
        {"name": "", "rating": "bad"},
        {"address": "x"},
        '{"name": "broken"',
        {"name": "Old", "npiNumber": None},
        {"name": "x", "rating": "bad"},
        {"name": "x", "numberOfProviders": 2.5},
        {"name": "x", "clinicLocationId": "gone"},
        {"name": "x", "clinicLocationId": ""},
    )
    change = creates.create_sources(req, src, AS_OF, clinics=clinics)
    made = {r["name"]: r.asDict() for r in change.delta.collect()}
    assert made["New"]["address"] is None and made["New"]["faxNumber"] == "" and made["New"]["rating"] is None
    assert made["New"]["numberOfProviders"] == 3 and made["New"]["clinicLocationId"] == "cl1"
    assert made["New"]["createdAt"] == datetime(2024, 9, 1, 12)
    assert set(made) == {"New", "Old", "x"}, "a name may repeat"
    assert reasons(change.rejects) == {
        "r1": "Name is required", "r2": "Name is required", "r3": "Failed to create referral source",
        "r5": "Failed to create referral source", "r6": "Failed to create referral source",
        "r7": "Failed to create referral source",
    }
    assert change.table.count() == 4
    again = creates.create_sources(req, src, AS_OF, clinics=clinics).delta
    assert {r.id for r in again.collect()} == {v["id"] for v in made.values()} | {r.id for r in change.delta.collect()}


def test_create_interactions(spark):
    src = table(spark, "referral_source", [{"id": "s1", "name": "A"}])
    req = requests(
        spark,
        {"referralSourceId": "s1", "type": "CALL", "date": "2024-03-01", "notes": ""},
        {"type": "CALL", "date": "2024-03-01"},
        {"referralSourceId": "s1", "date": "2024-03-01"},
        {"referralSourceId": "s1", "type": "CALL", "date": None},
        {},
        {"referralSourceId": "s1", "type": "CALL", "date": "soon"},
        {"referralSourceId": "s9", "type": "CALL", "date": "2024-03-01"},
    )
    change = creates.create_interactions(req, table(spark, "interaction", []), src, AS_OF)
    (made,) = change.delta.collect()
    assert (made["date"], made["notes"]) == (datetime(2024, 3, 1), None)
    assert reasons(change.rejects) == {
        "r1": "Referral source ID is required", "r2": "Interaction type is required",
        "r3": "Interaction date is required", "r4": "Referral source ID is required",
        "r5": "Failed to create interaction", "r6": "Failed to create interaction",
    }


def test_create_campaigns(spark):
    src = table(spark, "referral_source", [{"id": f"s{i}", "name": "A"} for i in range(3)])
    req = requests(
        spark,
        {"name": "A", "type": "FAX", "startDate": "2024-03-01", "documentName": "d", "referralSourceIds": ["s0", "s1"]},
        {"name": "B", "type": "FAX", "documentUrl": "/u", "documentName": "d", "endDate": "", "status": "ACTIVE"},
        {"type": "FAX"},
        {"name": "C"},
        {"name": "D", "type": "FAX", "referralSourceIds": ["s0", "s0"]},
        {"name": "E", "type": "FAX", "referralSourceIds": ["s0", "s9"]},
        {"name": "F", "type": "FAX", "startDate": "soon"},
        {"name": "G", "type": "FAX", "referralSourceIds": []},
    )
    change = creates.create_campaigns(
        req, table(spark, "campaign", []), table(spark, "campaign_link", []), src, AS_OF, "America/New_York")
    made = {r["name"]: r for r in change.campaigns.delta.collect()}
    assert set(made) == {"A", "B", "G"}
    assert made["A"].startDate == datetime(2024, 3, 1, 17) and made["B"].startDate == datetime(2024, 9, 1, 12)
    assert (made["A"].documentName, made["B"].documentName) == (None, "d")
    assert (made["A"].status, made["B"].status, made["B"].endDate, made["A"].includeCoverSheet) == ("DRAFT", "ACTIVE", None, True)
    links = sorted((r.campaignId, r.referralSourceId, r.status) for r in change.links.delta.collect())
    assert links == [(made["A"].id, "s0", "PENDING"), (made["A"].id, "s1", "PENDING")]
    assert reasons(change.rejects) == {
        "r2": "Name is required", "r3": "Campaign type is required",
        **dict.fromkeys(("r4", "r5", "r6"), "Failed to create campaign"),
    }


def test_create_clinics(spark):
    clinic = table(spark, "clinic_location", [{"id": "c0", "name": "Here", "isActive": True}])
    req = requests(
        spark, {"name": "There"}, {"name": "There"}, {"name": "Here"}, {"name": ""}, {"name": "Off", "isActive": False},
        {"name": "Null", "isActive": None}, {"name": "Null"}, {"name": "Here", "isActive": None},
    )
    change = creates.create_clinics(req, clinic, AS_OF)
    assert {r["name"]: r["isActive"] for r in change.delta.collect()} == {"There": True, "Off": False, "Null": True}
    taken = "A clinic location with this name already exists"
    assert reasons(change.rejects) == {
        "r1": taken, "r2": taken, "r3": "Name is required", "r5": "Failed to create clinic location", "r7": taken}


# ---- patches -------------------------------------------------------------------------------------------------------


def test_patch_sources(spark):
    src = table(spark, "referral_source", [
        {"id": "a", "name": "A", "address": "1", "notes": "old", "numberOfProviders": 4},
        {"id": "b", "name": "B", "address": "2"}, {"id": "c", "name": "C", "rating": 3.0}])
    req = requests(
        spark,
        ("a", {"notes": "one", "address": None}), ("a", {"notes": "two"}), ("a", {"numberOfProviders": 0}),
        ("b", {"address": ""}), ("b", {"name": None}), ("zz", {"name": "x"}), ("c", "{broken"), ("c", {"rating": "x"}),
        ("c", {"rating": None}), ("c", {}),
    )
    change = patches.patch_sources(req, src, AS_OF)
    got = {r.id: r for r in change.table.collect()}
    assert (got["a"].notes, got["a"].address, got["a"].numberOfProviders, got["a"]["name"]) == ("two", None, 0, "A")
    assert (got["b"].address, got["b"]["name"], got["c"].rating) == ("", "B", None)
    failed = "Failed to update referral source"
    assert reasons(change.rejects) == {"r4": failed, "r5": "Referral source not found", "r6": failed, "r7": failed}
    assert {r.id for r in change.delta.collect()} == {"a", "b", "c"}
    assert got["a"].updatedAt == datetime(2024, 9, 1, 12)


def test_patch_checks_foreign_keys(spark):
    src = table(spark, "referral_source", [{"id": "a", "name": "A", "clinicLocationId": "c1"}])
    clinics = table(spark, "clinic_location", [{"id": "c1", "name": "One"}])
    req = requests(spark, ("a", {"clinicLocationId": "zz"}), ("a", {"clinicLocationId": None}))
    change = patches.patch_sources(req, src, AS_OF, clinics=clinics)
    assert reasons(change.rejects) == {"r0": "Failed to update referral source"}
    assert change.table.first().clinicLocationId is None


def test_patch_interactions(spark):
    inter = table(spark, "interaction", [
        {"id": "i", "referralSourceId": "s", "type": "CALL", "date": datetime(2024, 1, 1), "notes": "n"}])
    req = requests(spark, ("i", {"date": None, "notes": None}), ("i", {"date": ""}), ("i", {"type": None}), ("j", {}))
    change = patches.patch_interactions(req, inter, AS_OF)
    row = change.table.first()
    assert (row["date"], row.notes, row["type"]) == (datetime(1970, 1, 1), None, "CALL")
    assert reasons(change.rejects) == {
        "r1": "Failed to update interaction", "r2": "Failed to update interaction", "r3": "Interaction not found"}


def test_patch_clinics(spark):
    clinic = table(spark, "clinic_location", [{"id": i, "name": i.upper(), "isActive": True} for i in "abc"])
    req = requests(
        spark, ("a", {"name": "A", "city": "x"}), ("a", {"name": "B"}), ("b", {"name": "N"}), ("c", {"name": "N"}),
        ("z", {"name": "B"}), ("c", {"isActive": None}), ("c", {"isActive": False}), ("b", {"name": "N", "city": "y"}),
    )
    change = patches.patch_clinics(req, clinic, AS_OF)
    got = {r.id: (r["name"], r.city, r.isActive) for r in change.table.collect()}
    assert got == {"a": ("A", "x", True), "b": ("N", "y", True), "c": ("C", None, False)}
    taken = "A clinic location with this name already exists"
    assert reasons(change.rejects) == {
        "r1": taken, "r3": taken, "r4": "Clinic location not found", "r5": "Failed to update clinic location"}


def test_patch_campaigns(spark):
    camp = table(spark, "campaign", [
        {"id": "c", "name": "C", "type": "FAX", "status": "DRAFT", "startDate": datetime(2024, 1, 1),
         "endDate": datetime(2024, 2, 1), "documentUrl": "/old", "documentName": "old"},
        {"id": "d", "name": "D", "type": "FAX", "documentUrl": "/old", "documentName": "old"}])
    req = requests(
        spark, ("c", {"startDate": "", "documentName": "ignored"}), ("c", {"startDate": None, "endDate": ""}),
        ("d", {"documentUrl": "/new", "documentName": "new", "startDate": "2024-05-05"}), ("c", {"endDate": "soon"}),
        ("d", {"type": None}), ("x", {}), ("d", {"documentUrl": None}),
    )
    change = patches.patch_campaigns(req, camp, AS_OF)
    got = {r.id: r for r in change.table.collect()}
    assert (got["c"].startDate, got["c"].endDate, got["c"].documentName) == (datetime(2024, 1, 1), None, "old")
    assert (got["d"].documentUrl, got["d"].documentName, got["d"].startDate) == (None, "new", datetime(2024, 5, 5, 12))
    failed = "Failed to update campaign"
    assert reasons(change.rejects) == {"r3": failed, "r4": failed, "r5": "Campaign not found"}


def test_patch_cover_sheet(spark):
    camp = table(spark, "campaign", [{"id": "c", "name": "C", "includeCoverSheet": True, "coverSheetSubject": "old"}])
    full = {"includeCoverSheet": True, "coverSheetFromName": "A", "coverSheetSubject": "B", "coverSheetMessage": "C"}
    req = requests(
        spark, ("c", full), ("c", {**full, "coverSheetFromName": ""}), ("c", {**full, "coverSheetSubject": None}),
        ("c", {k: v for k, v in full.items() if k != "coverSheetMessage"}), ("z", {"includeCoverSheet": False}),
        ("z", {"includeCoverSheet": True}), ("c", {"coverSheetCompanyInfo": "D"}), ("c", {"includeCoverSheet": None}),
    )
    change = patches.patch_cover_sheet(req, camp, AS_OF)
    row = change.table.first()
    assert (row.coverSheetFromName, row.coverSheetSubject, row.coverSheetMessage, row.coverSheetCompanyInfo) == tuple("ABCD")
    assert reasons(change.rejects) == {
        "r1": "From Name is required for cover sheet", "r2": "Subject is required for cover sheet",
        "r3": "Message is required for cover sheet", "r4": "Campaign not found",
        "r5": "From Name is required for cover sheet", "r7": "Failed to update cover sheet settings"}


def links(spark, *pairs, status="SENT"):
    return table(spark, "campaign_link", [
        {"campaignId": c, "referralSourceId": s, "status": status} for c, s in pairs])


def test_sync_recipients(spark):
    link = links(spark, ("add", "a"), ("rem", "a"), ("rem", "b"), ("both", "a"), ("same", "a"), ("none", "a"), ("null", "a"),
                 ("twice", "a"), ("bad", "a"))
    asked = [("add", ["a", "b"]), ("rem", ["a"]), ("both", ["b"]), ("same", ["a"]), ("none", []), ("null", None),
             ("twice", ["b", "b"]), ("bad", ["zz"]), ("kept", ["a"])]
    req = spark.createDataFrame(asked, "campaignId string, referralSourceIds array<string>")
    src = table(spark, "referral_source", [{"id": i, "name": i} for i in "ab"])
    sync = patches.sync_recipients(req, link, AS_OF, src)
    pairs = lambda df: {(r.campaignId, r.referralSourceId, r.status) for r in df.collect()}
    assert pairs(sync.added) == {("add", "b", "PENDING"), ("both", "b", "PENDING"), ("kept", "a", "PENDING")}
    assert pairs(sync.removed) == {("rem", "b", "SENT"), ("both", "a", "SENT"), ("none", "a", "SENT")}
    assert {r.campaignId for r in sync.rejects.collect()} == {"twice", "bad"}
    assert pairs(sync.table) == (pairs(link) - pairs(sync.removed)) | pairs(sync.added)


def test_repeated_recipient_that_is_kept_is_allowed(spark):
    req = spark.createDataFrame([("c", ["a", "a"])], "campaignId string, referralSourceIds array<string>")
    sync = patches.sync_recipients(req, links(spark, ("c", "a")), AS_OF)
    assert sync.rejects.count() == 0 and sync.table.count() == 1


def test_update_campaigns_is_one_unit(spark):
    camp = table(spark, "campaign", [{"id": i, "name": i, "type": "FAX"} for i in "xyz"])
    src = table(spark, "referral_source", [{"id": i, "name": i} for i in "ab"])
    req = requests(
        spark, ("x", {"name": "X", "referralSourceIds": ["b"]}), ("y", {"name": "Y", "referralSourceIds": ["zz"]}),
        ("z", {"name": None, "referralSourceIds": ["b"]}), ("x", {"content": "c"}),
    )
    done = patches.update_campaigns(req, camp, links(spark, ("x", "a"), ("y", "a"), ("z", "a")), src, AS_OF)
    assert {r.id: r["name"] for r in done.campaigns.table.collect()} == {"x": "X", "y": "y", "z": "z"}
    assert {(r.campaignId, r.referralSourceId) for r in done.links.table.collect()} == {("x", "b"), ("y", "a"), ("z", "a")}
    assert set(reasons(done.rejects)) == {"r1", "r2"}


# ---- deletes -------------------------------------------------------------------------------------------------------


def ask(spark, *ids):
    return spark.createDataFrame([(f"r{n}", i) for n, i in enumerate(ids)], "requestId string, id string")


def test_delete_interactions_and_campaigns(spark):
    inter = table(spark, "interaction", [{"id": i, "referralSourceId": "s", "type": "CALL"} for i in "ab"])
    change = deletes.delete_interactions(ask(spark, "a", "a", "z"), inter)
    assert [r.id for r in change.table.collect()] == ["b"]
    assert reasons(change.rejects) == {"r2": "Interaction not found"}
    camp = table(spark, "campaign", [{"id": i, "name": i} for i in "xy"])
    gone = deletes.delete_campaigns(ask(spark, "x", "z"), camp, links(spark, ("x", "a"), ("y", "a")))
    assert [r.id for r in gone.table.collect()] == ["y"] and [r.campaignId for r in gone.links.collect()] == ["y"]
    assert reasons(gone.rejects) == {"r1": "Campaign not found"}


def test_delete_sources_refuses_before_it_removes(spark):
    src = table(spark, "referral_source", [{"id": i, "name": i} for i in "abc"])
    inter = table(spark, "interaction", [{"id": "i", "referralSourceId": "a", "type": "CALL"}])
    gone = deletes.delete_sources(ask(spark, "a", "b", "z"), src, links(spark, ("x", "a"), ("x", "b"), ("x", "c")), inter)
    assert {r.id for r in gone.table.collect()} == {"a", "c"}
    assert {r.referralSourceId for r in gone.links.collect()} == {"a", "c"}
    assert reasons(gone.rejects) == {"r0": "Failed to delete referral source", "r2": "Referral source not found"}


def test_delete_clinics(spark):
    clinic = table(spark, "clinic_location", [{"id": i, "name": i} for i in "abc"])
    src = table(spark, "referral_source", [{"id": str(n), "name": "s", "clinicLocationId": "a"} for n in range(3)])
    change = deletes.delete_clinics(ask(spark, "a", "b", "z"), clinic, src)
    assert {r.id for r in change.table.collect()} == {"a", "c"}
    assert reasons(change.rejects) == {
        "r0": "Cannot delete clinic location. 3 referral source(s) are linked to this location.",
        "r2": "Clinic location not found"}


# ---- dispatch ------------------------------------------------------------------------------------------------------


def test_dispatch_round(spark):
    camp = table(spark, "campaign", [
        {"id": "c1", "name": "C", "status": "COMPLETED", "documentUrl": "/d.pdf", "includeCoverSheet": True},
        {"id": "c2", "name": "D", "status": "DRAFT", "documentUrl": ""}])
    src = table(spark, "referral_source", [
        {"id": "s1", "name": "A", "faxNumber": "(910) 555-1234"}, {"id": "s2", "name": "B", "faxNumber": ""},
        {"id": "s3", "name": "E", "faxNumber": "none", "contactPerson": "Dr E"}])
    link = table(spark, "campaign_link", [
        {"campaignId": c, "referralSourceId": s, "status": "SENT" if s == "s3" else "PENDING"}
        for c, s in (("c1", "s1"), ("c1", "s2"), ("c1", "s3"), ("c2", "s1"))])
    box = dispatch.build_outbox(camp, link, src, dispatch.DispatchConfig(host="localhost:3000"))
    out = {r.referralSourceId: r for r in box.outbox.collect()}
    assert set(out) == {"s1", "s3"} and out["s1"].toNumber == "19105551234" and out["s3"].toNumber == "none"
    assert out["s1"].documentUrl == "http://localhost:3000/d.pdf" and out["s3"].coverSheet.toName == "Dr E"
    assert [(r.referralSourceId, r.error) for r in box.skipped.collect()] == [("s2", "No fax number provided")]
    assert reasons(box.rejects) == {"c2": "Campaign does not have a document to send"}
    status = {(r.campaignId, r.referralSourceId): r.status for r in box.links.collect()}
    assert status == {("c1", "s1"): "SENDING", ("c1", "s2"): "PENDING", ("c1", "s3"): "SENDING", ("c2", "s1"): "PENDING"}
    pending = dispatch.build_outbox(camp, link, src, dispatch.DispatchConfig(), only_pending=True)
    assert [r.referralSourceId for r in pending.outbox.collect()] == ["s1"]

    results = spark.createDataFrame(
        [("c1", "s1", True, None, '{"id":"d7"}', None, None), ("c1", "s3", False, None, None, "busy", None),
         ("c1", "s1", True, None, '{"id":"d7"}', None, None)],
        "campaignId string, referralSourceId string, success boolean, faxId string, data string, error string, status string")
    sent = dispatch.apply_send_results(box.links, camp, results, AS_OF)
    got = {(r.campaignId, r.referralSourceId): r for r in sent.links.collect()}
    assert len(got) == sent.links.count() == 4
    assert got["c1", "s1"].status == "SENT" and got["c1", "s1"].sentAt == datetime(2024, 9, 1, 12)
    assert json.loads(got["c1", "s1"].response) == {"faxId": "d7", "status": "sent", "details": {"id": "d7"}}
    assert got["c1", "s3"].status == "FAILED" and json.loads(got["c1", "s3"].response) == {"error": "busy", "data": {}}
    assert got["c1", "s2"].status == "PENDING"
    assert {r.id: r.status for r in sent.campaigns.collect()} == {"c1": "ACTIVE", "c2": "DRAFT"}
    assert sent.delta.count() == 2


def test_reconcile_final(spark):
    def link(key, status="SENT", minutes=10):
        return {"campaignId": "c", "referralSourceId": key, "status": status, "sentAt": datetime(2024, 9, 1, 11, 60 - minutes),
                "response": json.dumps({"faxId": f"f-{key}"})}

    rows = [link("ok"), link("bad"), link("case"), link("busy"), link("none"), link("early", minutes=2),
            link("edge", minutes=3), link("failed", "FAILED")]
    feed = spark.createDataFrame(
        [(f"f-{k}", s, '{"status":"%s"}' % s) for k, s in (
            ("ok", "delivered"), ("bad", "failed"), ("case", "Delivered"), ("busy", "processing"), ("early", "delivered"),
            ("edge", "delivered"), ("failed", "delivered"))] + [(None, "delivered", None)],
        "faxId string, status string, body string")
    done = {r.referralSourceId: r for r in dispatch.reconcile_final(table(spark, "campaign_link", rows), feed, AS_OF).collect()}
    assert {k: r.status for k, r in done.items()} == {
        "ok": "DELIVERED", "bad": "FAILED", "case": "SENT", "busy": "SENT", "none": "SENT", "early": "SENT",
        "edge": "DELIVERED", "failed": "FAILED"}
    assert json.loads(done["case"].response) == {
        "faxId": "f-case", "finalStatus": "Delivered", "finalCheck": True, "details": {"status": "Delivered"}}
    assert json.loads(done["none"].response) == {"faxId": "f-none"}


# ---- migration -----------------------------------------------------------------------------------------------------


def test_migration(spark):
    names = [*migration.SEED_CLINICS.values(), "Elsewhere", None]
    legacy = spark.createDataFrame([(f"s{i}", "S", "OTHER", "ACTIVE", n) for i, n in enumerate(names)],
                                   "id string, name string, industry string, status string, clinicLocation string")
    new = migration.migrate_sources(legacy)
    assert new.columns == [f.name for f in TABLES["referral_source"].fields]
    assert [r.clinicLocationId for r in new.orderBy("id").collect()] == ["clm1", "clm2", "clm3", "clm4", "clm5", None, None]
    seeds = migration.seed_clinics(spark, AS_OF)
    assert [r["name"] for r in seeds.orderBy("id").collect()] == list(migration.SEED_CLINICS.values())
    old = spark.createDataFrame([("c", "C", "FAX")], "id string, name string, type string")
    assert migration.migrate_campaigns(old).first().includeCoverSheet is True


# ---- properties ----------------------------------------------------------------------------------------------------

PAIRS = st.sets(st.tuples(st.sampled_from("xy"), st.sampled_from("abcd")), max_size=8)


@settings(max_examples=6, deadline=None)
@given(PAIRS, PAIRS)
def test_recipient_diff_partitions_both_sides(spark, current, requested):
    frame = lambda pairs: spark.createDataFrame(sorted(pairs), "campaignId string, referralSourceId string")
    add, remove, keep = ({tuple(r) for r in df.select(*LINK_KEY).collect()} for df in recipient_diff(frame(current), frame(requested)))
    assert add | keep == requested and remove | keep == current
    assert not add & keep and not remove & keep


@settings(max_examples=4, deadline=None)
@given(st.lists(st.sampled_from(["ok", "noname", "notype", "twice", "broken"]), min_size=1, max_size=8))
def test_every_request_is_applied_or_rejected(spark, kinds):
    bodies = {"ok": {"name": "A", "type": "FAX"}, "noname": {"type": "FAX"}, "notype": {"name": "A"},
              "twice": {"name": "A", "type": "FAX", "referralSourceIds": ["s", "s"]}, "broken": "{"}
    src = table(spark, "referral_source", [{"id": "s", "name": "S"}])
    change = creates.create_campaigns(
        requests(spark, *[bodies[k] for k in kinds]), table(spark, "campaign", []), table(spark, "campaign_link", []), src, AS_OF)
    applied, rejected = change.campaigns.delta.count(), change.rejects.select("requestId").distinct().count()
    assert applied + rejected == len(kinds) and rejected == change.rejects.count()


@pytest.mark.parametrize("action, expected", [("all", {"b", "c"}), ("clear", set()), ("toggle", {"a", "d"})])
def test_update_selection(spark, action, expected):
    ids = lambda text: spark.createDataFrame([(i,) for i in text], "id string")
    got = update_selection(ids("ab"), ids("bc"), action, ids("bd"))
    assert {r.id for r in got.collect()} == expected


def test_conform_completes_and_orders(spark):
    df = conform(spark.createDataFrame([("x", 1)], "name string, extra int"), "referral_category")
    assert df.columns == ["id", "name", "description", "createdAt", "updatedAt"]
    assert df.where(F.col("id").isNull()).count() == 1


def test_sync_of_a_campaign_that_does_not_exist(spark):
    camp = spark.createDataFrame([("c",)], "id string")
    req = spark.createDataFrame([("c", ["b"]), ("nowhere", ["a"])], "campaignId string, referralSourceIds array<string>")
    sync = patches.sync_recipients(req, links(spark, ("c", "a")), AS_OF, camp=camp)
    assert {(r.campaignId, r.referralSourceId) for r in sync.table.collect()} == {("c", "b")}
    assert [(r.campaignId, r.reason) for r in sync.rejects.collect()] == [("nowhere", patches.CAMPAIGN_MISSING)]


# ---- unique keys -----------------------------------------------------------------------------------------------------


def numbered_requests(spark, *rows):
    return spark.createDataFrame([(r, n, None, json.dumps(b)) for r, n, b in rows],
                                 "requestId string, seq long, id string, body string")


def test_the_first_request_of_an_id_makes_the_row(spark):
    req = numbered_requests(
        spark, ("a", 2, {"name": "later"}), ("a", 1, {"name": "first"}), ("a", 1, {"name": "first"}), ("b", 1, {"name": ""}),
        ("b", 2, {"name": "sound"}), ("c", 1, {"name": "stored"}), ("d", 1, {"name": "d"}))
    stored = creates.create_sources(numbered_requests(spark, ("c", 9, {"name": "old"})), table(spark, "referral_source", []), AS_OF)
    made = creates.create_sources(req, stored.table, AS_OF)
    assert sorted(r["name"] for r in made.delta.collect()) == ["d", "first", "sound"]
    assert sorted((r.requestId, r.reason) for r in made.rejects.collect()) == [
        ("a", creates.SOURCE_FAILED), ("b", creates.NAME_REQUIRED), ("c", creates.SOURCE_FAILED)]
    assert all_key_audits({"referral_source": made.table}).count() == 0


def test_campaigns_of_one_request_are_made_once_with_their_links(spark):
    src = table(spark, "referral_source", [{"id": "s1"}, {"id": "s2"}])
    none = [table(spark, n, []) for n in ("campaign", "campaign_link")]
    body = {"name": "n", "type": "FAX", "referralSourceIds": ["s1"]}
    req = numbered_requests(spark, ("a", 1, body), ("a", 1, body), ("a", 2, {**body, "referralSourceIds": ["s1", "s2"]}))
    made = creates.create_campaigns(req, *none, src, AS_OF)
    assert made.campaigns.delta.count() == 1 and made.links.delta.count() == 1
    assert reasons(made.rejects) == {"a": creates.CAMPAIGN_FAILED}
    tables = {"campaign": made.campaigns.table, "campaign_link": made.links.table}
    assert all_key_audits(tables).count() == 0


def test_key_audit_counts_every_declared_key(spark):
    clinics = table(spark, "clinic_location", [{"id": "1", "name": "x"}, {"id": "1", "name": "y"}, {"id": "2", "name": "x"},
                                               {"id": None, "name": None}, {"id": None, "name": None}])
    links = table(spark, "campaign_link", [{"campaignId": "c", "referralSourceId": s} for s in ("1", "1", "2", None, None)])
    found = all_key_audits({"clinic_location": clinics, "campaign_link": links}).collect()
    assert sorted((r.table, r.key, r.value, r["count"]) for r in found) == [
        ("campaign_link", "campaignId,referralSourceId", '["c","1"]', 2), ("clinic_location", "id", '["1"]', 2),
        ("clinic_location", "name", '["x"]', 2)]


def test_single_key_is_counted_by_its_columns(spark):
    """Values are put into text for repeated keys only, so that a task keeps the columns and a count."""
    links = table(spark, "campaign_link", [{"campaignId": 'c"', "referralSourceId": s} for s in ("1", "1", "2", None, None)])
    found = all_key_audits({"campaign_link": links})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    assert [tuple(r) for r in found.collect()] == [("campaign_link", "campaignId,referralSourceId", '["c\\"","1"]', 2)]


def test_campaign_requests_are_parsed_once(spark):
    src = table(spark, "referral_source", [{"id": "s1"}])
    none = [table(spark, n, []) for n in ("campaign", "campaign_link")]
    body = {"name": "n", "type": "FAX", "referralSourceIds": ["s1"]}
    req = numbered_requests(spark, ("a", 1, body), ("b", 2, {**body, "name": ""}), ("c", 3, {**body, "referralSourceIds": ["s2"]}))
    made = creates.create_campaigns(req, *none, src, AS_OF)
    for frame in (made.campaigns.delta, made.links.delta, made.rejects):
        assert "from_json" not in frame._jdf.queryExecution().executedPlan().toString()
    assert made.links.delta.count() == 1
    assert reasons(made.rejects) == {"b": creates.NAME_REQUIRED, "c": creates.CAMPAIGN_FAILED}


def test_answer_of_a_send_that_throws(spark):
    link = table(spark, "campaign_link", [{"campaignId": "c", "referralSourceId": s, "status": "SENDING"} for s in "ab"])
    camp = table(spark, "campaign", [{"id": "c", "status": "DRAFT"}])
    results = spark.createDataFrame(
        [("c", "a", False, None, '{"x":1}', "timeout", "500", True), ("c", "b", False, None, '{"x":1}', "busy", "500", False)],
        "campaignId string, referralSourceId string, success boolean, faxId string, data string, error string, status string, "
        "thrown boolean")
    got = {r.referralSourceId: json.loads(r.response) for r in dispatch.apply_send_results(link, camp, results, AS_OF).links.collect()}
    assert got == {"a": {"error": "timeout"}, "b": {"error": "busy", "status": "500", "data": {"x": 1}}}
