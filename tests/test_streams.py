"""Streams on a temp folder: replay, restart, order, dead letters."""

import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caretrail.schemas import TABLES, conform
from caretrail.session import shared_folder
from caretrail.sources import commit, read_entity, table_paths, write_snapshot
from caretrail.sources.tables import latest_version
from caretrail.streaming.checkpoints import checkpoint_folder
from caretrail.streaming import delivery, links, recent

START = datetime(2024, 9, 1)
EVENT = "campaignId string, referralSourceId string, faxId string, status string, error string, receivedAt timestamp_ntz"


def event(key, status, minute, fax="f1", **extra):
    return {"faxId": fax, "status": status, "metadata": {"campaignId": "c", "referralSourceId": key},
            "receivedAt": (START + timedelta(minutes=minute)).isoformat(), **extra}


def land(folder, name, *items):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(i if isinstance(i, str) else json.dumps(i) for i in items))


def setup(spark, root, *keys):
    rows = [("c", k, "SENT", None, None, "{}", None, None) for k in keys]
    write_snapshot(spark.createDataFrame(rows, TABLES["campaign_link"]), root, "campaign_link", 0)


def run(spark, tmp_path, **kw):
    query = delivery.run_delivery_stream(spark, str(tmp_path / "in"), str(tmp_path / "db"), str(tmp_path / "ckpt"), **kw)
    query.awaitTermination()


def state(spark, root):
    return {r.referralSourceId: (r.status, r.responseAt) for r in links.current_links(spark, root).collect()}


def minute(n):
    return START + timedelta(minutes=n)


@pytest.mark.parametrize("files", [1, 2])
def test_last_event_wins(spark, tmp_path, files):
    root = str(tmp_path / "db")
    setup(spark, root, "a", "b", "quiet")
    first = [event("a", "queued", 1), event("b", "Delivered", 1)]
    second = [event("a", "Delivered", 2), event("b", "queued", 2)]
    if files == 1:
        land(tmp_path / "in", "1.json", *first, *second)
    else:
        land(tmp_path / "in", "1.json", *first)
        land(tmp_path / "in", "2.json", *second)
    run(spark, tmp_path, files_per_trigger=1)
    expected = {"a": ("SENT", minute(2)), "b": ("PENDING", minute(1)), "quiet": ("SENT", None)}
    assert state(spark, root) == expected
    response = links.current_links(spark, root).where("referralSourceId = 'b'").first().response
    assert json.loads(response) == {"faxId": "f1", "status": "queued", "updatedAt": "2024-09-01T00:02:00.000Z", "error": None}
    links.compact_links(spark, root, "compact")
    assert state(spark, root) == expected and table_paths(spark, root, links.CHANGES) == []


def test_dead_letters(spark, tmp_path):
    root = str(tmp_path / "db")
    setup(spark, root, "a")
    land(tmp_path / "in", "1.json", event("a", "ERROR", 1, error="busy"), "{broken", {"faxId": "f", "status": "queued"},
         event("zz", "Delivered", 1), event("a", "", 2), event("a", "queued", 1, fax=None))
    run(spark, tmp_path)
    found = sorted(r.reason for r in delivery.dead_letters(spark, root).collect())
    assert found == ["Failed to process webhook", *["Missing required fields"] * 3, "Unknown campaign link"]
    assert state(spark, root) == {"a": ("FAILED", minute(1))}


def test_restart_goes_on_and_replay_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "db")
    setup(spark, root, "a", "b")
    land(tmp_path / "in", "1.json", event("a", "Delivered", 1))
    run(spark, tmp_path)
    land(tmp_path / "in", "2.json", event("b", "FAILED", 2))
    run(spark, tmp_path)
    before = state(spark, root)
    assert before == {"a": ("SENT", minute(1)), "b": ("FAILED", minute(2))}
    paths = table_paths(spark, root, links.CHANGES)
    assert len(paths) == 2
    # the last batch once more, as after a crash between the commit and the checkpoint
    for name in ("1", ".1.crc"):
        (tmp_path / "ckpt" / "commits" / name).unlink(missing_ok=True)
    run(spark, tmp_path)
    assert state(spark, root) == before and table_paths(spark, root, links.CHANGES) == paths


def count(spark, root):
    events = read_entity(spark, root, links.CHANGES, schema=links.CHANGE_SCHEMA).count()
    return events, delivery.dead_letters(spark, root).count()


def test_a_new_checkpoint_loses_and_doubles_nothing(spark, tmp_path):
    root = str(tmp_path / "db")
    setup(spark, root, "a", "b")
    land(tmp_path / "in", "1.json", event("a", "Delivered", 1), "{broken", event("zz", "queued", 1))
    run(spark, tmp_path)
    assert count(spark, root) == (2, 2)
    land(tmp_path / "in", "2.json", event("b", "FAILED", 2))
    again = delivery.run_delivery_stream(spark, str(tmp_path / "in"), root, str(tmp_path / "other"), files_per_trigger=1)
    again.awaitTermination()
    assert count(spark, root) == (3, 2)
    assert state(spark, root) == {"a": ("SENT", minute(1)), "b": ("FAILED", minute(2))}
    links.compact_links(spark, root, "compact")
    delivery.run_delivery_stream(spark, str(tmp_path / "in"), root, str(tmp_path / "third")).awaitTermination()
    assert count(spark, root) == (0, 2) and state(spark, root)["b"] == ("FAILED", minute(2))


def test_two_roots_with_default_checkpoints(spark, tmp_path):
    land(tmp_path / "in", "1.json", event("a", "Delivered", 1))
    for name in ("db1", "db2"):
        setup(spark, str(tmp_path / name), "a")
        delivery.run_delivery_stream(spark, str(tmp_path / "in"), str(tmp_path / name), name="twice").awaitTermination()
        assert state(spark, str(tmp_path / name)) == {"a": ("SENT", minute(1))}


def test_storing_reads_no_links(spark, tmp_path):
    """The link table isn't even there, and an event that came before its link counts once it is."""
    root = str(tmp_path / "db")
    land(tmp_path / "in", "1.json", event("a", "Delivered", 1))
    run(spark, tmp_path)
    assert [r.reason for r in delivery.dead_letters(spark, root).collect()] == ["Unknown campaign link"]
    setup(spark, root, "a")
    assert state(spark, root) == {"a": ("SENT", minute(1))} and delivery.dead_letters(spark, root).count() == 0


def test_events_that_come_while_links_are_compacted_stay(spark, tmp_path):
    root = str(tmp_path / "db")
    setup(spark, root, "a", "b")
    land(tmp_path / "in", "1.json", event("a", "Delivered", 1), event("zz", "queued", 1))
    run(spark, tmp_path)
    version = latest_version(spark, root)
    frames = {"campaign_link": links.current_links(spark, root, version), **links.settled(spark, root, version)}
    land(tmp_path / "in", "2.json", event("b", "FAILED", 2))
    run(spark, tmp_path)
    commit(spark, root, frames, "late", append=[links.DEAD], base=version)
    assert state(spark, root) == {"a": ("SENT", minute(1)), "b": ("FAILED", minute(2))}
    assert count(spark, root) == (1, 1)


EVENTS = st.lists(
    st.tuples(st.sampled_from("ab"), st.sampled_from(["f1", "f2"]), st.sampled_from(["queued", "Delivered", "ERROR"]),
              st.integers(0, 3)), min_size=1, max_size=10)


@settings(max_examples=5, deadline=None)
@given(EVENTS, st.integers(0, 10))
def test_one_batch_or_two_give_the_same_links(spark, events, cut):
    rows = [("c", k, f, s, None, minute(m)) for k, f, s, m in events]
    base = spark.createDataFrame([("c", k, "SENT", None, None, None, None, None) for k in "ab"], TABLES["campaign_link"])
    fold = lambda part: delivery.fold_events(spark.createDataFrame(part, EVENT))
    whole = links.overlay(base, fold(rows))
    parts = links.overlay(base, fold(rows[:cut]).unionByName(fold(rows[cut:])))
    read = lambda df: sorted((r.referralSourceId, r.status, r.response, r.responseAt) for r in df.collect())
    key = lambda rows_: [tuple(str(v) for v in r) for r in rows_]
    assert key(read(whole)) == key(read(parts))


def test_recent_stream(spark, tmp_path):
    root, new = str(tmp_path / "db"), tmp_path / "new"

    def inter(n, day):
        return {"id": f"i{n}", "referralSourceId": "s", "type": "CALL", "date": f"2024-01-{day:02d}T00:00:00"}

    old = spark.createDataFrame([(f"o{d}", "s", "CALL", datetime(2024, 1, d)) for d in range(1, 8)],
                                "id string, referralSourceId string, type string, date timestamp_ntz")
    src = spark.createDataFrame([("s", "Source")], "id string, name string")
    commit(spark, root, {"interaction": conform(old, "interaction"), "referral_source": conform(src, "referral_source")}, "v0")

    def refresh():
        recent.run_recent_stream(spark, str(new), root, str(tmp_path / "ckpt"), k=3, available_now=True).awaitTermination()
        return [r.id for r in recent.recent_list(spark, root).orderBy("date", ascending=False).collect()]

    land(new, "1.json", inter(1, 20), inter(2, 2))
    assert refresh() == ["i1", "o7", "o6"]
    land(new, "2.json", inter(3, 10))
    assert refresh() == ["i1", "i3", "o7"]
    assert read_entity(spark, root, "interaction").count() == 10
    # rows removed meanwhile leave fewer than k above the old bound: the whole table is read again
    fewer = read_entity(spark, root, "interaction").where("id not in ('i1', 'i3', 'o7')")
    write_snapshot(fewer, root, "interaction", "less")
    land(new, "3.json", inter(4, 1))
    assert refresh() == ["o6", "o5", "o4"]


def test_recent_list_follows_every_commit(spark, tmp_path):
    root = str(tmp_path / "db")

    def rows(*days):
        df = spark.createDataFrame([(f"o{d}", "s", "CALL", datetime(2024, 1, d)) for d in days],
                                   "id string, referralSourceId string, type string, date timestamp_ntz")
        return conform(df, "interaction")

    src = conform(spark.createDataFrame([("s", "Source")], "id string, name string"), "referral_source")
    commit(spark, root, {"interaction": rows(1, 2, 3), "referral_source": src}, "v0")

    def refresh():
        recent.run_recent_list(spark, root, str(tmp_path / "ckpt"), k=2, available_now=True).awaitTermination()
        return [r.id for r in recent.recent_list(spark, root).orderBy("date", ascending=False).collect()]

    assert refresh() == ["o3", "o2"]
    commit(spark, root, {"interaction": rows(9)}, "v1", append=["interaction"])
    assert refresh() == ["o9", "o3"]
    version = latest_version(spark, root)
    assert refresh() == ["o9", "o3"] and latest_version(spark, root) == version, "lists don't set each other off"
    commit(spark, root, {"interaction": read_entity(spark, root, "interaction").where("id <> 'o9'")}, "v2")
    assert refresh() == ["o3", "o2"]


def test_broken_lines_and_unknown_sources_are_kept_apart(spark, tmp_path):
    root, good = str(tmp_path / "db"), {"referralSourceId": "s", "type": "CALL", "date": "2024-01-05T00:00:00"}
    src = conform(spark.createDataFrame([("s", "Source")], "id string, name string"), "referral_source")
    commit(spark, root, {"referral_source": src}, "v0")
    land(tmp_path / "new", "1.json", {"id": "a", **good}, "{broken", {"id": "b", **good, "referralSourceId": "gone"},
         {"id": "c", **good, "type": ""}, {"id": "d", "referralSourceId": "s", "type": "CALL"}, {"id": "e", "type": "CALL"})

    def run_recent(folder):
        recent.run_recent_stream(spark, str(tmp_path / "new"), root, str(tmp_path / folder), available_now=True).awaitTermination()
        assert [r.id for r in read_entity(spark, root, "interaction").collect()] == ["a"]
        return sorted((r.id or "", r.line or "", r.reason) for r in recent.dead_interactions(spark, root).collect())

    found = run_recent("ckpt")
    assert found == [
        ("", "{broken", "Failed to create interaction"), ("b", "", "Failed to create interaction"),
        ("c", "", "Interaction type is required"), ("d", "", "Interaction date is required"),
        ("e", "", "Referral source ID is required")]
    assert run_recent("other") == found


def test_work_goes_to_the_shared_folder(spark):
    class Bare:
        """A session without the setting."""

        class conf:
            get = staticmethod(lambda key, default=None: default)

    shared = spark.conf.get("spark.checkpoint.dir")
    assert shared and shared_folder(spark, "x") == f"{shared}/x"
    assert not shared_folder(Bare, "x").startswith(shared)


def test_a_local_folder_is_refused_on_a_cluster():
    class Session:
        def __init__(self, **settings):
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: settings.get(key, default))})

    def folder(master, warehouse, checkpoint=None):
        return shared_folder(Session(**{"spark.master": master, "spark.sql.warehouse.dir": warehouse,
                                        "spark.checkpoint.dir": checkpoint}), "x")

    for warehouse in ("file:/w", "/w", "spark-warehouse"):
        with pytest.raises(ValueError, match="of one machine"):
            folder("yarn", warehouse)
        assert folder("local[4]", warehouse) == f"{warehouse}/_shared/x"
        assert folder("yarn", warehouse, "hdfs://n/c/") == "hdfs://n/c/x"
    assert folder("k8s://h", "s3a://b/w/") == "s3a://b/w/_shared/x"


def test_checkpoint_defaults_to_the_shared_folder(spark, tmp_path):
    root = str(tmp_path / "db")
    setup(spark, root, "a")
    land(tmp_path / "in", "1.json", event("a", "Delivered", 1))
    delivery.run_delivery_stream(spark, str(tmp_path / "in"), root, name="defaulted").awaitTermination()
    assert state(spark, root) == {"a": ("SENT", minute(1))}
    assert Path(checkpoint_folder(spark, root, "defaulted"), "offsets").is_dir()


def test_table_not_there_yet_costs_no_join(spark, tmp_path):
    landed = read_entity(spark, str(tmp_path / "db"), links.LANDED, schema=links.LANDED_SCHEMA)
    files = spark.range(5).selectExpr("concat('f', id) AS file")
    left = files.join(landed.where("stream <> 's'").select("file"), "file", "left_anti")
    assert left.count() == 5 and "Join" not in left._jdf.queryExecution().executedPlan().toString()


def test_fold_carries_nothing_twice(spark):
    """An event's moment, fax id and status travel once; ties go by them, in this order."""
    rows = [("c", "a", "f1", "sent", "e", START), ("c", "a", "f2", "Failed", None, START), ("c", "a", "f2", "Delivered", "x", START),
            ("c", "a", "f9", "queued", None, START - timedelta(minutes=1)), ("c", "b", "f1", "odd", None, None)]
    folded = delivery.fold_events(spark.createDataFrame(rows, EVENT))
    assert "max_by" not in folded._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.referralSourceId, r.status, r.faxId, r.eventStatus, r.receivedAt, r.responseAt) for r in folded.collect()) == [
        ("a", "FAILED", "f2", "Failed", START, START), ("b", "PENDING", "f1", "odd", None, None)]


def test_stream_query_packs_its_landing(spark):
    from checks.flows import _run_delivery

    events = spark.createDataFrame([("f1", "Delivered", "c", "a", START), ("f2", "queued", "c", "z", START)],
                                   "faxId string, status string, campaignId string, referralSourceId string, receivedAt timestamp_ntz")
    link = spark.createDataFrame([("c", "a", "SENT")], "campaignId string, referralSourceId string, status string")
    _, root = _run_delivery(events, link)
    assert [r.faxId for r in links.dead_letters(spark, root).collect()] == ["f2"]
    landed = [f.name for f in Path(root).parent.joinpath("events").iterdir() if f.name.startswith("part-")]
    assert landed and all(name.endswith(".json.gz") for name in landed)
