"""Plan shapes that carry the jobs to large tables."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from caretrail.operators import aggregates, filters, guards, joins, places, sorting
from caretrail.plans import deletes, dispatch, patches
from caretrail.schemas import LINK_KEY, conform
from caretrail.sources.tables import lookup
from caretrail.streaming import delivery
from checks import CHECKS
from checks.reads import campaign_recipient_lists
from checks.views import view

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def physical(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


@pytest.fixture
def stored(spark, tmp_path):
    """Views as parquet tables, so that pushdown can be seen."""

    def store(name):
        path = str(tmp_path / name)
        view(spark, SF_DIR, name).write.parquet(path)
        return spark.read.parquet(path)

    return store


@pytest.fixture
def no_broadcast(spark):
    """As if every side were large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", [n for n in CHECKS if not n.startswith("streamed")])
def test_no_cross_join_and_no_python(spark, name):
    text = plan(CHECKS[name].run(spark, SF_DIR))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert node not in text


def test_filters_and_columns_reach_the_scan(stored):
    inter = stored("interaction")
    text = physical(filters.interactions_of(inter, "rs7").select("id", "date"))
    assert "EqualTo(referralSourceId,rs7)" in text
    assert "ReadSchema: struct<id:string,referralSourceId:string,date:timestamp_ntz>" in text
    text = physical(places.places_near(stored("place_listing"), stored("gazetteer"), "NATION_7, NC", "econ"))
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(lat,3\d\.\d+\), LessThanOrEqual\(lat,3\d\.\d+\)", text)


def test_totals_read_no_column(stored):
    text = physical(aggregates.table_totals(*[stored(n) for n in ("referral_source", "interaction", "campaign")]))
    assert text.count("ReadSchema: struct<>") == 3


def test_top_k_is_cut_before_the_join(stored):
    text = plan(sorting.recent_interactions(stored("interaction"), stored("referral_source")))
    assert text.count("TakeOrderedAndProject") == 2 and "rangepartitioning" not in text


def test_counts_are_combined_before_the_exchange(no_broadcast, stored):
    text = plan(aggregates.campaign_recipient_counts(stored("campaign"), stored("campaign_link")))
    assert re.search(r"Exchange hashpartitioning.*\n.*partial_count", text)


def smj(text):
    """(join type, whether the left input of each sort-merge join reads links)."""
    return re.findall(r"SortMergeJoin\s*(?:\(skew=true\)\s*)?\[.*?\], \[.*?\], (\w+)", text)


def test_hot_sides_can_be_split(no_broadcast, stored):
    """Skew handling splits either side of an inner join, but only the left one of an outer or anti join."""
    camp, link, src = (stored(n) for n in ("campaign", "campaign_link", "referral_source"))
    kinds = smj(plan(joins.campaign_recipients(camp, link, src)))
    assert sorted(kinds) == ["Inner", "LeftAnti", "LeftOuter"] and "RightOuter" not in kinds
    box = dispatch.build_outbox(conform(camp, "campaign"), link, src, dispatch.DispatchConfig())
    assert set(smj(plan(box.outbox))) == {"Inner"}


def skewed(spark, hot, rest):
    """Campaign links where one campaign holds ``hot`` rows, and ``rest`` campaigns one row each."""
    n = F.col("id")
    return spark.range(hot + rest).select(
        F.when(n < hot, "big").otherwise(F.concat(F.lit("c"), n - hot)).alias("campaignId"),
        F.when(n < hot, F.concat(F.lit("s"), n)).otherwise("s1").alias("referralSourceId"),
        F.lit("PENDING").alias("status"),
    )


@pytest.fixture
def split_small(spark):
    """Skew handling at the size of a test."""
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.forceOptimizeSkewedJoin": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value) if value else spark.conf.unset(key)


def hot_jobs(spark):
    """Jobs over links where one campaign has two thirds of the rows: (frame, its number of rows)."""
    link = conform(skewed(spark, 60_000, 30_000), "campaign_link").withColumn("response", F.sha2("referralSourceId", 256))
    names = spark.range(30_000).select(F.concat(F.lit("c"), "id").alias("id")).union(spark.createDataFrame([("big",)], "id string"))
    camp = names.withColumn("name", F.col("id"))
    src = spark.range(60_000).select(F.concat(F.lit("s"), "id").alias("id"), F.lit("n").alias("name"))
    gone = names.where("id <> 'big'").limit(10_000).select("id", F.col("id").alias("requestId"))
    lists = names.select(F.col("id").alias("campaignId"), F.array(F.lit("s1")).alias("referralSourceIds"))
    events = link.select(*LINK_KEY, F.sha2("referralSourceId", 256).alias("faxId"), F.lit("queued").alias("status"),
                         F.lit("2024-01-01").cast("timestamp_ntz").alias("receivedAt"))
    one = events.withColumn("referralSourceId", F.lit("s1"))
    return {
        "recipients": (joins.campaign_recipients(camp, link, src).select("campaignId", "source.id", "link.response"), 90_000),
        "pages": (joins.campaign_recipients(camp, link, src, nested=True, page_size=1000).select(F.explode("recipients")), 90_000),
        "delete": (deletes.delete_campaigns(gone, camp, link).links, 80_000),
        "sync": (patches.sync_recipients(lists, link, "2024-01-01 00:00:00", src).removed, 59_999),
        "lookup": (lookup(link, names.select(F.col("id").alias("campaignId")), "campaignId"), 90_000),
        "outbox": (dispatch.build_outbox(camp.withColumn("documentUrl", F.lit("/d")), link,
                                         src.withColumn("faxNumber", F.lit("1")), dispatch.DispatchConfig()).outbox, 90_000),
        "dead events": (delivery.apply_events(one, link.where("referralSourceId = 's1' and campaignId <> 'big'"))[1], 60_000),
        "known requests": (guards.guard_exists(link.withColumnRenamed("campaignId", "id"), camp, "id")[0], 90_000),
    }


@pytest.mark.parametrize(
    "job", ["recipients", "pages", "delete", "sync", "lookup", "outbox", "dead events", "known requests"])
def test_a_hot_key_is_split(spark, no_broadcast, split_small, job):
    df, expected = hot_jobs(spark)[job]
    assert len(df.collect()) == expected
    assert "skew=true" in plan(df), job


def test_a_hot_campaign_is_paged(spark, no_broadcast):
    link = skewed(spark, 5_000, 20)
    camp = link.select(F.col("campaignId").alias("id")).distinct().unionByName(spark.createDataFrame([("none",)], "id string"))
    src = spark.range(5_000).select(F.concat(F.lit("s"), "id").alias("id"))
    pages = joins.campaign_recipients(camp, link, src, nested=True, page_size=100)
    rows = pages.select("campaignId", "page", "pages", F.size("recipients").alias("n"), "recipients.referralSourceId").collect()
    hot = sorted((r for r in rows if r.campaignId == "big"), key=lambda r: r.page)
    assert [i for r in hot for i in r.referralSourceId] == sorted(f"s{i}" for i in range(5_000))
    assert {(r.pages, r.n) for r in hot} == {(50, 100)}
    assert [(r.page, r.n) for r in rows if r.campaignId == "c7"] == [(0, 1)]
    assert [(r.page, r.n) for r in rows if r.campaignId == "none"] == [(0, 0)]
    assert "hashpartitioning(campaignId, page" in re.sub(r"#\d+", "", plan(pages))


def test_recipient_pages_hold_a_thousand_at_every_size(spark):
    sizes = {"a": 1_000, "b": 1_001, "c": 2_500, "d": 0, "e": 1}
    camp = spark.createDataFrame([(c,) for c in sizes], "id string")
    link = spark.createDataFrame([(c, f"s{i}") for c, n in sizes.items() for i in range(n)],
                                 "campaignId string, referralSourceId string")
    src = spark.range(2_499).select(F.concat(F.lit("s"), "id").alias("id"), F.concat(F.lit("n"), "id").alias("name"))
    rows = sorted(tuple(r) for r in campaign_recipient_lists(camp, link, src, 1_000).collect())
    name = lambda i: f"{i}:{'n' + i[1:] if i != 's2499' else '?'}"
    want = []
    for c, n in sizes.items():
        ids, pages = sorted(f"s{i}" for i in range(n)), max(1, -(-n // 1_000))
        want += [(c, p, pages, n, len(part := ids[p * 1_000:(p + 1) * 1_000]), ",".join(map(name, part))) for p in range(pages)]
    assert rows == want


def test_recipient_lists_carry_only_what_they_show(spark, no_broadcast):
    """A row's links and sources move several times on their way into pages: columns nobody reads stay behind."""
    camp = spark.createDataFrame([("a",), ("none",)], "id string")
    link = spark.createDataFrame([("a", "s1", "SENT"), ("a", "s2", "SENT")], "campaignId string, referralSourceId string, status string")
    src = spark.createDataFrame([("s1", "n1", "road")], "id string, name string, address string")
    pages = campaign_recipient_lists(camp, link, src, 1)
    assert sorted(tuple(r) for r in pages.collect()) == [
        ("a", 0, 2, 2, 1, "s1:n1"), ("a", 1, 2, 2, 1, "s2:?"), ("none", 0, 1, 0, 0, "")]
    carried = plan(pages)
    assert "address" not in carried and "status" not in carried and "createdAt" not in carried


def test_many_patches_of_one_row_are_folded_first(spark, no_broadcast):
    src = spark.range(10).select(F.concat(F.lit("s"), "id").alias("id"), F.lit("n").alias("name"))
    req = spark.range(2_000).select(
        F.concat(F.lit("r"), "id").alias("requestId"), F.col("id").alias("seq"),
        F.when(F.col("id") < 1_900, "s3").otherwise("s4").alias("id"),
        F.concat(F.lit('{"notes":"'), "id", F.lit('"}')).alias("body"))
    change = patches.patch_sources(req, conform(src, "referral_source"), "2024-01-01 00:00:00")
    assert change.table.where("id = 's3'").first().notes == "1899" and change.table.count() == 10
    assert re.search(r"Exchange hashpartitioning\(id.*\n.*partial_max_by", plan(change.delta))


def test_bodies_are_parsed_once(spark):
    for name in ("patched_sources", "patched_campaigns", "created_campaigns"):
        text = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
        scans = text.count("Relation [")
        assert text.count("from_json(MapType") <= scans


def test_sort_sources_orders_rows(spark):
    schema = ("id string, name string, address string, city string, expectedMonthlyReferrals int, numberOfProviders int, "
              "createdAt timestamp_ntz, clinicLocation struct<name:string>")
    from datetime import datetime

    day = lambda d: datetime(2024, 1, d)
    rows = [("1", "b", None, "x", None, 3, day(1), ("K",)), ("2", "a", "9 St", "", 5, None, day(2), None),
            ("3", None, "1 St", "T", 5, 0, day(3), ("A",))]
    df = spark.createDataFrame(rows, schema)
    order = lambda *a: "".join(r.id for r in sorting.sort_sources(df, *a).collect())
    assert order() == "321" and order("name", "desc") == "123"
    assert order("clinicLocation") == "231" and order("address") == "132" and order("address", "desc") == "231"
    assert order("expectedMonthlyReferrals") == "132" and order("expectedMonthlyReferrals", "desc") == "321"
    assert order("numberOfProviders") == "321" and order("unknown") == "321"


def test_share_is_null_without_campaigns(spark):
    camp = spark.createDataFrame([("PAUSED",)], "status string")
    dist = aggregates.status_share(aggregates.status_distribution(camp))
    assert {(r["name"], r["value"], r["label"]) for r in dist.collect()} == {
        (n, 0, None) for n in ("Active", "Draft", "Completed", "Cancelled")}
