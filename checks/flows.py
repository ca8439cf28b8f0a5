"""Round trips through files, and the streams, on data Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caretrail.jobs import Tables
from caretrail.operators import searches
from caretrail.schemas import LINK_KEY, conform
from caretrail.sources.documents import document_catalog
from caretrail.sources.output import write_json
from caretrail.sources.places import read_geocodes, read_places
from caretrail.sources.requests import read_requests
from caretrail.sources.tables import commit, read_entity, write_snapshot
from caretrail.streaming import delivery, links, recent
from checks.catalog import AS_OF, check, scratch
from checks.changes import SOURCE_PATCHES, _merge

# ---- files ---------------------------------------------------------------------------------------------------------


@check("stored_sources", "S1 S3", "referral_source", "SELECT id, name, city, numberOfProviders FROM referral_source")
def _(src):
    spark, root = src.sparkSession, scratch(src.sparkSession, "tables")
    write_snapshot(conform(src, "referral_source"), root, "referral_source", 1, cluster=True)
    return read_entity(spark, root, "referral_source").select("id", "name", "city", "numberOfProviders")


@check("stored_source_patches", "M5 S3 S4", "source_patch referral_source",
       SOURCE_PATCHES.replace(", seq) FILTER", ", seq + 1000000000 * (seq % 2)) FILTER") + f"""SELECT s.id, {_merge('n', 's.name', 'name')}, {_merge('a', 's.address', 'address')},
         {_merge('t', 'NULL', 'notes')}, {_merge('v', '"numberOfProviders"', 'numberOfProviders')}, s.city
         FROM referral_source s LEFT JOIN p ON p.id = s.id""")
def _(req, src):
    """Patches in two batches, stored as deltas and read with the table."""
    spark, base = req.sparkSession, scratch(req.sparkSession, "patches")
    write_snapshot(conform(src, "referral_source"), f"{base}/tables", "referral_source", 1, cluster=True)
    tables = Tables(spark, f"{base}/tables")
    late = F.col("seq") % 2 == 1
    for n, part in enumerate((req.where(~late), req.where(late))):
        body = F.from_json("body", "map<string,string>")
        part.withColumn("body", body).write.option("ignoreNullFields", "false").json(f"{base}/in{n}")
        tables.patch_sources(f"{base}/in{n}", f"patch-{n}", AS_OF)
    return tables.read("referral_source").select("id", "name", "address", "notes", "numberOfProviders", "city")


@check("requests_read_back", "S4 S7", "source_request",
       """SELECT "requestId", seq, json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.address') AS address,
            NOT json_valid(body) AS broken FROM source_request""")
def _(req):
    spark, path = req.sparkSession, scratch(req.sparkSession, "requests") + "/in"
    # a request file holds the body as it came, so a broken body breaks its line
    head = F.concat(F.lit('{"requestId":"'), "requestId", F.lit('","seq":'), F.col("seq").cast("string"), F.lit(',"body":'))
    req.select(F.concat(head, "body", F.lit("}"))).write.text(path)
    rows = read_requests(spark, path)
    corrupt = F.col("_corrupt_record")
    ids = F.coalesce("requestId", F.regexp_extract(corrupt, '"requestId":"([^"]*)"', 1))
    seq = F.coalesce("seq", F.regexp_extract(corrupt, '"seq":([0-9]+)', 1).try_cast("long"))
    broken = corrupt.isNotNull()
    return rows.select(
        ids.alias("requestId"), seq.alias("seq"),
        F.when(~broken, F.get_json_object("body", "$.address")).alias("address"), broken.alias("broken"))


@check("document_catalog", "S6 X10", "clinic_location",
       """SELECT id AS folder, 'txt' AS extension, CAST(length(name) + 1 AS BIGINT) AS size, true AS placed
          FROM clinic_location""")
def _(clinic):
    """One document for each clinic, landed in a folder of its own."""
    spark, path = clinic.sparkSession, scratch(clinic.sparkSession, "uploads") + "/in"
    clinic.select("id", F.col("name").alias("value")).repartition("id").write.partitionBy("id").text(path)
    files = document_catalog(spark, path).where(~F.col("originalName").startswith("_"))
    named = F.col("storedName").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}[.]txt$")
    return files.select(
        F.regexp_extract("path", "id=([^/]+)/", 1).alias("folder"), "extension", "size",
        (named & (F.col("url") == F.concat(F.lit("/uploads/"), "storedName"))).alias("placed"))


@check("listings_read_back", "S5 S7", "place_listing",
       "SELECT place_id, name, rating, round(lat, 6) AS lat, round(lng, 6) AS lng FROM place_listing")
def _(listing):
    spark, path = listing.sparkSession, scratch(listing.sparkSession, "places") + "/pages"
    result = F.struct(
        "place_id", "name", "formatted_address", "rating", "user_ratings_total",
        F.struct(F.struct("lat", "lng").alias("location")).alias("geometry"))
    # pages of at most 20 listings, as the service sends them
    page = F.floor(F.substring("place_id", 2, 20).cast("long") / 20)
    pages = listing.groupBy(page.alias("page")).agg(F.collect_list(result).alias("results"))
    write_json(pages.select(F.lit("OK").alias("status"), "results"), path)
    return read_places(spark, path).select(
        "place_id", "name", "rating", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def _located(search, answers):
    """Searches and the geocoder's answers for their places, which are read back from what was landed."""
    spark, path = answers.sparkSession, scratch(answers.sparkSession, "geocodes") + "/answers"
    component = F.struct(F.array(F.lit("political"), "kind").alias("types"))
    result = F.struct(
        "formatted_address", F.when(~F.col("bare"), F.array(component)).alias("address_components"),
        F.struct(F.when(F.col("lat").isNotNull(), F.struct("lat", "lng")).alias("location")).alias("geometry"))
    none = F.array().cast(f"array<{answers.select(result.alias('r')).schema['r'].dataType.simpleString()}>")
    landed = F.when(F.col("status") == "OK", F.array(result)).otherwise(none)
    write_json(answers.select("place", "status", landed.alias("results")), path)
    return searches.located_searches(search, read_geocodes(spark, path))


LOCATED = """WITH asked AS (SELECT s.requestId AS "requestId", s.businessType AS word, coalesce(s.minRating, 0) AS least,
      coalesce(s.radius, 50000) AS radius, g.formatted_address AS location, g.lat, g.lng, g.kind,
      CASE WHEN s.location = '' OR s.businessType IS NULL THEN 'Location and business type are required'
        WHEN g.place IS NULL OR g.status <> 'OK' OR g.lat IS NULL THEN 'Failed to geocode location'
        WHEN g.bare THEN 'Failed to search businesses' END AS reason
    FROM place_search s LEFT JOIN geocode_answer g ON g.place = s.location)
"""


@check("located_searches", "S5 F8 J11", "place_search geocode_answer",
       LOCATED + """SELECT "requestId", location, round(lat, 4) AS lat, round(lng, 4) AS lng, CAST(radius AS INT) AS radius,
         kind = 'administrative_area_level_1' AS "isStateSearch" FROM asked WHERE reason IS NULL""")
def _(search, answers):
    shown = searches.search_metadata(_located(search, answers)[0])
    return shown.select("requestId", "location", F.round("coordinates.lat", 4).alias("lat"),
                        F.round("coordinates.lng", 4).alias("lng"), "radius", "isStateSearch")


@check("rejected_searches", "S5 J11", "place_search geocode_answer",
       LOCATED + 'SELECT "requestId", reason FROM asked WHERE reason IS NOT NULL')
def _(search, answers):
    return _located(search, answers)[1]


@check("searched_listings", "S5 J11 F7", "place_search geocode_answer place_listing",
       LOCATED + """, far AS (SELECT a."requestId", p.place_id, a.radius,
           2 * 6371000.0 * asin(sqrt(pow(sin(radians(p.lat - a.lat) / 2), 2)
             + cos(radians(p.lat)) * cos(radians(a.lat)) * pow(sin(radians(p.lng - a.lng) / 2), 2))) AS metres
         FROM asked a JOIN place_listing p ON p.rating >= a.least
           AND (contains(lower(p.name), lower(a.word)) OR contains(lower(p.primary_type), lower(a.word)))
         WHERE a.reason IS NULL)
       SELECT "requestId", place_id, round(metres / 1000, 3) AS km FROM far WHERE metres <= radius""")
def _(search, answers, listing):
    found = searches.searched_listings(_located(search, answers)[0], listing)
    return found.select("requestId", "place_id", F.round(F.col("distance") / 1000, 3).alias("km"))


# ---- events --------------------------------------------------------------------------------------------------------

EVENTS = """WITH good AS (SELECT e.*, CASE WHEN upper(e.status) IN ('DELIVERED', 'COMPLETED') THEN 'SENT'
      WHEN upper(e.status) IN ('FAILED', 'ERROR') THEN 'FAILED' ELSE 'PENDING' END AS mapped
    FROM delivery_event e JOIN campaign_link l
      ON l.campaignId = e.campaignId AND l.referralSourceId = e.referralSourceId),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY campaignId, referralSourceId
      ORDER BY receivedAt DESC, faxId DESC, status DESC) AS n,
      max(CASE WHEN mapped IN ('SENT', 'FAILED') THEN receivedAt END)
        OVER (PARTITION BY campaignId, referralSourceId) AS responded FROM good)
"""


@check("folded_events", "T2 J9 X20", "delivery_event campaign_link",
       EVENTS + """SELECT campaignId, referralSourceId, mapped AS status, responded AS "responseAt", faxId, status AS event
         FROM ranked WHERE n = 1""")
def _(ev, link):
    changes, _dead = delivery.apply_events(ev, link)
    return changes.select(
        *LINK_KEY, "status", "responseAt", "faxId", F.col("eventStatus").alias("event"))


DEAD = """SELECT e.faxId, e.status, e.campaignId, e.referralSourceId, CASE WHEN e.campaignId IS NULL
    THEN 'Missing required fields' ELSE 'Unknown campaign link' END AS reason
  FROM delivery_event e LEFT JOIN campaign_link l
    ON l.campaignId = e.campaignId AND l.referralSourceId = e.referralSourceId WHERE l.campaignId IS NULL"""


@check("dead_events", "T3", "delivery_event campaign_link", DEAD)
def _(ev, link):
    return delivery.split_invalid(ev, link)[1].select("faxId", "status", *LINK_KEY, "reason")


def _run_delivery(ev, link):
    """Land the events as files, run the stream over them in several batches, return the table root."""
    spark, base = ev.sparkSession, scratch(ev.sparkSession, "delivery")
    landed, root = f"{base}/events", f"{base}/tables"
    write_snapshot(conform(link, "campaign_link"), root, "campaign_link", 0)
    body = ev.select("faxId", "status", F.struct(*LINK_KEY).alias("metadata"), "receivedAt")
    # packed, and in files of a bounded size, as a packed file is read by one task
    packed = {"compression": "gzip", "maxRecordsPerFile": 1_000_000}
    body.write.options(timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS", **packed).json(landed)
    files = len(spark.read.format("binaryFile").load(landed).inputFiles())
    query = delivery.run_delivery_stream(
        spark, landed, root, f"{base}/checkpoint", files_per_trigger=max((files + 1) // 2, 1))
    query.awaitTermination()
    return spark, root


@check("streamed_links", "T1 T2 S8 S9", "delivery_event campaign_link",
       EVENTS + """SELECT l.campaignId, l.referralSourceId, coalesce(r.mapped, l.status) AS status,
         r.responded AS "responseAt", r.faxId AS fax FROM campaign_link l LEFT JOIN ranked r
         ON r.n = 1 AND r.campaignId = l.campaignId AND r.referralSourceId = l.referralSourceId""")
def _(ev, link):
    spark, root = _run_delivery(ev, link)
    links.compact_links(spark, root, "compact-1")
    return links.current_links(spark, root).select(
        *LINK_KEY, "status", "responseAt", F.get_json_object("response", "$.faxId").alias("fax"))


@check("streamed_dead_letters", "T1 T3", "delivery_event campaign_link", DEAD)
def _(ev, link):
    spark, root = _run_delivery(ev, link)
    return delivery.dead_letters(spark, root).select("faxId", "status", *LINK_KEY, "reason")


@check("streamed_recent_interactions", "T4 O5", "interaction referral_source",
       """SELECT i.id, i.date, s.name AS source_name FROM interaction i
          JOIN referral_source s ON s.id = i.referralSourceId ORDER BY i.date DESC, i.id LIMIT 5""")
def _(inter, src):
    spark, base = inter.sparkSession, scratch(inter.sparkSession, "recent")
    root, landed = f"{base}/tables", f"{base}/new"
    rows = conform(inter, "interaction")
    arriving = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    commit(spark, root, {"interaction": rows.where(~arriving), "referral_source": conform(src, "referral_source")}, "v0")
    whole = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    rows.where(arriving).repartition(4).write.options(**whole).json(landed)
    query = recent.run_recent_stream(spark, landed, root, f"{base}/checkpoint", available_now=True, files_per_trigger=2)
    query.awaitTermination()
    return recent.recent_list(spark, root).select("id", "date", F.col("sourceName").alias("source_name"))
