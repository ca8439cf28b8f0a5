"""Reads: filters, joins, counts, sorts, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from caretrail.operators import aggregates, filters, guards, joins, places, sets, sorting
from caretrail.sources.tables import lookup
from checks.catalog import check

# ---- filters -------------------------------------------------------------------------------------------------------


@check("interactions_of_source", "F1", "interaction",
       "SELECT id, type, date FROM interaction WHERE referralSourceId = 'rs7'")
def _(inter):
    return filters.interactions_of(inter, "rs7").select("id", "type", "date")


@check("active_clinics", "F2", "clinic_location", "SELECT id, name FROM clinic_location WHERE isActive")
def _(clinic):
    return filters.active_clinics(clinic).select("id", "name")


@check("sources_of_clinic", "F3", "referral_source",
       "SELECT id, name, city FROM referral_source WHERE clinicLocationId = 'cl3'")
def _(src):
    return filters.sources_of_clinic(src, "cl3").select("id", "name", "city")


@check("searched_sources", "F4", "referral_source",
       """SELECT id, name, contactPerson FROM referral_source
          WHERE contains(lower(name), 'tact 1') OR coalesce(contains(lower(contactPerson), 'tact 1'), false)""")
def _(src):
    return filters.search_sources(src, "TACT 1").select("id", "name", "contactPerson")


@check("campaign_candidates", "F5", "referral_source",
       """SELECT id, name FROM referral_source WHERE clinicLocationId = 'cl3'
          AND (contains(lower(name), '1') OR coalesce(contains(lower(contactPerson), '1'), false))""")
def _(src):
    return filters.campaign_candidates(src, "cl3", "1").select("id", "name")


@check("relation_projection", "F6", "referral_source", "SELECT id, name, contactPerson FROM referral_source")
def _(src):
    return filters.project_relation(src, ["id", "name", "contactPerson"])


@check("rated_listings", "F7", "place_listing", "SELECT place_id, rating FROM place_listing WHERE rating >= 3.5")
def _(places_):
    return filters.min_rating(places_, 3.5).select("place_id", "rating")


@check("state_searches", "F8", "geocode_component",
       """SELECT place_id,
            (kind1 = 'administrative_area_level_1' OR kind2 = 'administrative_area_level_1')
            AND kind1 <> 'locality' AND kind2 NOT IN ('locality', 'postal_code') AS is_state
          FROM geocode_component""")
def _(found):
    components = F.array(
        F.struct(F.array("kind1", F.lit("political")).alias("types")), F.struct(F.array("kind2").alias("types"))
    )
    return found.select("place_id", filters.is_state_search(components).alias("is_state"))


def details_frame(details):
    """Detail view in the shape of the service's answer."""
    return details.select(
        "place_id", "status",
        F.struct(
            "name", "formatted_address", "rating", "user_ratings_total", F.col("phone").alias("formatted_phone_number"),
            "website", F.array("kind", F.lit("health")).alias("types"), F.lit(None).cast("struct<lat:double,lng:double>").alias("location"),
        ).alias("result"),
    )


ENRICHED = """SELECT d.place_id AS id, d.name, d.formatted_address AS address, d.rating,
  d.user_ratings_total AS "userRatingsTotal", d.phone, d.website, concat(d.kind, '|health') AS types
FROM place_listing l JOIN place_detail d USING (place_id)"""


def _shown(df):
    return df.select("id", "name", "address", "rating", "userRatingsTotal", "phone", "website",
                     F.array_join("types", "|").alias("types"))


@check("enriched_listings", "J10", "place_listing place_detail", ENRICHED)
def _(listing, detail):
    return _shown(places.enrich_listings(listing, details_frame(detail)))


@check("valid_details", "F9 J10", "place_listing place_detail", ENRICHED + " WHERE d.status = 'OK'")
def _(listing, detail):
    return _shown(filters.valid_details(places.enrich_listings(listing, details_frame(detail))))


RECIPIENTS = """SELECT l.campaignId, l.referralSourceId, s.faxNumber
FROM campaign_link l JOIN referral_source s ON s.id = l.referralSourceId"""


@check("sendable_recipients", "F10", "campaign_link referral_source",
       RECIPIENTS + " WHERE coalesce(s.faxNumber, '') <> ''")
def _(link, src):
    fax = src.select(F.col("id").alias("referralSourceId"), "faxNumber")
    rows = link.select("campaignId", "referralSourceId").join(fax, "referralSourceId")
    return filters.split_sendable(rows)[0].select("campaignId", "referralSourceId", "faxNumber")


@check("skipped_recipients", "F10", "campaign_link referral_source",
       f"SELECT campaignId, referralSourceId, 'No fax number provided' AS error FROM ({RECIPIENTS}) "
       "WHERE coalesce(faxNumber, '') = ''")
def _(link, src):
    fax = src.select(F.col("id").alias("referralSourceId"), "faxNumber")
    rows = link.select("campaignId", "referralSourceId").join(fax, "referralSourceId")
    return filters.split_sendable(rows)[1].select("campaignId", "referralSourceId", "error")


@check("campaigns_without_document", "F11", "campaign",
       """SELECT id, 'Campaign does not have a document to send' AS reason FROM campaign
          WHERE coalesce(documentUrl, '') = ''""")
def _(camp):
    return filters.has_document(camp)[1].select("id", "reason")


# ---- joins ---------------------------------------------------------------------------------------------------------


@check("sources_enriched", "J1 O1", "referral_source clinic_location referral_category",
       """SELECT s.id, s.name, c.name AS clinic, c.isActive AS clinic_active, g.name AS category, s.createdAt
          FROM referral_source s LEFT JOIN clinic_location c ON c.id = s.clinicLocationId
          LEFT JOIN referral_category g ON g.id = s.categoryId""")
def _(src, clinic, cat):
    rows = joins.sources_enriched(src, clinic, cat).select(
        "id", "name", F.col("clinicLocation.name").alias("clinic"),
        F.col("clinicLocation.isActive").alias("clinic_active"), F.col("category.name").alias("category"), "createdAt",
    )
    return sorting.newest_first(rows)


@check("interactions_enriched", "J2 O2", "interaction referral_source",
       """SELECT i.id, i.type, i.date, s.id AS source_id, s.name AS source_name
          FROM interaction i JOIN referral_source s ON s.id = i.referralSourceId""")
def _(inter, src):
    rows = sorting.latest_interactions(joins.interactions_enriched(inter, src))
    return rows.select("id", "type", "date", F.col("referralSource.id").alias("source_id"),
                       F.col("referralSource.name").alias("source_name"))


@check("campaign_recipients", "J3", "campaign campaign_link referral_source",
       """SELECT c.id AS campaign_id, c.name AS campaign_name, l.referralSourceId AS link_source, l.status AS link_status,
            s.name AS source_name
          FROM campaign c LEFT JOIN campaign_link l ON l.campaignId = c.id
          LEFT JOIN referral_source s ON s.id = l.referralSourceId""")
def _(camp, link, src):
    return joins.campaign_recipients(camp, link, src).select(
        F.col("campaignId").alias("campaign_id"), F.col("campaign.name").alias("campaign_name"),
        F.col("link.referralSourceId").alias("link_source"), F.col("link.status").alias("link_status"),
        F.col("source.name").alias("source_name"),
    )


def _pages(keys: str, rows: str, size: int) -> str:
    """Twin of nesting: ``rows`` (key, item id, item text) of all ``keys`` in pages of ``size`` in id order."""
    return f"""WITH r AS (SELECT k.key, t.id, t.item, row_number() OVER (PARTITION BY k.key ORDER BY t.id) - 1 AS n,
        count(t.id) OVER (PARTITION BY k.key) AS total FROM ({keys}) k LEFT JOIN ({rows}) t ON t.key = k.key)
      SELECT key, CAST(n // {size} AS INT) AS page, CAST(greatest(ceil(total / {size}), 1) AS INT) AS pages, total,
        count(id) AS items, coalesce(string_agg(item, ',' ORDER BY id) FILTER (id IS NOT NULL), '') AS names
      FROM r GROUP BY key, n // {size}, total"""


RECIPIENT_PAGE, ROSTER_PAGE = 3, 100


@check("campaign_recipient_lists", "J3", "campaign campaign_link referral_source",
       _pages("SELECT id AS key FROM campaign",
              "SELECT l.campaignId AS key, l.referralSourceId AS id, concat(l.referralSourceId, ':', coalesce(s.name, '?')) AS item "
              "FROM campaign_link l LEFT JOIN referral_source s ON s.id = l.referralSourceId", RECIPIENT_PAGE))
def campaign_recipient_lists(camp, link, src, page_size=RECIPIENT_PAGE):
    """Pages of one size at any number of recipients, in id order, with the campaign's whole number of them."""
    pages = joins.campaign_recipients(
        camp, link, src, nested=True, page_size=page_size, link_cols=["referralSourceId"], source_cols=["name"])
    names = F.transform("recipients", lambda r: F.concat(
        r["referralSourceId"], F.lit(":"), F.coalesce(r["source"]["name"], F.lit("?"))))
    return pages.select(F.col("campaignId").alias("key"), "page", "pages", "total", F.size("recipients").cast("long").alias("items"),
                        F.array_join(names, ",").alias("names"))


@check("clinic_roster_pages", "J4", "clinic_location referral_source",
       _pages("SELECT id AS key FROM clinic_location",
              "SELECT clinicLocationId AS key, id, concat(id, ':', name, ':', coalesce(contactPerson, '')) AS item "
              "FROM referral_source", ROSTER_PAGE))
def _(clinic, src):
    full = src.withColumn("contactPhone", F.lit(None).cast("string"))
    pages = joins.clinic_roster(clinic, full, nested=True, page_size=ROSTER_PAGE)
    names = F.transform("sources", lambda r: F.concat(
        r["id"], F.lit(":"), r["name"], F.lit(":"), F.coalesce(r["contactPerson"], F.lit(""))))
    return pages.select(F.col("clinicLocationId").alias("key"), "page", "pages", "total",
                        F.size("sources").cast("long").alias("items"), F.array_join(names, ",").alias("names"))


@check("clinic_roster", "J4", "clinic_location referral_source",
       """SELECT c.id AS clinic_id, c.name AS clinic, s.id AS source_id, s.name AS source, s.contactPerson AS contact
          FROM clinic_location c LEFT JOIN referral_source s ON s.clinicLocationId = c.id""")
def _(clinic, src):
    full = src.withColumn("contactPhone", F.lit(None).cast("string"))
    return joins.clinic_roster(clinic, full).select(
        F.col("clinicLocationId").alias("clinic_id"), F.col("clinic.name").alias("clinic"),
        F.col("source.id").alias("source_id"), F.col("source.name").alias("source"),
        F.col("source.contactPerson").alias("contact"),
    )


@check("known_patches", "J5", "source_patch referral_source",
       "SELECT p.requestId, p.id, s.id IS NOT NULL AS found FROM source_patch p LEFT JOIN referral_source s ON s.id = p.id")
def _(req, src):
    found, missing = guards.guard_exists(req, src, "id")
    tag = lambda df, flag: df.select("requestId", "id", F.lit(flag).alias("found"))
    return tag(found, True).unionByName(tag(missing, False))


@check("free_clinic_names", "J6", "clinic_request clinic_location",
       """WITH named AS (SELECT requestId, seq, json_extract_string(body, '$.name') AS name FROM clinic_request),
          fresh AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS n FROM named
            WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM clinic_location))
          SELECT requestId, name FROM fresh WHERE n = 1""")
def _(req, clinic):
    named = req.select("requestId", "seq", F.get_json_object("body", "$.name").alias("name"))
    ok, _dup = guards.guard_unique_name(named.where(F.col("name").isNotNull()), clinic)
    return ok.select("requestId", "name")


@check("clinic_of_source_city", "J7", "referral_source clinic_location",
       """SELECT s.id, s.city, (SELECT min_by(c.id, c.name) FROM clinic_location c
            WHERE c.isActive AND s.city <> '' AND contains(lower(s.city), lower(c.name))) AS matched
          FROM referral_source s""")
def _(src, clinic):
    rows = places.match_clinic(src.select("id", "city"), clinic, "city")
    return rows.select("id", "city", F.col("clinicLocationId").alias("matched"))


@check("orphaned_references", "J8",
       "referral_source clinic_location referral_category interaction campaign campaign_link",
       """SELECT 'referral_source.categoryId' AS reference, id AS child, categoryId AS missing FROM referral_source
            WHERE categoryId IS NOT NULL AND categoryId NOT IN (SELECT id FROM referral_category)
          UNION ALL SELECT 'referral_source.clinicLocationId', id, clinicLocationId FROM referral_source
            WHERE clinicLocationId IS NOT NULL AND clinicLocationId NOT IN (SELECT id FROM clinic_location)
          UNION ALL SELECT 'interaction.referralSourceId', id, referralSourceId FROM interaction
            WHERE referralSourceId NOT IN (SELECT id FROM referral_source)
          UNION ALL SELECT 'campaign_link.campaignId', concat(campaignId, '/', referralSourceId), campaignId
            FROM campaign_link WHERE campaignId NOT IN (SELECT id FROM campaign)
          UNION ALL SELECT 'campaign_link.referralSourceId', concat(campaignId, '/', referralSourceId), referralSourceId
            FROM campaign_link WHERE referralSourceId NOT IN (SELECT id FROM referral_source)""")
def _(src, clinic, cat, inter, camp, link):
    from caretrail.schemas import FOREIGN_KEYS, PRIMARY_KEYS

    tables = {"referral_source": src, "clinic_location": clinic, "referral_category": cat, "interaction": inter,
              "campaign": camp, "campaign_link": link}
    return sets.append_pages(*[
        joins.orphans(tables[child], tables[parent], fk).select(
            F.lit(f"{child}.{fk}").alias("reference"), F.concat_ws("/", *PRIMARY_KEYS[child]).alias("child"),
            F.col(fk).alias("missing"))
        for child, fk, parent, _rule in FOREIGN_KEYS
    ])


@check("orphaned_patches", "J8", "source_patch referral_source",
       """SELECT "requestId", id AS "sourceId" FROM source_patch WHERE id NOT IN (SELECT id FROM referral_source)""")
def _(req, src):
    return joins.orphans(req.select("requestId", F.col("id").alias("sourceId")), src, "sourceId")


@check("events_with_links", "J9", "delivery_event campaign_link",
       """SELECT e.faxId, e.status, e.campaignId, e.referralSourceId, l.status AS link_status
          FROM delivery_event e JOIN campaign_link l
          ON l.campaignId = e.campaignId AND l.referralSourceId = e.referralSourceId""")
def _(ev, link):
    return joins.events_to_links(ev, link).select(
        "faxId", "status", "campaignId", "referralSourceId", F.col("linkStatus").alias("link_status"))


@check("places_near", "J11", "place_listing gazetteer",
       """WITH here AS (SELECT lat AS a, lng AS o FROM gazetteer WHERE place = 'NATION_7, NC'),
          far AS (SELECT place_id, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(lat - a) / 2), 2)
              + cos(radians(lat)) * cos(radians(a)) * pow(sin(radians(lng - o) / 2), 2))) AS metres
            FROM place_listing, here
            WHERE contains(lower(name), 'econom') OR contains(lower(primary_type), 'econom'))
          SELECT place_id, round(metres / 1000, 3) AS km FROM far WHERE metres <= 50000""")
def _(listing, gazetteer):
    near = places.places_near(listing, gazetteer, "NATION_7, NC", "Econom")
    return near.select("place_id", F.round(F.col("distance") / 1000, 3).alias("km"))


# ---- aggregates ----------------------------------------------------------------------------------------------------


@check("clinic_source_counts", "A1 O3", "clinic_location referral_source",
       """SELECT c.id, c.name, count(s.id) AS sources FROM clinic_location c
          LEFT JOIN referral_source s ON s.clinicLocationId = c.id GROUP BY c.id, c.name""")
def _(clinic, src):
    counted = sorting.clinics_by_name(aggregates.clinic_source_counts(clinic.select("id", "name"), src))
    return counted.withColumnRenamed("referralSources", "sources")


@check("campaign_recipient_counts", "A2 O1", "campaign campaign_link",
       """SELECT c.id, c.name, count(l.campaignId) AS recipients FROM campaign c
          LEFT JOIN campaign_link l ON l.campaignId = c.id GROUP BY c.id, c.name""")
def _(camp, link):
    return aggregates.campaign_recipient_counts(camp.select("id", "name"), link).withColumnRenamed(
        "referralSources", "recipients")


@check("table_totals", "A3", "referral_source interaction campaign",
       """SELECT 'referralSources' AS name, count(*) AS total FROM referral_source
          UNION ALL SELECT 'interactions', count(*) FROM interaction UNION ALL SELECT 'campaigns', count(*) FROM campaign""")
def _(src, inter, camp):
    return aggregates.table_totals(src, inter, camp)


@check("campaign_status_totals", "A4", "campaign",
       """SELECT count(*) AS total, count(*) FILTER (status = 'ACTIVE') AS active,
            count(*) FILTER (status = 'DRAFT') AS draft, count(*) FILTER (status = 'COMPLETED') AS completed,
            count(*) FILTER (status = 'CANCELLED') AS cancelled FROM campaign""")
def _(camp):
    return aggregates.campaign_status_totals(camp)


@check("campaigns_by_type", "A5", "campaign", 'SELECT type AS name, count(*) AS count FROM campaign GROUP BY type')
def _(camp):
    return aggregates.campaigns_by_type(camp)


SLICES = """SELECT n.name, count(c.id) AS value FROM (VALUES ('Active'), ('Draft'), ('Completed'), ('Cancelled')) n(name)
  LEFT JOIN campaign c ON c.status = upper(n.name) GROUP BY n.name"""


@check("status_distribution", "A6", "campaign", SLICES)
def _(camp):
    return aggregates.status_distribution(camp)


@check("status_share", "A7", "campaign",
       f"""WITH slices AS ({SLICES}) SELECT name, value,
             concat(name, ': ', CAST(round(100.0 * value / (SELECT sum(value) FROM slices)) AS BIGINT), '%') AS label
           FROM slices""")
def _(camp):
    return aggregates.status_share(aggregates.status_distribution(camp))


@check("clinics_in_use", "A8", "referral_source clinic_location",
       "SELECT DISTINCT c.id, c.name FROM referral_source s JOIN clinic_location c ON c.id = s.clinicLocationId")
def _(src, clinic):
    return aggregates.clinics_in_use(src, clinic)


@check("linked_sources_per_clinic", "A10", "clinic_location referral_source",
       """SELECT c.id, count(*) AS count FROM clinic_location c JOIN referral_source s ON s.clinicLocationId = c.id
          GROUP BY c.id""")
def _(clinic, src):
    return aggregates.linked_counts(clinic, src, "clinicLocationId")


@check("linked_campaigns_per_source", "A10", "referral_source campaign_link",
       """SELECT s.id, count(*) AS count FROM referral_source s JOIN campaign_link l ON l.referralSourceId = s.id
          GROUP BY s.id""")
def _(src, link):
    return aggregates.linked_counts(src, link, "referralSourceId")


@check("selection_counts", "A12", "referral_source",
       """SELECT (SELECT count(*) FROM referral_source WHERE numberOfProviders > 5) AS selected,
            (SELECT count(*) FROM referral_source WHERE clinicLocationId = 'cl3') AS filtered""")
def _(src):
    return aggregates.selection_counts(src.where("numberOfProviders > 5"), filters.sources_of_clinic(src, "cl3"))


@check("duplicate_event_keys", "A13", "delivery_event",
       """SELECT campaignId, referralSourceId, count(*) AS count FROM delivery_event
          GROUP BY ALL HAVING count(*) > 1""")
def _(ev):
    return aggregates.duplicate_keys(ev, ["campaignId", "referralSourceId"])


# ---- sorts and top-k -----------------------------------------------------------------------------------------------


@check("newest_sources", "O1", "referral_source",
       "SELECT id, name, createdAt FROM referral_source ORDER BY createdAt DESC, id")
def _(src):
    return sorting.newest_first(src.select("id", "name", "createdAt"))


@check("latest_interactions", "O2", "interaction", "SELECT id, date FROM interaction ORDER BY date DESC, id")
def _(inter):
    return sorting.latest_interactions(inter.select("id", "date"))


@check("clinics_by_name", "O3", "clinic_location", "SELECT id, name FROM clinic_location ORDER BY name, id")
def _(clinic):
    return sorting.clinics_by_name(clinic.select("id", "name"))


@check("sources_by_address", "O4", "referral_source clinic_location referral_category",
       """SELECT id, name FROM referral_source ORDER BY CASE WHEN coalesce(address, '') = '' THEN ''
            WHEN coalesce(city, '') = '' THEN address ELSE concat(address, ', ', city) END DESC, createdAt DESC, id""")
def _(src, clinic, cat):
    return sorting.sort_sources(joins.sources_enriched(src, clinic, cat), "address", "desc").select("id", "name")


@check("sources_by_providers", "O4", "referral_source clinic_location referral_category",
       """SELECT id, name FROM referral_source ORDER BY coalesce(numberOfProviders, 0), createdAt DESC, id""")
def _(src, clinic, cat):
    return sorting.sort_sources(joins.sources_enriched(src, clinic, cat), "numberOfProviders").select("id", "name")


@check("recent_interactions", "O5", "interaction referral_source",
       """SELECT i.id, i.date, s.name AS source_name FROM interaction i
          JOIN referral_source s ON s.id = i.referralSourceId ORDER BY i.date DESC, i.id LIMIT 5""")
def _(inter, src):
    return sorting.recent_interactions(inter, src).select("id", "date", F.col("referralSource.name").alias("source_name"))


def recent_campaigns(camp, link):
    return sorting.recent_campaigns(camp.select("id", "name", "type", "status", "createdAt"), link)


check("recent_campaigns", "O6 A2", "campaign campaign_link",
      """SELECT c.id, c.name, c.type, c.status, c.createdAt,
           (SELECT count(*) FROM campaign_link l WHERE l.campaignId = c.id) AS "referralSources"
         FROM campaign c ORDER BY c.createdAt DESC, c.id LIMIT 5""")(recent_campaigns)


@check("limited_interactions", "O7", "interaction", "SELECT id, date FROM interaction ORDER BY date DESC, id LIMIT 12")
def _(inter):
    return sorting.limit_interactions(inter.select("id", "date"), 12)


# ---- sets ----------------------------------------------------------------------------------------------------------


@check("appended_pages", "U1", "place_listing",
       """SELECT place_id, name, rating FROM place_listing UNION ALL SELECT place_id, name, rating FROM place_listing""")
def _(listing):
    page = listing.select("place_id", "name", "rating")
    return sets.append_pages(page, page)


@check("recipient_differences", "U2", "campaign_link kept_recipient",
       """SELECT coalesce(l.campaignId, k.campaignId) AS campaignId,
            coalesce(l.referralSourceId, k.referralSourceId) AS referralSourceId,
            CASE WHEN l.campaignId IS NULL THEN 'add' WHEN k.campaignId IS NULL THEN 'remove' ELSE 'keep' END AS change
          FROM campaign_link l FULL JOIN kept_recipient k
          ON l.campaignId = k.campaignId AND l.referralSourceId = k.referralSourceId""")
def _(link, requested):
    return sets.recipient_changes(link, requested)


@check("toggled_selection", "U3", "referral_source",
       """SELECT id FROM referral_source
          WHERE (coalesce(numberOfProviders > 5, false)) <> (coalesce(clinicLocationId = 'cl3', false))""")
def _(src):
    return sets.update_selection(src.where("numberOfProviders > 5"), src, "toggle", filters.sources_of_clinic(src, "cl3"))


@check("looked_up_sources", "S2", "referral_source interaction",
       "SELECT id, name FROM referral_source WHERE id IN (SELECT referralSourceId FROM interaction WHERE type = 'VISIT')")
def _(src, inter):
    keys = inter.where("type = 'VISIT'").select(F.col("referralSourceId").alias("id"))
    return lookup(src, keys, "id").select("id", "name")
