"""Bulk changes and dispatch."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from caretrail.functions.defaults import new_id
from caretrail.functions.dispatch import DispatchConfig
from caretrail.operators.aggregates import activate_campaigns, send_summary
from caretrail.operators.keys import all_key_audits
from caretrail.plans import creates, deletes, dispatch, migration, patches, prospects
from caretrail.schemas import PRIMARY_KEYS, conform
from checks.catalog import AS_OF, check
from checks.reads import details_frame

CFG = DispatchConfig(host="outreach.example.com")
NOON = f"TIMESTAMP '{AS_OF}'"
NEW_ID = "concat('c', substring(sha256(requestId), 1, 24))"


def _body(req: str) -> str:
    return f"SELECT *, CASE WHEN json_valid(body) THEN body END AS j FROM {req}"


def _text(key: str) -> str:
    return f"json_extract_string(j, '$.{key}')"


def _has(key: str) -> str:
    return f"coalesce(json_exists(j, '$.{key}'), false)"


# ---- creation ------------------------------------------------------------------------------------------------------

SOURCE_REQUESTS = f"""WITH b AS ({_body('source_request')}),
  v AS (SELECT *, {_text('name')} AS name, nullif({_text('address')}, '') AS address, nullif({_text('city')}, '') AS city,
      nullif({_text('clinicLocationId')}, '') AS clinic, {_text('faxNumber')} AS fax, {_text('rating')} AS rating,
      {_text('numberOfProviders')} AS providers FROM b),
  r AS (SELECT *, CASE WHEN j IS NULL THEN 'Failed to create referral source'
      WHEN coalesce(name, '') = '' THEN 'Name is required'
      WHEN TRY_CAST(rating AS DOUBLE) IS NULL OR CAST(providers AS DOUBLE) <> floor(CAST(providers AS DOUBLE))
        OR (clinic IS NOT NULL AND clinic NOT IN (SELECT id FROM clinic_location))
      THEN 'Failed to create referral source' END AS reason FROM v)
"""


@check("created_sources", "M1 X8 X23 S4", "source_request referral_source clinic_location",
       SOURCE_REQUESTS + f"""SELECT {NEW_ID} AS id, name, address, city, clinic AS "clinicLocationId", fax AS "faxNumber",
         nullif(CAST(rating AS DOUBLE), 0) AS rating, nullif(CAST(CAST(providers AS DOUBLE) AS INT), 0) AS "numberOfProviders",
         {NOON} AS "createdAt" FROM r WHERE reason IS NULL""")
def _(req, src, clinic):
    made = creates.create_sources(req, src, AS_OF, clinics=clinic).delta
    return made.select("id", "name", "address", "city", "clinicLocationId", "faxNumber", "rating", "numberOfProviders",
                       "createdAt")


@check("rejected_sources", "M1", "source_request referral_source clinic_location",
       SOURCE_REQUESTS + """SELECT "requestId", reason FROM r WHERE reason IS NOT NULL""")
def _(req, src, clinic):
    return creates.create_sources(req, src, AS_OF, clinics=clinic).rejects


@check("sources_after_creation", "M1", "source_request referral_source clinic_location",
       SOURCE_REQUESTS + f"""SELECT id, name, city FROM referral_source UNION ALL SELECT {NEW_ID}, name, city FROM r
         WHERE reason IS NULL""")
def _(req, src, clinic):
    return creates.create_sources(req, src, AS_OF, clinics=clinic).table.select("id", "name", "city")


INTERACTION_REQUESTS = f"""WITH b AS ({_body('interaction_request')}),
  v AS (SELECT *, {_text('referralSourceId')} AS source, {_text('type')} AS kind, {_text('date')} AS day,
      nullif({_text('notes')}, '') AS notes FROM b),
  r AS (SELECT *, TRY_CAST(replace(day, 'Z', '') AS TIMESTAMP) AS moment,
      CASE WHEN j IS NULL THEN 'Failed to create interaction'
      WHEN coalesce(source, '') = '' THEN 'Referral source ID is required'
      WHEN coalesce(kind, '') = '' THEN 'Interaction type is required'
      WHEN coalesce(day, '') = '' THEN 'Interaction date is required'
      WHEN TRY_CAST(replace(day, 'Z', '') AS TIMESTAMP) IS NULL OR source NOT IN (SELECT id FROM referral_source)
      THEN 'Failed to create interaction' END AS reason FROM v)
"""


@check("created_interactions", "M2 X6", "interaction_request interaction referral_source",
       INTERACTION_REQUESTS + f"""SELECT {NEW_ID} AS id, source AS "referralSourceId", kind AS type, moment AS date, notes
         FROM r WHERE reason IS NULL""")
def _(req, inter, src):
    made = creates.create_interactions(req, inter, src, AS_OF).delta
    return made.select("id", "referralSourceId", "type", "date", "notes")


@check("rejected_interactions", "M2", "interaction_request interaction referral_source",
       INTERACTION_REQUESTS + """SELECT "requestId", reason FROM r WHERE reason IS NOT NULL""")
def _(req, inter, src):
    return creates.create_interactions(req, inter, src, AS_OF).rejects


CAMPAIGN_REQUESTS = f"""WITH b AS ({_body('campaign_request')}),
  v AS (SELECT *, {_text('name')} AS name, {_text('type')} AS kind, nullif({_text('startDate')}, '') AS start,
      nullif({_text('documentUrl')}, '') AS doc, coalesce({_text('status')}, 'DRAFT') AS state,
      CAST(json_extract(j, '$.referralSourceIds') AS VARCHAR[]) AS ids FROM b),
  w AS (SELECT requestId, unnest(ids) AS source FROM v),
  bad AS (SELECT requestId FROM w WHERE source NOT IN (SELECT id FROM referral_source)
    UNION SELECT requestId FROM w GROUP BY requestId, source HAVING count(*) > 1),
  r AS (SELECT *, CASE WHEN coalesce(name, '') = '' THEN 'Name is required'
      WHEN coalesce(kind, '') = '' THEN 'Campaign type is required'
      WHEN requestId IN (SELECT requestId FROM bad) THEN 'Failed to create campaign' END AS reason FROM v)
"""


@check("created_campaigns", "M3 X5", "campaign_request campaign campaign_link referral_source",
       CAMPAIGN_REQUESTS + f"""SELECT {NEW_ID} AS id, name, kind AS type, state AS status,
         CASE WHEN start IS NULL THEN {NOON}
           ELSE make_date(2024, 2, 1) + to_days(CAST(substring(start, 9, 2) AS INT) - 1) + INTERVAL 12 HOUR END AS "startDate",
         doc AS "documentUrl", CASE WHEN doc IS NOT NULL THEN 'd.pdf' END AS "documentName" FROM r WHERE reason IS NULL""")
def _(req, camp, link, src):
    made = creates.create_campaigns(req, camp, link, src, AS_OF).campaigns.delta
    return made.select("id", "name", "type", "status", "startDate", "documentUrl", "documentName")


@check("created_campaign_links", "M3", "campaign_request campaign campaign_link referral_source",
       CAMPAIGN_REQUESTS + f"""SELECT {NEW_ID} AS "campaignId", unnest(ids) AS "referralSourceId", 'PENDING' AS status
         FROM r WHERE reason IS NULL""")
def _(req, camp, link, src):
    made = creates.create_campaigns(req, camp, link, src, AS_OF).links.delta
    return made.select("campaignId", "referralSourceId", "status")


@check("rejected_campaigns", "M3", "campaign_request campaign campaign_link referral_source",
       CAMPAIGN_REQUESTS + """SELECT "requestId", reason FROM r WHERE reason IS NOT NULL""")
def _(req, camp, link, src):
    return creates.create_campaigns(req, camp, link, src, AS_OF).rejects


CLINIC_REQUESTS = f"""WITH b AS ({_body('clinic_request')}),
  v AS (SELECT *, {_text('name')} AS name, nullif({_text('city')}, '') AS city,
      {_has('isActive')} AND {_text('isActive')} IS NULL AS broken, coalesce({_text('isActive')}, 'true') = 'true' AS active
    FROM b),
  f AS (SELECT requestId, row_number() OVER (PARTITION BY name ORDER BY seq) AS n FROM v
    WHERE name IS NOT NULL AND NOT broken AND name NOT IN (SELECT name FROM clinic_location)),
  r AS (SELECT v.*, CASE WHEN coalesce(name, '') = '' THEN 'Name is required'
      WHEN f.n > 1 OR name IN (SELECT name FROM clinic_location) THEN 'A clinic location with this name already exists'
      WHEN broken THEN 'Failed to create clinic location' END AS reason FROM v LEFT JOIN f USING (requestId))
"""


@check("created_clinics", "M4 J6", "clinic_request clinic_location",
       CLINIC_REQUESTS + f"""SELECT {NEW_ID} AS id, name, city, active AS "isActive" FROM r WHERE reason IS NULL""")
def _(req, clinic):
    return creates.create_clinics(req, clinic, AS_OF).delta.select("id", "name", "city", "isActive")


@check("rejected_clinics", "M4 J6", "clinic_request clinic_location",
       CLINIC_REQUESTS + """SELECT "requestId", reason FROM r WHERE reason IS NOT NULL""")
def _(req, clinic):
    return creates.create_clinics(req, clinic, AS_OF).rejects


# ---- unique keys: requests sent again, some as they were and some later, some of ids that are stored already ---------


def _again(req):
    """The requests, a fifth of them once more later, a seventh of them once more as they are."""
    late = req.where(F.col("seq") % 5 == 0).withColumn("seq", F.col("seq") + 10**9)
    return req.unionByName(late).unionByName(req.where(F.col("seq") % 7 == 0))


def _stored_too(table, req):
    """The table with the rows that an eleventh of the requests would make."""
    ids = req.where(F.col("seq") % 11 == 0).select(new_id("requestId").alias("id"))
    return table.unionByName(ids, allowMissingColumns=True)


def _outcomes(change):
    """(id, reason) of what was made, (requestId, reason) of what was refused."""
    return change.delta.select("id", F.lit(None).cast("string").alias("reason")).unionByName(
        change.rejects.select(F.col("requestId").alias("id"), "reason"))


def _claims(requests: str, view: str, failed: str) -> str:
    """Twin over the twin of a creation: ``r`` has all requests with their reasons."""
    again = f"""again AS (SELECT * FROM {view} UNION ALL SELECT requestId, seq + 1000000000, body FROM {view} WHERE seq % 5 = 0
      UNION ALL SELECT * FROM {view} WHERE seq % 7 = 0),
  """
    requests = re.sub(rf"\b{view}\b", "again", requests)
    assert requests.startswith("WITH ")
    return "WITH " + again + requests[5:] + f""",
  claims AS (SELECT requestId, seq, row_number() OVER (PARTITION BY requestId ORDER BY seq) AS n
    FROM (SELECT DISTINCT requestId, seq FROM r WHERE reason IS NULL)),
  taken AS (SELECT requestId FROM {view} WHERE seq % 11 = 0)
  SELECT "requestId" AS id, reason FROM r WHERE reason IS NOT NULL
  UNION ALL SELECT CASE WHEN n = 1 AND requestId NOT IN (FROM taken) THEN {NEW_ID} ELSE requestId END,
    CASE WHEN n = 1 AND requestId NOT IN (FROM taken) THEN NULL ELSE '{failed}' END FROM claims"""


@check("claimed_sources", "M1 A13", "source_request referral_source clinic_location",
       _claims(SOURCE_REQUESTS, "source_request", creates.SOURCE_FAILED))
def _(req, src, clinic):
    return _outcomes(creates.create_sources(_again(req), _stored_too(src, req), AS_OF, clinics=clinic))


@check("claimed_interactions", "M2 A13", "interaction_request interaction referral_source",
       _claims(INTERACTION_REQUESTS, "interaction_request", creates.INTERACTION_FAILED))
def _(req, inter, src):
    return _outcomes(creates.create_interactions(_again(req), _stored_too(inter, req), src, AS_OF))


@check("claimed_campaigns", "M3 A13", "campaign_request campaign campaign_link referral_source",
       _claims(CAMPAIGN_REQUESTS.replace("SELECT requestId FROM w GROUP BY requestId, source HAVING count(*) > 1",
                                         "SELECT requestId FROM v WHERE len(list_distinct(ids)) < len(ids)"), "campaign_request", creates.CAMPAIGN_FAILED))
def _(req, camp, link, src):
    made = creates.create_campaigns(_again(req), _stored_too(camp, req), link, src, AS_OF)
    return _outcomes(made.campaigns)


@check("claimed_clinics", "M4 J6 A13", "clinic_request clinic_location",
       _claims(CLINIC_REQUESTS.replace("SELECT requestId, row_number() OVER (PARTITION BY name ORDER BY seq) AS n FROM v",
                                       "SELECT DISTINCT requestId, 1 + (first_value(requestId) OVER (PARTITION BY name ORDER BY "
                                       "seq) <> requestId)::int AS n FROM v"),
               "clinic_request", creates.CLINIC_FAILED))
def _(req, clinic):
    return _outcomes(creates.create_clinics(_again(req), _stored_too(clinic, req), AS_OF))


@check("claimed_prospects", "M16 A13", "place_listing place_detail clinic_location referral_source",
       f"""SELECT {NEW_ID} AS id, NULL AS reason FROM (SELECT DISTINCT concat('place/', d.place_id) AS "requestId"
             FROM place_listing l JOIN place_detail d USING (place_id)
             WHERE l.rating >= 2 AND d.status = 'OK' AND l.user_ratings_total % 3 <> 0)
           UNION ALL SELECT concat('place/', d.place_id), '{creates.SOURCE_FAILED}' FROM place_listing l
             JOIN place_detail d USING (place_id) WHERE l.rating >= 2 AND d.status = 'OK' AND l.user_ratings_total % 3 = 0""")
def _(listing, detail, clinic, src):
    """Half of the listings are on a second page, a third of them are stored."""
    pages = listing.unionByName(listing.where(F.col("user_ratings_total") % 2 == 0))
    known = listing.where(F.col("user_ratings_total") % 3 == 0).select(
        new_id(F.concat(F.lit("place/"), "place_id")).alias("id"))
    table = src.unionByName(known, allowMissingColumns=True)
    return _outcomes(prospects.import_prospects(pages, details_frame(detail), clinic, table, AS_OF, 2))


KEYED = "clinic_location referral_source referral_category interaction campaign campaign_link"


def _key_twin(table: str, key: str, value: str) -> str:
    columns = key.split(",")
    odd = f"hash({columns[0]}) % 3 = 0" if table == "referral_category" else f"length({columns[0]}) % 2 = 0"
    twice = f"(SELECT {key} FROM {table} UNION ALL SELECT {key} FROM {table} WHERE {odd.replace('hash', 'length')})"
    return (f"""SELECT '{table}' AS "table", '{key}' AS key, {value} AS value, count(*) AS count FROM {twice}
      WHERE {' AND '.join(f'{c} IS NOT NULL' for c in columns)} GROUP BY {key} HAVING count(*) > 1""")


def _json(*columns: str) -> str:
    return "concat('[\"', " + ", '\",\"', ".join(columns) + ", '\"]')"


@check("duplicate_table_keys", "A13", KEYED, " UNION ALL ".join([
    _key_twin("clinic_location", "id", _json("id")), _key_twin("referral_source", "id", _json("id")),
    _key_twin("referral_category", "id", _json("id")), _key_twin("interaction", "id", _json("id")),
    _key_twin("campaign", "id", _json("id")),
    _key_twin("campaign_link", "campaignId,referralSourceId", _json("campaignId", "referralSourceId")),
    _key_twin("clinic_location", "name", _json("name")).replace("length(name) % 2 = 0", "length(id) % 2 = 0"),
    _key_twin("referral_category", "name", _json("name")).replace("length(name) % 3 = 0", "length(id) % 3 = 0")]))
def _(*frames):
    """All declared keys of the six tables, whose rows are partly there twice."""
    tables = {}
    for name, df in zip(KEYED.split(), frames, strict=True):
        key, step = PRIMARY_KEYS[name][0], 3 if name == "referral_category" else 2
        tables[name] = df.unionByName(df.where(F.length(key) % step == 0))
    return all_key_audits(tables)


# ---- patches -------------------------------------------------------------------------------------------------------


def _last(expr: str, when: str, name: str) -> str:
    """Twin of folding: the last value sent, boxed so that a null sent differs from nothing sent."""
    return f"arg_max(list_value({expr}), seq) FILTER ({when}) AS {name}"


def _merge(box: str, old: str, name: str) -> str:
    return f'CASE WHEN {box} IS NOT NULL THEN {box}[1] ELSE {old} END AS "{name}"'


SOURCE_PATCHES = f"""WITH b AS ({_body('source_patch')}),
  r AS (SELECT *, CASE WHEN id NOT IN (SELECT id FROM referral_source) THEN 'Referral source not found'
      WHEN {_has('name')} AND {_text('name')} IS NULL THEN 'Failed to update referral source' END AS reason FROM b),
  p AS (SELECT id, {_last(_text('name'), _has('name'), 'n')}, {_last(_text('address'), _has('address'), 'a')},
      {_last(_text('notes'), _has('notes'), 't')},
      {_last('CAST(' + _text('numberOfProviders') + ' AS INT)', _has('numberOfProviders'), 'v')}
    FROM r WHERE reason IS NULL GROUP BY id)
"""


@check("patched_sources", "M5", "source_patch referral_source",
       SOURCE_PATCHES + f"""SELECT s.id, {_merge('n', 's.name', 'name')}, {_merge('a', 's.address', 'address')},
         {_merge('t', 'NULL', 'notes')}, {_merge('v', '"numberOfProviders"', 'numberOfProviders')}, s.city
         FROM referral_source s LEFT JOIN p ON p.id = s.id""")
def _(req, src):
    table = patches.patch_sources(req, conform(src, "referral_source"), AS_OF).table
    return table.select("id", "name", "address", "notes", "numberOfProviders", "city")


@check("rejected_source_patches", "M5 J5", "source_patch referral_source",
       SOURCE_PATCHES + """SELECT "requestId", reason FROM r WHERE reason IS NOT NULL""")
def _(req, src):
    return patches.patch_sources(req, conform(src, "referral_source"), AS_OF).rejects


INTERACTION_PATCHES = f"""WITH b AS ({_body('interaction_patch')}),
  r AS (SELECT *, CASE WHEN id NOT IN (SELECT id FROM interaction) THEN 'Interaction not found'
      WHEN {_text('date')} = '' THEN 'Failed to update interaction' END AS reason FROM b),
  p AS (SELECT id, {_last(_text('outcome'), _has('outcome'), 'o')},
      {_last(f"coalesce(CAST({_text('date')} AS TIMESTAMP), TIMESTAMP '1970-01-01')", _has('date'), 'd')}
    FROM r WHERE reason IS NULL GROUP BY id)
"""


@check("patched_interactions", "M6 X6", "interaction_patch interaction",
       INTERACTION_PATCHES + f"""SELECT i.id, {_merge('o', 'i.outcome', 'outcome')}, {_merge('d', 'i.date', 'date')}, i.notes
         FROM interaction i LEFT JOIN p ON p.id = i.id""")
def _(req, inter):
    table = patches.patch_interactions(req, conform(inter, "interaction"), AS_OF).table
    return table.select("id", "outcome", "date", "notes")


@check("rejected_interaction_patches", "M6", "interaction_patch interaction",
       INTERACTION_PATCHES + """SELECT "requestId", reason FROM r WHERE reason IS NOT NULL""")
def _(req, inter):
    return patches.patch_interactions(req, conform(inter, "interaction"), AS_OF).rejects


CLINIC_PATCHES = f"""WITH b AS ({_body('clinic_patch')}),
  v AS (SELECT *, {_text('name')} AS name, {_has('isActive')} AND {_text('isActive')} IS NULL AS broken FROM b),
  k AS (SELECT v.*, c.id IS NOT NULL AS known, o.id IS NOT NULL AND o.id <> v.id AS taken FROM v
    LEFT JOIN clinic_location c ON c.id = v.id LEFT JOIN clinic_location o ON o.name = v.name),
  f AS (SELECT requestId, row_number() OVER (PARTITION BY name ORDER BY seq) AS n FROM k
    WHERE known AND NOT taken AND NOT broken AND name IS NOT NULL),
  r AS (SELECT k.*, CASE WHEN NOT known THEN 'Clinic location not found'
      WHEN taken OR f.n > 1 THEN 'A clinic location with this name already exists'
      WHEN broken THEN 'Failed to update clinic location' END AS reason FROM k LEFT JOIN f USING (requestId))
"""


@check("patched_clinics", "M7 J6", "clinic_patch clinic_location",
       CLINIC_PATCHES + f"""SELECT c.id, coalesce(r.name, c.name) AS name, {_text('phoneNumber')} AS "phoneNumber",
         CASE WHEN r.id IS NULL THEN c.isActive ELSE false END AS "isActive"
         FROM clinic_location c LEFT JOIN r ON r.id = c.id AND r.reason IS NULL""")
def _(req, clinic):
    table = patches.patch_clinics(req, conform(clinic, "clinic_location"), AS_OF).table
    return table.select("id", "name", "phoneNumber", "isActive")


@check("rejected_clinic_patches", "M7 J6", "clinic_patch clinic_location",
       CLINIC_PATCHES + """SELECT "requestId", reason FROM r WHERE reason IS NOT NULL""")
def _(req, clinic):
    return patches.patch_clinics(req, conform(clinic, "clinic_location"), AS_OF).rejects


CAMPAIGN_PATCHES = f"""WITH b AS ({_body('campaign_patch')}),
  r AS (SELECT *, CASE WHEN id NOT IN (SELECT id FROM campaign) THEN 'Campaign not found'
      WHEN {_has('type')} AND {_text('type')} IS NULL THEN 'Failed to update campaign' END AS reason FROM b),
  p AS (SELECT id, {_last(_text('description'), _has('description'), 'd')},
      {_last(f"TRY_CAST({_text('startDate')} AS TIMESTAMP) + INTERVAL 12 HOUR", f"coalesce({_text('startDate')}, '') <> ''", 's')},
      {_last(f"CAST({_text('endDate')} AS TIMESTAMP) + INTERVAL 12 HOUR", _has('endDate'), 'e')},
      {_last(_text('documentUrl'), _has('documentUrl'), 'u')}, {_last(_text('documentName'), _has('documentUrl'), 'n')}
    FROM r WHERE reason IS NULL GROUP BY id)
"""


@check("patched_campaigns", "M8 X5", "campaign_patch campaign",
       CAMPAIGN_PATCHES + f"""SELECT c.id, {_merge('d', 'NULL', 'description')}, {_merge('s', 'c.startDate', 'startDate')},
         {_merge('e', 'NULL', 'endDate')}, {_merge('u', 'c.documentUrl', 'documentUrl')},
         {_merge('n', 'NULL', 'documentName')} FROM campaign c LEFT JOIN p ON p.id = c.id""")
def _(req, camp):
    table = patches.patch_campaigns(req, conform(camp, "campaign"), AS_OF).table
    return table.select("id", "description", "startDate", "endDate", "documentUrl", "documentName")


@check("rejected_campaign_patches", "M8", "campaign_patch campaign",
       CAMPAIGN_PATCHES + """SELECT "requestId", reason FROM r WHERE reason IS NOT NULL""")
def _(req, camp):
    return patches.patch_campaigns(req, conform(camp, "campaign"), AS_OF).rejects


SYNC = """WITH req AS (SELECT campaignId, CAST(CAST(ids AS JSON) AS VARCHAR[]) AS ids FROM recipient_request WHERE ids IS NOT NULL),
  want AS (SELECT campaignId, unnest(ids) AS referralSourceId FROM req),
  fresh AS (SELECT w.campaignId, w.referralSourceId, count(*) AS n FROM want w
    ANTI JOIN campaign_link l ON l.campaignId = w.campaignId AND l.referralSourceId = w.referralSourceId GROUP BY ALL),
  bad AS (SELECT DISTINCT campaignId FROM fresh WHERE n > 1 OR referralSourceId NOT IN (SELECT id FROM referral_source)),
  good AS (SELECT campaignId FROM req WHERE campaignId NOT IN (SELECT campaignId FROM bad)),
  added AS (SELECT campaignId, referralSourceId FROM fresh WHERE campaignId NOT IN (SELECT campaignId FROM bad)),
  kept AS (SELECT l.* FROM campaign_link l WHERE campaignId NOT IN (SELECT campaignId FROM good)
    OR EXISTS (SELECT 1 FROM want w WHERE w.campaignId = l.campaignId AND w.referralSourceId = l.referralSourceId))
"""


def _sync(req, link, src):
    asked = req.select("campaignId", F.from_json("ids", "array<string>").alias("referralSourceIds"))
    return patches.sync_recipients(asked, conform(link, "campaign_link"), AS_OF, src)


@check("synced_links", "M9 U2", "recipient_request campaign_link referral_source",
       SYNC + """SELECT campaignId, referralSourceId, status FROM kept
         UNION ALL SELECT campaignId, referralSourceId, 'PENDING' FROM added""")
def _(req, link, src):
    return _sync(req, link, src).table.select("campaignId", "referralSourceId", "status")


@check("rejected_syncs", "M9", "recipient_request campaign_link referral_source",
       SYNC + "SELECT campaignId, 'Failed to update campaign' AS reason FROM bad")
def _(req, link, src):
    return _sync(req, link, src).rejects


COVER_PATCHES = f"""WITH b AS ({_body('cover_patch')}),
  r AS (SELECT *, {_text('includeCoverSheet')} = 'true' AS active, CASE
      WHEN {_text('includeCoverSheet')} = 'true' AND coalesce({_text('coverSheetFromName')}, '') = ''
        THEN 'From Name is required for cover sheet'
      WHEN {_text('includeCoverSheet')} = 'true' AND coalesce({_text('coverSheetSubject')}, '') = ''
        THEN 'Subject is required for cover sheet'
      WHEN {_text('includeCoverSheet')} = 'true' AND coalesce({_text('coverSheetMessage')}, '') = ''
        THEN 'Message is required for cover sheet'
      WHEN id NOT IN (SELECT id FROM campaign) THEN 'Campaign not found' END AS reason FROM b),
  p AS (SELECT id, {_last('active', 'true', 'i')}, {_last(_text('coverSheetFromName'), _has('coverSheetFromName'), 'f')},
      {_last(_text('coverSheetSubject'), _has('coverSheetSubject'), 's')},
      {_last(_text('coverSheetMessage'), _has('coverSheetMessage'), 'm')} FROM r WHERE reason IS NULL GROUP BY id)
"""


@check("patched_cover_sheets", "M10", "cover_patch campaign",
       COVER_PATCHES + f"""SELECT c.id, {_merge('i', '"includeCoverSheet"', 'includeCoverSheet')},
         {_merge('f', 'NULL', 'coverSheetFromName')}, {_merge('s', 'c.coverSheetSubject', 'coverSheetSubject')},
         {_merge('m', 'NULL', 'coverSheetMessage')} FROM campaign c LEFT JOIN p ON p.id = c.id""")
def _(req, camp):
    table = patches.patch_cover_sheet(req, conform(camp, "campaign"), AS_OF).table
    return table.select("id", "includeCoverSheet", "coverSheetFromName", "coverSheetSubject", "coverSheetMessage")


@check("rejected_cover_sheets", "M10", "cover_patch campaign",
       COVER_PATCHES + """SELECT "requestId", reason FROM r WHERE reason IS NOT NULL""")
def _(req, camp):
    return patches.patch_cover_sheet(req, conform(camp, "campaign"), AS_OF).rejects


# ---- dispatch ------------------------------------------------------------------------------------------------------

DIGITS = "regexp_replace(s.faxNumber, '[^0-9]', '', 'g')"
PLANNED = f"""SELECT l.campaignId, l.referralSourceId, s.name, s.contactPerson, s.faxNumber, c.name AS campaign,
    c.documentUrl, c.includeCoverSheet AS shown, c.coverSheetFromNumber AS sender, c.coverSheetSubject AS subject,
    CASE WHEN length({DIGITS}) = 10 THEN concat('1', {DIGITS}) ELSE coalesce(nullif({DIGITS}, ''), s.faxNumber) END AS number
  FROM campaign c JOIN campaign_link l ON l.campaignId = c.id JOIN referral_source s ON s.id = l.referralSourceId
  WHERE coalesce(c.documentUrl, '') <> ''"""


def _outbox(camp, link, src):
    return dispatch.build_outbox(camp, link, src, CFG)


@check("outbox", "M11 J3 F10 F11 X1 X17 X18 X19", "campaign campaign_link referral_source",
       f"""WITH planned AS ({PLANNED})
         SELECT campaignId, referralSourceId, number AS "toNumber", 'https://outreach.example.com' || documentUrl AS document,
           substring(campaignId, 1, 10) AS short, shown AS cover, campaign AS "campaignName",
           CASE WHEN shown THEN coalesce(contactPerson, name) ELSE 'Provider' END AS recipient,
           CASE WHEN shown THEN concat('Fax: ', coalesce(nullif(sender, ''), '19105550000')) ELSE '' END AS company,
           CASE WHEN shown THEN coalesce(subject, 'Referral Information') ELSE 'Referral Information' END AS subject
         FROM planned WHERE coalesce(faxNumber, '') <> ''""")
def _(camp, link, src):
    return _outbox(camp, link, src).outbox.select(
        "campaignId", "referralSourceId", "toNumber", F.col("documentUrl").alias("document"),
        F.col("shortCampaignId").alias("short"), F.col("coverSheet.includeCoversheet").alias("cover"), "campaignName",
        F.col("coverSheet.toName").alias("recipient"), F.col("coverSheet.companyInfo").alias("company"),
        "coverSheet.subject")


@check("outbox_skipped", "M11 F10", "campaign campaign_link referral_source",
       f"""SELECT campaignId, referralSourceId, name, 'No fax number provided' AS error FROM ({PLANNED})
           WHERE coalesce(faxNumber, '') = ''""")
def _(camp, link, src):
    return _outbox(camp, link, src).skipped


@check("links_while_sending", "M11", "campaign campaign_link referral_source",
       f"""SELECT l.campaignId, l.referralSourceId, CASE WHEN p.campaignId IS NULL THEN l.status ELSE 'SENDING' END AS status
           FROM campaign_link l LEFT JOIN ({PLANNED}) p
           ON p.campaignId = l.campaignId AND p.referralSourceId = l.referralSourceId AND coalesce(p.faxNumber, '') <> ''""")
def _(camp, link, src):
    return _outbox(camp, link, src).links.select("campaignId", "referralSourceId", "status")


@check("links_after_sending", "M12 X13", "campaign_link campaign send_result",
       f"""SELECT l.campaignId, l.referralSourceId,
             CASE WHEN r.success THEN 'SENT' WHEN NOT r.success THEN 'FAILED' ELSE l.status END AS status,
             CASE WHEN r.success THEN {NOON} ELSE l.sentAt END AS "sentAt",
             CASE WHEN r.success THEN coalesce(r.faxId, json_extract_string(r.data, '$.id'),
               concat('unknown-', epoch_ms({NOON}))) WHEN NOT r.success THEN coalesce(r.error, 'Unknown error') END AS answer,
             coalesce(r.thrown, false) AS alone
           FROM campaign_link l LEFT JOIN send_result r
           ON r.campaignId = l.campaignId AND r.referralSourceId = l.referralSourceId""")
def _(link, camp, results):
    links = dispatch.apply_send_results(link, camp, results, AS_OF).links
    answer = F.coalesce(F.get_json_object("response", "$.faxId"), F.get_json_object("response", "$.error"))
    return links.select("campaignId", "referralSourceId", "status", "sentAt", answer.alias("answer"),
                        F.coalesce(F.json_object_keys("response") == F.array(F.lit("error")), F.lit(False)).alias("alone"))


@check("activated_campaigns", "A11 M12", "campaign send_result",
       """SELECT c.id, CASE WHEN c.id IN (SELECT campaignId FROM send_result WHERE success) THEN 'ACTIVE' ELSE c.status END
            AS status FROM campaign c""")
def _(camp, results):
    return activate_campaigns(camp, results).select("id", "status")


SUMMARY = f"""WITH skipped AS (SELECT campaignId, referralSourceId FROM ({PLANNED}) WHERE coalesce(faxNumber, '') = '')"""


def _summary(camp, link, src, results):
    skipped = _outbox(camp, link, src).skipped
    named = results.withColumn("name", F.lit(None).cast("string"))
    return send_summary(dispatch.send_details(named, AS_OF), skipped)


@check("send_summary", "A9", "campaign campaign_link referral_source send_result",
       SUMMARY + """SELECT campaignId, count(*) FILTER (success) AS sent, count(*) FILTER (NOT success) AS failed
         FROM (SELECT campaignId, success FROM send_result UNION ALL SELECT campaignId, false FROM skipped) GROUP BY 1""")
def _(camp, link, src, results):
    return _summary(camp, link, src, results)[0]


@check("send_details", "A9", "campaign campaign_link referral_source send_result",
       SUMMARY + f"""SELECT campaignId, referralSourceId, success,
           CASE WHEN success THEN coalesce(faxId, json_extract_string(data, '$.id'), concat('unknown-', epoch_ms({NOON}))) END
             AS "faxId", CASE WHEN NOT success THEN coalesce(error, 'Unknown error') END AS error FROM send_result
         UNION ALL SELECT campaignId, referralSourceId, false, NULL, 'No fax number provided' FROM skipped""")
def _(camp, link, src, results):
    return _summary(camp, link, src, results)[1].select("campaignId", "referralSourceId", "success", "faxId", "error")


@check("reconciled_links", "M14 X21", "sent_link provider_status",
       """SELECT l.campaignId, l.referralSourceId,
            CASE WHEN f.status IS NULL THEN l.status WHEN f.status = 'delivered' THEN 'DELIVERED'
              WHEN f.status = 'failed' THEN 'FAILED' ELSE 'SENT' END AS status,
            f.status AS final, coalesce(json_extract_string(f.body, '$.pages'), '') AS pages
          FROM sent_link l LEFT JOIN provider_status f ON f.faxId = json_extract_string(l.response, '$.faxId')
            AND l.status = 'SENT' AND l.sentAt <= TIMESTAMP '1996-06-01' - INTERVAL 3 MINUTE""")
def _(link, feed):
    done = dispatch.reconcile_final(link, feed, "1996-06-01 00:00:00")
    return done.select(
        "campaignId", "referralSourceId", "status", F.get_json_object("response", "$.finalStatus").alias("final"),
        F.coalesce(F.get_json_object("response", "$.details.pages"), F.lit("")).alias("pages"))


# ---- deletes, migration, import ------------------------------------------------------------------------------------


@check("interactions_after_delete", "M13 J5", "interaction_delete interaction",
       "SELECT id, type FROM interaction WHERE id NOT IN (SELECT id FROM interaction_delete)")
def _(req, inter):
    return deletes.delete_interactions(req, inter).table.select("id", "type")


@check("rejected_interaction_deletes", "M13", "interaction_delete interaction",
       """SELECT "requestId", 'Interaction not found' AS reason FROM interaction_delete
          WHERE id NOT IN (SELECT id FROM interaction)""")
def _(req, inter):
    return deletes.delete_interactions(req, inter).rejects


@check("campaigns_after_delete", "M13", "campaign_delete campaign campaign_link",
       "SELECT id FROM campaign WHERE id NOT IN (SELECT id FROM campaign_delete)")
def _(req, camp, link):
    return deletes.delete_campaigns(req, camp, link).table.select("id")


@check("links_after_campaign_delete", "M13", "campaign_delete campaign campaign_link",
       """SELECT campaignId, referralSourceId FROM campaign_link
          WHERE campaignId NOT IN (SELECT id FROM campaign_delete WHERE id IN (SELECT id FROM campaign))""")
def _(req, camp, link):
    return deletes.delete_campaigns(req, camp, link).links.select("campaignId", "referralSourceId")


@check("rejected_campaign_deletes", "M13", "campaign_delete campaign campaign_link",
       """SELECT "requestId", 'Campaign not found' AS reason FROM campaign_delete
          WHERE id NOT IN (SELECT id FROM campaign)""")
def _(req, camp, link):
    return deletes.delete_campaigns(req, camp, link).rejects


USED = "SELECT referralSourceId FROM spread_interaction"
GONE = f"SELECT id FROM source_patch WHERE id NOT IN ({USED})"


@check("sources_after_delete", "M13 J5", "source_patch referral_source campaign_link spread_interaction",
       f"SELECT id FROM referral_source WHERE id NOT IN ({GONE})")
def _(req, src, link, inter):
    return deletes.delete_sources(req, src, link, inter).table.select("id")


@check("links_after_source_delete", "M13", "source_patch referral_source campaign_link spread_interaction",
       f"""SELECT campaignId, referralSourceId FROM campaign_link
           WHERE referralSourceId NOT IN (SELECT id FROM ({GONE}) WHERE id IN (SELECT id FROM referral_source))""")
def _(req, src, link, inter):
    return deletes.delete_sources(req, src, link, inter).links.select("campaignId", "referralSourceId")


@check("rejected_source_deletes", "M13", "source_patch referral_source campaign_link spread_interaction",
       f"""SELECT "requestId", CASE WHEN id NOT IN (SELECT id FROM referral_source) THEN 'Referral source not found'
             ELSE 'Failed to delete referral source' END AS reason FROM source_patch
           WHERE id NOT IN (SELECT id FROM referral_source) OR id IN ({USED})""")
def _(req, src, link, inter):
    return deletes.delete_sources(req, src, link, inter).rejects


@check("clinics_after_delete", "M13 A10", "clinic_patch clinic_location grouped_source",
       """SELECT id FROM clinic_location WHERE id NOT IN (SELECT id FROM clinic_patch)
          OR id IN (SELECT clinicLocationId FROM grouped_source)""")
def _(req, clinic, src):
    return deletes.delete_clinics(req, clinic, src).table.select("id")


@check("rejected_clinic_deletes", "M13 A10", "clinic_patch clinic_location grouped_source",
       """WITH n AS (SELECT clinicLocationId AS id, count(*) AS n FROM grouped_source GROUP BY 1)
          SELECT "requestId", CASE WHEN c.id IS NULL THEN 'Clinic location not found' ELSE concat(
              'Cannot delete clinic location. ', n.n, ' referral source(s) are linked to this location.') END AS reason
          FROM clinic_patch p LEFT JOIN clinic_location c ON c.id = p.id LEFT JOIN n ON n.id = p.id
          WHERE c.id IS NULL OR n.n IS NOT NULL""")
def _(req, clinic, src):
    return deletes.delete_clinics(req, clinic, src).rejects


@check("migrated_sources", "M15", "legacy_source",
       """SELECT id, name, CASE clinicLocation WHEN 'Jacksonville' THEN 'clm1' WHEN 'Wilmington' THEN 'clm2'
            WHEN 'Beulaville' THEN 'clm3' WHEN 'Goldsboro' THEN 'clm4' WHEN 'Nashville' THEN 'clm5' END AS "clinicLocationId"
          FROM legacy_source""")
def _(legacy):
    return migration.migrate_sources(legacy).select("id", "name", "clinicLocationId")


@check("imported_prospects", "M16 J7 J10 F7 F9 X2 X16 M1", "place_listing place_detail clinic_location referral_source",
       r"""WITH found AS (SELECT d.*, concat('place/', d.place_id) AS "requestId",
              list_transform(string_split(d.formatted_address, ','), lambda x: trim(x)) AS raw
            FROM place_listing l JOIN place_detail d USING (place_id) WHERE l.rating >= 2 AND d.status = 'OK'),
          parts AS (SELECT *, CASE WHEN len(raw) > 2 AND raw[-1] IN ('USA', 'US') THEN raw[1:len(raw) - 1] ELSE raw END AS p
            FROM found),
          addr AS (SELECT *, CASE WHEN len(p) >= 3 THEN p[1] ELSE formatted_address END AS address,
              CASE WHEN len(p) >= 3 THEN p[2] END AS city,
              CASE WHEN len(p) >= 3 THEN coalesce(nullif(regexp_extract(p[-1], '([A-Z]{2})\s+(.+)', 1), ''), p[-1]) END AS state
            FROM parts)
          SELECT concat('c', substring(sha256("requestId"), 1, 24)) AS id, name, address, city, state,
            (SELECT min_by(c.id, c.name) FROM clinic_location c WHERE c.isActive AND contains(lower(a.city), lower(c.name)))
              AS clinic,
            phone, nullif(website, '') AS website,
            concat('Google Rating: ', coalesce(regexp_replace(CAST(rating AS VARCHAR), '\.0$', ''), 'undefined'), ' (',
              user_ratings_total, ' reviews)', chr(10), 'Business Types: ', kind, ', health') AS notes FROM addr a""")
def _(listing, detail, clinic, src):
    made = prospects.import_prospects(listing, details_frame(detail), clinic, src, AS_OF, 2).delta
    return made.select("id", "name", "address", "city", "state", F.col("clinicLocationId").alias("clinic"),
                       F.col("contactPhone").alias("phone"), "website", "notes")
