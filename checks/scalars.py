"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caretrail import functions as X
from caretrail.functions.defaults import ntz
from caretrail.functions.dispatch import DispatchConfig
from checks.catalog import AS_OF, check

CFG = DispatchConfig(host="outreach.example.com")


@check("dialable_numbers", "X1", "referral_source",
       """WITH d AS (SELECT id, nullif(faxNumber, '') AS raw, regexp_replace(faxNumber, '[^0-9]', '', 'g') AS n
            FROM referral_source)
          SELECT id, CASE WHEN length(n) = 10 THEN concat('1', n) ELSE coalesce(nullif(n, ''), raw) END AS number FROM d""")
def _(src):
    return src.select("id", X.normalize_phone("faxNumber").alias("number"))


@check("parsed_addresses", "X2", "place_listing",
       r"""WITH p AS (SELECT place_id, formatted_address AS raw,
              list_transform(string_split(formatted_address, ','), lambda x: trim(x)) AS parts FROM place_listing),
          q AS (SELECT place_id, raw, CASE WHEN len(parts) > 2 AND parts[-1] IN ('USA', 'US')
              THEN parts[1:len(parts) - 1] ELSE parts END AS parts FROM p)
          SELECT place_id, CASE WHEN len(parts) >= 3 THEN parts[1] ELSE raw END AS address,
            CASE WHEN len(parts) >= 3 THEN parts[2] ELSE '' END AS city,
            CASE WHEN len(parts) < 3 THEN '' WHEN regexp_matches(parts[-1], '[A-Z]{2}\s+.+')
              THEN regexp_extract(parts[-1], '([A-Z]{2})\s+(.+)', 1) ELSE parts[-1] END AS state,
            CASE WHEN len(parts) < 3 THEN '' ELSE regexp_extract(parts[-1], '([A-Z]{2})\s+(.+)', 2) END AS zip
          FROM q""")
def _(listing):
    a = X.parse_address("formatted_address")
    return listing.select("place_id", a.alias("a")).select(
        "place_id", "a.address", "a.city", "a.state", F.col("a.zipCode").alias("zip"))


@check("type_captions", "X3", "form_text",
       "SELECT n, concat(substring(code, 1, 1), lower(substring(code, 2))) AS caption FROM form_text")
def _(text):
    return text.select("n", X.type_caption("code").alias("caption"))


@check("campaign_type_labels", "X4", "form_text",
       """SELECT n, CASE code WHEN 'EMAIL' THEN 'Email' WHEN 'FAX' THEN 'Fax' WHEN 'CALL' THEN 'Call'
            WHEN 'EVENT' THEN 'Event' WHEN 'DIRECT_MAIL' THEN 'Direct Mail' WHEN 'SOCIAL_MEDIA' THEN 'Social Media'
            ELSE code END AS listed,
          CASE code WHEN 'EMAIL' THEN 'Email Campaign' WHEN 'FAX' THEN 'Fax Campaign' WHEN 'CALL' THEN 'Call Campaign'
            WHEN 'EVENT' THEN 'Event' WHEN 'DIRECT_MAIL' THEN 'Direct Mail' WHEN 'SOCIAL_MEDIA' THEN 'Social Media'
            WHEN 'OTHER' THEN 'Other' ELSE code END AS form FROM form_text""")
def _(text):
    return text.select("n", X.campaign_type_label("code").alias("listed"),
                       X.campaign_type_label("code", "form").alias("form"))


NUMBERS = """d AS (SELECT n, moment, regexp_matches(moment, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS bare,
    TRY_CAST(substring(moment, 1, 4) AS INT) AS y, TRY_CAST(substring(moment, 6, 2) AS INT) AS m,
    TRY_CAST(substring(moment, 9, 2) AS INT) AS d FROM form_text)"""
ROLLED = "make_date(y, 1, 1) + to_months(m - 1) + to_days(d - 1)"


@check("local_dates", "X5", "form_text",
       f"""WITH {NUMBERS}
          SELECT n, CASE WHEN bare THEN timezone('UTC', timezone('America/New_York', {ROLLED} + INTERVAL 12 HOUR))
            WHEN moment LIKE '%Z' THEN TRY_CAST(replace(moment, 'Z', '') AS TIMESTAMP)
            WHEN moment LIKE '%:30-0%' OR moment LIKE '%:00-0%'
              THEN TRY_CAST(substring(moment, 1, 19) AS TIMESTAMP)
                + to_minutes(60 * CAST(substring(moment, 21, 2) AS INT) + CAST(substring(moment, 24, 2) AS INT))
            WHEN moment LIKE '____-__-__T__:__'
              THEN timezone('UTC', timezone('America/New_York', TRY_CAST(concat(moment, ':00') AS TIMESTAMP)))
            END AS moment FROM d""")
def _(text):
    return text.select("n", X.parse_local_date("moment", "America/New_York").alias("moment"))


@check("instants", "X6", "form_text",
       f"""WITH {NUMBERS}
          SELECT n, CASE WHEN bare AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 THEN {ROLLED}
            WHEN moment LIKE '%Z' THEN TRY_CAST(replace(moment, 'Z', '') AS TIMESTAMP)
            WHEN moment LIKE '%:30-0%' OR moment LIKE '%:00-0%'
              THEN TRY_CAST(substring(moment, 1, 19) AS TIMESTAMP)
                + to_minutes(60 * CAST(substring(moment, 21, 2) AS INT) + CAST(substring(moment, 24, 2) AS INT))
            WHEN moment LIKE '____-__-__T__:__' THEN TRY_CAST(concat(moment, ':00') AS TIMESTAMP) END AS moment FROM d""")
def _(text):
    return text.select("n", X.parse_instant("moment").alias("moment"))


@check("date_texts", "X7", "interaction campaign_link",
       """SELECT id, strftime(timezone('America/New_York', timezone('UTC', date)), '%b %-d, %Y') AS long,
            strftime(date, '%b %-d') AS short,
            strftime(timezone('America/New_York', timezone('UTC', date)), '%Y-%m-%d') AS input,
            strftime(date, '%Y-%m-%d') AS utc FROM interaction
          UNION ALL SELECT concat(campaignId, '/', referralSourceId), coalesce(strftime(sentAt, '%b %-d, %Y'), '-'),
            '', '', '' FROM campaign_link""")
def _(inter, link):
    zone = "America/New_York"
    shown = inter.select(
        "id", X.format_date("date", "long", zone).alias("long"), X.format_date("date", "short").alias("short"),
        X.format_date("date", "input", zone).alias("input"), X.format_date("date", "utc", zone).alias("utc"))
    sent = link.select(
        F.concat_ws("/", "campaignId", "referralSourceId").alias("id"), X.format_date("sentAt", empty="-").alias("long"),
        *[F.lit("").alias(c) for c in ("short", "input", "utc")])
    return shown.unionByName(sent)


@check("emptied_values", "X8", "referral_source",
       """SELECT id, nullif(city, '') AS city, nullif(faxNumber, '') AS fax, nullif(numberOfProviders, 0) AS providers
          FROM referral_source""")
def _(src):
    return src.select("id", X.null_if_empty("city").alias("city"), X.null_if_empty("faxNumber").alias("fax"),
                      X.null_if_zero("numberOfProviders").alias("providers"))


@check("form_integers", "X9", "form_text",
       r"SELECT n, TRY_CAST(regexp_extract(number, '^\s*([+-]?[0-9]+)', 1) AS INT) AS value FROM form_text")
def _(text):
    return text.select("n", X.parse_int("number").alias("value"))


@check("file_parts", "X10", "form_text",
       """SELECT n, string_split(path, '.')[-1] AS ext, coalesce(nullif(string_split(path, '/')[-1], ''), 'document.pdf')
            AS base, CASE WHEN path = 'https://h.example.com' THEN '/' WHEN contains(path, '://')
            THEN replace(path, 'https://h.example.com', '') ELSE path END AS url_path FROM form_text""")
def _(text):
    return text.select("n", X.file_ext("path").alias("ext"), X.base_name("path").alias("base"),
                       X.url_path("path").alias("url_path"))


@check("display_fallbacks", "X11", "referral_source",
       """SELECT id, coalesce(nullif(faxNumber, ''), 'Not specified') AS fax,
            coalesce(CAST(numberOfProviders AS VARCHAR), 'N/A') AS listed,
            coalesce(CAST(nullif(numberOfProviders, 0) AS VARCHAR), 'Not specified') AS detailed FROM referral_source""")
def _(src):
    return src.select(
        "id", X.or_default("faxNumber", "Not specified").alias("fax"),
        X.or_default("numberOfProviders", "N/A", falsy=False).alias("listed"),
        X.or_default("numberOfProviders", "Not specified", number=True).alias("detailed"))


@check("address_lines", "X12", "referral_source",
       """SELECT id, CASE WHEN coalesce(address, '') = '' THEN '' WHEN coalesce(city, '') = '' THEN address
            ELSE concat(address, ', ', city) END AS street,
          concat_ws(', ', nullif(city, ''), nullif(state, ''), nullif(zipCode, '')) AS locality,
          CASE WHEN coalesce(address, '') <> '' AND city <> '' AND state <> ''
            THEN concat(city, ', ', state, ' ', coalesce(zipCode, '')) END AS clinic FROM referral_source""")
def _(src):
    return src.select("id", X.address_line("address", "city").alias("street"),
                      X.locality_line("city", "state", "zipCode").alias("locality"),
                      X.clinic_address_lines("address", "city", "state", "zipCode").alias("clinic"))


@check("stored_responses", "X13", "send_result",
       f"""SELECT campaignId, referralSourceId, CASE WHEN success THEN
            concat('{{"faxId":"', coalesce(faxId, json_extract_string(data, '$.id'),
              concat('unknown-', epoch_ms(TIMESTAMP '{AS_OF}'))), '","status":"', coalesce(status, 'sent'),
              '","details":', coalesce(data, '{{}}'), '}}')
            WHEN thrown THEN concat('{{"error":"', coalesce(error, 'Unknown error'), '"}}')
            ELSE concat('{{"error":"', coalesce(error, 'Unknown error'), '"',
              CASE WHEN status IS NULL THEN '' ELSE concat(',"status":"', status, '"') END,
              ',"data":', coalesce(data, '{{}}'), '}}') END AS response FROM send_result""")
def _(results):
    text = X.send_response("success", "faxId", "data", "error", "status", ntz(AS_OF), "thrown")
    return results.select("campaignId", "referralSourceId", text.alias("response"))


@check("event_responses", "X13", "delivery_event",
       """SELECT faxId, status, concat('{"faxId":"', faxId, '","status":"', status, '","updatedAt":"',
            strftime(receivedAt, '%Y-%m-%dT%H:%M:%S.%g'), 'Z","error":null}') AS response FROM delivery_event""")
def _(ev):
    text = X.event_response("faxId", "status", "receivedAt", F.lit(None).cast("string"))
    return ev.select("faxId", "status", text.alias("response"))


@check("provider_ids", "X14", "provider_answer",
       """WITH a AS (SELECT n, tmpId, json_extract_string(answer, '$.data.sentFax.id') AS sent,
            json_extract_string(answer, '$.faxId') AS fax, json_extract_string(answer, '$.id') AS id FROM provider_answer)
          SELECT n, coalesce(CASE WHEN sent NOT IN ('', '0') THEN sent END, CASE WHEN fax NOT IN ('', '0') THEN fax END,
            CASE WHEN id NOT IN ('', '0') THEN id END, tmpId) AS fax FROM a""")
def _(answers):
    return answers.select("n", X.provider_fax_id("answer", "tmpId").alias("fax"))


@check("website_links", "X15", "referral_source",
       """SELECT id, CASE WHEN starts_with(website, 'http') THEN website ELSE 'https://' || website END AS link
          FROM referral_source""")
def _(src):
    return src.select("id", X.website_url("website").alias("link"))


@check("import_notes", "X16", "place_detail",
       r"""SELECT place_id, concat('Google Rating: ', coalesce(regexp_replace(CAST(rating AS VARCHAR), '\.0$', ''),
            'undefined'), ' (', user_ratings_total, ' reviews)', chr(10), 'Business Types: ', kind, ', health') AS note
          FROM place_detail""")
def _(detail):
    note = X.import_note("rating", "user_ratings_total", F.array("kind", F.lit("health")))
    return detail.select("place_id", note.alias("note"))


@check("document_urls", "X17", "campaign",
       """SELECT id, 'https://outreach.example.com' || documentUrl AS remote, 'http://localhost:3000' || documentUrl AS local
          FROM campaign""")
def _(camp):
    return camp.select("id", X.document_url("documentUrl", CFG.host).alias("remote"),
                       X.document_url("documentUrl", "localhost:3000").alias("local"))


@check("short_ids", "X18", "campaign_link",
       """SELECT campaignId, substring(concat(campaignId, '-', referralSourceId), 1, 10) AS short FROM campaign_link""")
def _(link):
    return link.select("campaignId", X.short_id(F.concat_ws("-", "campaignId", "referralSourceId")).alias("short"))


@check("cover_sheets", "X19", "campaign",
       """SELECT id, includeCoverSheet AS shown, 'Referral Outreach' AS sender,
            CASE WHEN includeCoverSheet THEN concat('Fax: ', coalesce(nullif(coverSheetFromNumber, ''), '19105550000'))
              ELSE '' END AS company,
            CASE WHEN includeCoverSheet THEN name ELSE 'Provider' END AS recipient,
            CASE WHEN includeCoverSheet THEN coalesce(nullif(coverSheetSubject, ''), 'Referral Information')
              ELSE 'Referral Information' END AS subject,
            'Please see the attached referral information.' AS message FROM campaign""")
def _(camp):
    none = F.lit(None).cast("string")
    sheet = X.cover_sheet(none, "coverSheetFromNumber", none, "coverSheetSubject", none, "includeCoverSheet", none,
                          "name", CFG)
    return camp.select("id", sheet.alias("s")).select(
        "id", F.col("s.includeCoversheet").alias("shown"), F.col("s.fromName").alias("sender"),
        F.col("s.companyInfo").alias("company"), F.col("s.toName").alias("recipient"), "s.subject", "s.message")


@check("event_statuses", "X20", "delivery_event",
       """SELECT faxId, status, CASE WHEN upper(status) IN ('DELIVERED', 'COMPLETED') THEN 'SENT'
            WHEN upper(status) IN ('FAILED', 'ERROR') THEN 'FAILED' ELSE 'PENDING' END AS mapped FROM delivery_event""")
def _(ev):
    return ev.select("faxId", "status", X.map_event_status("status").alias("mapped"))


@check("final_statuses", "X21", "provider_status",
       """SELECT faxId, CASE status WHEN 'delivered' THEN 'DELIVERED' WHEN 'failed' THEN 'FAILED' ELSE 'SENT' END
            AS mapped FROM provider_status""")
def _(feed):
    return feed.select("faxId", X.map_final_status("status").alias("mapped"))


@check("unit_texts", "X22", "place_listing",
       """SELECT place_id, printf('%.4f', lat) AS lat, printf('%.4f', lng) AS lng,
            printf('%.1f km (%d miles)', (user_ratings_total * 100 + 7) / 1000,
              CAST(floor((user_ratings_total * 100 + 7) / 1609 + 0.5) AS BIGINT)) AS distance FROM place_listing""")
def _(listing):
    return listing.select("place_id", X.fmt_coord("lat").alias("lat"), X.fmt_coord("lng").alias("lng"),
                          X.fmt_distance(F.col("user_ratings_total") * 100 + 7).alias("distance"))


@check("insert_defaults", "X23", "source_request",
       f"""SELECT requestId, concat('c', substring(sha256(requestId), 1, 24)) AS id, 'DRAFT' AS status,
             true AS "includeCoverSheet", TIMESTAMP '{AS_OF}' AS "createdAt" FROM source_request""")
def _(req):
    rows = X.with_defaults(req.select("requestId"), "campaign", AS_OF, "requestId")
    return rows.select("requestId", "id", "status", "includeCoverSheet", "createdAt")
