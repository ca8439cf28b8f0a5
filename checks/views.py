"""Entities and requests as SQL over the driver's tables.

One text per view, run by both engines: ``{customer}`` and the like are frames in Spark and plain names in DuckDB.
Request bodies are JSON text; some of it is broken on purpose.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

VIEWS = {
    "clinic_location": """
SELECT concat('cl', n_nationkey) AS id, n_name AS name,
  CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE concat(n_nationkey, ' Clinic Way') END AS address,
  concat('City ', n_nationkey) AS city, 'NC' AS state, lpad(CAST(28400 + n_nationkey AS STRING), 5, '0') AS zipCode,
  n_nationkey % 5 <> 4 AS isActive
FROM {nation}""",
    "referral_category": """
SELECT DISTINCT concat('cat_', c_mktsegment) AS id, c_mktsegment AS name FROM {customer}""",
    "referral_source": """
SELECT concat('rs', c_custkey) AS id, c_name AS name,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE concat(c_custkey, ' Main St') END AS address,
  CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat('Greater NATION_', c_nationkey) END AS city,
  'NC' AS state,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE lpad(CAST(28000 + c_custkey % 900 AS STRING), 5, '0') END AS zipCode,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('cl', c_nationkey) END AS clinicLocationId,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('cat_', c_mktsegment) END AS categoryId,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('Contact ', c_custkey % 50) END AS contactPerson,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ''
    WHEN 2 THEN concat('(910) 555-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))
    WHEN 3 THEN concat('910555', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))
    WHEN 4 THEN concat('+1 910 555 ', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))
    ELSE concat('555-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) END AS faxNumber,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('http://s', c_custkey, '.example.com')
    ELSE concat('s', c_custkey, '.example.com') END AS website,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 40 AS INT) END AS expectedMonthlyReferrals,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_custkey % 12 AS INT) END AS numberOfProviders,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) + c_custkey * INTERVAL '1' MINUTE AS createdAt
FROM {customer}""",
    "interaction": """
SELECT concat('i', event_id) AS id, concat('rs', user_id) AS referralSourceId,
  CASE event_type WHEN 'click' THEN 'CALL' WHEN 'view' THEN 'VISIT' WHEN 'signup' THEN 'MEETING'
    WHEN 'purchase' THEN 'REFERRAL' ELSE 'OTHER' END AS type,
  ts AS date, CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END AS notes,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Follow up' END AS outcome
FROM {events}""",
    "campaign": """
SELECT concat('c', o_orderkey) AS id, concat('Campaign ', o_orderkey) AS name, o_orderdate AS startDate,
  o_orderdate AS createdAt,
  CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'COMPLETED'
    ELSE CASE o_orderkey % 3 WHEN 0 THEN 'CANCELLED' WHEN 1 THEN 'DRAFT' ELSE 'PAUSED' END END AS status,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'FAX' WHEN '2' THEN 'EMAIL' WHEN '3' THEN 'CALL'
    WHEN '4' THEN 'EVENT' ELSE 'DIRECT_MAIL' END AS type,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('/uploads/', o_orderkey, '.pdf') END AS documentUrl,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('Subject ', o_orderkey % 7) END AS coverSheetSubject,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '19105550000' END AS coverSheetFromNumber,
  o_orderkey % 6 <> 0 AS includeCoverSheet
FROM {orders}""",
    "campaign_link": """
SELECT concat('c', l_orderkey) AS campaignId, concat('rs', l_partkey % 150) AS referralSourceId,
  CASE min(l_returnflag) WHEN 'A' THEN 'PENDING' WHEN 'N' THEN 'SENT' ELSE 'FAILED' END AS status,
  CASE WHEN min(l_returnflag) = 'A' THEN NULL ELSE max(l_shipdate) END AS sentAt
FROM {lineitem} GROUP BY l_orderkey, l_partkey % 150""",
    "place_listing": """
SELECT concat('p', p_partkey) AS place_id, p_name AS name,
  CASE p_partkey % 4
    WHEN 0 THEN concat(p_partkey, ' Main St, NATION_', p_partkey % 25, ', NC ',
      lpad(CAST(28000 + p_partkey % 900 AS STRING), 5, '0'), ', USA')
    WHEN 1 THEN concat('Suite ', p_partkey % 9, ', ', p_partkey, ' Oak Ave, NATION_', p_partkey % 25, ', NC ',
      lpad(CAST(28000 + p_partkey % 900 AS STRING), 5, '0'), ', US')
    WHEN 2 THEN concat(p_partkey, ' Elm St, NATION_', p_partkey % 25, ', North Carolina')
    ELSE concat('NATION_', p_partkey % 25, ', NC') END AS formatted_address,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(1 + (p_size % 9) * 0.5 AS DOUBLE) END AS rating,
  CAST(p_partkey % 500 AS INT) AS user_ratings_total,
  CAST(34 + (p_partkey % 100) * 0.02 AS DOUBLE) AS lat, CAST(-78 - (p_partkey % 70) * 0.02 AS DOUBLE) AS lng,
  p_type AS primary_type
FROM {part}""",
    "delivery_event": """
SELECT concat('f', l_orderkey, '-', l_linenumber) AS faxId, 'queued' AS status,
  concat('c', l_orderkey) AS campaignId, concat('rs', l_partkey % 150) AS referralSourceId,
  l_shipdate + (l_suppkey % 3) * INTERVAL '1' MINUTE AS receivedAt
FROM {lineitem}
UNION ALL
SELECT concat('f', l_orderkey, '-', l_linenumber) AS faxId,
  CASE l_returnflag WHEN 'A' THEN 'Delivered' WHEN 'N' THEN 'FAILED'
    ELSE CASE l_linestatus WHEN 'O' THEN 'completed' ELSE 'unknown' END END AS status,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE concat('c', l_orderkey) END AS campaignId,
  concat('rs', l_partkey % 151) AS referralSourceId,
  l_shipdate + INTERVAL '1' MINUTE AS receivedAt
FROM {lineitem}""",
    "gazetteer": """
SELECT concat(n_name, ', NC') AS place, CAST(34 + n_nationkey * 0.08 AS DOUBLE) AS lat,
  CAST(-78 - n_nationkey * 0.05 AS DOUBLE) AS lng
FROM {nation}""",
    # detail answers: one in seven failed, one in eleven is for another place; some lack a phone, website or rating
    "place_detail": """
SELECT concat(CASE WHEN p_partkey % 11 = 5 THEN 'q' ELSE 'p' END, p_partkey) AS place_id,
  CASE WHEN p_partkey % 7 = 3 THEN 'NOT_FOUND' ELSE 'OK' END AS status,
  concat(p_name, ' ', p_brand) AS name,
  CASE p_partkey % 4
    WHEN 0 THEN concat(p_partkey, ' Main St, Greater NATION_', p_partkey % 25, ', NC ',
      lpad(CAST(28000 + p_partkey % 900 AS STRING), 5, '0'), ', USA')
    WHEN 1 THEN concat('Suite ', p_partkey % 9, ', ', p_partkey, ' Oak Ave, NATION_', p_partkey % 25, ', NC ',
      lpad(CAST(28000 + p_partkey % 900 AS STRING), 5, '0'), ', US')
    WHEN 2 THEN concat(p_partkey, ' Elm St, NATION_', p_partkey % 25, ', North Carolina')
    ELSE concat('NATION_', p_partkey % 25, ', NC') END AS formatted_address,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(1 + (p_size % 9) * 0.5 AS DOUBLE) END AS rating,
  CAST(p_partkey % 500 AS INT) AS user_ratings_total,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat('(910) 555-', lpad(CAST(p_partkey % 10000 AS STRING), 4, '0')) END
    AS phone,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat('https://p', p_partkey, '.example.com') END AS website,
  lower(p_type) AS kind
FROM {part}""",
    # what the geocoder answers: one in seven finds nothing, one in eleven has no location, one no components
    "geocode_answer": """
SELECT concat(n_name, ', NC') AS place, CASE WHEN n_nationkey % 7 = 3 THEN 'ZERO_RESULTS' ELSE 'OK' END AS status,
  concat(n_name, ', North Carolina, USA') AS formatted_address,
  CASE n_nationkey % 3 WHEN 0 THEN 'administrative_area_level_1' WHEN 1 THEN 'locality' ELSE 'postal_code' END AS kind,
  CAST(CASE WHEN n_nationkey % 11 = 5 THEN NULL ELSE 34 + n_nationkey * 0.08 END AS DOUBLE) AS lat,
  CAST(CASE WHEN n_nationkey % 11 = 5 THEN NULL ELSE -78 - n_nationkey * 0.05 END AS DOUBLE) AS lng,
  n_nationkey = 9 AS bare
FROM {nation}""",
    "place_search": """
SELECT concat('ps', s_suppkey) AS requestId,
  CASE WHEN s_suppkey % 13 = 0 THEN '' WHEN s_suppkey % 17 = 0 THEN 'Nowhere'
    ELSE concat('NATION_', s_nationkey, ', NC') END AS location,
  CASE s_suppkey % 5 WHEN 0 THEN 'Econom' WHEN 1 THEN 'brass' WHEN 2 THEN 'PROMO' WHEN 3 THEN 'TIN'
    ELSE CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'steel' END END AS businessType,
  CAST(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 1 + s_suppkey % 4 END AS DOUBLE) AS minRating,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 5000 + s_suppkey % 9 * 9000 END AS radius
FROM {supplier}""",
    # places as the geocoder describes them: whole states, towns, zip codes
    "geocode_component": """
SELECT concat('p', p_partkey) AS place_id,
  CASE p_partkey % 3 WHEN 0 THEN 'administrative_area_level_1' WHEN 1 THEN 'country' ELSE 'locality' END AS kind1,
  CASE p_partkey % 5 WHEN 0 THEN 'postal_code' WHEN 1 THEN 'locality' WHEN 2 THEN 'administrative_area_level_1'
    ELSE 'country' END AS kind2
FROM {part}""",
    "source_request": """
SELECT concat('sq', c_custkey) AS requestId, c_custkey AS seq,
  concat('{{"name":', CASE WHEN c_custkey % 10 = 0 THEN '""' WHEN c_custkey % 17 = 0 THEN 'null'
      ELSE concat('"New ', c_name, '"') END,
    ',"address":"', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat(c_custkey, ' Pine Rd') END, '"',
    CASE WHEN c_custkey % 3 = 0 THEN ',"city":null' ELSE ',"city":"Town"' END,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(',"clinicLocationId":"cl', c_custkey % 28, '"') END,
    ',"faxNumber":', CASE c_custkey % 3 WHEN 0 THEN '""' WHEN 1 THEN 'null' ELSE '"910"' END,
    ',"rating":', CASE WHEN c_custkey % 29 = 0 THEN '"good"' ELSE CAST(c_custkey % 6 AS STRING) END,
    ',"numberOfProviders":', CASE WHEN c_custkey % 31 = 0 THEN '2.5' ELSE CAST(c_custkey % 3 AS STRING) END,
    CASE WHEN c_custkey % 19 = 0 THEN '' ELSE '}}' END) AS body
FROM {customer}""",
    "interaction_request": """
SELECT concat('iq', event_id) AS requestId, event_id AS seq,
  concat('{{', CASE WHEN event_id % 10 = 0 THEN '"referralSourceId":"",'
      ELSE concat('"referralSourceId":"rs', user_id * (1 + event_id % 2 * 100), '",') END,
    CASE WHEN event_id % 6 = 0 THEN '' ELSE '"type":"CALL",' END,
    '"date":', CASE event_id % 8 WHEN 0 THEN 'null' WHEN 1 THEN '"2024-03-01"' WHEN 2 THEN '"soon"'
      ELSE concat('"2024-03-0', 1 + event_id % 9, 'T1', event_id % 10, ':30:00.250Z"') END,
    ',"notes":"', CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Spoke' END, '"',
    CASE WHEN event_id % 23 = 0 THEN '' ELSE '}}' END) AS body
FROM {events}""",
    "campaign_request": """
SELECT concat('cq', o_orderkey) AS requestId, o_orderkey AS seq,
  concat('{{"name":', CASE WHEN o_orderkey % 9 = 0 THEN '""' ELSE concat('"Drive ', o_orderkey, '"') END,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ',"type":"FAX"' END,
    CASE WHEN o_orderkey % 4 = 0 THEN ',"status":"ACTIVE"' ELSE '' END,
    ',"startDate":"', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('2024-02-', 10 + o_orderkey % 22) END, '"',
    CASE WHEN o_orderkey % 3 = 0 THEN ',"documentUrl":"/uploads/d.pdf"' ELSE '' END, ',"documentName":"d.pdf"',
    ',"referralSourceIds":',
    CASE o_orderkey % 6 WHEN 0 THEN 'null' WHEN 1 THEN '[]'
      ELSE concat('["rs', o_custkey % 160, '","rs', o_orderkey % 40, '"]') END,
    '}}') AS body
FROM {orders}""",
    "clinic_request": """
SELECT concat('lq', s_suppkey) AS requestId, s_suppkey AS seq,
  concat('{{"name":', CASE WHEN s_suppkey % 11 = 0 THEN 'null' ELSE concat('"NATION_', (s_suppkey * 7) % 60, '"') END,
    ',"city":"', CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'Town' END, '"',
    CASE s_suppkey % 4 WHEN 0 THEN ',"isActive":false' WHEN 1 THEN ',"isActive":null' WHEN 2 THEN ',"isActive":true'
      ELSE '' END, '}}') AS body
FROM {supplier}""",
    "source_patch": """
SELECT concat('sp', c_custkey) AS requestId, c_custkey AS seq,
  concat('rs', (c_custkey - c_custkey % 2) * (1 + c_custkey % 3 % 2)) AS id,
  concat('{{"notes":"n', c_custkey, '"',
    CASE WHEN c_custkey % 3 = 0 THEN ',"address":null' WHEN c_custkey % 3 = 1 THEN ',"address":""' ELSE '' END,
    CASE WHEN c_custkey % 13 = 0 THEN ',"name":null' WHEN c_custkey % 4 = 0
      THEN concat(',"name":"Renamed ', c_custkey, '"') ELSE '' END,
    CASE WHEN c_custkey % 5 = 0 THEN ',"numberOfProviders":0' ELSE '' END, '}}') AS body
FROM {customer}""",
    "interaction_patch": """
SELECT concat('ip', event_id) AS requestId, event_id AS seq, concat('i', event_id * (1 + event_id % 2)) AS id,
  concat('{{"outcome":', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"Done"' END,
    CASE event_id % 5 WHEN 0 THEN ',"date":null' WHEN 1 THEN ',"date":""' WHEN 2 THEN ',"date":"2024-05-05"' ELSE '' END,
    '}}') AS body
FROM {events}""",
    "clinic_patch": """
SELECT concat('lp', s_suppkey) AS requestId, s_suppkey AS seq, concat('cl', s_suppkey) AS id,
  concat('{{', CASE WHEN s_suppkey % 3 = 0 THEN concat('"name":"NATION_', s_suppkey + 4 * (s_suppkey % 2), '",')
      WHEN s_suppkey % 3 = 1 THEN concat('"name":"Clinic ', s_suppkey % 4, '",') ELSE '' END,
    '"phoneNumber":"', s_suppkey, '"', CASE WHEN s_suppkey % 7 = 0 THEN ',"isActive":null' ELSE ',"isActive":false' END,
    '}}') AS body
FROM {supplier}""",
    "campaign_patch": """
SELECT concat('cp', o_orderkey) AS requestId, o_orderkey AS seq, concat('c', o_orderkey * (1 + o_orderkey % 2)) AS id,
  concat('{{"description":"d', o_orderkey, '"',
    CASE o_orderkey % 4 WHEN 0 THEN ',"startDate":""' WHEN 1 THEN ',"startDate":null'
      WHEN 2 THEN ',"startDate":"2024-07-04"' ELSE '' END,
    CASE o_orderkey % 3 WHEN 0 THEN ',"endDate":null' WHEN 1 THEN ',"endDate":"2024-08-01"' ELSE '' END,
    CASE WHEN o_orderkey % 5 = 0 THEN ',"documentUrl":"/uploads/n.pdf"' ELSE '' END, ',"documentName":"n.pdf"',
    CASE WHEN o_orderkey % 17 = 0 THEN ',"type":null' ELSE '' END, '}}') AS body
FROM {orders}""",
    "cover_patch": """
SELECT concat('vp', o_orderkey) AS requestId, o_orderkey AS seq, concat('c', o_orderkey * (1 + o_orderkey % 2)) AS id,
  concat('{{"includeCoverSheet":', CASE o_orderkey % 4 WHEN 0 THEN 'false' ELSE 'true' END,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',"coverSheetFromName":"Front desk"' END,
    CASE WHEN o_orderkey % 5 = 0 THEN ',"coverSheetSubject":""' ELSE ',"coverSheetSubject":"Hello"' END,
    CASE WHEN o_orderkey % 7 = 0 THEN ',"coverSheetMessage":null' ELSE ',"coverSheetMessage":"See attached"' END,
    '}}') AS body
FROM {orders}""",
    # requested recipients: some kept, some new, some unknown, some listed twice, some lists empty or absent
    "recipient_request": """
SELECT concat('c', o_orderkey) AS campaignId,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '[]'
    ELSE concat('["rs', o_custkey % 150, '","rs', o_orderkey % 150, '","rs', o_custkey % 1600, '"]') END AS ids
FROM {orders}""",
    "kept_recipient": """
SELECT DISTINCT concat('c', l_orderkey) AS campaignId,
  concat('rs', CASE WHEN l_linenumber < 3 THEN l_partkey % 150 ELSE l_suppkey % 150 END) AS referralSourceId
FROM {lineitem}""",
    "send_result": """
SELECT concat(CASE WHEN l_orderkey % 3 = 0 THEN 'k' ELSE 'c' END, l_orderkey) AS campaignId,
  concat('rs', l_partkey % 150) AS referralSourceId,
  min(l_quantity) > 5 AS success,
  CASE WHEN min(l_linenumber) < 3 THEN concat('f', min(l_suppkey)) ELSE NULL END AS faxId,
  CASE WHEN max(l_linenumber) > 4 THEN concat('{{"id":"d', max(l_suppkey), '"}}') ELSE NULL END AS data,
  CASE WHEN min(l_quantity) > 3 THEN NULL ELSE 'busy' END AS error,
  CASE WHEN min(l_quantity) > 2 THEN NULL ELSE '500' END AS status,
  min(l_quantity) BETWEEN 2 AND 4 AS thrown
FROM {lineitem} GROUP BY l_orderkey, l_partkey % 150""",
    # links as they stand after a send, with the stored answer
    "sent_link": """
SELECT concat('c', l_orderkey) AS campaignId, concat('rs', l_partkey % 150) AS referralSourceId,
  CASE min(l_returnflag) WHEN 'A' THEN 'PENDING' WHEN 'N' THEN 'SENT' ELSE 'FAILED' END AS status,
  CASE WHEN min(l_returnflag) = 'A' THEN NULL ELSE max(l_shipdate) END AS sentAt,
  concat('{{"faxId":"f', l_orderkey, '-', l_partkey % 150, '","status":"sent","details":{{}}}}') AS response
FROM {lineitem} GROUP BY l_orderkey, l_partkey % 150""",
    "provider_status": """
SELECT DISTINCT concat(CASE WHEN l_partkey % 150 % 5 = 0 THEN 'g' ELSE 'f' END, l_orderkey, '-', l_partkey % 150) AS faxId,
  CASE (l_orderkey + l_partkey % 150) % 4 WHEN 0 THEN 'delivered' WHEN 1 THEN 'failed' WHEN 2 THEN 'Delivered'
    ELSE 'processing' END AS status,
  '{{"pages":2}}' AS body
FROM {lineitem}""",
    "provider_answer": """
SELECT o_orderkey AS n, concat('tmp.', o_orderkey) AS tmpId,
  CASE o_orderkey % 6
    WHEN 0 THEN concat('{{"data":{{"sentFax":{{"id":', o_orderkey, '}}}},"faxId":"x"}}')
    WHEN 1 THEN concat('{{"faxId":"f', o_orderkey, '"}}') WHEN 2 THEN concat('{{"id":', o_orderkey, '}}')
    WHEN 3 THEN '{{}}' WHEN 4 THEN concat('{{"faxId":"","id":"i', o_orderkey, '"}}') ELSE NULL END AS answer
FROM {orders}""",
    # ids to delete, half of them unknown
    "interaction_delete": """
SELECT concat('id', event_id) AS requestId,
  concat(CASE WHEN event_id % 4 < 2 THEN 'i' ELSE 'x' END, event_id) AS id FROM {events}""",
    "campaign_delete": """
SELECT concat('cd', o_orderkey) AS requestId,
  concat(CASE WHEN o_orderkey % 4 < 2 THEN 'c' ELSE 'x' END, o_orderkey) AS id FROM {orders}""",
    # contacts with every third source only, sources of every third clinic only
    "spread_interaction": """
SELECT concat('i', event_id) AS id, concat('rs', user_id * 3) AS referralSourceId FROM {events}""",
    "grouped_source": """
SELECT concat('rs', c_custkey) AS id, concat('cl', c_nationkey - c_nationkey % 3) AS clinicLocationId FROM {customer}""",
    "legacy_source": """
SELECT concat('rs', c_custkey) AS id, c_name AS name, 'OTHER' AS industry, 'ACTIVE' AS status,
  CASE c_custkey % 8 WHEN 0 THEN 'Jacksonville' WHEN 1 THEN 'Wilmington' WHEN 2 THEN 'Beulaville'
    WHEN 3 THEN 'Goldsboro' WHEN 4 THEN 'Nashville' WHEN 5 THEN 'Raleigh' WHEN 6 THEN 'wilmington' ELSE NULL END
    AS clinicLocation
FROM {customer}""",
    # form texts of every shape the scalar functions must know
    "form_text": """
SELECT o_orderkey AS n,
  CASE o_orderkey % 6 WHEN 0 THEN concat(o_orderkey, 'abc') WHEN 1 THEN '' WHEN 2 THEN 'none'
    WHEN 3 THEN concat(' -', o_orderkey) WHEN 4 THEN concat(o_orderkey, '.75') ELSE NULL END AS number,
  CASE o_orderkey % 5 WHEN 0 THEN concat('dir/', o_orderkey, '.tar.gz') WHEN 1 THEN 'noext' WHEN 2 THEN 'dot.'
    WHEN 3 THEN concat('https://h.example.com/uploads/', o_orderkey, '.pdf') ELSE 'https://h.example.com' END AS path,
  CASE o_orderkey % 7 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'FAX' WHEN 2 THEN 'CALL' WHEN 3 THEN 'EVENT'
    WHEN 4 THEN 'DIRECT_MAIL' WHEN 5 THEN 'SOCIAL_MEDIA' ELSE 'OTHER' END AS code,
  CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN concat('2024-02-', 10 + o_orderkey % 22)
    WHEN 2 THEN concat('2024-0', 1 + o_orderkey % 9, '-15T23:30:00.125Z') WHEN 3 THEN 'tomorrow'
    WHEN 4 THEN concat('2024-0', 1 + o_orderkey % 9, '-15T02:30:00-0', o_orderkey % 6, ':30')
    WHEN 5 THEN '2023-13-01' WHEN 6 THEN concat('2024-0', 1 + o_orderkey % 9, '-15T02:30') ELSE NULL END AS moment
FROM {orders}""",
}


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(BASE[name]).parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as frame; plain ``timestamp`` columns become zone-less, as everywhere in the data model."""
    text = VIEWS[name]
    tables = {t: base_table(spark, sf_dir, t) for t in set(re.findall(r"(?<!\{)\{(\w+)\}", text))}
    df = spark.sql(text, **tables)
    zoned = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in zoned}) if zoned else df


def oracle(body: str, *views: str) -> str:
    """DuckDB text: the named views as CTEs before ``body``."""
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].format(**{t: t for t in BASE})})" for v in views)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
