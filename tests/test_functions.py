"""Scalar functions on hand-written rows: every null, empty and order rule."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caretrail import functions as X
from caretrail.functions.defaults import ntz
from caretrail.functions.dispatch import FORM_MESSAGE, DispatchConfig, cover_sheet_form
from caretrail.operators.filters import is_state_search


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.v for r in df.select("i", fn(F.col("c")).alias("v")).orderBy("i").collect()]


def test_normalize_phone(spark):
    raw = ["(910) 555-1234", "+1 910 555 1234", "555-12345", "letters", "", None]
    assert apply(spark, raw, X.normalize_phone) == ["19105551234", "19105551234", "55512345", "letters", None, None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="0123456789()-+ ab", max_size=14), min_size=1, max_size=20))
def test_normalize_phone_is_idempotent(spark, raw):
    once = apply(spark, raw, X.normalize_phone)
    assert apply(spark, once, X.normalize_phone) == once


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1 Main St, Town, NC 28401, USA", ("1 Main St", "Town", "NC", "28401")),
        ("1 Main St, Town, NC 28401, US", ("1 Main St", "Town", "NC", "28401")),
        ("Suite 3, 9 Oak Ave, Town, NC 28401-1234, USA", ("Suite 3", "9 Oak Ave", "NC", "28401-1234")),
        ("1 Main St, Town, North Carolina", ("1 Main St", "Town", "North Carolina", "")),
        ("Town, NC", ("Town, NC", "", "", "")),
        ("A, B, USA", ("A, B, USA", "", "", "")),
        ("A, USA", ("A, USA", "", "", "")),
        ("A , B ,NC 28401 ", ("A", "B", "NC", "28401")),
        ("A, B, C, USA, USA", ("A", "B", "USA", "")),
        ("A,, NC 1", ("A", "", "NC", "1")),
        ("", ("", "", "", "")),
        (None, None),
    ],
)
def test_parse_address(spark, text, expected):
    got = apply(spark, [text], X.parse_address)[0]
    assert (tuple(got) if got else got) == expected


def test_type_caption(spark):
    assert apply(spark, ["DIRECT_MAIL", "a", "", None], X.type_caption) == ["Direct_mail", "a", "", None]


def test_campaign_type_label(spark):
    codes = ["DIRECT_MAIL", "OTHER", "NEW", None]
    assert apply(spark, codes, X.campaign_type_label) == ["Direct Mail", "OTHER", "NEW", None]
    assert apply(spark, codes, lambda c: X.campaign_type_label(c, "form")) == ["Direct Mail", "Other", "NEW", None]


MOMENTS = ["2024-03-01", "2024-02-31", "2024-03-01T10:00:00.123456Z", "2024-03-01T10:00:00+05:30", "2024-03-01 10:00",
           "2024-13-01", "2024-03-01T25:00", "soon", "", None]


def test_parse_instant(spark):
    d = datetime
    assert apply(spark, MOMENTS, X.parse_instant) == [
        d(2024, 3, 1), d(2024, 3, 2), d(2024, 3, 1, 10, 0, 0, 123000), d(2024, 3, 1, 4, 30), d(2024, 3, 1, 10),
        None, None, None, None, None,
    ]


def test_parse_local_date(spark):
    d = datetime
    assert apply(spark, MOMENTS, lambda c: X.parse_local_date(c, "America/New_York")) == [
        d(2024, 3, 1, 17), d(2024, 3, 2, 17), d(2024, 3, 1, 10, 0, 0, 123000), d(2024, 3, 1, 4, 30), d(2024, 3, 1, 15),
        d(2025, 1, 1, 17), None, None, None, None,
    ]


def test_dates_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        expected = apply(spark, MOMENTS, X.parse_instant)
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert apply(spark, MOMENTS, X.parse_instant) == expected
        shown = apply(spark, ["2024-03-01T02:00:00Z"], lambda c: X.format_date(X.parse_instant(c), "long", "America/New_York"))
        assert shown == ["Feb 29, 2024"]
        # a moment the session's clocks skip
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        skipped = X.event_response(F.lit("f"), F.lit("s"), ntz("2024-03-10 02:30:00.25"), F.lit(None).cast("string"))
        assert '"2024-03-10T02:30:00.250Z"' in spark.range(1).select(skipped).first()[0]
        texts = ["2024-03-10T02:30:00Z", "2024-11-03T01:30:00-04:00", "2024-11-03T01:30:00-05:00"]
        assert apply(spark, texts, X.parse_instant) == [
            datetime(2024, 3, 10, 2, 30), datetime(2024, 11, 3, 5, 30), datetime(2024, 11, 3, 6, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_format_date(spark):
    show = lambda style, tz="UTC", empty="": lambda c: X.format_date(X.parse_instant(c), style, tz, empty)
    texts = ["2024-03-01T02:00:00Z", None]
    assert apply(spark, texts, show("long", "America/New_York")) == ["Feb 29, 2024", ""]
    assert apply(spark, texts, show("short")) == ["Mar 1", ""]
    assert apply(spark, texts, show("input", "America/New_York", "-")) == ["2024-02-29", "-"]
    assert apply(spark, texts, show("utc", "America/New_York")) == ["2024-03-01", ""]


def test_empty_values(spark):
    assert apply(spark, ["", "a", None], X.null_if_empty) == [None, "a", None]
    assert apply(spark, [0, 2, None], X.null_if_zero, "int") == [None, 2, None]
    assert apply(spark, ["", "a", None], lambda c: X.or_default(c, "N/A")) == ["N/A", "a", "N/A"]
    assert apply(spark, ["", "0", None], lambda c: X.or_default(c, "N/A", falsy=False)) == ["", "0", "N/A"]
    assert apply(spark, [0, 2, None], lambda c: X.or_default(c, "-", number=True), "int") == ["-", "2", "-"]
    assert apply(spark, [0, 2, None], lambda c: X.or_default(c, "-", falsy=False), "int") == ["0", "2", "-"]


def test_parse_int(spark):
    texts = ["12abc", " -7", "+3", "", "abc", "1.9", "99999999999", None]
    assert apply(spark, texts, X.parse_int) == [12, -7, 3, None, None, 1, None, None]


def test_file_parts(spark):
    assert apply(spark, ["a.pdf", "b.tar.gz", "noext", "dot.", None], X.file_ext) == ["pdf", "gz", "noext", "", None]
    assert apply(spark, ["/x/a.pdf", "a.pdf", "x/", None], X.base_name) == ["a.pdf", "a.pdf", "document.pdf", None]
    urls = ["https://h/uploads/a.pdf?x=1", "https://h", "/uploads/a.pdf", None]
    assert apply(spark, urls, X.url_path) == ["/uploads/a.pdf", "/", "/uploads/a.pdf", None]


def test_links_and_lines(spark):
    sites = ["http://a", "https://a", "a.example.com", "", None]
    assert apply(spark, sites, X.website_url) == ["http://a", "https://a", "https://a.example.com", None, None]
    df = spark.createDataFrame([("1 St", "T", "NC", "2"), ("1 St", "", "NC", None), (None, "T", "NC", "2")], "a string, c string, s string, z string")
    got = df.select(X.address_line("a", "c"), X.locality_line("c", "s", "z"), X.clinic_address_lines("a", "c", "s", "z")).collect()
    assert [tuple(r) for r in got] == [("1 St, T", "T, NC, 2", "T, NC 2"), ("1 St", "NC", None), ("", "T, NC, 2", None)]


def test_document_url_and_short_id(spark):
    assert apply(spark, ["/u/a.pdf"], lambda c: X.document_url(c, "x.example.com")) == ["https://x.example.com/u/a.pdf"]
    assert apply(spark, ["/u/a.pdf"], lambda c: X.document_url(c, "localhost:3000")) == ["http://localhost:3000/u/a.pdf"]
    assert apply(spark, ["c12345678901", "short"], X.short_id) == ["c123456789", "short"]


def test_units(spark):
    assert apply(spark, [50000, 1609, 0], X.fmt_distance, "int") == ["50.0 km (31 miles)", "1.6 km (1 miles)", "0.0 km (0 miles)"]
    assert apply(spark, [34.2, -77.94471], X.fmt_coord, "double") == ["34.2000", "-77.9447"]


def test_import_note(spark):
    df = spark.createDataFrame([(4.0, 12, ["a", "b"]), (4.5, None, ["a"]), (None, 3, None)], "r double, n int, t array<string>")
    assert [r[0] for r in df.select(X.import_note("r", "n", "t")).collect()] == [
        "Google Rating: 4 (12 reviews)\nBusiness Types: a, b", "Google Rating: 4.5 (undefined reviews)\nBusiness Types: a", None]


def test_send_response(spark):
    schema = "ok boolean, f string, d string, e string, s string"
    cases = {
        (True, "7", '{"b":1}', None, None): '{"faxId":"7","status":"sent","details":{"b":1}}',
        (True, None, '{"id":"d1"}', None, "queued"): '{"faxId":"d1","status":"queued","details":{"id":"d1"}}',
        (True, None, None, None, None): '{"faxId":"unknown-1704067200000","status":"sent","details":{}}',
        (False, None, None, None, None): '{"error":"Unknown error","data":{}}',
        (False, None, '{"q":1}', "busy", "503"): '{"error":"busy","status":"503","data":{"q":1}}',
    }
    df = spark.createDataFrame(list(cases), schema)
    got = df.select(X.send_response("ok", "f", "d", "e", "s", ntz("2024-01-01 00:00:00"))).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_event_response_keeps_a_null_error(spark):
    df = spark.createDataFrame([("f1", "Delivered", None), ("f2", "ERROR", "busy")], "f string, s string, e string")
    got = [r[0] for r in df.select(X.event_response("f", "s", ntz("2024-01-01 10:00:00"), "e")).collect()]
    assert got == [
        '{"faxId":"f1","status":"Delivered","updatedAt":"2024-01-01T10:00:00.000Z","error":null}',
        '{"faxId":"f2","status":"ERROR","updatedAt":"2024-01-01T10:00:00.000Z","error":"busy"}',
    ]


def test_provider_fax_id(spark):
    answers = ['{"data":{"sentFax":{"id":100554730}},"faxId":"x"}', '{"faxId":"f","id":"i"}', '{"id":5}', "{}", "broken", None]
    assert apply(spark, answers, lambda c: X.provider_fax_id(c, F.lit("tmp"))) == ["100554730", "f", "5", "tmp", "tmp", "tmp"]


def test_statuses(spark):
    assert apply(spark, ["delivered", "Completed", "ERROR", "queued", "odd", None], X.map_event_status) == [
        "SENT", "SENT", "FAILED", "PENDING", "PENDING", "PENDING"]
    assert apply(spark, ["delivered", "failed", "Delivered", None], X.map_final_status) == ["DELIVERED", "FAILED", "SENT", "SENT"]


SHEET = "n string, f string, c string, s string, m string, i boolean, p string, r string"


def test_cover_sheet(spark):
    cfg = DispatchConfig(sender_name="Desk", display_number="100")
    rows = [
        ("Ann", "200", "Clinic", "Hi", "Text", True, "Dr B", "Office"),
        (None, "", None, "", None, True, "", "Office"),
        ("Ann", "200", "Clinic", "Hi", "Text", False, "Dr B", "Office"),
        ("Ann", "200", "", "Hi", "Text", True, None, None),
    ]
    df = spark.createDataFrame(rows, SHEET)
    got = df.select(X.cover_sheet("n", "f", "c", "s", "m", "i", "p", "r", cfg).alias("x")).select("x.*").collect()
    standard = "Please see the attached referral information."
    assert [tuple(r) for r in got] == [
        (True, "Ann", "200", "Clinic | Fax: 200", "Dr B", "Hi", "Text"),
        (True, "Desk", "100", "Fax: 100", "Office", "Referral Information", standard),
        (False, "Desk", None, "", "Provider", "Referral Information", standard),
        (True, "Ann", "200", "Fax: 200", "Provider", "Hi", "Text"),
    ]


def test_cover_sheet_form(spark):
    df = spark.createDataFrame([("Ann", None, None, "", None, None, "", "")], SHEET)
    got = df.select(cover_sheet_form("n", "f", "c", "s", "m", "i", DispatchConfig()).alias("x")).select("x.*").first()
    assert tuple(got) == ("Ann", "", "", "Referral Information", FORM_MESSAGE, True)


def test_state_search(spark):
    state, town, code = (["administrative_area_level_1", "political"], ["locality"], ["postal_code"])
    df = spark.createDataFrame(
        [([(state,), (["country"],)],), ([(state,), (town,)],), ([(code,), (state,)],), ([(["country"],)],)],
        "c array<struct<types:array<string>>>",
    )
    assert [r[0] for r in df.select(is_state_search("c")).collect()] == [True, False, False, False]


def test_with_defaults_is_repeatable(spark):
    df = spark.createDataFrame([("r1", None), ("r2", "ACTIVE")], "requestId string, status string")
    make = lambda: sorted(tuple(r) for r in X.with_defaults(df, "campaign", "2024-01-01 00:00:00", "requestId").collect())
    first = make()
    assert first == make()
    assert [r[1] for r in first] == ["DRAFT", "ACTIVE"]
    assert len({r for r in first}) == 2
