"""Bulk creation. Requests are (requestId, seq, body); a new id comes from its request, so a repeat adds the same row."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.functions.dates import parse_instant, parse_local_date
from caretrail.functions.defaults import is_missing, null_if_empty, null_if_zero, ntz, with_defaults
from caretrail.operators.guards import DUPLICATE_CLINIC, flag_duplicate_name
from caretrail.plans.change import (
    Change, blank, first_reason, has, mark_known, once, split_rejects, value, whole_number, with_body,
    written_down,
)
from caretrail.operators.keys import claim_keys
from caretrail.schemas import PRIMARY_KEYS, TABLES, conform

# Reasons given to the caller.
NAME_REQUIRED = "Name is required"
SOURCE_FAILED = "Failed to create referral source"
SOURCE_REQUIRED = "Referral source ID is required"
TYPE_REQUIRED = "Interaction type is required"
DATE_REQUIRED = "Interaction date is required"
INTERACTION_FAILED = "Failed to create interaction"
CAMPAIGN_TYPE_REQUIRED = "Campaign type is required"
CAMPAIGN_FAILED = "Failed to create campaign"
CLINIC_FAILED = "Failed to create clinic location"

SOURCE_TEXTS = (
    "address", "city", "state", "zipCode", "clinicLocationId", "contactPerson", "contactTitle", "contactPhone",
    "contactEmail", "website", "notes", "categoryId",
)
CLINIC_TEXTS = ("address", "city", "state", "zipCode", "phoneNumber", "faxNumber")


def _filled(*keys: str) -> dict[str, Column]:
    """Text columns where '' is stored as null."""
    return {k: null_if_empty(value(k)) for k in keys}


def _insert(
    table: DataFrame, ok: DataFrame, name: str, rejects: DataFrame, as_of: datetime | str, failed: str,
    carried: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(new rows with ``carried`` columns, all rejects). Ids are unique: the first request of an id that isn't stored
    makes the row, by seq and then by what it holds; the others fail."""
    full = with_defaults(ok, name, as_of, "requestId")
    seq = F.col("seq") if "seq" in ok.columns else F.lit(None).cast("long")
    columns = [f.name for f in TABLES[name].fields if f.name in full.columns]
    rows = full.select(*columns, *carried, "requestId", seq.alias("_seq"), F.xxhash64(*columns, *carried).alias("_tie"))
    claim = claim_keys(rows, PRIMARY_KEYS[name], ["_seq", "_tie"], table)
    refused = claim.refused.select("requestId", F.lit(failed).alias("reason"))
    return claim.fresh, rejects.unionByName(refused)


def _finish(
    table: DataFrame, ok: DataFrame, name: str, rejects: DataFrame, as_of: datetime | str, failed: str
) -> Change:
    rows, refused = _insert(table, ok, name, rejects, as_of, failed)
    made = conform(rows, name)
    return Change(table.unionByName(made, allowMissingColumns=True), made, refused)


def _unreadable() -> Column:
    return F.col("b").isNull()


def create_sources(
    req: DataFrame, src: DataFrame, as_of: datetime | str, clinics: DataFrame | None = None,
    categories: DataFrame | None = None,
) -> Change:
    """New sources. '' and 0 are stored as null, except in fax and NPI number."""
    numbers = {"rating": value("rating").try_cast("double")}
    numbers |= {k: whole_number(value(k)) for k in ("expectedMonthlyReferrals", "numberOfProviders")}
    wrong = F.lit(False)
    for k, number in numbers.items():
        wrong = wrong | (~blank(k) & number.isNull())
    rows = with_body(req).withColumns(
        {
            "name": value("name"),
            **_filled(*SOURCE_TEXTS),
            "faxNumber": value("faxNumber"),
            "npiNumber": value("npiNumber"),
            **{k: null_if_zero(number) for k, number in numbers.items()},
            "_wrong": wrong | _unreadable(),
        }
    )
    return insert_sources(rows, src, as_of, clinics, categories)


def insert_sources(
    rows: DataFrame, src: DataFrame, as_of: datetime | str, clinics: DataFrame | None = None,
    categories: DataFrame | None = None,
) -> Change:
    """New sources from typed rows with ``requestId`` and ``_wrong``, which rejects a row whatever else it holds."""
    dangling = F.lit(False)
    for key, parent in (("clinicLocationId", clinics), ("categoryId", categories)):
        if parent is not None:
            rows = mark_known(rows, parent, key, f"_{key}")
            dangling = dangling | (F.col(key).isNotNull() & ~F.col(f"_{key}"))
    unreadable = F.col("b").isNull() if "b" in rows.columns else F.col("_wrong")
    reason = first_reason(
        (unreadable, SOURCE_FAILED), (is_missing("name"), NAME_REQUIRED), (F.col("_wrong") | dangling, SOURCE_FAILED)
    )
    ok, rejects = split_rejects(rows.withColumn("reason", reason))
    return _finish(src, ok, "referral_source", rejects, as_of, SOURCE_FAILED)


def create_interactions(
    req: DataFrame, inter: DataFrame, src: DataFrame, as_of: datetime | str, tz: str = "UTC"
) -> Change:
    """New interactions of known sources."""
    rows = with_body(req).withColumns(
        {
            "referralSourceId": value("referralSourceId"),
            "type": value("type"),
            "date": parse_instant(value("date"), tz),
            **_filled("notes", "outcome"),
        }
    )
    rows = mark_known(rows, src, "referralSourceId", "_source")
    reason = first_reason(
        (_unreadable(), INTERACTION_FAILED),
        (blank("referralSourceId"), SOURCE_REQUIRED),
        (blank("type"), TYPE_REQUIRED),
        (blank("date"), DATE_REQUIRED),
        (F.col("date").isNull() | ~F.col("_source"), INTERACTION_FAILED),
    )
    ok, rejects = split_rejects(rows.withColumn("reason", reason))
    return _finish(inter, ok, "interaction", rejects, as_of, INTERACTION_FAILED)


class CampaignChange(NamedTuple):
    campaigns: Change
    links: Change
    rejects: DataFrame


def recipient_ids() -> Column:
    """``referralSourceIds`` of a body; null when absent or null."""
    return F.from_json(value("referralSourceIds"), "array<string>")


def create_campaigns(
    req: DataFrame, camp: DataFrame, link: DataFrame, src: DataFrame, as_of: datetime | str, tz: str = "UTC"
) -> CampaignChange:
    """New campaigns with one PENDING link per recipient. An unknown or repeated recipient rejects the campaign."""
    document = ~blank("documentUrl")
    rows = once(with_body(req), "_ids", recipient_ids()).withColumns(
        {
            "name": value("name"),
            "type": value("type"),
            "status": F.coalesce(null_if_empty(value("status")), F.lit("DRAFT")),
            "startDate": F.when(blank("startDate"), ntz(as_of)).otherwise(parse_local_date(value("startDate"), tz)),
            "endDate": F.when(~blank("endDate"), parse_local_date(value("endDate"), tz)),
            **_filled("description", "content", "documentUrl"),
            "documentName": F.when(document, null_if_empty(value("documentName"))),
        }
    )
    wanted = rows.select("requestId", F.explode("_ids").alias("referralSourceId"))
    bad = (
        mark_known(wanted, src, "referralSourceId", "_source")
        .where(~F.col("_source"))
        .select("requestId").distinct().withColumn("_bad", F.lit(True))
    )
    repeated = F.coalesce(F.size(F.array_distinct("_ids")) < F.size("_ids"), F.lit(False))
    reason = first_reason(
        (_unreadable(), CAMPAIGN_FAILED),
        (blank("name"), NAME_REQUIRED),
        (blank("type"), CAMPAIGN_TYPE_REQUIRED),
        (
            F.col("startDate").isNull() | (~blank("endDate") & F.col("endDate").isNull()) | repeated
            | F.coalesce(F.col("_bad"), F.lit(False)),
            CAMPAIGN_FAILED,
        ),
    )
    # read by several branches below: the bodies are parsed and judged once
    judged = rows.join(bad, "requestId", "left").withColumn("reason", reason).drop("b", "body", "_bad")
    ok, rejects = split_rejects(written_down(judged, "judged"))
    fresh, rejects = _insert(camp, ok, "campaign", rejects, as_of, CAMPAIGN_FAILED, ("_ids",))
    made = conform(fresh, "campaign")
    # new campaigns with different recipients: the pairs are new
    pairs = fresh.select(F.col("id").alias("campaignId"), F.explode("_ids").alias("referralSourceId"))
    links = conform(with_defaults(pairs, "campaign_link", as_of), "campaign_link")
    return CampaignChange(
        Change(camp.unionByName(made, allowMissingColumns=True), made, rejects),
        Change(link.unionByName(links, allowMissingColumns=True), links, rejects), rejects)


def create_clinics(req: DataFrame, clinic: DataFrame, as_of: datetime | str) -> Change:
    """New clinics, active unless given; the name must be free in the table and in the batch."""
    rows = with_body(req).withColumns(
        {
            "name": value("name"),
            **_filled(*CLINIC_TEXTS),
            "isActive": F.when(~has("isActive") | (value("isActive") == "true"), True)
            .when(value("isActive") == "false", False),
        }
    )
    early = first_reason((_unreadable(), CLINIC_FAILED), (blank("name"), NAME_REQUIRED))
    late = first_reason((F.col("isActive").isNull(), CLINIC_FAILED))
    rows = rows.withColumn("_early", early).withColumn("_late", late)
    sound = rows.where(F.col("_early").isNull())
    # only a request that would be stored takes its name away from later ones
    takers = flag_duplicate_name(sound.where(F.col("_late").isNull()).select("requestId", "seq", "name"), clinic)
    taken = clinic.select("name", F.lit(True).alias("_exists"))
    flagged = (
        rows.join(takers.select("requestId", "name", "duplicate").distinct(), ["requestId", "name"], "left")
        .join(taken, "name", "left")
        .withColumn(
            "reason",
            F.coalesce(
                F.col("_early"),
                F.when(F.coalesce(F.col("duplicate"), F.col("_exists"), F.lit(False)), F.lit(DUPLICATE_CLINIC)),
                F.col("_late"),
            ),
        )
    )
    ok, rejects = split_rejects(flagged)
    return _finish(clinic, ok, "clinic_location", rejects, as_of, CLINIC_FAILED)
