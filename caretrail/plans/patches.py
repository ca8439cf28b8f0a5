"""Bulk updates. Requests are (requestId, seq, id, body): only keys in the body change, null clears."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.functions.defaults import ntz, with_defaults
from caretrail.operators.guards import DUPLICATE_CLINIC, flag_duplicate_name
from caretrail.plans.change import (
    Change, Field, apply_patches, blank, first_reason, mark_known, once, split_rejects, value, with_body,
    with_values, wrong_values,
)
from caretrail.plans.creates import recipient_ids
from caretrail.operators.joins import rekeyed
from caretrail.schemas import COLUMN_DEFAULTS, LINK_KEY, TABLES, conform

# Reasons given to the caller.
SOURCE_MISSING = "Referral source not found"
SOURCE_FAILED = "Failed to update referral source"
INTERACTION_MISSING = "Interaction not found"
INTERACTION_FAILED = "Failed to update interaction"
CLINIC_MISSING = "Clinic location not found"
CLINIC_FAILED = "Failed to update clinic location"
CAMPAIGN_MISSING = "Campaign not found"
CAMPAIGN_FAILED = "Failed to update campaign"
COVER_FAILED = "Failed to update cover sheet settings"
COVER_REQUIRED = {
    "coverSheetFromName": "From Name is required for cover sheet",
    "coverSheetSubject": "Subject is required for cover sheet",
    "coverSheetMessage": "Message is required for cover sheet",
}

TEXT, NAME = Field(), Field(required=True)
SOURCE_FIELDS = {
    "name": NAME,
    **dict.fromkeys(
        (
            "address", "city", "state", "zipCode", "clinicLocationId", "contactPerson", "contactTitle",
            "contactPhone", "contactEmail", "faxNumber", "npiNumber", "website", "notes",
        ),
        TEXT,
    ),
    "rating": Field("double"),
    "expectedMonthlyReferrals": Field("int"),
    "numberOfProviders": Field("int"),
    "categoryId": TEXT,
}
INTERACTION_FIELDS = {
    "referralSourceId": NAME, "type": NAME, "date": Field("instant", required=True), "notes": TEXT, "outcome": TEXT,
}
CLINIC_FIELDS = {
    "name": NAME,
    **dict.fromkeys(("address", "city", "state", "zipCode", "phoneNumber", "faxNumber"), TEXT),
    "isActive": Field("bool", required=True),
}
CAMPAIGN_FIELDS = {
    "name": NAME, "description": TEXT, "startDate": Field("start_date"), "endDate": Field("end_date"),
    "status": NAME, "type": NAME, "content": TEXT, "documentUrl": TEXT,
    "documentName": Field(needs="documentUrl"),
}
COVER_FIELDS = {
    "includeCoverSheet": Field("bool", required=True),
    **dict.fromkeys(
        ("coverSheetFromName", "coverSheetFromNumber", "coverSheetCompanyInfo", "coverSheetSubject",
         "coverSheetMessage"),
        TEXT,
    ),
}


def _dangling(rows: DataFrame, key: str, parent: DataFrame | None) -> DataFrame:
    """Adds ``_<key>``: a patched foreign key names a parent, or is null."""
    known = mark_known(rows.withColumn(key, value(key)), parent, key, f"_{key}").drop(key)
    return known.withColumn(f"_{key}", F.col(f"_{key}") | value(key).isNull())


def _patch(
    rows: DataFrame, table: DataFrame, spec: dict[str, Field], as_of: datetime | str,
    early: list[tuple[Column, str]], missing: str, late: list[tuple[Column, str]],
) -> Change:
    """Reasons in order: ``early`` checks, unknown id, ``late`` checks. ``rows`` come from :func:`with_values`."""
    rows = rows.withColumn("_early", first_reason(*early)).withColumn("_late", first_reason(*late))
    sound = rows.where(F.col("_early").isNull() & F.col("_late").isNull())
    checked = mark_known(rows.select("requestId", "id", "_early", "_late"), table, "id", "_known")
    unknown = F.when(~F.col("_known"), F.lit(missing))
    rejects = split_rejects(checked.withColumn("reason", F.coalesce("_early", unknown, "_late")))[1]
    return apply_patches(table, sound, rejects, spec, as_of)


def _unreadable() -> Column:
    return F.col("b").isNull()


def patch_sources(
    req: DataFrame, src: DataFrame, as_of: datetime | str, clinics: DataFrame | None = None,
    categories: DataFrame | None = None, tz: str = "UTC",
) -> Change:
    rows = with_values(with_body(req), SOURCE_FIELDS, tz)
    rows = _dangling(_dangling(rows, "clinicLocationId", clinics), "categoryId", categories)
    wrong = wrong_values(SOURCE_FIELDS) | ~F.col("_clinicLocationId") | ~F.col("_categoryId")
    return _patch(
        rows, src, SOURCE_FIELDS, as_of, [(_unreadable(), SOURCE_FAILED)], SOURCE_MISSING, [(wrong, SOURCE_FAILED)]
    )


def patch_interactions(
    req: DataFrame, inter: DataFrame, as_of: datetime | str, src: DataFrame | None = None, tz: str = "UTC"
) -> Change:
    rows = _dangling(with_values(with_body(req), INTERACTION_FIELDS, tz), "referralSourceId", src)
    wrong = wrong_values(INTERACTION_FIELDS) | ~F.col("_referralSourceId")
    return _patch(
        rows, inter, INTERACTION_FIELDS, as_of, [(_unreadable(), INTERACTION_FAILED)], INTERACTION_MISSING,
        [(wrong, INTERACTION_FAILED)],
    )


def patch_clinics(req: DataFrame, clinic: DataFrame, as_of: datetime | str, tz: str = "UTC") -> Change:
    """A changed name must be free: in the table, and among the earlier requests of the batch."""
    rows = with_values(with_body(req), CLINIC_FIELDS, tz).withColumns(
        {"_name": F.when(~blank("name"), value("name")), "_wrong": wrong_values(CLINIC_FIELDS)}
    )
    # only a request that would be stored takes its name away from later ones
    known = rows.where(~F.col("_wrong") & F.col("_name").isNotNull()).join(clinic.select("id"), "id", "left_semi")
    renames = known.select("requestId", "seq", "id", F.col("_name").alias("name"))
    late = flag_duplicate_name(renames, clinic).where(F.col("duplicate")).select("requestId", F.lit(True).alias("_late"))
    owners = clinic.select(F.col("name").alias("_name"), F.col("id").alias("_owner"))
    rows = rows.join(owners, "_name", "left").join(late, "requestId", "left")
    taken = F.coalesce(F.col("_late"), F.col("_owner") != F.col("id"), F.lit(False))
    return _patch(
        rows.withColumn("_taken", taken).drop("_late"), clinic, CLINIC_FIELDS, as_of, [(_unreadable(), CLINIC_FAILED)], CLINIC_MISSING,
        [(F.col("_taken"), DUPLICATE_CLINIC), (F.col("_wrong"), CLINIC_FAILED)],
    )


def patch_campaigns(req: DataFrame, camp: DataFrame, as_of: datetime | str, tz: str = "UTC") -> Change:
    return _patch(
        with_values(with_body(req), CAMPAIGN_FIELDS, tz), camp, CAMPAIGN_FIELDS, as_of,
        [(_unreadable(), CAMPAIGN_FAILED)], CAMPAIGN_MISSING, [(wrong_values(CAMPAIGN_FIELDS), CAMPAIGN_FAILED)],
    )


def patch_cover_sheet(req: DataFrame, camp: DataFrame, as_of: datetime | str, tz: str = "UTC") -> Change:
    """Cover sheet settings; when switched on, sender, subject and message must be in the same request."""
    on = ~F.coalesce(value("includeCoverSheet").isin("", "0", "false"), F.lit(True))
    early = [(_unreadable(), COVER_FAILED), *[(on & blank(key), text) for key, text in COVER_REQUIRED.items()]]
    return _patch(
        with_values(with_body(req), COVER_FIELDS, tz), camp, COVER_FIELDS, as_of, early, CAMPAIGN_MISSING,
        [(wrong_values(COVER_FIELDS), COVER_FAILED)],
    )


class Sync(NamedTuple):
    """``table`` is the new link table, ``added`` and ``removed`` the links that differ, ``rejects`` (campaignId, reason)."""

    table: DataFrame
    added: DataFrame
    removed: DataFrame
    rejects: DataFrame


def sync_recipients(
    req: DataFrame, link: DataFrame, as_of: datetime | str, src: DataFrame | None = None, camp: DataFrame | None = None
) -> Sync:
    """Make the recipients of each campaign those of the request (campaignId, referralSourceIds).

    No list changes nothing, an empty one removes all; links that stay are untouched. A new recipient that is unknown
    or listed twice rejects the campaign, and so does (given ``camp``) one that does not exist. The key pair is unique, so the joins on it spread evenly even if one campaign
    holds much of the table.
    """
    pairs, verdicts = _compared(req, link, src, camp)
    rejects = verdicts.where(F.col("_reason").isNotNull()).select("campaignId", F.col("_reason").alias("reason"))
    judged = pairs.join(rekeyed(verdicts, "campaignId"), "campaignId", "left")
    applies = F.coalesce(F.col("_asked") & F.col("_reason").isNull(), F.lit(False))
    held = F.col("_link").isNotNull()
    new = conform(with_defaults(judged.where(applies & ~held).select(*LINK_KEY), "campaign_link", as_of), "campaign_link")
    # one pass for the table: links that stay and links that come
    values = {**{f.name: F.lit(None) for f in TABLES["campaign_link"].fields}, **{k: F.col(k) for k in LINK_KEY},
              **{k: F.lit(v) for k, v in COLUMN_DEFAULTS["campaign_link"].items()}, "createdAt": ntz(as_of), "updatedAt": ntz(as_of)}
    types = dict(link.dtypes)
    fresh = F.struct(*[values[c].cast(types[c]).alias(c) if c in values else F.lit(None).cast(types[c]).alias(c) for c in link.columns])
    table = judged.where(F.when(held, ~applies | F.col("_wanted")).otherwise(applies)).select(
        F.when(held, F.col("_link")).otherwise(fresh).alias("row")).select("row.*")
    removed = judged.where(held & applies & ~F.col("_wanted")).select("_link.*").select(*link.columns)
    return Sync(table, new, removed, rejects)


def _compared(
    req: DataFrame, link: DataFrame, src: DataFrame | None, camp: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """(all pairs that are linked or wanted, with ``_link`` and ``_wanted``; a verdict for each campaign asked for).

    One full outer join on the pair, which is unique on both sides, tells new, kept and removed recipients apart. What
    speaks against a campaign is combined in every task before it is exchanged.
    """
    asked = req.where(F.col("referralSourceIds").isNotNull())
    # a row for each recipient, and one without for the campaign itself, which stands for an empty list
    listed = asked.select("campaignId", F.explode(F.concat(
        F.array(F.lit(None).cast("string")), "referralSourceIds")).alias("referralSourceId"), F.lit(True).alias("_listed"))
    wanted = listed.groupBy(*LINK_KEY).agg((F.count(F.lit(1)) > 1).alias("_twice"))
    wanted = mark_known(wanted, src.select("id") if src is not None else None, "referralSourceId", "_source")
    if camp is not None:
        wanted = mark_known(wanted.withColumnRenamed("campaignId", "id"), camp, "id", "_campaign").withColumnRenamed(
            "id", "campaignId")
    else:
        wanted = wanted.withColumn("_campaign", F.lit(True))
    held = link.select(*LINK_KEY, F.struct(*link.columns).alias("_link"))
    pairs = held.join(wanted.withColumn("_wanted", F.lit(True)), LINK_KEY, "full").withColumn(
        "_wanted", F.coalesce("_wanted", F.lit(False)))
    fresh = F.col("_link").isNull() & F.col("referralSourceId").isNotNull()
    verdicts = pairs.where("_wanted").groupBy("campaignId").agg(
        F.lit(True).alias("_asked"),
        F.when(~F.bool_and("_campaign"), F.lit(CAMPAIGN_MISSING)).when(
            F.bool_or(fresh & (F.col("_twice") | ~F.col("_source"))), F.lit(CAMPAIGN_FAILED)).alias("_reason"))
    return pairs.where(F.col("referralSourceId").isNotNull()), verdicts


class CampaignUpdate(NamedTuple):
    campaigns: Change
    links: Sync
    rejects: DataFrame


def update_campaigns(
    req: DataFrame, camp: DataFrame, link: DataFrame, src: DataFrame, as_of: datetime | str, tz: str = "UTC"
) -> CampaignUpdate:
    """Patch and recipient sync as one unit: a request that fails in one part changes neither.

    Of several lists for one campaign the last one counts.
    """
    patched = patch_campaigns(req, camp, as_of, tz)
    sound = req.join(patched.rejects.select("requestId").distinct(), "requestId", "left_anti")
    body = once(with_body(sound), "_ids", recipient_ids())
    lists = (
        body.where(F.col("_ids").isNotNull())
        .groupBy(F.col("id").alias("campaignId"))
        .agg(F.max_by("_ids", F.struct("seq", "requestId")).alias("referralSourceIds"),
             F.max_by("requestId", F.struct("seq", "requestId")).alias("requestId"))
    )
    links = sync_recipients(lists, link, as_of, src)
    failed = lists.join(links.rejects, "campaignId").select("requestId", "reason")
    rejects = patched.rejects.unionByName(failed)
    applied = req.join(rejects.select("requestId").distinct(), "requestId", "left_anti")
    return CampaignUpdate(patch_campaigns(applied, camp, as_of, tz), links, rejects)
