"""Campaign dispatch: the outbox of a send, its results, the late status check.

Each arrow between the jobs is a table: outbox -> sender -> results, so a restart loses nothing.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrail.functions.defaults import is_missing, ntz
from caretrail.functions.dispatch import DispatchConfig, cover_sheet, document_url, short_id
from caretrail.functions.labels import map_final_status
from caretrail.functions.payloads import final_response, send_response, sent_fax_id
from caretrail.functions.text import normalize_phone
from caretrail.operators.aggregates import activate_campaigns
from caretrail.operators.filters import has_document, split_sendable
from caretrail.schemas import LINK_KEY, TABLES


class Outbox(NamedTuple):
    """``outbox``: one row per fax; ``skipped``: recipients without fax number; ``links``: the new link table;
    ``rejects``: campaigns that cannot be sent."""

    outbox: DataFrame
    skipped: DataFrame
    links: DataFrame
    rejects: DataFrame


def _full(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the columns of ``table`` it lacks, as null."""
    return df.withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in TABLES[table].fields if f.name not in df.columns}
    )


def build_outbox(
    camp: DataFrame, link: DataFrame, src: DataFrame, cfg: DispatchConfig, only_pending: bool = False
) -> Outbox:
    """Everything the sender needs for the given campaigns.

    A send goes to all recipients again unless ``only_pending``. Links are the preserved or inner side of both joins,
    so the recipients of one huge campaign, or the campaigns of one busy source, can be split.
    """
    ready, rejects = has_document(_full(camp, "campaign"))
    recipients = link.where(F.col("status") == "PENDING") if only_pending else link
    sources = _full(src, "referral_source").select(
        F.col("id").alias("referralSourceId"), F.col("name").alias("name"), "contactPerson", "faxNumber"
    )
    campaigns = ready.select(
        F.col("id").alias("campaignId"), F.col("name").alias("campaignName"), "documentUrl", "coverSheetFromName",
        "coverSheetFromNumber", "coverSheetCompanyInfo", "coverSheetSubject", "coverSheetMessage", "includeCoverSheet",
    )
    planned = recipients.select(*LINK_KEY).join(campaigns, "campaignId").join(sources, "referralSourceId")
    sendable, without = split_sendable(planned)
    outbox = sendable.select(
        *LINK_KEY,
        "name",
        "campaignName",
        normalize_phone("faxNumber").alias("toNumber"),
        F.lit(cfg.sender_number).alias("fromNumber"),
        document_url("documentUrl", cfg.host).alias("documentUrl"),
        short_id("campaignId").alias("shortCampaignId"),
        short_id("referralSourceId").alias("shortReferralSourceId"),
        cover_sheet(
            "coverSheetFromName", "coverSheetFromNumber", "coverSheetCompanyInfo", "coverSheetSubject",
            "coverSheetMessage", "includeCoverSheet", "contactPerson", "name", cfg,
        ).alias("coverSheet"),
    )
    sending = sendable.select(*LINK_KEY, F.lit("SENDING").alias("_status"))
    links = link.join(sending, LINK_KEY, "left").withColumn("status", F.coalesce("_status", "status"))
    return Outbox(
        outbox,
        without.select(*LINK_KEY, "name", "error"),
        links.select(*link.columns),
        rejects.select("id", "reason"),
    )


class Sent(NamedTuple):
    links: DataFrame
    campaigns: DataFrame
    delta: DataFrame


def apply_send_results(
    link: DataFrame, camp: DataFrame, results: DataFrame, as_of: datetime | str
) -> Sent:
    """Store what the sender reports: (campaignId, referralSourceId, success, faxId, data, error, status), and thrown
    where an error came instead of an answer.

    One answer per link is kept should the sender repeat itself; campaigns with a success become ACTIVE.
    """
    moment = ntz(as_of)
    failed = F.col("thrown") if "thrown" in results.columns else F.lit(False)
    thrown = F.coalesce(failed & ~F.col("success"), F.lit(False)).alias("thrown")
    answers = results.groupBy(*LINK_KEY).agg(
        F.max(F.struct("success", "faxId", "data", "error", F.col("status").alias("sendStatus"), thrown)).alias("_r")
    )

    def store(joined: DataFrame) -> DataFrame:
        r = F.col("_r")
        answered = r.isNotNull()
        text = send_response(r["success"], r["faxId"], r["data"], r["error"], r["sendStatus"], moment, r["thrown"])
        return joined.withColumns(
            {
                "status": F.when(answered, F.when(r["success"], "SENT").otherwise("FAILED")).otherwise(F.col("status")),
                "sentAt": F.when(r["success"], moment).otherwise(F.col("sentAt")),
                "response": F.when(answered, text).otherwise(F.col("response")),
                "updatedAt": F.when(answered, moment).otherwise(F.col("updatedAt")),
            }
        ).drop("_r")

    full = _full(link, "campaign_link")
    links = store(full.join(answers, LINK_KEY, "left"))
    delta = store(full.join(answers, LINK_KEY))
    return Sent(links, activate_campaigns(camp, results), delta)


def send_details(results: DataFrame, as_of: datetime | str) -> DataFrame:
    """Results with the fax id the caller is told."""
    told = sent_fax_id("faxId", "data", ntz(as_of))
    return results.withColumn("faxId", F.when(F.col("success"), told))


def reconcile_final(
    link: DataFrame, provider_status: DataFrame, as_of: datetime | str, after: str = "3 minutes"
) -> DataFrame:
    """Links sent long enough ago take the provider's final status: (faxId, status, body).

    Only those links meet the feed; the rest of the table passes by without an exchange. No feed row, no change.
    """
    moment = ntz(as_of)
    full = _full(link, "campaign_link")
    due = (F.col("status") == "SENT") & (F.col("sentAt") <= moment - F.expr(f"INTERVAL {after}"))
    # a made-up id stands for many faxes and is in no feed
    named = F.get_json_object("response", "$.faxId")
    waits = F.coalesce(due & ~named.startswith("unknown-"), F.lit(False))
    feed = provider_status.where(~is_missing("faxId")).groupBy("faxId").agg(
        F.max(F.struct("status", "body")).alias("_f")
    )
    found = F.col("_f").isNotNull()
    checked = full.where(waits).withColumn("faxId", named).join(feed, "faxId", "left").withColumns(
        {
            "status": F.when(found, map_final_status("_f.status")).otherwise(F.col("status")),
            "response": F.when(found, final_response("faxId", "_f.status", "_f.body")).otherwise(F.col("response")),
            "updatedAt": F.when(found, moment).otherwise(F.col("updatedAt")),
        }
    )
    return checked.select(*full.columns).unionByName(full.where(~waits))
