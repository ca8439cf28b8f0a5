"""The link table under a stream of events.

A micro-batch appends its events as they are and reads nothing: a batch costs what it brings, not the size of the table.
They are settled where the links are read: folded per link and laid over the last snapshot. :func:`compact_links` makes
that the new snapshot from time to time, and turns events without a link into dead letters, once, in the same commit.
An event that comes before its link so waits for it until then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caretrail.functions.defaults import is_missing
from caretrail.functions.labels import map_event_status
from caretrail.functions.payloads import event_response
from caretrail.schemas import LINK_KEY, struct
from caretrail.sources.tables import commit, latest_version, read_entity, table_paths

CHANGES = "campaign_link_event"
CHANGE_SCHEMA = struct(
    "campaignId STRING, referralSourceId STRING, faxId STRING, status STRING, error STRING, receivedAt TIMESTAMP_NTZ"
)
DEAD = "dead_letter"
DEAD_SCHEMA = struct(
    "faxId STRING, status STRING, campaignId STRING, referralSourceId STRING, receivedAt TIMESTAMP_NTZ, reason STRING"
)
LANDED = "landed_file"
LANDED_SCHEMA = struct("stream STRING, file STRING")

# Reasons given to the sender.
MALFORMED = "Failed to process webhook"
MISSING = "Missing required fields"
UNKNOWN = "Unknown campaign link"


def well_formed(batch: DataFrame) -> DataFrame:
    """Events with ``reason``, null where nothing is missing."""
    malformed = F.col("malformed") if "malformed" in batch.columns else F.lit(False)
    lacking = is_missing("faxId") | is_missing("status") | is_missing("campaignId") | is_missing("referralSourceId")
    return batch.withColumn("reason", F.when(malformed, F.lit(MALFORMED)).when(lacking, F.lit(MISSING)))


def fold_events(batch: DataFrame) -> DataFrame:
    """One change per link: the last event to arrive wins, even a less final one; equal times go by fax id and status.

    ``responseAt`` is the arrival of the latest event that meant sent or failed. Many events of one link are combined
    per task before they are exchanged.
    """
    error = F.col("error") if "error" in batch.columns else F.lit(None).cast("string")
    # the order comes first in the struct, so that nothing is carried twice through the exchange
    last = F.max(F.struct("receivedAt", "faxId", F.col("status").alias("eventStatus"), error.alias("error")))
    responded = F.when(map_event_status("status").isin("SENT", "FAILED"), F.col("receivedAt"))
    folded = batch.groupBy(*LINK_KEY).agg(last.alias("_l"), F.max(responded).alias("responseAt"))
    return folded.select(
        *LINK_KEY, map_event_status("_l.eventStatus").alias("status"),
        event_response("_l.faxId", "_l.eventStatus", "_l.receivedAt", "_l.error").alias("response"), "responseAt",
        "_l.receivedAt", "_l.faxId", "_l.eventStatus",
    )


def fold_changes(changes: DataFrame) -> DataFrame:
    """Latest change per link; the same whatever batches the changes came in."""
    order = F.struct("receivedAt", "faxId", "eventStatus")
    return changes.groupBy(*LINK_KEY).agg(
        F.max_by(F.struct("status", "response", "receivedAt"), order).alias("_last"),
        F.max("responseAt").alias("_responseAt"),
    )


def overlay(link: DataFrame, changes: DataFrame) -> DataFrame:
    """Links with their changes laid over. The pair is unique on both sides: no key is hot."""
    last = F.col("_last")
    changed = last.isNotNull()
    return (
        link.join(fold_changes(changes), LINK_KEY, "left")
        .withColumns(
            {
                "status": F.when(changed, last["status"]).otherwise(F.col("status")),
                "response": F.when(changed, last["response"]).otherwise(F.col("response")),
                "responseAt": F.greatest("responseAt", "_responseAt"),
                "updatedAt": F.when(changed, last["receivedAt"]).otherwise(F.col("updatedAt")),
            }
        )
        .select(*link.columns)
    )


def with_link_mark(events: DataFrame, link: DataFrame, mark: str) -> DataFrame:
    """``events`` with the boolean ``mark``: their link is in the table.

    One left join, in which a hot link's events are on the side that can be split.
    """
    known = link.select(*LINK_KEY, F.lit(True).alias(mark))
    return events.join(known, LINK_KEY, "left").withColumn(mark, F.coalesce(F.col(mark), F.lit(False)))


def _events(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return read_entity(spark, root, CHANGES, version, CHANGE_SCHEMA)


def current_links(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    link = read_entity(spark, root, "campaign_link", version)
    if not table_paths(spark, root, CHANGES, version):
        return link
    return overlay(link, fold_events(_events(spark, root, version)))


def unknown_events(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Events that no link has (yet), as dead letters."""
    marked = with_link_mark(
        _events(spark, root, version), read_entity(spark, root, "campaign_link", version), "_known").where(~F.col("_known"))
    return marked.select(*[f.name for f in DEAD_SCHEMA.fields[:-1]], F.lit(UNKNOWN).alias("reason"))


def dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """What could not be applied: malformed and incomplete events, and those whose link is unknown as of now."""
    kept = read_entity(spark, root, DEAD, schema=DEAD_SCHEMA)
    return kept.unionByName(unknown_events(spark, root)) if table_paths(spark, root, CHANGES) else kept


def settled(spark: SparkSession, root: str, version: int) -> dict[str, DataFrame | None]:
    """What a commit needs besides a link table made from ``version``: its events go, the lost ones as dead letters."""
    if not table_paths(spark, root, CHANGES, version):
        return {}
    return {CHANGES: None, DEAD: unknown_events(spark, root, version)}


def compact_links(spark: SparkSession, root: str, txn: str) -> int:
    """New snapshot with all events settled, which start empty again in the same commit. Their files stay known.

    What streams and creations add meanwhile stays beside the snapshot.
    """
    version = latest_version(spark, root)
    frames = {"campaign_link": current_links(spark, root, version), **settled(spark, root, version)}
    if len(table_paths(spark, root, LANDED, version)) > 1:
        frames[LANDED] = read_entity(spark, root, LANDED, version, LANDED_SCHEMA).coalesce(1)
    return commit(spark, root, frames, txn, append=[DEAD], cluster=True, base=version, rebase=["campaign_link", LANDED])


def store_events(spark: SparkSession, root: str, batch: DataFrame, txn: str, stream: str) -> int:
    """Append a batch of events (with ``file``, where they come from), and its dead letters, in one commit.

    A repeated ``txn`` does nothing. A file that another stream has stored is left out: a stream with a new checkpoint
    reads everything again. Only the files of other streams are looked at, so a stream that goes on skips its own.
    """
    others = read_entity(spark, root, LANDED, schema=LANDED_SCHEMA).where(F.col("stream") != stream).select("file")
    checked = well_formed(batch.join(others, "file", "left_anti"))
    bad = F.col("reason").isNotNull()
    frames = {
        CHANGES: checked.where(~bad).select(*[f.name for f in CHANGE_SCHEMA.fields]),
        DEAD: checked.where(bad).select(*[f.name for f in DEAD_SCHEMA.fields]),
        LANDED: batch.select(F.lit(stream).alias("stream"), "file").distinct(),
    }
    return commit(spark, root, frames, txn, append=frames)
