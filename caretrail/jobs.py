"""Whole jobs over a table root: read the tables and the requests, change, commit.

A job is named by its ``txn``; running it again after it was committed does nothing. Creations append their new rows
and leave the rest of the table unread; patches append what they change; deletes write a new version. What is refused joins the ``reject``
table in the same commit.
"""

from __future__ import annotations

from datetime import datetime
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caretrail.functions.dispatch import DispatchConfig
from caretrail.plans import creates, deletes, dispatch, patches, prospects
from caretrail.plans.change import Change
from caretrail.schemas import TABLES, struct
from caretrail.sources.patched import compact, conform_patch, patch_table, read_patched
from caretrail.sources.requests import read_requests
from caretrail.sources.tables import commit, latest_version, lookup, read_entity, table_paths
from caretrail.streaming.links import DEAD, compact_links, current_links, settled

REJECT_SCHEMA = struct("txn STRING, requestId STRING, reason STRING")
OUTBOX, SKIPPED = "outbox", "outbox_skipped"


def job(method):
    """All that a job reads is of one version, the latest when it starts; its commit is made from that one."""

    @wraps(method)
    def run(self: Tables, *args, **kw) -> int:
        return method(Tables(self.spark, self.root, self.tz, latest_version(self.spark, self.root)), *args, **kw)

    return run


class Tables:
    """The tables under a root, as of a version if one is given, with the change jobs of the data model."""

    def __init__(self, spark: SparkSession, root: str, tz: str = "UTC", version: int | None = None):
        self.spark, self.root, self.tz, self.version = spark, root, tz, version

    def read(self, name: str) -> DataFrame:
        if name == "campaign_link":
            return current_links(self.spark, self.root, self.version)
        return read_patched(self.spark, self.root, name, self.version)

    def compact(self, name: str, txn: str) -> int:
        """A new snapshot of a table with its patches (or, of the links, their events) folded in."""
        if name == "campaign_link":
            return compact_links(self.spark, self.root, txn)
        return compact(self.spark, self.root, name, txn)

    def rejects(self) -> DataFrame:
        return read_entity(self.spark, self.root, "reject", schema=REJECT_SCHEMA)

    def _commit(self, txn: str, changes: dict[str, DataFrame], rejects: DataFrame, append: tuple[str, ...] = ()) -> int:
        refused = rejects.select(F.lit(txn).alias("txn"), "requestId", "reason")
        frames: dict[str, DataFrame | None] = {**changes, "reject": refused}
        if "campaign_link" in changes and "campaign_link" not in append:
            # the new version was made from the links with their events laid over
            frames |= settled(self.spark, self.root, self.version)
        for name in changes:
            if name in TABLES and name not in append and table_paths(self.spark, self.root, patch_table(name), self.version):
                frames[patch_table(name)] = None  # the new version was made from the table with its patches
        return commit(self.spark, self.root, frames, txn, append=(*append, "reject", DEAD), base=self.version)

    def _patch(self, txn: str, name: str, done: Change) -> int:
        patch = patch_table(name)
        return self._commit(txn, {patch: conform_patch(done.patch, name)}, done.rejects, (patch,))

    # ---- creation, from request files

    @job
    def create_sources(self, path: str, txn: str, as_of: datetime | str) -> int:
        made = creates.create_sources(
            read_requests(self.spark, path), self.read("referral_source"), as_of, self.read("clinic_location"),
            self.read("referral_category"))
        return self._commit(txn, {"referral_source": made.delta}, made.rejects, ("referral_source",))

    @job
    def create_interactions(self, path: str, txn: str, as_of: datetime | str) -> int:
        made = creates.create_interactions(
            read_requests(self.spark, path), self.read("interaction"), self.read("referral_source"), as_of, self.tz)
        return self._commit(txn, {"interaction": made.delta}, made.rejects, ("interaction",))

    @job
    def create_campaigns(self, path: str, txn: str, as_of: datetime | str) -> int:
        made = creates.create_campaigns(
            read_requests(self.spark, path), self.read("campaign"), self.read("campaign_link"),
            self.read("referral_source"), as_of, self.tz)
        new = {"campaign": made.campaigns.delta, "campaign_link": made.links.delta}
        return self._commit(txn, new, made.rejects, tuple(new))

    @job
    def create_clinics(self, path: str, txn: str, as_of: datetime | str) -> int:
        made = creates.create_clinics(read_requests(self.spark, path), self.read("clinic_location"), as_of)
        return self._commit(txn, {"clinic_location": made.delta}, made.rejects, ("clinic_location",))

    @job
    def import_prospects(self, places: DataFrame, details: DataFrame, txn: str, as_of: datetime | str, rating: float = 0) -> int:
        made = prospects.import_prospects(
            places, details, self.read("clinic_location"), self.read("referral_source"), as_of, rating)
        return self._commit(txn, {"referral_source": made.delta}, made.rejects, ("referral_source",))

    # ---- updates, from request files

    @job
    def patch_sources(self, path: str, txn: str, as_of: datetime | str) -> int:
        done = patches.patch_sources(
            read_requests(self.spark, path), self.read("referral_source"), as_of, self.read("clinic_location"),
            self.read("referral_category"), self.tz)
        return self._patch(txn, "referral_source", done)

    @job
    def patch_interactions(self, path: str, txn: str, as_of: datetime | str) -> int:
        done = patches.patch_interactions(
            read_requests(self.spark, path), self.read("interaction"), as_of, self.read("referral_source"), self.tz)
        return self._patch(txn, "interaction", done)

    @job
    def patch_clinics(self, path: str, txn: str, as_of: datetime | str) -> int:
        done = patches.patch_clinics(read_requests(self.spark, path), self.read("clinic_location"), as_of, self.tz)
        return self._patch(txn, "clinic_location", done)

    @job
    def update_campaigns(self, path: str, txn: str, as_of: datetime | str) -> int:
        done = patches.update_campaigns(
            read_requests(self.spark, path), self.read("campaign"), self.read("campaign_link"),
            self.read("referral_source"), as_of, self.tz)
        patch = patch_table("campaign")
        frames = {patch: conform_patch(done.campaigns.patch, "campaign"), "campaign_link": done.links.table}
        return self._commit(txn, frames, done.rejects, (patch,))

    @job
    def patch_cover_sheets(self, path: str, txn: str, as_of: datetime | str) -> int:
        done = patches.patch_cover_sheet(read_requests(self.spark, path), self.read("campaign"), as_of, self.tz)
        return self._patch(txn, "campaign", done)

    # ---- deletion, from request files

    @job
    def delete_interactions(self, path: str, txn: str) -> int:
        done = deletes.delete_interactions(read_requests(self.spark, path), self.read("interaction"))
        return self._commit(txn, {"interaction": done.table}, done.rejects)

    @job
    def delete_campaigns(self, path: str, txn: str) -> int:
        done = deletes.delete_campaigns(
            read_requests(self.spark, path), self.read("campaign"), self.read("campaign_link"))
        return self._commit(txn, {"campaign": done.table, "campaign_link": done.links}, done.rejects)

    @job
    def delete_sources(self, path: str, txn: str) -> int:
        done = deletes.delete_sources(
            read_requests(self.spark, path), self.read("referral_source"), self.read("campaign_link"),
            self.read("interaction"))
        return self._commit(txn, {"referral_source": done.table, "campaign_link": done.links}, done.rejects)

    @job
    def delete_clinics(self, path: str, txn: str) -> int:
        done = deletes.delete_clinics(
            read_requests(self.spark, path), self.read("clinic_location"), self.read("referral_source"))
        return self._commit(txn, {"clinic_location": done.table}, done.rejects)

    # ---- dispatch

    @job
    def send_campaigns(
        self, ids: DataFrame, txn: str, cfg: DispatchConfig, only_pending: bool = False
    ) -> int:
        """Outbox rows and skipped recipients of the campaigns in ``ids`` (id, requestId), links marked as sending."""
        box = dispatch.build_outbox(
            lookup(self.read("campaign"), ids, "id"), self.read("campaign_link"), self.read("referral_source"), cfg,
            only_pending)
        missing = deletes.missing(ids, self.read("campaign"), patches.CAMPAIGN_MISSING)
        refused = ids.join(box.rejects, "id").select("requestId", "reason").unionByName(missing)
        frames = {OUTBOX: box.outbox, SKIPPED: box.skipped, "campaign_link": box.links}
        return self._commit(txn, frames, refused, (OUTBOX, SKIPPED))

    @job
    def apply_send_results(self, results: DataFrame, txn: str, as_of: datetime | str) -> int:
        links = self.read("campaign_link")
        sent = dispatch.apply_send_results(links, self.read("campaign"), results, as_of)
        none = self.spark.createDataFrame([], "requestId STRING, reason STRING")
        return self._commit(txn, {"campaign_link": sent.links, "campaign": sent.campaigns}, none)

    @job
    def reconcile_final(self, provider_status: DataFrame, txn: str, as_of: datetime | str, after: str = "3 minutes") -> int:
        done = dispatch.reconcile_final(self.read("campaign_link"), provider_status, as_of, after)
        none = self.spark.createDataFrame([], "requestId STRING, reason STRING")
        return self._commit(txn, {"campaign_link": done}, none)
