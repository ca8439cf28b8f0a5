"""Delivery-status events: read, checked, folded per link, stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caretrail.operators.joins import rekeyed
from caretrail.schemas import LINK_KEY
from caretrail.streaming.checkpoints import checkpoint_folder, stream_id
from caretrail.streaming.links import (
    DEAD_SCHEMA, MALFORMED, MISSING, UNKNOWN, dead_letters, fold_events, store_events, well_formed, with_link_mark,
)

__all__ = [
    "DEAD_SCHEMA", "MALFORMED", "MISSING", "UNKNOWN", "apply_events", "dead_letters", "fold_events",
    "read_delivery_stream", "run_delivery_stream", "split_invalid", "well_formed",
]

EVENT_SCHEMA = (
    "faxId STRING, status STRING, metadata STRUCT<campaignId: STRING, referralSourceId: STRING>, error STRING, "
    "receivedAt TIMESTAMP_NTZ, _corrupt_record STRING"
)


def read_delivery_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events as they land, one JSON object per line; the arrival time is the receiver's, else the file's."""
    reader = (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # counted from the epoch: a cast would shift the time by the session's zone
    micros = "CAST(unix_micros(_metadata.file_modification_time) AS DECIMAL(20, 0))"
    landed = F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST({micros} / 1000000 AS DECIMAL(18, 6)))")
    return reader.json(path).select(
        "faxId", "status", "metadata.campaignId", "metadata.referralSourceId", "error",
        F.coalesce("receivedAt", landed).alias("receivedAt"), F.col("_corrupt_record").isNotNull().alias("malformed"),
        F.col("_metadata.file_path").alias("file"),
    )


def _marked(batch: DataFrame, link: DataFrame) -> DataFrame:
    """Events with their ``reason``, null for those to apply: one join, which reads either side once."""
    marked = with_link_mark(well_formed(batch), link, "_known")
    return marked.withColumn("reason", F.coalesce("reason", F.when(~F.col("_known"), F.lit(UNKNOWN)))).drop("_known")


def split_invalid(batch: DataFrame, link: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events to apply, dead letters with their reason)."""
    marked = _marked(batch, link)
    return (marked.where(F.col("reason").isNull()).select(*batch.columns),
            marked.where(F.col("reason").isNotNull()).select(*batch.columns, "reason"))


def apply_events(batch: DataFrame, link: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one change per known link, dead letters).

    Events are folded before they meet the links: a link with very many events then brings one row to the join.
    """
    sound = well_formed(batch).where(F.col("reason").isNull())
    # the pair is the key of both sides: an inner join adds no row, and either side may be the small one
    changes = rekeyed(fold_events(sound), *LINK_KEY).join(link.select(*LINK_KEY), LINK_KEY)
    return changes, split_invalid(batch, link)[1]


def run_delivery_stream(
    spark: SparkSession, src: str, root: str, ckpt: str | None = None, name: str = "delivery",
    files_per_trigger: int | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Store landed events under ``root``, where the link table is read with them; see :mod:`caretrail.streaming.links`.

    The commit is named by the checkpoint and the batch, so a batch replayed after a crash is stored once, and one of a
    new checkpoint is not taken for it.
    """
    folder = checkpoint_folder(spark, root, name, ckpt)
    stream = f"{name}-{stream_id(spark, folder)}"

    def store(batch: DataFrame, batch_id: int) -> None:
        events = batch.persist()
        try:
            store_events(batch.sparkSession, root, events, f"{stream}-{batch_id}", stream)
        finally:
            events.unpersist()

    writer = (
        read_delivery_stream(spark, src, files_per_trigger)
        .writeStream.queryName(name)
        .option("checkpointLocation", folder)
        .foreachBatch(store)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
