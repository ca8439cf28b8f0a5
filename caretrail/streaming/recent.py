"""The latest interactions, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caretrail.functions.defaults import is_missing
from caretrail.operators.sorting import recent_interactions
from caretrail.plans.change import first_reason, mark_known
from caretrail.plans.creates import DATE_REQUIRED, INTERACTION_FAILED, SOURCE_REQUIRED, TYPE_REQUIRED
from caretrail.schemas import TABLES, conform, struct
from caretrail.sources.tables import COMMIT_SCHEMA, commit, read_entity
from caretrail.streaming.checkpoints import checkpoint_folder, stream_id
from caretrail.streaming.links import LANDED, LANDED_SCHEMA

RECENT = "recent_interaction"
LIST_TXN = "-list-[0-9]+$"
DEAD = "interaction_dead"
DEAD_SCHEMA = struct("id STRING, referralSourceId STRING, type STRING, date TIMESTAMP_NTZ, line STRING, reason STRING")
RECENT_SCHEMA = struct(
    "id STRING, referralSourceId STRING, sourceName STRING, type STRING, date TIMESTAMP_NTZ, notes STRING"
)


def latest(spark: SparkSession, root: str, k: int) -> DataFrame:
    """The ``k`` latest of the interaction table.

    The oldest date of the previous list bounds the scan, so parquet skips older row groups. Should deletions have left
    fewer than ``k`` rows above the bound, the whole table is read.
    """
    inter = read_entity(spark, root, "interaction")
    bound = read_entity(spark, root, RECENT, schema=RECENT_SCHEMA).agg(F.min("date"), F.count(F.lit(1))).first()
    if bound[1] >= k:
        recent = inter.where(F.col("date") >= F.lit(bound[0]).cast("timestamp_ntz"))
        if recent.select("id").limit(k).count() == k:
            inter = recent
    rows = recent_interactions(inter, read_entity(spark, root, "referral_source"), k)
    return rows.select("id", "referralSourceId", F.col("referralSource.name").alias("sourceName"), "type", "date", "notes")


def run_recent_stream(
    spark: SparkSession, src: str, root: str, ckpt: str | None = None, k: int = 5, name: str = "recent",
    available_now: bool = False, files_per_trigger: int | None = None,
) -> StreamingQuery:
    """New interactions (JSON rows under ``src``) join the table; every minute the list of the latest is renewed.

    A line that can't be read, a row that lacks what a new interaction needs and one of an unknown source go to the
    ``interaction_dead`` table. See :func:`run_recent_list` for changes that come from elsewhere.
    """
    folder = checkpoint_folder(spark, root, name, ckpt)
    stream = f"{name}-{stream_id(spark, folder)}"

    def refresh(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = batch.persist()
        try:
            checked = landed_reasons(
                rows.join(_files_of_others(session, root, stream), "file", "left_anti"),
                read_entity(session, root, "referral_source"))
            frames = {
                "interaction": conform(checked.where(F.col("reason").isNull()), "interaction"),
                DEAD: checked.where(F.col("reason").isNotNull()).select(*[f.name for f in DEAD_SCHEMA.fields]),
                LANDED: rows.select(F.lit(stream).alias("stream"), "file").distinct(),
            }
            commit(session, root, frames, f"{stream}-rows-{batch_id}", append=frames)
        finally:
            rows.unpersist()
        commit(session, root, {RECENT: latest(session, root, k)}, f"{stream}-list-{batch_id}")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES["interaction"].fields)
    reader = spark.readStream.schema(f"{fields}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    writer = (
        reader.json(src).select("*", F.col("_metadata.file_path").alias("file"))
        .writeStream.queryName(name)
        .option("checkpointLocation", folder)
        .foreachBatch(refresh)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": "60 seconds"}
    return writer.trigger(**trigger).start()


def landed_reasons(rows: DataFrame, src: DataFrame) -> DataFrame:
    """Landed rows with ``reason``, in the order in which a new interaction is checked; null for those to store."""
    known = mark_known(rows, src, "referralSourceId", "_source")
    lacking = first_reason(
        (F.col("_corrupt_record").isNotNull() | F.col("id").isNull(), INTERACTION_FAILED),
        (is_missing("referralSourceId"), SOURCE_REQUIRED),
        (is_missing("type"), TYPE_REQUIRED),
        (F.col("date").isNull(), DATE_REQUIRED),
        (~F.col("_source"), INTERACTION_FAILED),
    )
    return known.withColumn("reason", lacking).withColumnRenamed("_corrupt_record", "line").drop("_source")


def _files_of_others(spark: SparkSession, root: str, stream: str) -> DataFrame:
    """Files that another stream has stored: one with a new checkpoint reads everything again."""
    return read_entity(spark, root, LANDED, schema=LANDED_SCHEMA).where(F.col("stream") != stream).select("file")


def run_recent_list(
    spark: SparkSession, root: str, ckpt: str | None = None, k: int = 5, name: str = "recent-list", available_now: bool = False,
) -> StreamingQuery:
    """Follow the commits under ``root``: whoever changes interactions or sources, the list is renewed within a minute.

    The commit folder is the stream's source. A batch that holds other commits than those of lists renews the list once.
    """
    folder = checkpoint_folder(spark, root, name, ckpt)
    stream = f"{name}-{stream_id(spark, folder)}"

    def refresh(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if batch.where(~F.col("txn").rlike(LIST_TXN)).isEmpty():
            return
        commit(session, root, {RECENT: latest(session, root, k)}, f"{stream}-list-{batch_id}")

    writer = (
        spark.readStream.schema(COMMIT_SCHEMA).json(f"{root}/commits")
        .writeStream.queryName(name)
        .option("checkpointLocation", folder)
        .foreachBatch(refresh)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": "60 seconds"}
    return writer.trigger(**trigger).start()


def dead_interactions(spark: SparkSession, root: str) -> DataFrame:
    return read_entity(spark, root, DEAD, schema=DEAD_SCHEMA)


def recent_list(spark: SparkSession, root: str) -> DataFrame:
    return read_entity(spark, root, RECENT, schema=RECENT_SCHEMA)
