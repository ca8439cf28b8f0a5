"""Counts and distributions. Every count is combined per task before it is exchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caretrail.functions.defaults import col

# The four slices of the status chart and the codes behind them.
STATUS_SLICES = {"Active": "ACTIVE", "Draft": "DRAFT", "Completed": "COMPLETED", "Cancelled": "CANCELLED"}


def child_counts(parent: DataFrame, child: DataFrame, fk: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 kept. Children are counted first, so the join sees each key once."""
    counts = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("id")).agg(F.count(F.lit(1)).alias(name))
    return parent.join(counts, "id", "left").select(
        *parent.columns, F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)
    )


def clinic_source_counts(clinic: DataFrame, src: DataFrame) -> DataFrame:
    return child_counts(clinic, src, "clinicLocationId", "referralSources")


def campaign_recipient_counts(camp: DataFrame, link: DataFrame) -> DataFrame:
    return child_counts(camp, link, "campaignId", "referralSources")


def linked_counts(parent: DataFrame, child: DataFrame, fk: str) -> DataFrame:
    """Parents that have children, with their number: the rows a delete must refuse."""
    counts = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("id")).agg(F.count(F.lit(1)).alias("count"))
    return parent.select("id").join(counts, "id").select("id", "count")


def table_totals(src: DataFrame, inter: DataFrame, camp: DataFrame) -> DataFrame:
    """Row counts of the three main tables; no data column is read."""

    def total(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("name"), "total")

    return (
        total("referralSources", src).unionByName(total("interactions", inter)).unionByName(total("campaigns", camp))
    )


def campaign_status_totals(camp: DataFrame) -> DataFrame:
    """One row: total, active, draft, completed, cancelled."""
    return camp.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == code).alias(name.lower()) for name, code in STATUS_SLICES.items()],
    )


def campaigns_by_type(camp: DataFrame) -> DataFrame:
    return camp.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("count"))


def status_distribution(camp: DataFrame) -> DataFrame:
    """Four rows, zeros kept; other statuses are in none of them."""
    slices = ", ".join(f"'{name}', {name.lower()}" for name in STATUS_SLICES)
    return campaign_status_totals(camp).select(F.expr(f"stack({len(STATUS_SLICES)}, {slices}) AS (name, value)"))


def status_share(dist: DataFrame) -> DataFrame:
    """Label of each slice with its share in whole per cent; null when all are 0. ``dist`` has four rows, always."""
    whole = F.sum("value").over(Window.partitionBy())
    percent = F.when(whole > 0, F.round(F.lit(100) * F.col("value") / whole).cast("long"))
    return dist.select("name", "value", F.concat("name", F.lit(": "), percent.cast("string"), F.lit("%")).alias("label"))


def clinics_in_use(src: DataFrame, clinic: DataFrame) -> DataFrame:
    """Clinics some source belongs to, by name. Clinic ids are made distinct before they meet the clinics."""
    used = src.where(F.col("clinicLocationId").isNotNull()).select(F.col("clinicLocationId").alias("id")).distinct()
    return clinic.select("id", "name").join(used, "id", "left_semi").orderBy(F.collate("name", "UNICODE"), "id")


def send_summary(results: DataFrame, skipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(number sent and failed per campaign, the detail rows). Skipped recipients count as failed."""
    cols = ["campaignId", "referralSourceId", "name"]
    done = results.select(
        *cols, F.col("success"), F.when(F.col("success"), F.col("faxId")).alias("faxId"),
        F.when(~F.col("success"), F.coalesce(F.nullif("error", F.lit("")), F.lit("Unknown error"))).alias("error"),
    )
    left_out = skipped.select(*cols, F.lit(False).alias("success"), F.lit(None).cast("string").alias("faxId"), "error")
    details = done.unionByName(left_out)
    counts = details.groupBy("campaignId").agg(
        F.count_if("success").alias("sent"), F.count_if(~F.col("success")).alias("failed")
    )
    return counts, details


def activate_campaigns(camp: DataFrame, results: DataFrame, success: Column | str = "success") -> DataFrame:
    """Campaigns with a successful send become ACTIVE, whatever they were."""
    sent = results.where(col(success)).select(F.col("campaignId").alias("id")).distinct().withColumn("_sent", F.lit(True))
    status = F.when(F.col("_sent"), F.lit("ACTIVE")).otherwise(F.col("status"))
    return camp.join(sent, "id", "left").withColumn("status", status).select(*camp.columns)


def selection_counts(selected: DataFrame, filtered: DataFrame) -> DataFrame:
    """Sizes of both sets, in one row."""
    both = selected.select(F.lit(1).alias("s"), F.lit(0).alias("f")).unionAll(filtered.select(F.lit(0), F.lit(1)))
    return both.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("selected"), F.coalesce(F.sum("f"), F.lit(0)).alias("filtered")
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
