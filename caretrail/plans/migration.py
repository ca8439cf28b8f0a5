"""From the oldest source table to the present one."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caretrail.functions.defaults import with_defaults
from caretrail.schemas import COLUMN_DEFAULTS, TABLES, conform

# The five first clinics.
SEED_CLINICS = {
    "clm1": "Jacksonville",
    "clm2": "Wilmington",
    "clm3": "Beulaville",
    "clm4": "Goldsboro",
    "clm5": "Nashville",
}
DROPPED_SOURCE_COLUMNS = ("industry", "status", "clinicLocation")


def seed_clinics(spark: SparkSession, as_of: datetime | str) -> DataFrame:
    rows = spark.createDataFrame(list(SEED_CLINICS.items()), "id STRING, name STRING").withColumn("isActive", F.lit(True))
    return conform(with_defaults(rows, "clinic_location", as_of), "clinic_location")


def migrate_sources(src_legacy: DataFrame) -> DataFrame:
    """Clinic names become clinic ids (an unknown name becomes null), dropped columns go, new ones come as null."""
    if "clinicLocation" in src_legacy.columns:
        name = F.col("clinicLocation")
        clinic_id = reduce(lambda acc, kv: acc.when(name == kv[1], kv[0]), SEED_CLINICS.items(), F)
        src_legacy = src_legacy.withColumn("clinicLocationId", clinic_id)
    return conform(src_legacy.drop(*DROPPED_SOURCE_COLUMNS), "referral_source")


def migrate_campaigns(camp_legacy: DataFrame) -> DataFrame:
    """Document and cover sheet columns come as null; the cover sheet is on."""
    full = conform(camp_legacy, "campaign")
    defaults = {name: F.coalesce(F.col(name), F.lit(v)) for name, v in COLUMN_DEFAULTS["campaign"].items()}
    return full.withColumns(defaults).select(*[f.name for f in TABLES["campaign"].fields])
