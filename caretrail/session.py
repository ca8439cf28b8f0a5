"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution does three things the plans here rely on: it turns a join into a broadcast only
# after the real size of the side is known, it splits hot join partitions, and it merges small ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # one hot key must be split even when the split costs another exchange further up
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # HotSpot does not compile larger methods; the jobs that read request bodies would make some
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(name: str = "caretrail", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one below the warehouse where it is unset.

    A warehouse on a local disk will do for a local session only: on a cluster every executor would write to its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/")
    master = spark.conf.get("spark.master", None) or "local"
    if not master.startswith("local") and (warehouse.startswith("file:") or ":/" not in warehouse):
        raise ValueError(f"spark.checkpoint.dir is unset and the warehouse {warehouse} is a folder of one machine")
    return f"{warehouse}/_shared"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of that name which every executor sees."""
    return f"{shared_base(spark)}/{name}"
