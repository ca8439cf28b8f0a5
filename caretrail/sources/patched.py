"""Entity tables under updates: a batch of patches adds what it changes, and readers lay it over the table.

A patch row holds an id and, of the columns that were sent, their values in a box, so that a null sent differs from nothing
sent. The folders of a table's patches are in the order of their commits. A batch so writes its own size, leaves the table's
files (and their order by key) alone and conflicts with no other writer. :func:`compact` folds all patches into a new
snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretrail.schemas import TABLES
from caretrail.sources.tables import commit, latest_version, read_entity, table_paths

FIXED = ("id", "createdAt", "updatedAt")


def patch_table(name: str) -> str:
    return f"{name}_patch"


def patch_columns(name: str) -> list[T.StructField]:
    return [f for f in TABLES[name].fields if f.name not in FIXED]


def patch_schema(name: str) -> T.StructType:
    boxes = [T.StructField(f.name, T.StructType([T.StructField("v", f.dataType)])) for f in patch_columns(name)]
    return T.StructType([T.StructField("id", T.StringType()), *boxes, T.StructField("updatedAt", T.TimestampNTZType())])


def conform_patch(patch: DataFrame, name: str) -> DataFrame:
    """A patch with all columns that may be patched, empty boxes for those it knows nothing of."""
    have = set(patch.columns)
    return patch.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                          for f in patch_schema(name).fields])


def overlay_patches(table: DataFrame, patches: DataFrame, name: str) -> DataFrame:
    """``table`` with ``patches`` (as in :func:`patch_schema`, and ``_n``, their order) laid over.

    Patches of one row are combined in every task before they are exchanged; the id is unique on both sides of the join.
    """
    columns = [f.name for f in patch_columns(name)]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_n"))).alias(f"_{c}") for c in columns]
    folded = patches.groupBy("id").agg(*last, F.max_by("updatedAt", "_n").alias("_updatedAt"))
    new = {c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)) for c in columns}
    if "updatedAt" in table.columns:
        new["updatedAt"] = F.coalesce("_updatedAt", "updatedAt")
    return table.join(folded, "id", "left").withColumns(new).select(*table.columns)


def read_patched(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table with its patches."""
    table = read_entity(spark, root, name, version)
    paths = table_paths(spark, root, patch_table(name), version)
    if not paths:
        return table
    rows = spark.read.schema(patch_schema(name)).parquet(*[f"{root}/{p}" for p in paths])
    folder = F.element_at(F.split(F.url_decode("_metadata.file_path"), "/"), -2)
    order = F.create_map(*[x for i, p in enumerate(paths) for x in (F.lit(p.rpartition("/")[2]), F.lit(i))])
    return overlay_patches(table, rows.select("*", F.element_at(order, folder).alias("_n")), name)


def compact(spark: SparkSession, root: str, name: str, txn: str) -> int:
    """A new snapshot, sorted by key, with all patches folded in; rows and patches added meanwhile stay beside it."""
    version = latest_version(spark, root)
    frames = {name: read_patched(spark, root, name, version), patch_table(name): None}
    return commit(spark, root, frames, txn, cluster=True, base=version, rebase=[name])
