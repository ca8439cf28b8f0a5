"""Unique keys: rows that would break one are found before they are stored."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrail.operators.joins import rekeyed
from caretrail.schemas import PRIMARY_KEYS, UNIQUE_NAMES


class Claim(NamedTuple):
    """Rows to store, one for each key, and rows whose key is taken."""

    fresh: DataFrame
    refused: DataFrame


def claim_keys(rows: DataFrame, keys: list[str], order: list[str], table: DataFrame) -> Claim:
    """The earliest row of a key by ``order`` claims it, unless the key stands in ``table``; the others are refused.

    Rows alike in key and order are one row that was sent again, and count once. Rows of a key are combined in every
    task before they are exchanged, so a key that fills the batch moves once a task. Of the table only the key columns
    are read. Refused rows are looked for among keys that several rows have.
    """
    place = F.struct(*order)
    first = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*rows.columns), place).alias("_row"), F.min(place).alias("_first"), F.count("*").alias("_n"))
    stored = table.select(*keys)
    claimed = rekeyed(first.select(*keys, "_row"), *keys)
    fresh = claimed.join(stored, keys, "left_anti").select("_row.*")
    known = claimed.join(stored, keys, "left_semi").select("_row.*")
    later = rows.join(rekeyed(first.where("_n > 1").select(*keys, "_first"), *keys), keys).where(
        ~place.eqNullSafe(F.col("_first"))).dropDuplicates([*keys, *order]).select(*rows.columns)
    return Claim(fresh, known.unionByName(later))


def declared_keys(table: str) -> list[list[str]]:
    """The keys of a table of the data model that no two rows may share."""
    return [PRIMARY_KEYS[table], *([["name"]] if table in UNIQUE_NAMES else [])]


def key_audit(df: DataFrame, table: str) -> DataFrame:
    """table, key (its columns), value (theirs, as JSON), count of every declared key value that several rows hold.

    A single key is counted by its columns, so a task keeps no more of a value than that; several are counted in one pass,
    as grouping sets. The text is made for repeated values only. Rows with a null in a key aren't held against it.
    """
    keys = declared_keys(table)
    if len(keys) == 1:
        names = [f"_k{i}" for i in range(len(keys[0]))]
        values = df.select(*[F.col(c).cast("string").alias(n) for c, n in zip(keys[0], names)]).dropna()
        found = values.groupBy(*names).count().where("count > 1").select(
            F.lit(",".join(keys[0])).alias("key"), F.to_json(F.array(*names)).alias("value"), "count")
    else:
        one = [F.when(F.greatest(*[F.col(c).isNull() for c in [*key, key[0]]]), None).otherwise(F.struct(
            F.lit(",".join(key)).alias("key"), F.to_json(F.array(*[F.col(c).cast("string") for c in key])).alias("value")))
            for key in keys]
        found = df.select(F.explode(F.array(*one)).alias("k")).where("k IS NOT NULL").groupBy(
            "k.key", "k.value").count().where("count > 1")
    return found.select(F.lit(table).alias("table"), "key", "value", F.col("count").alias("count"))


def all_key_audits(tables: dict[str, DataFrame]) -> DataFrame:
    """:func:`key_audit` over several tables."""
    return reduce(DataFrame.unionByName, [key_audit(df, name) for name, df in tables.items()])
