"""Empty values, display fallbacks and column defaults."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.schemas import COLUMN_DEFAULTS, PRIMARY_KEYS, TABLES


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_empty(c: Column | str) -> Column:
    """'' becomes null."""
    return F.nullif(col(c), F.lit(""))


def null_if_zero(c: Column | str) -> Column:
    """0 becomes null."""
    return F.nullif(col(c), F.lit(0))


def is_missing(c: Column | str) -> Column:
    """True for null and ''; never null itself."""
    return F.coalesce(col(c) == "", F.lit(True))


def or_default(c: Column | str, text: str, falsy: bool = True, number: bool = False) -> Column:
    """The value as text, or ``text`` where it is missing.

    ``falsy`` also replaces '' (or 0 when ``number``); without it only null is replaced.
    """
    value = col(c)
    if falsy:
        value = null_if_zero(value) if number else null_if_empty(value)
    return F.coalesce(value.cast("string"), F.lit(text))


def new_id(*parts: Column | str) -> Column:
    """Id derived from the request, so that a repeated batch makes the same rows."""
    return F.concat(F.lit("c"), F.substring(F.sha2(F.concat_ws("/", *[col(p) for p in parts]), 256), 1, 24))


def ntz(moment: datetime | str) -> Column:
    return F.lit(str(moment)).cast("timestamp_ntz")


def with_defaults(df: DataFrame, table: str, as_of: datetime | str, request_key: Column | str | None = None) -> DataFrame:
    """Fill what an insert leaves out: id, createdAt, updatedAt and the table's column defaults."""
    have = set(df.columns)
    fill = {"createdAt": ntz(as_of), "updatedAt": ntz(as_of)}
    if "id" in PRIMARY_KEYS[table] and request_key is not None:
        fill["id"] = new_id(request_key)
    fill |= {name: F.lit(value) for name, value in COLUMN_DEFAULTS.get(table, {}).items()}
    types = {f.name: f.dataType for f in TABLES[table].fields}
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), value).cast(types[name]) if name in have else value.cast(types[name])
            for name, value in fill.items()
        }
    )
