"""What the change jobs share: reading request bodies, first failing reason, folding patches."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.functions.dates import parse_instant, parse_local_date
from caretrail.functions.defaults import is_missing, null_if_empty, ntz
from caretrail.session import shared_folder


class Change(NamedTuple):
    """Result of a change job. ``table`` is the whole new version, ``delta`` only its new or changed rows (for a delete
    the ids that go): what an append needs. ``rejects`` is (requestId, reason). ``patch`` of an update holds, for each row
    that changes, only the columns sent, boxed."""

    table: DataFrame
    delta: DataFrame
    rejects: DataFrame
    patch: DataFrame | None = None


def once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """``df`` with a costly column that is worked out once per row.

    It comes out of a one-element explode. As a plain column it would be worked out again by every filter that the
    optimizer moves below it.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def written_down(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a work folder in the shared folder, for rows that are costly to make and read several times."""
    path = shared_folder(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_body(req: DataFrame) -> DataFrame:
    """``req`` with its JSON body as map ``b``: a key is missing, null or has a value. Unreadable text gives null."""
    return once(req, "b", F.from_json("body", "map<string,string>"))


def has(key: str) -> Column:
    return F.coalesce(F.map_contains_key("b", key), F.lit(False))


def value(key: str) -> Column:
    return F.col("b").getItem(key)


def blank(key: str) -> Column:
    """Missing, null or ''."""
    return is_missing(value(key))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Reason of the first check that holds, null when none does."""
    return F.coalesce(*[F.when(holds, F.lit(reason)) for holds, reason in checks])


def split_rejects(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = checked.where(F.col("reason").isNull()).drop("reason")
    return ok, checked.where(F.col("reason").isNotNull()).select("requestId", "reason")


def mark_known(req: DataFrame, table: DataFrame | None, fk: str, mark: str) -> DataFrame:
    """``req`` with boolean ``mark``: its ``fk`` is an id of the table. Without a table everything is known."""
    if table is None:
        return req.withColumn(mark, F.lit(True))
    ids = table.select(F.col("id").alias(fk), F.lit(True).alias(mark))
    return req.join(ids, fk, "left").withColumn(mark, F.coalesce(F.col(mark), F.lit(False)))


def whole_number(text: Column) -> Column:
    """Integer column value of JSON text; null for fractions and anything else."""
    number = text.try_cast("double")
    fits = (number == F.floor(number)) & number.between(-(2**31), 2**31 - 1)
    return F.when(fits, number.cast("int"))


@dataclass(frozen=True)
class Field:
    """How a patch key becomes a column value. ``needs`` is another key that must be present too."""

    kind: str = "text"
    required: bool = False
    needs: str | None = None

    def present(self, key: str) -> Column:
        there = has(key) & has(self.needs) if self.needs else has(key)
        return there & ~blank(key) if self.kind == "start_date" else there

    def value(self, key: str, tz: str) -> Column:
        text = value(key)
        if self.kind == "int":
            return whole_number(text)
        if self.kind == "double":
            return text.try_cast("double")
        if self.kind == "bool":
            return F.when(text.isin("true", "false"), text == "true")
        if self.kind == "instant":
            # a null date is moment zero for the web client
            return F.when(text.isNull(), ntz("1970-01-01 00:00:00")).otherwise(parse_instant(text, tz))
        if self.kind in ("start_date", "end_date"):
            return parse_local_date(null_if_empty(text), tz)
        return text

    def bad(self, key: str) -> Column:
        """The value cannot be stored: of the wrong type, or null where the column needs one."""
        text = value(key)
        wrong = text.isNotNull() & F.col("v")[key].isNull()
        if self.kind == "end_date":
            wrong = wrong & (text != "")
        if self.required and self.kind != "instant":
            wrong = wrong | text.isNull()
        return self.present(key) & wrong


def with_values(rows: DataFrame, spec: dict[str, Field], tz: str) -> DataFrame:
    """``rows`` with the typed values of all patch keys as struct ``v``."""
    return once(rows, "v", F.struct(*[field.value(key, tz).alias(key) for key, field in spec.items()]))


def wrong_values(spec: dict[str, Field]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(f.bad(k), F.lit(False)) for k, f in spec.items()])


def fold_patches(req: DataFrame, spec: dict[str, Field]) -> DataFrame:
    """One row per id: for every column the last value sent (null when none was), by (seq, requestId) with null first.
    Many patches of one row are combined per task before they are exchanged."""

    def last(key: str, field: Field) -> Column:
        there = field.present(key)
        boxed = F.struct(F.col("v")[key].alias("v"))
        return F.max_by(F.when(there, boxed), F.when(there, F.struct("seq", "requestId"))).alias(f"_{key}")

    return req.groupBy("id").agg(*[last(k, f) for k, f in spec.items()], F.lit(True).alias("_patched"))


def apply_patches(
    table: DataFrame, ok: DataFrame, rejects: DataFrame, spec: dict[str, Field], as_of: datetime | str
) -> Change:
    """Fold the sound requests and lay them over the table. Requests for unknown ids find no row here; they are among
    ``rejects``, which come from a join of their own. So many patches of one row are folded before any of them moves.
    """
    folded = fold_patches(ok, spec)

    def merged(joined: DataFrame) -> DataFrame:
        new = {
            k: F.when(F.col(f"_{k}").isNotNull(), F.col(f"_{k}.v")).otherwise(F.col(k)).cast(table.schema[k].dataType)
            for k in spec
        }
        if "updatedAt" in table.columns:
            new["updatedAt"] = F.when(F.col("_patched"), ntz(as_of)).otherwise(F.col("updatedAt"))
        return joined.withColumns(new).select(*table.columns)

    def box(key: str) -> Column:
        sent = F.col(f"_{key}")
        return F.when(sent.isNotNull(), F.struct(sent["v"].cast(table.schema[key].dataType).alias("v"))).alias(key)

    patch = folded.join(table.select("id"), "id", "left_semi").select(
        "id", *[box(k) for k in spec], ntz(as_of).alias("updatedAt"))
    return Change(merged(table.join(folded, "id", "left")), merged(table.join(folded, "id")), rejects, patch)
