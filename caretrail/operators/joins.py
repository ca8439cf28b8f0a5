"""Joins.

No side is forced to be broadcast: the optimizer does so below ``spark.sql.autoBroadcastJoinThreshold``, adaptive
execution once the true size in bytes is known, and anything larger is a sort-merge join.

One key may hold a large part of a table. Adaptive execution splits such a key's partition when the join is inner, or
the hot rows are on its left; when both inputs come straight from an exchange; and when nothing above relies on the
join's partitioning. So tables whose keys repeat without bound go left, tables with a primary key are joined as they
are (no ``distinct`` between exchange and join), and keys worked out by an aggregate or join pass :func:`rekeyed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.operators.ranks import numbered
from caretrail.schemas import LINK_KEY

PAGE = 1000


def key_set(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Distinct keys; each task drops its repeats before the exchange, so a hot key travels once per task."""
    return df.select(*cols).distinct()


def rekeyed(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with its (text) keys worked out anew, so that the partitioning it has by them is no longer known.

    A sort-merge join on the keys then has an exchange right below it on this side too. That moves a small side once
    more, and is what allows the hot partitions of the other side to be split. For a broadcast it changes nothing.
    """
    return df.withColumns({k: F.concat(F.col(k), F.lit("")) for k in keys})


def as_relation(df: DataFrame, key: str, name: str, cols: list[str] | None = None) -> DataFrame:
    """A to-one partner: its key as ``_<name>`` and its columns as one struct, null after an unmatched left join."""
    return df.select(F.col("id").alias(key), F.struct(*(cols or df.columns)).alias(name))


def sources_enriched(src: DataFrame, clinic: DataFrame, cat: DataFrame) -> DataFrame:
    """Sources with their clinic and category, null where there is none."""
    return (
        src.join(as_relation(clinic, "clinicLocationId", "clinicLocation"), "clinicLocationId", "left")
        .join(as_relation(cat, "categoryId", "category"), "categoryId", "left")
        .select(*src.columns, "clinicLocation", "category")
    )


def interactions_enriched(inter: DataFrame, src: DataFrame) -> DataFrame:
    """Interactions with id and name of their source. The key is required, so the inner join keeps all rows."""
    partner = as_relation(src, "referralSourceId", "referralSource", ["id", "name"])
    return inter.join(partner, "referralSourceId").select(*inter.columns, "referralSource")


def with_childless(parent: DataFrame, child: DataFrame, key: str, joined: DataFrame) -> DataFrame:
    """``joined`` (parent and child, inner) plus the parents without any child.

    One outer join would say the same, but could not split the children of a hot parent: they would sit on its
    null-supplying side.
    """
    lonely = parent.join(key_set(child.where(F.col(key).isNotNull()), key), key, "left_anti")
    return joined.unionByName(lonely, allowMissingColumns=True)


def nest(flat: DataFrame, key: str, order: str, items: str, page_size: int = PAGE) -> DataFrame:
    """Rows of a key as arrays in the order of ``order``: (key, page, pages, total, <items>).

    Every page but a key's last holds ``page_size`` items, whatever the key's number of them; a key without any (null
    items) has one empty page. A row's place within its key is its place in the whole table less that of the key's first
    row, so a key with very many rows is ranked by as many tasks as it has ranges, and no array is longer than a page.
    """
    rows = numbered(flat.select(key, F.col(order).alias("_order"), items), [key, "_order"])
    keys = rows.groupBy(key).agg(F.min("_pos").alias("_first"), F.count(items).alias("total"))
    page = F.expr(f"int((_pos - _first) div {page_size})").alias("page")
    placed = rows.join(rekeyed(keys, key), key).select(
        key, page, F.greatest(F.ceil(F.col("total") / page_size), F.lit(1)).cast("int").alias("pages"), "total",
        F.when(F.col(items).isNotNull(), F.struct("_pos", items)).alias("_item"))
    pages = placed.repartition(key, "page").groupBy(key, "page", "pages", "total").agg(
        F.sort_array(F.collect_list("_item")).alias("_items"))
    return pages.select(key, "page", "pages", "total", F.col("_items")[items].alias(items))


def campaign_recipients(
    camp: DataFrame, link: DataFrame, src: DataFrame, nested: bool = False, page_size: int = PAGE,
    link_cols: list[str] | None = None, source_cols: list[str] | None = None,
) -> DataFrame:
    """Campaigns with their links and the linked sources; campaigns without recipients stay.

    Flat: one row per recipient (campaignId, campaign, link, source). Nested: one row per campaign and page, recipients in
    the order of their source's id, see :func:`nest`; the campaign's own columns are joined on by the caller who wants them.

    ``link_cols`` (with the referralSourceId) and ``source_cols`` are the columns of the link and the source that the
    caller wants, all unless told: those of a nested row can't be pruned later, and every one moves several times.
    """
    parents = as_relation(camp, "campaignId", "campaign")
    children = link.select(*LINK_KEY, F.struct(*(link_cols or link.columns)).alias("link"))
    joined = children.join(parents, "campaignId").join(
        as_relation(src, "referralSourceId", "source", source_cols), "referralSourceId", "left"
    )
    flat = with_childless(parents, link, "campaignId", joined).select("campaignId", "campaign", "link", "source")
    if not nested:
        return flat
    item = F.when(F.col("link").isNotNull(), F.struct("link.referralSourceId", "link", "source"))
    rows = flat.select("campaignId", item.alias("recipients"))
    return nest(rows, "campaignId", "recipients.referralSourceId", "recipients", page_size)


def clinic_roster(clinic: DataFrame, src: DataFrame, nested: bool = False, page_size: int = PAGE) -> DataFrame:
    """Clinics with the id, name and contact of their sources; clinics without sources stay."""
    parents = as_relation(clinic, "clinicLocationId", "clinic")
    children = src.where(F.col("clinicLocationId").isNotNull()).select(
        "clinicLocationId", F.struct("id", "name", "contactPerson", "contactPhone").alias("source")
    )
    flat = with_childless(parents, src, "clinicLocationId", children.join(parents, "clinicLocationId")).select(
        "clinicLocationId", "clinic", "source"
    )
    if not nested:
        return flat
    rows = flat.withColumnRenamed("source", "sources")
    return nest(rows, "clinicLocationId", "sources.id", "sources", page_size)


def events_to_links(ev: DataFrame, link: DataFrame) -> DataFrame:
    """Delivery events with the link they are about."""
    state = link.select(*LINK_KEY, F.col("status").alias("linkStatus"), F.col("sentAt"))
    return ev.join(state, LINK_KEY)


def orphans(child: DataFrame, parent: DataFrame, fk: str) -> DataFrame:
    """Rows whose foreign key names no parent."""
    ids = parent.select(F.col("id").alias(fk))
    return child.where(F.col(fk).isNotNull()).join(ids, fk, "left_anti").select(*child.columns)
