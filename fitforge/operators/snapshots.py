"""Snapshots of postings: selection by caps, differences, retention and corpus cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_recent(rows: DataFrame, group: str, key: str, posted: str, per_group: int, cap: int) -> DataFrame:
    """The ``per_group`` latest rows of each group, of these the ``cap`` latest; undated ones last, ties by key."""
    latest = [F.col(posted).desc_nulls_last(), F.col(key)]
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*latest))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= per_group).drop("_rank").orderBy(*latest).limit(cap)


def content_hash(title: Column, text: Column) -> Column:
    return F.sha2(F.concat(title, F.lit("\n"), text), 256)


def diff(stored: DataFrame, incoming: DataFrame, key: str, content: str, is_open: str) -> DataFrame:
    """``key`` and ``action`` of each row of two snapshots.

    new, updated (other content), reopened (same content, was closed), unchanged,
    closed (open, but no longer listed), absent (closed and not listed).
    """
    a = stored.select(key, F.col(content).alias("_was"), F.col(is_open).alias("_open"), F.lit(True).alias("_stored"))
    b = incoming.select(key, F.col(content).alias("_is"), F.lit(True).alias("_listed"))
    both = a.join(b, key, "full_outer")
    action = (
        F.when(F.col("_stored").isNull(), "new")
        .when(F.col("_listed").isNull(), F.when(F.col("_open"), "closed").otherwise("absent"))
        .when(~F.col("_was").eqNullSafe(F.col("_is")), "updated")
        .when(F.col("_open"), "unchanged")
        .otherwise("reopened")
    )
    return both.select(key, action.alias("action"))


def prune(rows: DataFrame, protected: DataFrame, key: str, expired: Column) -> DataFrame:
    """``rows`` without those that are expired and not protected."""
    gone = rows.where(expired).select(key).join(protected.select(key), key, "left_anti")
    return rows.join(gone, key, "left_anti")


def over_cap(rows: DataFrame, key: str, is_open: Column, posted: str, cap: int) -> DataFrame:
    """The oldest open rows beyond ``cap`` (undated first, ties by key): what a cap closes.

    Counts per date tell the date at which the cap falls, so that only the rows of
    that date are ranked.
    """
    opened = rows.where(is_open)
    per_date = opened.groupBy(posted).agg(F.count("*").alias("_n"))
    newer = F.sum("_n").over(Window.orderBy(F.col(posted).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    dated = per_date.withColumn("_newer", F.coalesce(newer, F.lit(0))).where(F.col("_newer") + F.col("_n") > cap)
    edge = dated.withColumnRenamed(posted, "_date")
    near = opened.join(edge, opened[posted].eqNullSafe(edge["_date"])).drop("_date")
    rank = F.row_number().over(Window.partitionBy(posted).orderBy(F.col(key).desc()))
    return near.withColumn("_rank", F.col("_newer") + rank).where(F.col("_rank") > cap).drop("_rank", "_newer", "_n")


def apply_snapshot(stored: DataFrame, incoming: DataFrame, key: str, content: str, fields: list[str], as_of: Column) -> DataFrame:
    """``stored`` after a snapshot: ``key``, content, fields, status, first_seen, last_seen and the action taken.

    Unchanged rows are seen again and open, whatever they were; new and changed ones
    take all fields of the snapshot and keep their first_seen; open rows that are not
    listed close; closed ones stay as they are.
    """
    new = incoming.select(key, *(F.col(c).alias(f"_{c}") for c in (content, *fields)), F.lit(True).alias("_listed"))
    both = stored.select(key, content, *fields, "status", "first_seen", "last_seen", F.lit(True).alias("_stored")).join(new, key, "full_outer")
    changed = F.col("_stored").isNull() | ~F.col(content).eqNullSafe(F.col(f"_{content}"))
    action = (
        F.when(F.col("_listed").isNull(), F.when(F.col("status") == "open", "closed").otherwise("absent"))
        .when(F.col("_stored").isNull(), "new")
        .when(changed, "updated")
        .when(F.col("status") == "open", "unchanged")
        .otherwise("reopened")
    )
    told = both.withColumn("action", action)
    takes, seen = F.col("action").isin("new", "updated"), F.col("_listed").isNotNull()
    return told.select(
        key,
        *(F.when(takes, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in (content, *fields)),
        F.when(seen, "open").when(F.col("action") == "closed", "closed").otherwise(F.col("status")).alias("status"),
        F.coalesce("first_seen", F.when(seen, as_of)).alias("first_seen"),
        F.when(seen, as_of).otherwise(F.col("last_seen")).alias("last_seen"),
        "action",
    )


def replace_children(children: DataFrame, incoming: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """The child rows after a snapshot: those of new and changed parents come from ``incoming``, others stay."""
    renewed = applied.where(F.col("action").isin("new", "updated")).select(key)
    return children.join(renewed, key, "left_anti").unionByName(incoming.join(renewed, key, "left_semi"))


def lists_differ(stored: DataFrame, parsed: DataFrame, key: str, order: str | list[str], fields: list[str]) -> DataFrame:
    """``key`` and ``differs``: whether the lists of child rows (``fields`` in this order) are not the same.

    Compared place by place, so that no list is gathered.  Rows that the order leaves
    open have no order among them: they are the same if their fields are, each as often.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order), *fields))
    a = stored.select(key, place.alias("_place"), F.struct(*fields).alias("_was"))
    b = parsed.select(key, place.alias("_place"), F.struct(*fields).alias("_is"))
    return a.join(b, [key, "_place"], "full_outer").groupBy(key).agg(F.bool_or(~F.col("_was").eqNullSafe(F.col("_is"))).alias("differs"))


def chunks(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """``rows`` with ``chunk``, from 0 in each group: what is written together."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size).cast("int"))
