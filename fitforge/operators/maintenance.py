"""Changes to stored tables as new versions of them: upserts, flags, guarded inserts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_names(stored: DataFrame, incoming: DataFrame, key: str, name: str, active: str) -> DataFrame:
    """``stored`` with the incoming names; new keys are active, and a known one keeps its flag."""
    new = incoming.select(key, F.col(name).alias("_name"))
    both = stored.select(key, name, active, F.lit(True).alias("_stored")).join(new, key, "full_outer")
    flag = F.when(F.col("_stored"), F.col(active)).otherwise(True)
    return both.select(key, F.coalesce("_name", name).alias(name), flag.alias(active))


def activate(rows: DataFrame, targets: DataFrame, group: str, key: str, active: str) -> DataFrame:
    """In each group that has a target (group, key) that row alone is active; other groups stay.

    ``targets`` names one key a group at most; one that the group lacks changes nothing.
    """
    real = targets.select(group, key).join(rows.select(group, key), [group, key], "left_semi").withColumnRenamed(key, "_target")
    flag = F.when(F.col("_target").isNull(), F.col(active)).otherwise(F.col(key) == F.col("_target"))
    return rows.join(real, group, "left").withColumn(active, flag).drop("_target")


def delete_and_promote(rows: DataFrame, gone: Column, group: str, active: str, newest: list[Column]) -> DataFrame:
    """``rows`` without those that are gone; where the active one went, the newest that is left becomes active."""
    lost = F.max(gone & F.col(active)).over(Window.partitionBy(group))
    left = rows.withColumn("_lost", lost).where(~gone)
    first = F.row_number().over(Window.partitionBy(group).orderBy(*newest)) == 1
    return left.withColumn("_first", first).withColumn(active, F.col(active) | (F.col("_lost") & F.col("_first"))).drop("_lost", "_first")


def insert_unique(stored: DataFrame, incoming: DataFrame, unique: list[str], order: list[str]) -> DataFrame:
    """``incoming`` with ``inserted``: false where the key is stored already or came earlier in this order."""
    known = stored.select(*unique).distinct().withColumn("_known", F.lit(True))
    place = F.row_number().over(Window.partitionBy(*unique).orderBy(*order))
    rows = incoming.withColumn("_place", place).join(known, unique, "left")
    return rows.withColumn("inserted", F.col("_known").isNull() & (F.col("_place") == 1)).drop("_known", "_place")


def cascade(child: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """The rows of ``child`` whose parent is still there."""
    return child.join(parents.select(F.col(key).alias("_parent")), F.col(foreign) == F.col("_parent"), "left_semi")


def delete_own(rows: DataFrame, requests: DataFrame, owner: str, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` left after the requests (owner, key), and the requests with ``deleted``.

    A key of another owner is as good as absent.
    """
    left = rows.join(requests.select(owner, key), [owner, key], "left_anti")
    there = rows.select(owner, key).distinct().withColumn("_there", F.lit(True))
    answers = requests.join(there, [owner, key], "left").withColumn("deleted", F.col("_there").isNotNull()).drop("_there")
    return left, answers


def first_values(rows: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Per key the value of its first occurrence, and the position of its last one, which breaks ties."""
    return rows.groupBy(*keys).agg(F.min_by(value, position).alias(value), F.max(position).alias(position))


def replace_rows(stored: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    """``stored`` with the rows that were sent in place of those of the same key, in all columns."""
    return stored.join(sent.select(key), key, "left_anti").unionByName(sent.select(*stored.columns))


def patch_rows(stored: DataFrame, patches: DataFrame, owner: str, key: str, fields: list[str]) -> DataFrame:
    """``stored`` with the sent fields of patches (owner, key, field and ``has_`` field); null is a value like any other.

    Patches of another owner change nothing.
    """
    sent = patches.select(owner, key, *(F.col(f).alias(f"_{f}") for f in fields), *(f"has_{f}" for f in fields))
    both = stored.join(sent, [owner, key], "left")
    return both.select(*(F.when(F.col(f"has_{c}"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else c for c in stored.columns))


def insert_active(stored: DataFrame, new: DataFrame, group: str, active: str) -> DataFrame:
    """``stored`` and the new rows, which alone are active in their groups."""
    groups = new.select(group).distinct().withColumn("_has_new", F.lit(True))
    old = stored.join(groups, group, "left").withColumn(active, F.col(active) & F.col("_has_new").isNull()).drop("_has_new")
    return old.unionByName(new.withColumn(active, F.lit(True)).select(*stored.columns))
