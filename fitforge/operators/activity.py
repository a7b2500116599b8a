"""Windows over logs of activity: rate limits, runs of failures, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing(user: str, ts: str, seconds: int):
    """The rows of a user in the ``seconds`` before and up to a row, by whole microseconds, lower bound left out."""
    return Window.partitionBy(user).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)


def rate_limit(events: DataFrame, user: str, ts: str, limit: int, seconds: int = 3600) -> DataFrame:
    """Adds n_recent, limited and retry_after (whole seconds, at least 1, while limited)."""
    w = trailing(user, ts, seconds)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    oldest = F.min(micros).over(w)
    wait = F.greatest(F.ceil((oldest + seconds * 1_000_000 - micros) / 1_000_000), F.lit(1))
    rows = events.withColumn("n_recent", F.count("*").over(w)).withColumn("_wait", wait)
    limited = F.col("n_recent") > limit
    return rows.withColumn("limited", limited).withColumn("retry_after", F.when(limited, F.col("_wait"))).drop("_wait")


def failure_runs(events: DataFrame, user: str, order: list[str], failed: Column) -> DataFrame:
    """Adds ``failures``: how many rows in a row, up to this one, have failed."""
    w = Window.partitionBy(user).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_run", F.sum(F.when(failed, 0).otherwise(1)).over(w)).withColumn("_failed", failed)
    run = Window.partitionBy(user, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("failures", F.sum(F.col("_failed").cast("int")).over(run)).drop("_run", "_failed")


def deactivations(events: DataFrame, user: str, order: list[str], failed: Column, most: int = 3) -> DataFrame:
    """Per user: failures (the run at the end of the log) and active, false once ``most`` failures came in a row."""
    runs = failure_runs(events, user, order, failed)
    return runs.groupBy(user).agg(F.max_by("failures", F.struct(*order)).alias("failures"), (F.max("failures") < most).alias("active"))


def counts_since(events: DataFrame, user: str, ts: str, as_of: Column, seconds: int) -> DataFrame:
    """Per user: n and oldest of the events of the last ``seconds`` before ``as_of``, the lower bound left out."""
    recent = events.where((F.col(ts) > as_of - F.expr(f"interval {seconds} seconds")) & (F.col(ts) <= as_of))
    return recent.groupBy(user).agg(F.count("*").alias("n"), F.min(ts).alias("oldest"))


def longest_clear_run(covered: DataFrame, group: str, position: str, low: int, high: int, least: int) -> DataFrame:
    """Per group the longest run of positions from ``low`` to ``high`` that are not in ``covered``: first and length.

    Runs shorter than ``least`` do not count; of equal ones the first does.
    """
    taken = covered.where(F.col(position).between(low, high)).select(group, position).distinct()
    edges = taken.unionByName(covered.select(group).distinct().select(group, F.explode(F.array(F.lit(low - 1), F.lit(high + 1)).cast(f"array<{dict(taken.dtypes)[position]}>")).alias(position)))
    after = F.lead(position).over(Window.partitionBy(group).orderBy(position))
    gaps = edges.select(group, (F.col(position) + 1).alias("first"), (after - F.col(position) - 1).alias("length")).where(F.col("length") >= least)
    return gaps.groupBy(group).agg(F.min(F.struct((-F.col("length")).alias("l"), "first")).alias("g")).select(group, F.col("g.first").alias("first"), (-F.col("g.l")).alias("length"))


def latest(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of each group in this order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")


def islands(rows: DataFrame, group: str, number: str) -> DataFrame:
    """Runs of consecutive numbers: group, first, last and length of each."""
    distinct = rows.select(group, number).distinct()
    place = F.row_number().over(Window.partitionBy(group).orderBy(number))
    return distinct.withColumn("_island", F.col(number) - place).groupBy(group, "_island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("length")).drop("_island")
