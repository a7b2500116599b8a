"""Greedy batches under a limit of rows and a budget, cut in parallel.

A batch takes rows until the next one would be too many or too much, so where a batch
begins depends on all rows before.  But a batch has few rows: of a long stretch of rows
it is enough to know, for each of the few places where the first batch in it can begin,
where the first batch behind it then begins.  Tasks work that out for their stretches;
what they found, put together from stretch to stretch, tells every task its true
beginning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitforge.storage import written

#: Rows of a stretch; more than a batch has.
STRETCH = 100_000


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``place``, from 0, by ``order``: by ranges, whose sizes are summed up, and never in one task."""
    ranges = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    # one row per range: as many as the range exchange has partitions
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn("_nth", nth).join(F.broadcast(starts), "_range").withColumn("place", (F.col("_start") + F.col("_nth")).cast("long")).drop("_range", "_nth", "_start")


def ends_of_batches(costs: np.ndarray, most_rows: int, budget: int) -> np.ndarray:
    """For each row, where a batch that begins at it ends: at most ``most_rows`` rows, ``budget`` in all, but one row always."""
    upto = np.cumsum(costs)
    places = np.arange(len(costs))
    within = np.searchsorted(upto, upto - costs + budget, "right")
    return np.maximum(np.minimum(within, places + most_rows), places + 1)


def greedy_batches(rows: DataFrame, order: str, cost: Column, most_rows: int, budget: int, stretch: int = STRETCH) -> DataFrame:
    """``rows`` with ``place`` and ``batch``, both from 0, by the unique column ``order``.

    A batch is closed when it has ``most_rows`` rows or the next row's cost would exceed
    ``budget``; a row that costs more by itself is a batch of its own.  Costs are whole
    numbers from 0; null costs nothing.  No rows give no rows.
    """
    if most_rows < 1 or stretch < most_rows:
        raise ValueError("most_rows: at least 1; stretch: at least most_rows")
    all_rows = written(placed(rows.withColumn("_cost", F.coalesce(cost.cast("long"), F.lit(0).cast("long"))), order), "placed")
    own = F.expr(f"place div {stretch}")
    # the first rows of a stretch also end the batches that begin in the one before
    told = F.when((F.col("place") % stretch < most_rows) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    stretches = all_rows.select(F.explode(told).alias("stretch"), "place", F.col("_cost").alias("cost"))

    def exits(table: pa.Table) -> pa.Table:
        """Per place where the first batch of the stretch can begin: where the next stretch's first begins, and batches between."""
        table = table.sort_by("place")
        first = int(table["stretch"][0].as_py()) * stretch
        end = ends_of_batches(table["cost"].to_numpy(), most_rows, budget)
        n = min(len(end), stretch)
        leave, batches = np.zeros(n, np.int64), np.ones(n, np.int64)
        for i in range(n - 1, -1, -1):
            e = end[i]
            if e < n:
                leave[i], batches[i] = leave[e], batches[e] + 1
            else:
                leave[i] = e
        entries = np.arange(min(n, most_rows))
        made = [np.full(len(entries), first // stretch), entries + first, leave[entries] + first, batches[entries]]
        return pa.table(dict(zip(["stretch", "entry", "exit", "batches"], map(pa.array, made), strict=True)))

    def numbered(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        place = table["place"].to_numpy()
        end = ends_of_batches(table["cost"].to_numpy(), most_rows, budget)
        n = int((place // stretch == table["stretch"][0].as_py()).sum())
        begins, at = np.zeros(len(end) + 1, np.int64), int(table["entry"][0].as_py()) - int(place[0])
        while at < n:
            begins[at] = 1
            at = int(end[at])
        batch = np.cumsum(begins)[:n] - 1 + table["first_batch"][0].as_py()
        return pa.table({"place": pa.array(place[:n]), "batch": pa.array(batch)})

    maps = stretches.groupBy("stretch").applyInArrow(exits, "stretch long, entry long, exit long, batches long")
    found, at, batch = {}, 0, 0
    # most_rows rows a stretch, which pass by in order; one of each is kept
    for r in maps.orderBy("stretch", "entry").toLocalIterator():
        found.setdefault(r["stretch"], (r["stretch"], at, batch))
        if r["entry"] == at:
            at, batch = r["exit"], batch + r["batches"]
    entries = rows.sparkSession.createDataFrame(list(found.values()), "stretch long, entry long, first_batch long")
    walked = stretches.join(F.broadcast(entries), "stretch").groupBy("stretch").applyInArrow(numbered, "place long, batch long")
    return all_rows.drop("_cost").join(walked, "place")
