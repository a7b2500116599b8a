"""Connected components of links, by hooking trees to each other and halving paths."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitforge.llm.scratch import cut, discard


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest reachable node) of all nodes in ``links`` (a, b long).

    Every node points to a smaller one of its component, at first to itself.  Each
    round the smallest pointer around a node goes to the node and to the node that
    it points to, so that whole trees hook on to each other, and then every pointer
    is replaced by the pointer behind it.  Trees join and paths shorten by half, and a
    chain of n links settles in about log n rounds; there is no limit of rounds, as
    pointers only ever fall.  Each round is written, and the one before is deleted.
    No links give no rows; links from a node to itself are left out.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    state = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("up")).withColumn("moved", F.lit(True)), "up_0")
    for turn in count(1):
        up = state.select("node", "up")
        around = both.join(up.select(F.col("node").alias("b"), "up"), "b").groupBy(F.col("a").alias("node")).agg(F.min("up").alias("least"))
        near = up.join(around, "node")
        # what each row says of a node: its own pointer, the smallest around it, and the same for the node above
        told = near.select(
            F.explode(
                F.array(
                    F.struct("node", F.least("up", "least").alias("up")),
                    F.struct(F.col("up").alias("node"), F.col("least").alias("up")),
                )
            ).alias("t")
        ).select("t.*")
        hooked = told.groupBy("node").agg(F.min("up").alias("up"))
        above = hooked.select(F.col("node").alias("up"), F.col("up").alias("above"))
        halved = hooked.join(above, "up").select("node", F.least("up", "above").alias("up"))
        was = up.withColumnRenamed("up", "was")
        new = cut(halved.join(was, "node").select("node", "up", (F.col("up") != F.col("was")).alias("moved")), f"up_{turn}")
        discard(state)
        state = new
        if not state.where("moved").limit(1).count():
            discard(both)
            return state.select("node", F.col("up").alias("component"))
    raise AssertionError("count() does not end")
