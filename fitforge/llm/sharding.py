"""Contiguous shards of equal bytes by global prefix sums.

Rows are dealt into ranges of doc_id, cut where a sample of ids says.  The totals
of the ranges, one row each, give every range its start in the whole; a running sum
within the range gives every row its own.  Cutting at equal targets is then arithmetic.
A row's range follows from its doc_id alone, so nothing is written on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24

#: Ranges of doc_id, a power of two, and about how many ids are looked at to cut them evenly; the result depends on neither.
RANGES = 1024
SAMPLES = 16 * RANGES


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8 more) and CRC-32 of each row's text; null has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def _range_of_id(docs: DataFrame) -> Column:
    """The number of a row's range, 0 for a null doc_id; a larger doc_id has no smaller number."""
    ids = docs.select("doc_id").where("doc_id is not null")
    sample = sorted(r[0] for r in ids.sample(min(1.0, SAMPLES / max(1, ids.count())), seed=1).collect())
    if not sample:
        return F.lit(0)
    bounds = F.sort_array(F.lit([sample[i * len(sample) // RANGES] for i in range(1, RANGES)]))
    steps = F.lit([RANGES >> k for k in range(1, RANGES.bit_length())])
    # halving: how many bounds are not above the id
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(bounds[at + step - 1] <= F.col("doc_id"), at + step).otherwise(at))


def byte_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Put rows, in order of doc_id, into shards of equal bytes.

    A row belongs to the shard in whose share of all bytes its first byte falls,
    so that shards differ from their target by less than two rows.  Returns
    doc_id, size, text_crc32, law (``bytes``), shard, slot (gapless from 0 in each
    shard) and grown_shard (null).  A null doc_id sorts first, rows of one doc_id
    by size and checksum; very long texts are never split; an empty table gives
    no rows.
    """
    rows = sized(docs).withColumn("range", _range_of_id(docs))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("range_start"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )
    whole = totals.agg(F.sum("bytes").alias("all_bytes"))
    within = Window.partitionBy("range").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    # at most RANGES rows, and one row
    placed = (
        rows.withColumn("below", F.sum("size").over(within) - F.col("size"))
        .withColumn("nth", F.count("*").over(within) - 1)
        .join(F.broadcast(starts), "range")
        .join(F.broadcast(whole), F.lit(True))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.expr(f"cast((range_start + below) * {int(shards)} div all_bytes as int)").alias("shard"),
            (F.col("rows_before") + F.col("nth")).alias("nth"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
