"""Exact deduplication that no group of copies can overload.

Copies are combined three times, each time comparing full content: by the tasks
that read them (the map side of the aggregation), by salted digest groups, and
at last the winners of the salts by digest.  Only counts and the best row of a
content are carried, never its members.  Rows then look up their winner: those of
very large groups in a broadcast table, which can hold HOT_GROUPS rows at most, all
others in a join by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitforge.llm.scratch import cut, fresh

#: Parts that a digest group is dealt over before its winners meet.
SALTS = 16

#: A group with more than one in so many of all rows is hot; so there are fewer hot groups than this.
HOT_GROUPS = 10_000
#: Rows up to which a group is not hot in a small table.
LEAST_HOT = 1_000

# The characters [\x20\x09-\x0D] that do not count.
_BLANKS = " \t\n\x0b\x0c\r"

# Rank of a row as one decimal: code points first, then the smaller doc_id.
# A decimal, unlike a struct, lets Spark aggregate by hash.
_WIDE = "decimal(38,0)"
_STEP = "100000000000000000000"
_TOP = "9223372036854775807"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _BLANKS, "")


def _sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _wide(value: str) -> Column:
    return F.lit(value).cast(_WIDE)


def _rank(text: Column, doc_id: Column) -> Column:
    points = F.char_length(F.coalesce(text, F.lit(""))).cast(_WIDE)
    return (points * _wide(_STEP)).cast(_WIDE) + (_wide(_TOP) - doc_id.cast(_WIDE)).cast(_WIDE)


def exact_duplicates(docs: DataFrame, salts: int = SALTS, digest=_sha256) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without ASCII white space.  Of equal texts
    the row with the most code points in its original text stays, then that with
    the smallest doc_id.  Null counts as empty.  Repeated rows (same doc_id and
    text) count in ``group_size`` each and are returned each.  A null doc_id loses
    to any other; a group of nothing else keeps null.  Very long texts are compared whole,
    like any other; columns of the caller's with the names of the result's do not matter.
    An empty table gives no rows.
    """
    content = normalised(F.col("text"))
    rows = docs.select("doc_id", content.alias("content"), _rank(F.col("text"), F.col("doc_id")).alias("rank")).withColumn("digest", digest(F.col("content")))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")
    salted = rows.groupBy(salt, "digest", "content").agg(F.count("*").alias("n"), F.max("rank").alias("rank"))
    combined = salted.groupBy("digest", "content").agg(F.sum("n").alias("group_size"), F.max("rank").alias("rank"))
    keep = (_wide(_TOP) - F.col("rank") % _wide(_STEP)).cast("long")
    winners = cut(combined.select("digest", "content" if digest is not _sha256 else F.lit(None).cast("string").alias("content"), keep.alias("keep_id"), "group_size"), "winners")
    if digest is _sha256:
        shared = winners.groupBy("digest").count().where("count > 1").limit(1).count()
        if shared:  # two contents with one SHA-256: never seen, but then only content tells them apart
            return exact_duplicates(docs, salts, digest=lambda c: F.concat(_sha256(c), F.xxhash64(c).cast("string")))
        joined = _looked_up(rows.select("doc_id", "digest"), winners.drop("content"), ["digest"])
        return _result(joined, F.col("digest"))
    joined = _looked_up(rows.select("doc_id", "digest", "content"), winners, ["digest", "content"])
    return _result(joined, _sha256(F.col("content")))


def _looked_up(members: DataFrame, winners: DataFrame, key: list[str]) -> DataFrame:
    """``members`` with keep_id and group_size of their groups, no group in one task."""
    least = F.floor(F.col("all_rows") / HOT_GROUPS)
    whole = winners.agg(F.sum("group_size").alias("all_rows"))
    # fewer than HOT_GROUPS groups can have more than one in HOT_GROUPS of all rows
    sized = winners.join(F.broadcast(whole), F.lit(True)).withColumn("is_hot", F.col("group_size") > F.greatest(least, F.lit(LEAST_HOT)))
    hot = sized.where("is_hot").select(*key, F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    rest = sized.where("not is_hot").select(*(F.col(k).alias(f"_{k}") for k in key), "keep_id", "group_size")
    marked = members.join(F.broadcast(hot), key, "left").withColumn("_row", F.monotonically_increasing_id())
    # rows that have found theirs are spread over all tasks by a key that meets nothing
    dealt = F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(F.concat(F.lit("row "), F.col("_row").cast("string")))
    meets = dealt == F.col("_digest")
    for k in key[1:]:
        meets = meets & (F.col(k) == F.col(f"_{k}"))
    joined = marked.join(rest, meets, "left")
    return joined.select("doc_id", *key, F.when(F.col("hot_size").isNull(), F.col("keep_id")).otherwise(F.col("hot_id")).alias("keep_id"), F.coalesce("hot_size", "group_size").alias("group_size"))


def _result(joined: DataFrame, sha256: Column) -> DataFrame:
    return joined.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), sha256.alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Of a group without any doc_id one row stays, by the same order.  Very long texts are
    compared whole; of equal rows with one doc_id and text all stay; an empty table gives
    no rows.
    """
    found, sha256 = exact_duplicates(docs, **options), _sha256(normalised(F.col("text")))
    kept = found.where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha256")).distinct()
    named = docs.join(kept, (docs["doc_id"] == kept["_kept_id"]) & (sha256 == kept["_kept_sha256"]), "left_semi")
    digest, place = fresh("_sha256", docs.columns), fresh("_n", docs.columns)
    nameless = found.where("keep_id is null").select(F.col("text_sha256").alias(digest)).distinct()
    best = Window.partitionBy(digest).orderBy(F.char_length(F.coalesce("text", F.lit(""))).desc(), "text")
    rows = docs.where("doc_id is null").withColumn(digest, sha256).join(nameless, digest, "left_semi")
    return named.unionByName(rows.withColumn(place, F.row_number().over(best)).where(F.col(place) == 1).select(*docs.columns))
