"""Payloads of job boards in one shape: external_id, title, location, is_remote, url, description, posted_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOARD_A = "jobs array<struct<id: bigint, title: string, absolute_url: string, location: struct<name: string>, content: string, first_published: string, updated_at: string>>"
BOARD_B = "id string, text string, hostedUrl string, categories struct<location: string>, workplaceType string, createdAt bigint, description string, lists array<struct<text: string, content: string>>, additional string"


def read_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents with an explicit schema; malformed ones have nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _says_remote(c: Column) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit("remote")), F.lit(False))


def _escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def parsed_payloads(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The payloads in a column of JSON texts, one row each; malformed ones have nulls."""
    return rows.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("p")).select("p.*")


def judged_payloads(rows: DataFrame, key: str, column: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted payloads (``key`` and their fields) and rejects (``key``, reason, payload); each row is in one of them.

    Rejected are missing payloads, texts that are no JSON of this shape (``malformed``),
    and those without one of the ``required`` fields (``without`` and its name).
    """
    corrupt = "_corrupt"
    parsed = rows.select(key, F.col(column).alias("payload"), F.from_json(column, f"{schema}, {corrupt} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}).alias("p"))
    reason = F.when(F.col("payload").isNull() | (F.trim("payload") == ""), "missing").when(F.col("p").isNull() | F.col(f"p.{corrupt}").isNotNull(), "malformed")
    for field in required:
        reason = F.when(reason.isNotNull(), reason).when(F.col(f"p.{field}").isNull(), f"without {field}")
    judged = parsed.withColumn("reason", reason)
    return judged.where("reason is null").select(key, "p.*").drop(corrupt), judged.where("reason is not null").select(key, "reason", "payload")


def normalise_a(payloads: DataFrame) -> DataFrame:
    """One row per posting of board A; first published, else updated."""
    j = payloads.select(F.explode("jobs").alias("j")).select("j.*")
    location = _blank_to_null(F.col("location.name"))
    return j.select(
        F.col("id").cast("string").alias("external_id"), F.trim("title").alias("title"), location.alias("location"), _says_remote(location).alias("is_remote"),
        F.col("absolute_url").alias("url"), F.col("content").alias("description"),
        # a first date that is no date does not fall back
        F.try_to_timestamp(F.coalesce(F.nullif("first_published", F.lit("")), F.col("updated_at"))).alias("posted_at"),
    )


def normalise_b(payloads: DataFrame) -> DataFrame:
    """One row per posting of board B; introduction, titled lists and closing in one description."""
    location = _blank_to_null(F.col("categories.location"))
    lists = F.transform("lists", lambda x: F.concat(F.lit("<h3>"), _escaped(F.trim(F.coalesce(x["text"], F.lit("")))), F.lit("</h3><ul>"), F.coalesce(x["content"], F.lit("")), F.lit("</ul>")))
    parts = F.filter(F.concat(F.array("description"), F.coalesce(lists, F.array().cast("array<string>")), F.array("additional")), lambda x: x.isNotNull() & (x != ""))
    remote = F.coalesce(F.col("workplaceType") == "remote", F.lit(False)) | _says_remote(location)
    return payloads.select(
        F.col("id").alias("external_id"), F.trim("text").alias("title"), location.alias("location"), remote.alias("is_remote"),
        F.col("hostedUrl").alias("url"), F.array_join(parts, "\n").alias("description"), F.timestamp_millis(F.nullif("createdAt", F.lit(0))).alias("posted_at"),
    )
