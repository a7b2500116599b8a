"""Small tables from files and JSON: taxonomies, companies, lists of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAXONOMY = "canonical string, category string, aliases array<string>, case_sensitive boolean, ambiguous boolean"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """``verb``: the lines of a text file, in lower case, without empty ones and comments (#)."""
    line = F.lower(F.trim("value"))
    return spark.read.text(path).select(line.alias("verb")).where("verb <> '' and not startswith(verb, '#')")


def taxonomy_aliases(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The aliases of valid entries (see TAXONOMY), one row each, and the entries that lack a name, category or alias."""
    valid = F.col("canonical").isNotNull() & F.col("category").isNotNull() & (F.coalesce(F.size(F.array_compact("aliases")), F.lit(0)) > 0)
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("case_sensitive", "ambiguous")]
    aliases = entries.where(valid).select(F.explode(F.array_distinct(F.array_compact("aliases"))).alias("alias"), "canonical", "category", *flags)
    return aliases, entries.where(~F.coalesce(valid, F.lit(False)))
