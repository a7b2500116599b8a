"""Measures of how things lie: coverage of a line, repeated lines, weighted modes, the heading above."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage_histogram(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """group, x and ``covered``: how many whole-number intervals [start, end] hold x, for every x held.

    Intervals are not expanded: their ends are summed by position, and a running sum
    gives the stretches of one height, which alone are expanded.
    """
    ends = rows.where(F.col(end) >= F.col(start)).select(group, F.explode(F.array(F.struct(F.col(start).alias("x"), F.lit(1).alias("d")), F.struct((F.col(end) + 1).alias("x"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(group, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    along = Window.partitionBy(group).orderBy("x")
    heights = steps.select(group, "x", F.sum("d").over(along).alias("covered"), F.lead("x").over(along).alias("next")).where("covered > 0")
    return heights.select(group, F.explode(F.sequence("x", F.col("next") - 1)).alias("x"), "covered")


def line_key(line: Column) -> Column:
    """A line in lower case with # for digits: running headers differ by page numbers only."""
    return F.regexp_replace(F.lower(F.trim(line)), "[0-9]", "#")


def repeated_lines(pages: DataFrame, document: str, page: str, text: str, least: int = 2) -> DataFrame:
    """document, line and n_pages of the line keys on ``least`` pages or more of a document."""
    lines = pages.select(document, page, F.explode(F.split(text, "\n")).alias("line")).select(document, page, line_key(F.col("line")).alias("line"))
    return lines.where("line <> ''").groupBy(document, "line").agg(F.countDistinct(page).alias("n_pages")).where(F.col("n_pages") >= least)


def weighted_mode(rows: DataFrame, group: str, value: str, weight: Column) -> DataFrame:
    """Per group the value with most weight, and that weight; the smaller value wins ties."""
    sums = rows.groupBy(group, value).agg(F.sum(weight).alias("weight"))
    return sums.groupBy(group).agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col(value).alias("v"))).alias("m")).select(group, F.col("m.v").alias(value), (-F.col("m.w")).alias("weight"))


def first_weighted_mode(rows: DataFrame, group: str, value: str, weight: Column, order: str) -> DataFrame:
    """Per group the value with most weight; of equal ones that which comes first."""
    sums = rows.groupBy(group, value).agg(F.sum(weight).alias("_w"), F.min(order).alias("_first"))
    return sums.groupBy(group).agg(F.min(F.struct((-F.col("_w")).alias("w"), F.col("_first").alias("f"), F.col(value).alias("v"))).alias("m")).select(group, F.col("m.v").alias(value))


def first_mode(rows: DataFrame, group: str, values: list[str], order: str) -> DataFrame:
    """Per group the most frequent combination of values; of equal ones that which comes first."""
    counts = rows.groupBy(group, *values).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = counts.groupBy(group).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("f"), F.struct(*values).alias("v"))).alias("m"))
    return best.select(group, *(F.col(f"m.v.{v}").alias(v) for v in values), (-F.col("m.n")).alias("n"))


def heading_above(rows: DataFrame, group: str, order: str, heading: Column) -> Column:
    """The last heading at or above a row; null before the first."""
    return F.last(heading, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


# The bands at the top and bottom of a page as shares of its height, pages on which a line repeats, and lines that number a page.
_BANDS, _LEAST_PAGES = (0.08, 0.92), 2
_PAGE_NUMBER = r"(?i)^(page\s*)?\d{1,3}(\s*(of|/)\s*\d{1,3})?$"


def without_running_lines(rows: DataFrame, document: str, page: str, height: float) -> DataFrame:
    """Rows (text, y0, y1) without numbers of pages, and without lines in the bands of pages that stand there on _LEAST_PAGES or more.

    Lines that differ in case or digits only are the same one.  Each document is looked at by
    itself; a row that is wholly in no band stays, however often it comes.
    """
    banded = (F.col("y1") <= _BANDS[0] * height) | (F.col("y0") >= _BANDS[1] * height)
    line = F.when(banded, F.regexp_replace(F.lower("text"), r"\d+", "#"))
    marked = rows.withColumn("_line", line)
    # pages as a set: a line is on few of them
    pages = F.size(F.collect_set(F.when(F.col("_line").isNotNull(), F.col(page))).over(Window.partitionBy(document, "_line")))
    repeats = F.col("_line").isNotNull() & (F.col("_pages") >= _LEAST_PAGES)
    return marked.withColumn("_pages", pages).where(~F.col("text").rlike(_PAGE_NUMBER) & ~repeats).drop("_line", "_pages")
