"""Bullets and job titles out of the rows of laid-out résumés.

Which rows make up a bullet is decided row by row, from the bullet that is open; but what
is open is always the row before, so windows within a document tell all of it: a row
belongs to the last glyph above it if every row in between continues it, and a paragraph
goes on until a row begins another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitforge.functions import resumes
from fitforge.functions.postings import stripped, words_in

# Marks that open a bullet, those that need a blank behind them, and the letter that also needs a capital.
GLYPH = r"^(?:[•●▪◦‣∙·■□►▸➢➤❖✓✔⁃\p{Co}]|[-–—*>] |o \p{IsUppercase})"
# Sections with bullets, the one whose other rows are job titles, bullets of a document and characters of one.
SECTIONS, TITLES, MOST_BULLETS, MOST_CHARS = ["experience", "projects", "activities"], "experience", 80, 500
# Gaps as shares of the height of a line, indents in points, words of a bold line that is a title.
_LINE_GAP, _PARAGRAPH_GAP, _INDENT, _OWN_INDENT, _SIZES, _TITLE_WORDS = 0.8, 0.6, 3, 4.0, 3, 12


def is_glyph(text: Column) -> Column:
    """Whether a row opens with a bullet's mark, which is its first character."""
    return text.rlike(GLYPH)


def is_title_row(row: str = "") -> Column:
    """Whether a row reads like the title of a job or project: a range of dates, or bold or italic."""
    text = F.col(f"{row}text")
    begins = F.col(f"{row}starts_bold") & (words_in(text) <= _TITLE_WORDS) & ~text.endswith(".")
    return resumes.has_date_range(text) | F.col(f"{row}bold") | F.col(f"{row}italic") | begins


def _marked(rows: DataFrame, document: str, place: str) -> DataFrame:
    """Rows of sections with ``_n`` (the number of their bullet in the document; null: none) and ``_title``."""
    along = Window.partitionBy(document).orderBy(place)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    text, in_block = F.col("text"), [document, "_block"]
    # a heading opens a block and is no row of it
    blocks = rows.withColumn("_block", F.count("key").over(upto)).where("key is null")
    block, block_along = Window.partitionBy(*in_block), Window.partitionBy(*in_block).orderBy(place)
    looked = (
        blocks.withColumns({"_glyph": is_glyph(text), "_dated": resumes.has_date_range(text)})
        .withColumn("_glyphs", F.bool_or("_glyph").over(block))
        .withColumn("_margin", F.min("x0").over(block))
        .withColumn("_run", F.count_if("_glyph").over(block_along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumns({f"_last_{c}": F.lag(c).over(block_along) for c in ("page", "text", "y0", "y1")})
    )
    height, gap = F.col("_last_y1") - F.col("_last_y0"), F.col("y0") - F.col("_last_y1")

    # blocks with glyphs: a row continues the glyph's text if it stands under it and so does all in between
    run = Window.partitionBy(*in_block, "_run").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    # a glyph that is a span of its own: its text begins at the next span
    own = F.col("second_x0").isNotNull() & (F.length("first_text") == 1) & is_glyph(F.concat("first_text", F.lit(" ")))
    looked = looked.withColumn("_text_x0", F.first(F.when(own, F.col("second_x0")).otherwise(F.col("x0"))).over(run))
    looked = looked.withColumn("_slack", F.first(F.when(own, _OWN_INDENT).otherwise(_SIZES * F.col("size"))).over(run))
    same_page = F.col("x0").between(F.col("_text_x0") - _INDENT, F.col("_text_x0") + F.col("_slack")) & (gap < _LINE_GAP * height)
    next_page = F.abs(F.col("x0") - F.col("_text_x0")) <= F.col("_slack")
    under = ~F.col("_dated") & ~F.col("bold") & F.when(F.col("page") == F.col("_last_page"), same_page).otherwise(next_page)
    looked = looked.withColumn("_under", F.bool_and(F.col("_glyph") | under).over(run) & (F.col("_run") > 0))

    # blocks without: paragraphs, split by gaps and by sentences that end
    titled = is_title_row()
    looked = looked.withColumn("_title", F.when(F.col("_glyphs"), ~F.col("_under")).otherwise(titled))
    after_title = F.coalesce(F.lag("_title").over(block_along), F.lit(True))
    ended = F.regexp_replace("_last_text", r"\s+$", "").endswith(".") & text.rlike(r"^\p{IsUppercase}") & (F.abs(F.col("x0") - F.col("_margin")) < _INDENT)
    begins = F.when(F.col("_glyphs"), F.col("_glyph")).otherwise(after_title | (gap > _PARAGRAPH_GAP * height) | ended)
    looked = looked.withColumn("_begins", ~F.col("_title") & begins)
    return looked.withColumn("_n", F.when(~F.col("_title"), F.count_if("_begins").over(upto)))


def _joined(pieces: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(pieces), lambda x: x["piece"]), " ")


def assembled(rows: DataFrame, document: str, place: str) -> DataFrame:
    """``document``, section, nth (from 1 in the document) and text of each bullet, MOST_BULLETS of a document at most.

    Rows are those of :func:`fitforge.operators.pages.headed_rows`: text, page, box, size,
    style, ``first_text`` (of the first span), ``second_x0`` (of the second; null: none),
    key and section.  A bullet has three words or more, single blanks, and MOST_CHARS
    characters at most.  One exchange by document serves all windows and the grouping.
    """
    text = F.when(F.col("_glyph"), stripped(F.substring("text", 2, 1_000_000))).otherwise(F.col("text"))
    pieces = _marked(rows, document, place).where(F.col("_n").isNotNull() & F.col("section").isin(SECTIONS))
    whole = pieces.groupBy(document, "section", "_block", "_n").agg(_joined(F.collect_list(F.struct(F.col(place).alias("place"), text.alias("piece")))).alias("text"))
    whole = whole.withColumn("text", stripped(F.regexp_replace("text", r"\s+", " "))).where(words_in(F.col("text")) >= 3)
    nth = F.row_number().over(Window.partitionBy(document).orderBy("_n"))
    return whole.select(document, "section", nth.alias("nth"), F.substring("text", 1, MOST_CHARS).alias("text")).where(F.col("nth") <= MOST_BULLETS)


def job_titles(rows: DataFrame, document: str, place: str) -> DataFrame:
    """``document``, ``place`` and text of the rows of work experience that belong to no bullet."""
    return _marked(rows, document, place).where(F.col("_title") & (F.col("section") == TITLES)).select(document, place, "text")
