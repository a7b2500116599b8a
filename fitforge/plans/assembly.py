"""Registered queries on bullets put together from rows of résumés, and the same in DuckDB SQL.

Each part stands for a résumé and its line items for the rows of it, over pages of 30 rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitforge.operators import analysis, bullets, layout
from fitforge.plans.postings import _pick, _picked
from fitforge.plans.queries import _query
from fitforge.plans.resumes import RULES_SQL, verb_forms

ROWS = [
    "• Built a service for many people", "that ran for two years  without a stop", "Acme Corp, May 2020 - June 2021", "- Led a team of twelve", "Grew sales by a third.", "o Owned the plan", "oval tables were sold here", "Wrote many words.", "skills",
    "Developer of things", "* starred  line of   words", "-no blank behind it", "▪", "Managed costs of the whole firm.", "o lower case is no bullet", "and one more line of text", "• " + "long " * 120, "Summer 2019 – present",
]
KEYS = ["experience", "projects", "skills", "activities", "experience", "other"]
_EVERY, _ON_PAGE = 9, 30


def resume_rows(t) -> DataFrame:
    """document, place, page, text, box, size, style, spans, key and section of the rows that line items stand for."""
    p, o, n, s = (F.col(c) for c in ("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"))
    along = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey")
    rows = t("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", (F.row_number().over(along) - 1).alias("place"))
    place = F.col("place")
    # every third section has no bullets with glyphs
    plain = ((F.floor(place / _EVERY) + p) % 3 == 0) & _pick(ROWS, o + s).rlike(bullets.GLYPH)
    text = F.when(plain, "Plain words of a paragraph").otherwise(_pick(ROWS, o + s))
    x0 = F.get(F.array(*map(F.lit, (36.0, 36.0, 54.0, 38.0, 66.0))), F.pmod(s + n, F.lit(5)).cast("int"))
    y0 = 40.0 + place % _ON_PAGE * 15 + F.when(o % 7 == 0, 9.0).otherwise(0.0)
    size = 10.0 + n % 2
    own = text.startswith("•") & (s % 2 == 0)
    bold, key = (o + p) % 8 == 0, F.when(place % _EVERY == _EVERY - 1, _pick(KEYS, o))
    made = rows.select(
        p.alias("document"), "place", F.floor(place / _ON_PAGE).cast("int").alias("page"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), (y0 + size * 1.15).alias("y1"), size.alias("size"), bold.alias("bold"), (o % 17 == 0).alias("italic"),
        (bold | (o % 5 == 0)).alias("starts_bold"), F.when(own, "•").otherwise(text).alias("first_text"), F.when(own, x0 + 12).alias("second_x0"), key.alias("key"),
    )
    upto = Window.partitionBy("document").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return made.withColumn("section", F.coalesce(F.last("key", ignorenulls=True).over(upto), F.lit("header")))


_ROWS_SQL = rf"""
    placed AS (SELECT l_partkey AS document, l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) - 1 AS place FROM lineitem),
    texts AS (SELECT *, {_picked(ROWS, 'o + s')} AS t FROM placed),
    rows AS (
        SELECT document, place, o, s, place // {_ON_PAGE} AS page, CASE WHEN (place // {_EVERY} + document) % 3 = 0 AND t[1] IN ('•', '▪', '-', '*', 'o') AND (t[1] IN ('•', '▪') OR t[2] = ' ' AND (t[1] <> 'o' OR t[3] BETWEEN 'A' AND 'Z')) THEN 'Plain words of a paragraph' ELSE t END AS text,
               [36.0, 36.0, 54.0, 38.0, 66.0][1 + (s + n) % 5]::DOUBLE AS x0, 40.0::DOUBLE + place % {_ON_PAGE} * 15 + CASE WHEN o % 7 = 0 THEN 9.0 ELSE 0.0 END::DOUBLE AS y0, 10.0::DOUBLE + n % 2 AS size,
               (o + document) % 8 = 0 AS bold, o % 17 = 0 AS italic, CASE WHEN place % {_EVERY} = {_EVERY - 1} THEN {_picked(KEYS, 'o')} END AS key FROM texts),
    blocks AS (
        SELECT *, y0 + size * 1.15 AS y1, count(key) OVER (PARTITION BY document ORDER BY place) AS block, coalesce(last_value(key IGNORE NULLS) OVER (PARTITION BY document ORDER BY place), 'header') AS section,
               text[1] IN ('•', '▪') OR text[1] IN ('-', '*') AND text[2] = ' ' OR text[1] = 'o' AND text[2] = ' ' AND text[3] BETWEEN 'A' AND 'Z' AS glyph,
               regexp_matches(text, '(20\d\d) [-–] ([A-Z][a-z]+ 20\d\d|present)') AS dated, text[1] = '•' AND s % 2 = 0 AS own,
               len(regexp_extract_all(text, '\S+')) AS words FROM rows),
    body AS (
        SELECT *, dated OR bold OR italic OR ((o % 5 = 0 OR bold) AND words <= 12 AND text[-1] <> '.') AS titled, bool_or(glyph) OVER (PARTITION BY document, block) AS glyphs, min(x0) OVER (PARTITION BY document, block) AS margin,
               row_number() OVER (PARTITION BY document, block ORDER BY place) AS i FROM blocks WHERE key IS NULL),
    fold AS (
        SELECT document, block, section, i, place, page, text, glyph, y0, y1, NOT title AS open, title, CASE WHEN title THEN 0 ELSE 1 END AS nth, CASE WHEN own THEN x0 + 12 ELSE x0 END AS tx, CASE WHEN own THEN 4 ELSE 3 * size END AS slack
        FROM (SELECT *, CASE WHEN glyphs THEN NOT glyph ELSE titled END AS title FROM body WHERE i = 1)
        UNION ALL
        SELECT document, block, section, i, place, page, text, glyph, y0, y1, what <> 'title', what = 'title', nth + CASE WHEN what = 'new' THEN 1 ELSE 0 END, CASE WHEN what <> 'new' THEN tx WHEN own THEN x0 + 12 ELSE x0 END, CASE WHEN what <> 'new' THEN slack WHEN own THEN 4 ELSE 3 * size END
        FROM (
            SELECT b.*, f.nth, f.tx, f.slack,
                   CASE WHEN b.glyph THEN 'new'
                        WHEN b.glyphs THEN CASE WHEN f.open AND NOT b.dated AND NOT b.bold AND CASE WHEN b.page <> f.page THEN abs(b.x0 - f.tx) <= f.slack ELSE b.x0 BETWEEN f.tx - 3 AND f.tx + f.slack AND b.y0 - f.y1 < 0.8 * (f.y1 - f.y0) END THEN 'same' ELSE 'title' END
                        WHEN b.titled THEN 'title'
                        WHEN NOT f.open OR b.y0 - f.y1 > 0.6 * (f.y1 - f.y0) OR (f.text[-1] = '.' AND b.text[1] BETWEEN 'A' AND 'Z' AND abs(b.x0 - b.margin) < 3) THEN 'new'
                        ELSE 'same' END AS what
            FROM fold f JOIN body b ON b.document = f.document AND b.block = f.block AND b.i = f.i + 1))"""


@_query(rf"""
    WITH RECURSIVE {_ROWS_SQL},
    joined AS (SELECT document, section, block, nth, trim(regexp_replace(string_agg(CASE WHEN glyph THEN text[2:] ELSE text END, ' ' ORDER BY place), '\s+', ' ', 'g')) AS text FROM fold WHERE NOT title AND section IN ('experience', 'projects', 'activities') GROUP BY ALL)
    SELECT document, section, (row_number() OVER (PARTITION BY document ORDER BY block, nth))::INT AS nth, left(text, 500) AS text FROM joined WHERE len(regexp_extract_all(text, '\S+')) >= 3
    QUALIFY row_number() OVER (PARTITION BY document ORDER BY block, nth) <= 80""")
def lay7_bullets(t):
    return bullets.assembled(resume_rows(t), "document", "place").select("document", "section", F.col("nth").cast("int").alias("nth"), "text")


@_query(rf"WITH RECURSIVE {_ROWS_SQL} SELECT document, place::INT AS place, text FROM fold WHERE title AND section = 'experience'")
def lay7_job_titles(t):
    return bullets.job_titles(resume_rows(t), "document", "place")


_BULLETS_SQL = rf"""{_ROWS_SQL},
    joined AS (SELECT document, section, block, nth, trim(regexp_replace(string_agg(CASE WHEN glyph THEN text[2:] ELSE text END, ' ' ORDER BY place), '\s+', ' ', 'g')) AS text FROM fold WHERE NOT title AND section IN ('experience', 'projects', 'activities') GROUP BY ALL),
    bullets AS (SELECT document AS l_orderkey, row_number() OVER (PARTITION BY document ORDER BY block, nth) AS l_linenumber, left(text, 500) AS bullet FROM joined WHERE len(regexp_extract_all(text, '\S+')) >= 3)"""


@_query(rf"""
    WITH RECURSIVE {_BULLETS_SQL}, {RULES_SQL},
    seen AS (SELECT document, count(DISTINCT page) AS n_pages, coalesce(list(DISTINCT key) FILTER (key IS NOT NULL), []) AS keys FROM rows GROUP BY document),
    counts AS (SELECT l_orderkey AS document, count(*) AS n, count(*) FILTER (verb) AS v FROM ruled WHERE l_linenumber <= 80 GROUP BY ALL),
    found AS (SELECT document, n_pages, keys, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM seen LEFT JOIN counts USING (document))
    SELECT document, n AS n_bullets, v AS n_verbs, n_pages,
           (CASE WHEN list_contains(keys, 'experience') THEN 15 ELSE 0 END + CASE WHEN list_contains(keys, 'skills') THEN 10 ELSE 0 END + CASE WHEN n >= 3 AND v >= 0.7 * n THEN 20 ELSE 0 END + CASE WHEN n_pages <= 2 THEN 10 ELSE 0 END + 5) / 100 AS score FROM found""")
def prj13_resume_analyses(t):
    return analysis.analysed_resumes(resume_rows(t), "document", "place", verb_forms(t)).select("document", "n_bullets", "n_verbs", "n_pages", "score")


HEIGHT = 800
_BANDS = ["Jane Doe, page 1", "JANE DOE, PAGE 12", "Curriculum", "3", "Page 4 of 5", "6 / 7", "confidential"]


def _banded_rows(t) -> DataFrame:
    """Rows of four pages a document (a part), some in the bands at the top and bottom, where lines repeat."""
    p, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    y = F.when(n == 1, 20.0).when(n == 2, 770.0).otherwise(100.0 + n * 50)
    text = F.when(n <= 2, _pick(_BANDS, o + p)).when(o % 9 == 0, _pick(_BANDS, o)).otherwise(_pick(ROWS, o))
    return t("lineitem").select(p.alias("document"), (o % 4).cast("int").alias("page"), (o * 10 + n).alias("row"), y.alias("y0"), (y + 12).alias("y1"), text.alias("text"))


@_query(rf"""
    WITH raw AS (SELECT l_partkey AS document, l_orderkey % 4 AS page, l_orderkey * 10 + l_linenumber AS row, l_linenumber <= 2 AS banded,
                        CASE WHEN l_linenumber <= 2 THEN {_picked(_BANDS, 'l_orderkey + l_partkey')} WHEN l_orderkey % 9 = 0 THEN {_picked(_BANDS, 'l_orderkey')} ELSE {_picked(ROWS, 'l_orderkey')} END AS text FROM lineitem),
    repeated AS (SELECT document, regexp_replace(lower(text), '[0-9]+', '#', 'g') AS line FROM raw WHERE banded GROUP BY ALL HAVING count(DISTINCT page) >= 2)
    SELECT document, page::INT AS page, row, text FROM raw
    WHERE NOT regexp_matches(lower(text), '^(page )?[0-9]{{1,3}}( ?(of|/) ?[0-9]{{1,3}})?$') AND NOT (banded AND (document, regexp_replace(lower(text), '[0-9]+', '#', 'g')) IN (SELECT (document, line) FROM repeated))""")
def agg13_without_running_headers(t):
    return layout.without_running_lines(_banded_rows(t), "document", "page", HEIGHT).select("document", "page", "row", "text")
