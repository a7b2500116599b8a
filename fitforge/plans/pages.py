"""Registered queries on layout, and the same in DuckDB SQL.

Each part stands for a page and its line items for the spans on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitforge.operators import grids, pages
from fitforge.plans.postings import _pick, _picked
from fitforge.plans.queries import _query
from fitforge.plans.resumes import _KEYS_SQL, HEADS

WIDTH, HEIGHT = 600, 800
TEXTS = ["Led a team of twelve people over the years", "  2019 - 2021", "Berlin  ", " Built many things with care and wrote of it all", "x", "A line that is somewhat longer than others are", "   ", "May 2020", "Grew sales by a third in half of the time"]
_COLOURS = [0, 0xFFFFFF, 0x333333, 0xF5F5F0, 0xF0EF10]


def _first_lines(t) -> DataFrame:
    """Line items; of those with the same part, order and number the first in the table's files."""
    keys = ["l_partkey", "l_orderkey", "l_linenumber"]
    rest = F.struct("l_suppkey", "l_returnflag", "l_linestatus")
    return t("lineitem").groupBy(*keys).agg(F.min_by(rest, F.struct("_metadata.file_path", "_metadata.row_index")).alias("rest")).select(*keys, "rest.*")


def spans(t) -> DataFrame:
    p, o, s, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber")
    text, size = _pick(TEXTS, o + n), (F.lit(8.0) + n)
    right = (s + o) % 2 == 1
    x0 = F.when((p % 3 != 0) & right, F.when(p % 3 == 1, 330.0).otherwise(520.0)).otherwise(30.0 + (o % 4))
    x1 = F.least(x0 + F.length(text) * 5, F.when((p % 3 != 0) & ~right, F.lit(300.0)).otherwise(F.lit(590.0)))
    y0 = 20.0 + (o * 7 + n * 3) % 55 * 14
    return _first_lines(t).select(p.alias("page"), (o * 10 + n).alias("span"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + size * 1.15).alias("y1"), size.alias("size"),
                                  F.when(o % 13 == 0, 0).alias("alpha"), _pick(list(map(str, _COLOURS)), o).cast("int").alias("colour"), (F.col("l_returnflag") == "R").alias("bold"), (F.col("l_linestatus") == "O").alias("italic"))


_SPANS_SQL = rf"""
    raw AS (SELECT DISTINCT ON (l_partkey, l_orderkey, l_linenumber) l_partkey AS page, l_orderkey * 10 + l_linenumber AS span, {_picked(TEXTS, 'l_orderkey + l_linenumber')} AS text, l_orderkey AS o, l_linenumber AS n, (l_suppkey + l_orderkey) % 2 = 1 AS r, 8.0::DOUBLE + l_linenumber AS size FROM lineitem),
    sided AS (SELECT *, CASE WHEN page % 3 <> 0 AND r THEN CASE WHEN page % 3 = 1 THEN 330.0 ELSE 520.0 END ELSE 30.0 + o % 4 END::DOUBLE AS x0, 20.0::DOUBLE + (o * 7 + n * 3) % 55 * 14 AS y0 FROM raw),
    spans AS (SELECT *, least(x0 + length(text) * 5, CASE WHEN page % 3 <> 0 AND NOT r THEN 300.0 ELSE 590.0 END)::DOUBLE AS x1, y0 + size * 1.15 AS y1, {_COLOURS}[1 + o % 5] AS colour FROM sided)"""
_VISIBLE_SQL = f"""{_SPANS_SQL},
    visible AS (
        SELECT page, span, trim(text) AS text, x0 + (x1 - x0) * (length(text) - length(ltrim(text))) / length(text) AS x0, x1 - (x1 - x0) * (length(text) - length(rtrim(text))) / length(text) AS x1, y0, y1, size, colour
        FROM spans WHERE trim(text) <> '' AND o % 13 <> 0)"""


@_query(f"WITH {_VISIBLE_SQL} SELECT page, span, text, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM visible")
def lay3_visible_boxes(t):
    return pages.visible_boxes(spans(t)).select("page", "span", "text", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


def _rects(t) -> DataFrame:
    p = F.col("p_partkey")
    return t("part").select(p.alias("page"), F.lit(0.0).alias("x0"), (100.0 + p % 5 * 50).alias("y0"), (200.0 + p % 7 * 60).alias("x1"), (400.0 + p % 3 * 100).alias("y1"), ((p % 4) / 3.2).alias("brightest"))


_RECTS_SQL = "rects AS (SELECT p_partkey AS page, 0.0 AS x0, 100.0 + p_partkey % 5 * 50 AS y0, 200.0 + p_partkey % 7 * 60 AS x1, 400.0 + p_partkey % 3 * 100 AS y1, (p_partkey % 4) / 3.2 AS brightest FROM part)"


@_query(f"""
    WITH {_VISIBLE_SQL}, {_RECTS_SQL}
    SELECT page, span FROM visible v WHERE NOT ((colour >> 16) & 255 >= 240 AND (colour >> 8) & 255 >= 240 AND colour & 255 >= 240)
        OR EXISTS (SELECT 1 FROM rects r WHERE r.page = v.page AND brightest < 0.85 AND (v.x0 + v.x1) / 2 BETWEEN r.x0 AND r.x1 AND (v.y0 + v.y1) / 2 BETWEEN r.y0 AND r.y1)""")
def lay10_without_hidden(t):
    return pages.without_hidden(pages.visible_boxes(spans(t)), _rects(t)).select("page", "span")


@_query(f"""
    WITH {_VISIBLE_SQL}, {_RECTS_SQL},
    twice AS (SELECT page, 0 AS image, x0 + 0.2 AS x0, y0 + 0.3 AS y0, x1 + 0.1 AS x1, y1 - 0.2 AS y1 FROM rects UNION ALL SELECT page, 1, x0, y0, x1, y1 FROM rects),
    images AS (SELECT * FROM twice QUALIFY row_number() OVER (PARTITION BY page, round_even(x0, 0), round_even(y0, 0), round_even(x1, 0), round_even(y1, 0) ORDER BY image) = 1)
    SELECT i.page, round((i.x1 - i.x0) * (i.y1 - i.y0) / {WIDTH * HEIGHT}, 6) AS share, coalesce(sum(length(text)), 0)::BIGINT AS chars
    FROM images i LEFT JOIN visible v ON v.page = i.page AND (v.x0 + v.x1) / 2 BETWEEN i.x0 AND i.x1 AND (v.y0 + v.y1) / 2 BETWEEN i.y0 AND i.y1
    WHERE (i.x1 - i.x0) * (i.y1 - i.y0) / {WIDTH * HEIGHT} >= 0.25 GROUP BY i.page, i.image, i.x0, i.y0, i.x1, i.y1""")
def jn11_text_over_images(t):
    one = _rects(t)
    again = one.withColumns({"x0": F.col("x0") + 0.2, "y0": F.col("y0") + 0.3, "x1": F.col("x1") + 0.1, "y1": F.col("y1") - 0.2})
    images = again.withColumn("image", F.lit(0)).unionByName(one.withColumn("image", F.lit(1)))
    return pages.big_images(images, pages.visible_boxes(spans(t)), WIDTH, HEIGHT).select("page", F.round("share", 6).alias("share"), "chars")


_GUTTERS_SQL = f"""{_VISIBLE_SQL},
    body AS (SELECT * FROM visible WHERE y0 > {HEIGHT} * 0.12),
    sizes AS (SELECT page, count(*) AS n, sum(length(text)) AS total FROM body GROUP BY page HAVING count(*) >= 10),
    cover AS (SELECT page, x, count(*) AS c FROM (SELECT page, unnest(range(greatest(floor(x0)::BIGINT, 0), least(ceil(x1)::BIGINT, {WIDTH}) + 1)) AS x FROM body) GROUP BY ALL),
    blocked AS (SELECT page, x FROM cover JOIN sizes USING (page) WHERE c > greatest(1, floor(n * 0.03)) AND x BETWEEN 90 AND 510 UNION ALL SELECT page, unnest([89, 511]) FROM sizes),
    runs AS (SELECT page, x + 1 AS first, lead(x) OVER (PARTITION BY page ORDER BY x) - x - 1 AS len FROM blocked),
    widest AS (SELECT page, first + len / 2 AS gutter FROM runs WHERE len >= 8 QUALIFY row_number() OVER (PARTITION BY page ORDER BY len DESC, first) = 1),
    lefts AS (SELECT b.* FROM body b JOIN widest w ON b.page = w.page AND x1 <= gutter), rights AS (SELECT b.*, gutter FROM body b JOIN widest w ON b.page = w.page AND x0 >= gutter),
    sums AS (
        SELECT page, any_value(gutter) AS gutter, sum(length(text)) AS r, median(length(text)) AS usual,
               coalesce(sum(length(text)) FILTER (EXISTS (SELECT 1 FROM lefts l WHERE l.page = rights.page AND greatest(least(l.y1, rights.y1) - greatest(l.y0, rights.y0), 0) / least(l.y1 - l.y0, rights.y1 - rights.y0) >= 0.5)), 0) AS shared FROM rights GROUP BY page),
    gutters AS (
        SELECT page, gutter FROM sums JOIN (SELECT page, sum(length(text)) AS l FROM lefts GROUP BY page) USING (page) JOIN sizes USING (page)
        WHERE l >= 0.15 * total AND r >= 0.15 * total AND NOT (shared >= 0.4 * r AND usual < 25))"""


@_query(f"WITH {_GUTTERS_SQL} SELECT page, gutter FROM gutters")
def lay4_gutters(t):
    return pages.gutters(pages.visible_boxes(spans(t)), WIDTH, HEIGHT)


@_query(f"""
    WITH {_GUTTERS_SQL},
    tops AS (SELECT v.page, min(y0) FILTER (y0 > {HEIGHT} * 0.12 AND (x1 <= gutter OR x0 >= gutter)) AS top FROM visible v JOIN gutters g ON v.page = g.page GROUP BY v.page)
    SELECT v.page, span, CASE WHEN gutter IS NULL OR y1 <= coalesce(top, 0) THEN 0 WHEN x0 >= gutter THEN 2 ELSE 1 END AS region FROM visible v LEFT JOIN gutters g ON v.page = g.page LEFT JOIN tops ON tops.page = v.page""")
def lay5_regions(t):
    return pages.page_regions(pages.visible_boxes(spans(t)), WIDTH, HEIGHT).select("page", "span", "region")


@_query()
def win9_text_rows(t):
    return pages.page_rows(pages.visible_boxes(spans(t)), WIDTH, HEIGHT).select("page", "place", "region", "text", "size", "bold", "italic", "all_caps", "starts_bold")


def _resume_rows(t) -> DataFrame:
    p, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    place = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey"))
    text = F.when(o % 3 == 0, _pick(HEADS, o + p)).otherwise(_pick(TEXTS, o))
    rows = t("lineitem").select(p.alias("page"), place.alias("place"), text.alias("text"), F.when(o % 4 == 0, 12.0).otherwise(10.04 + n % 2 * 0.02).alias("size"), ((o + p) % 5 == 0).alias("bold"))
    letters = F.regexp_replace("text", r"[^\p{L}]", "")
    return rows.withColumn("all_caps", (F.length(letters) >= 2) & (letters == F.upper(letters)))


@_query(rf"""
    WITH lined AS (
        SELECT l_partkey AS page, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey)::INT AS place, CASE WHEN l_orderkey % 3 = 0 THEN {_picked(HEADS, 'l_orderkey + l_partkey')} ELSE {_picked(TEXTS, 'l_orderkey')} END AS text,
               CASE WHEN l_orderkey % 4 = 0 THEN 12.0 ELSE 10.0 + (l_linenumber % 2) * 0.1 END AS size1, CASE WHEN l_orderkey % 4 = 0 THEN 12 ELSE 10 END AS size, (l_orderkey + l_partkey) % 5 = 0 AS bold FROM lineitem),
    rows AS (SELECT *, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) >= 2 AND regexp_replace(text, '[^\p{{L}}]', '', 'g') = upper(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS caps FROM lined),
    bodies AS (SELECT page, size1 AS body FROM (SELECT page, size1, sum(length(text)) AS w, min(place) AS f FROM rows GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY page ORDER BY w DESC, f) = 1),
    heads AS (SELECT DISTINCT text, regexp_replace(regexp_replace(text, '^[^A-Za-z0-9_]+', ''), '[\s:|•–—.-]+$', '') AS b FROM rows),
    norms AS (SELECT text, regexp_matches(b, '^\S( \S){{3,}}$') AS spaced, lower(trim(regexp_replace(replace(replace(CASE WHEN regexp_matches(b, '^\S( \S){{3,}}$') THEN replace(b, ' ', '') ELSE b END, '&', ' and '), '/', ' '), '\s+', ' ', 'g'))) AS norm FROM heads),
    keyed AS (SELECT text, arg_min(key, rank) AS key FROM norms JOIN (VALUES {_KEYS_SQL}) AS k(rank, key, word) ON CASE WHEN spaced THEN contains(norm, replace(word, ' ', '')) ELSE regexp_matches(norm, '\b' || word || '\b') END GROUP BY text),
    marked AS (
        SELECT r.*, body, len(regexp_extract_all(norm, '\S+')) BETWEEN 1 AND 6 AND NOT regexp_matches(r.text, '\d') AND length(r.text) <= 50 AND NOT regexp_matches(r.text, ':\s*\S') AND trim(r.text, ' :|') <> '' AND NOT regexp_matches(rtrim(r.text, ' :|'), '[.,;]$')
               AND (bold OR caps OR CASE WHEN size = 12 THEN 12 ELSE size1 END >= body + 1) AS can, key FROM rows r JOIN bodies USING (page) JOIN norms USING (text) LEFT JOIN keyed USING (text)),
    styles AS (SELECT page, size AS s, bold AS b, caps AS c FROM (SELECT page, size, bold, caps, count(*) AS n, min(place) AS f FROM marked WHERE can AND key IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, f) = 1),
    kept AS (SELECT m.*, s, s IS NOT NULL AND size = s AND bold = b AND caps = c AS same, CASE WHEN can AND key IS NOT NULL AND ((size = s AND bold = b AND caps = c) OR caps) THEN key END AS k FROM marked m LEFT JOIN styles USING (page)),
    others AS (SELECT *, coalesce(k, CASE WHEN can AND ((same AND place > min(CASE WHEN k IS NOT NULL THEN place END) OVER (PARTITION BY page)) OR (s IS NULL AND caps AND size >= body + 2)) THEN 'other' END) AS final FROM kept)
    SELECT page, place, text, final AS key, coalesce(last_value(final IGNORE NULLS) OVER (PARTITION BY page ORDER BY place ROWS UNBOUNDED PRECEDING), 'header') AS section FROM others""")
def lay6_headed_rows(t):
    return pages.headed_rows(_resume_rows(t), "page", "place").select("page", "place", "text", "key", "section")


_CELL_WIDTH, _CELL_HEIGHT, _LEFT, _TOP = 50, 20, 100, 200


def _lines(t) -> DataFrame:
    """Ruling lines of each part's page: a grid of up to five rows and four columns, its lines a little apart and in two pieces; one in seven lacks its left side."""
    p = F.col("p_partkey")
    rows, columns = p % 6, p % 5
    across = F.transform(F.sequence(F.lit(0), rows), lambda i: F.struct((_LEFT + p * 0.0).alias("x0"), (_TOP + i * _CELL_HEIGHT + p % 3 * 0.5).alias("y0"), (_LEFT + columns * _CELL_WIDTH + p * 0.0).alias("x1"), (_TOP + i * _CELL_HEIGHT + p * 0.0).alias("y1")))
    half = rows * _CELL_HEIGHT / 2
    down = F.flatten(F.transform(F.sequence(F.lit(0), columns), lambda i: F.transform(F.array(F.lit(0.0), half), lambda a: F.struct((_LEFT + i * _CELL_WIDTH + p * 0.0).alias("x0"), (_TOP + a + p * 0.0).alias("y0"), (_LEFT + i * _CELL_WIDTH + p * 0.0).alias("x1"), (_TOP + a + half - F.when(a == 0, 1.5).otherwise(0.0)).alias("y1")))))
    kept = F.filter(F.concat(across, down), lambda x: ~((p % 7 == 0) & (x["x0"] == _LEFT) & (x["x1"] == _LEFT)))
    return t("part").select(p.alias("page"), F.inline(kept))


def _cell_spans(t) -> DataFrame:
    """One text a line item of the part, in the middle of a place of the grid or beside it."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    x, y = _LEFT + (o % 5 + 0.5) * _CELL_WIDTH, _TOP + (n % 6 + 0.5) * _CELL_HEIGHT
    return t("lineitem").select(F.col("l_partkey").alias("page"), (x - 5).alias("x0"), (y - 5).alias("y0"), (x + 5).alias("x1"), (y + 5).alias("y1"), _pick(TEXTS, o).alias("text"))


@_query(f"""
    WITH sized AS (SELECT p_partkey AS page, p_partkey % 6 AS r, p_partkey % 5 - (p_partkey % 7 = 0)::INT AS c, (p_partkey % 7 = 0)::INT AS skip FROM part),
    texts AS (SELECT l_partkey AS page, l_orderkey % 5 AS x, l_linenumber % 6 AS y, length({_picked(TEXTS, 'l_orderkey')}) AS n FROM lineitem),
    filled AS (SELECT page, r, c, x, y, sum(n) AS n FROM sized JOIN texts USING (page) WHERE x >= skip AND x < c + skip AND y < r GROUP BY ALL HAVING sum(n) > 0)
    SELECT page, 0 AS nth, r::INT AS n_rows, c::INT AS n_columns, (r * c)::INT AS n_cells, count(*)::INT AS n_filled, sum(n)::BIGINT AS chars FROM filled WHERE r >= 2 AND c >= 2 GROUP BY page, r, c HAVING count(*) >= 4""")
def lay8_tables(t):
    return grids.tables(_lines(t), _cell_spans(t))
