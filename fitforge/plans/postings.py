"""Registered queries on postings: text, sections, requirements, levels, years; and the same in DuckDB SQL.

Each order stands for a posting: its key picks the words of a title and the lines of a
text, so that the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitforge.functions import postings as rules
from fitforge.operators import scoring
from fitforge.plans.queries import _query, spread

# What the keys pick from.
BEFORE = ["", "Senior", "Junior", "Lead", "Staff", "Associate", "Principal", "Sr.", "New Grad", "Entry-Level", "Intermediate", "Head of", "Vice President,", "Co-op", "Mid-level", "Apprentice", "early career", "SENIOR", "Technical Fellow,", "Trainee"]
ROLES = ["Software Engineer", "Product Manager", "Engineering Manager", "Solutions Architect", "Data Architect", "Nurse", "Sales Manager", "Associate Director", "Account Manager, Lead", "Security Architect Manager", "Recruiter", "Customer Success Manager"]
BEHIND = ["", "I", "II", "III", "IV", "V", "Intern", "(Mid Level)", "I/II", "V-Team", "of Staff Relations"]
LINES = [
    "Requirements:", "## What you'll do", "**Nice to have**", "ABOUT US", "Benefits & Perks", "Why join", "Experience with Python", "Your Background", "Day-to-day", "Job description for this opening and many others here:", "Preferred Qualifications", "About you", "About the role", "about Outreach",
    "- 3+ years of experience with Python", "• Two (2) years working in a lab", "* 5 to 7 yrs of professional experience", "o Own the roadmap with the team", "-no blank behind this one", "– Write tests for all of it", "- Short one", "▪ Ten plus years in industry, 12 or more years in business",
    "We build tools. They help people! Do you like that? Yes indeed it is so.", "The base salary for this role is high.", "We are an equal opportunity employer.", "#LI-remote", "In this role, you can expect to", "You might also enjoy", "", "  ", "Founded 20 years ago, we have 3 years of growth.", "Senior people welcome",
    "This one long line says that a person who works here for two years of hands-on engineering will meet a great many others, and that all of them wish to learn. It goes on for so long that it must be cut in pieces. Every piece counts. So it goes.",
    "Over the last 5 years we grew", "You bring 1.5 years exp in sales", "40 years experience is too much", "at least 4 years of building and shipping software", "Pay range: 5 years vesting", "Medical, dental and 401(k) match", "Your role", "Skills and experience", "> Quoted line of three", "Extra credit: Go", "zero years experience needed", "privacy policy applies",
]
PICKS = [(1, 0), (3, 5), (7, 11), (5, 2), (11, 17), (13, 3), (17, 8), (2, 21), (19, 30), (23, 14)]


def _pick(values: list[str], place: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(place, F.lit(len(values))).cast("int"))


def postings(orders: DataFrame) -> DataFrame:
    """o_orderkey, title and text of the postings that orders stand for."""
    k = F.col("o_orderkey")
    title = F.trim(F.concat_ws(" ", _pick(BEFORE, k), _pick(ROLES, F.floor(k / 7)), _pick(BEHIND, F.floor(k / 3))))
    return spread(orders.select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", "o_custkey", title.alias("title"), F.concat_ws("\n", *(_pick(LINES, k * a + F.floor(k / len(LINES)) + b) for a, b in PICKS)).alias("text"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _picked(values: list[str], place: str) -> str:
    return f"{_list(values)}[1 + ({place}) % {len(values)}]"


TITLES_SQL = f"""
    titles AS (SELECT o_orderkey, o_custkey, trim({_picked(BEFORE, 'o_orderkey')} || ' ' || {_picked(ROLES, 'o_orderkey // 7')} || ' ' || {_picked(BEHIND, 'o_orderkey // 3')}) AS title FROM orders)"""
POSTINGS_SQL = f"""
    chosen AS (SELECT o_orderkey AS o, {_list(LINES)} AS lines FROM orders),
    texts AS (SELECT o, concat_ws(chr(10), {', '.join(f"lines[1 + (o * {a} + o // {len(LINES)} + {b}) % {len(LINES)}]" for a, b in PICKS)}) AS text FROM chosen)"""
_SQL_BULLET = r"'^(?:[•●▪◦‣∙·■□►▸➢➤❖✓✔⁃\p{Co}]|[-–—*>] |o \p{Lu})'"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_PHRASES_SQL = ", ".join(f"({i}, '{key}', {_quoted(p)}, {len(p.split())})" for i, key in enumerate(rules.HEADINGS) for p in rules.HEADINGS[key])
LINES_SQL = rf"""{POSTINGS_SQL},
    phrases(place, key, phrase, width) AS (VALUES {_PHRASES_SQL}),
    split AS (SELECT o, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM texts),
    bare AS (SELECT *, trim(line, ' ') AS b, regexp_matches(trim(line, ' '), {_SQL_BULLET}) AS bullet,
             lower(trim(regexp_replace(replace(regexp_replace(trim(line, ' '), '^[#*_\s]+|[#*_\s:]+$', '', 'g'), '&', ' and '), '\s+', ' ', 'g'))) AS norm FROM split),
    known AS (SELECT DISTINCT b, norm, bullet, len(regexp_extract_all(norm, '\S+')) AS n FROM bare),
    headed AS (
        SELECT b, arg_min(key, place) AS heading FROM known JOIN phrases ON regexp_matches(norm, '\b' || phrase || '\b')
        WHERE b <> '' AND NOT bullet AND length(b) <= 80 AND n BETWEEN 1 AND 8 AND NOT norm LIKE '%.'
              AND (b LIKE '%:' OR b LIKE '#%' OR b LIKE '**%' OR (b = upper(b) AND b <> lower(b) AND n <= 6) OR width >= n / 2)
        GROUP BY b),
    marked AS (
        SELECT bare.*, heading, len(regexp_extract_all(b, '\S+')) AS words,
               CASE WHEN regexp_matches(b, {_quoted(rules.BOILERPLATE['benefits'])}, 'i') THEN 'benefits' WHEN regexp_matches(b, {_quoted(rules.BOILERPLATE['about'])}, 'i') THEN 'about' END AS boiler
        FROM bare LEFT JOIN headed USING (b)),
    led AS (
        SELECT *, coalesce(words BETWEEN 1 AND 10 AND NOT regexp_matches(b, '[.!?]$') AND NOT bullet AND boiler IS NULL AND next.bullet AND next.boiler IS NULL, false) AS leads
        FROM (SELECT *, lead(CASE WHEN b <> '' THEN {{'bullet': bullet, 'boiler': boiler}} END IGNORE NULLS) OVER (PARTITION BY o ORDER BY i) AS next FROM marked))"""
SECTIONS_SQL = rf"""{LINES_SQL},
    fold AS (
        SELECT o, 0::BIGINT AS i, 0 AS n, 'intro' AS key, true AS unheaded, 'intro' AS resume, NULL::VARCHAR AS heading, NULL::VARCHAR AS body FROM texts
        UNION ALL
        SELECT o, i, n + (opens OR head IS NOT NULL)::INT, CASE WHEN opens THEN boiler ELSE coalesce(head, key) END, CASE WHEN opens THEN true WHEN head IS NOT NULL THEN false ELSE unheaded END,
               CASE WHEN opens THEN key ELSE resume END, CASE WHEN NOT opens AND head IS NOT NULL THEN trim(rtrim(b, ':'), '#* ') END, CASE WHEN opens OR head IS NULL THEN line END
        FROM (
            SELECT f.o, led.i, f.n, f.key, f.unheaded, f.resume, led.line, led.b, led.boiler,
                   led.heading IS NULL AND f.key NOT IN ('about', 'benefits') AND led.boiler IS NOT NULL AS opens,
                   CASE WHEN led.heading IS NULL AND f.unheaded AND f.key IN ('about', 'benefits') AND leads THEN f.resume ELSE led.heading END AS head
            FROM fold f JOIN led ON led.o = f.o AND led.i = f.i + 1)),
    numbered AS (SELECT o, n, any_value(key) AS key, max(heading) AS heading, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i), ''), '^\s+|\s+$', '', 'g') AS text FROM fold GROUP BY o, n),
    sections AS (SELECT o, n, key, heading, text FROM numbered WHERE text <> '' OR heading IS NOT NULL)"""


def _found(t) -> DataFrame:
    return postings(t("orders")).select("o_orderkey", rules.sections(F.col("text")).alias("sections"))


@_query(f"WITH {LINES_SQL} SELECT o AS o_orderkey, i, heading, boiler, bullet, leads FROM led")
def txt3_heading_lines(t):
    lines = postings(t("orders")).select("o_orderkey", F.split("text", "\n").alias("lines"))
    each = lines.select("o_orderkey", "lines", F.posexplode("lines").alias("p", "line"))
    line, behind = F.col("line"), F.get(F.filter(F.slice("lines", F.col("p") + 2, F.size("lines")), lambda x: F.trim(x) != ""), F.lit(0))
    return each.select(
        "o_orderkey",
        (F.col("p") + 1).cast("long").alias("i"),
        rules.heading_key(line).alias("heading"),
        rules.boilerplate_key(line).alias("boiler"),
        rules.has_bullet(rules.stripped(line)).alias("bullet"),
        rules.is_lead_in(line, rules.stripped(behind)).alias("leads"),
    )


@_query(f"WITH RECURSIVE {SECTIONS_SQL} SELECT o AS o_orderkey, row_number() OVER (PARTITION BY o ORDER BY n) - 1 AS place, key, heading, text FROM sections")
def txt5_sections(t):
    # whole structs come out of the generator: fields taken from them later would be taken by further folds below it
    placed = F.transform("sections", lambda s, i: F.struct(i.cast("long").alias("place"), s["key"].alias("key"), s["heading"].alias("heading"), s["text"].alias("text")))
    return _found(t).select("o_orderkey", F.inline(placed))


@_query(rf"""
    WITH RECURSIVE {SECTIONS_SQL},
    first AS (SELECT o, arg_min(key, n) AS key, arg_min(text, n) AS text FROM sections GROUP BY o),
    line AS (SELECT o, key, trim(regexp_extract(text, '^\s*([^\n]+)', 1)) AS line FROM first)
    SELECT o AS o_orderkey, CASE WHEN key = 'intro' AND len(regexp_extract_all(line, '\S+')) <= 10 AND NOT regexp_matches(line, '[.!?:]$') THEN nullif(line, '') END AS title
    FROM texts LEFT JOIN line USING (o)""")
def txt6_inferred_titles(t):
    return _found(t).select("o_orderkey", rules.inferred_title(F.col("sections")).alias("title"))


_UNITS_SQL = rf"""
    pieces AS (SELECT o, n, key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM sections),
    cut AS (SELECT *, regexp_matches(trim(line), {_SQL_BULLET}) AS bullet, trim(CASE WHEN regexp_matches(trim(line), {_SQL_BULLET}) THEN substr(trim(line), 2) ELSE line END) AS x FROM pieces),
    sentences AS (SELECT *, string_split(regexp_replace(x, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts, len(regexp_extract_all(x, '\S+')) AS words FROM cut),
    -- 0: units of sections with requirements; 1: lines with bullets; 2: all sentences
    units AS (
        SELECT o, 0 AS way, key, n, i, unnest(CASE WHEN words > 40 THEN parts ELSE [x] END) AS unit, generate_subscripts(CASE WHEN words > 40 THEN parts ELSE [x] END, 1) AS j
        FROM sentences WHERE key IN ('required', 'responsibilities', 'nice') AND x <> '' AND NOT x LIKE '%:'
        UNION ALL SELECT o, 1, 'required', n, i, x, 1 FROM sentences WHERE bullet AND key NOT IN ('about', 'benefits')
        UNION ALL SELECT o, 2, 'required', n, i, unnest(parts), generate_subscripts(parts, 1) FROM sentences WHERE key NOT IN ('about', 'benefits') AND x <> '' AND NOT x LIKE '%:'),
    whole AS (SELECT *, min(way) OVER (PARTITION BY o) AS best FROM units WHERE len(regexp_extract_all(unit, '\S+')) >= 3),
    requirements AS (
        SELECT o, key AS section, unit AS text, row_number() OVER (PARTITION BY o ORDER BY CASE key WHEN 'required' THEN 0 WHEN 'responsibilities' THEN 1 ELSE 2 END, n, i, j) - 1 AS place
        FROM whole WHERE way = best QUALIFY place < {rules.MOST_REQUIREMENTS})"""


@_query(f"WITH RECURSIVE {SECTIONS_SQL}, {_UNITS_SQL} SELECT o AS o_orderkey, place, section, text FROM requirements")
def txt8_requirements(t):
    placed = F.transform(rules.requirements(F.col("sections")), lambda r, i: F.struct(i.cast("long").alias("place"), r["section"].alias("section"), r["text"].alias("text")))
    return _found(t).select("o_orderkey", F.inline(placed))


_LEVEL_SQL = r"""
    CASE WHEN regexp_matches(title, '\b(intern|internship|co-?op|apprentice|apprenticeship)\b', 'i') THEN 'intern'
         WHEN regexp_matches(title, '\b(principal|staff|director|vp|svp|evp|vice president|head of|chief|distinguished|technical fellow)\b', 'i') THEN 'staff'
         WHEN regexp_matches(title, '\b(junior|jr|new grad|new graduate|graduate|entry.level|early.career|associate|trainee)\b', 'i') AND NOT regexp_matches(title, '\b(senior|sr)\b', 'i') THEN 'entry'
         WHEN regexp_matches(regexp_replace(title, '\b(product|account|customer success|success|solutions|data|security|relations)\s+(manager|architect)\b', ' ', 'gi'), '\b(lead|manager|architect)\b', 'i') THEN 'staff'
         WHEN regexp_matches(title, '\b(senior|sr)\b', 'i') THEN 'senior'
         WHEN numeral = 'I' THEN 'entry' WHEN numeral = 'II' THEN 'mid' WHEN numeral IN ('III', 'IV') THEN 'senior' WHEN numeral = 'V' THEN 'staff'
         WHEN regexp_matches(title, '\b(mid[- ]?level|intermediate)\b', 'i') THEN 'mid' END"""
LEVELS_SQL = rf"""{TITLES_SQL},
    numerals AS (SELECT *, regexp_extract_all(regexp_replace(title, '[\w]+-[\w-]*', ' ', 'g'), '\b(III|II|IV|I|V)\b')[-1] AS numeral FROM titles),
    levels AS (SELECT o_orderkey, o_custkey, title, {_LEVEL_SQL} AS level FROM numerals)"""


@_query(f"""
    WITH {LEVELS_SQL}
    SELECT o_orderkey, title, level, list_position(['intern', 'entry', 'mid', 'senior', 'staff'], level) - 1 AS place,
           CASE level WHEN 'intern' THEN 0 WHEN 'entry' THEN 2 WHEN 'mid' THEN 5 WHEN 'senior' THEN 9 END AS most_years FROM levels""")
def txt9_levels_of_titles(t):
    level = rules.level_from_title(F.col("title"))
    return postings(t("orders")).select("o_orderkey", "title", level.alias("level"), rules.level_place(level).alias("place"), rules.level_most_years(level).alias("most_years"))


# The same rule in another way: the text is cut at the mentions, and what stands before and behind each is looked at.
_WORDS_SQL = "|".join(rules.NUMBER_WORDS)
_MENTION_SQL = rf"(?i)(?:\d{{1,2}}(?:\.\d)?|{_WORDS_SQL})\s*(?:\(\s*\d{{1,2}}\s*\+?\s*\))?\s*(?:\+|plus|or more|or greater)?\s*(?:(?:-|–|—|to)\s*(?:\d{{1,2}}(?:\.\d)?|{_WORDS_SQL})\s*\+?\s*)?(?:years?|yrs?)\b"
_YEARS_SQL = rf"""
    cuts AS (SELECT *, string_split_regex(text, '{_MENTION_SQL}') AS between, regexp_extract_all(text, '{_MENTION_SQL}') AS mentions FROM source),
    mention AS (SELECT id, key, unnest(mentions) AS m, generate_subscripts(mentions, 1) AS j, between, mentions, text FROM cuts),
    placed AS (SELECT id, key, j, m, text, list_sum([length(x) for x in between[1:j]]) + coalesce(list_sum([length(x) for x in mentions[1:j-1]]), 0) AS start FROM mention),
    around AS (SELECT id, key, j, m, substr(text, start::BIGINT + length(m) + 1, 80) AS after, substr(text, greatest(start::BIGINT - 24, 1), least(start::BIGINT, 25)) AS before FROM placed),
    valued AS (
        SELECT id, key, j, after, coalesce(try_cast(regexp_extract(m, '^[\d.]+') AS DOUBLE), list_position({_list(rules.NUMBER_WORDS)}, lower(regexp_extract(m, '^[A-Za-z]+'))) - 1) AS years
        FROM around WHERE NOT regexp_matches(after, '^[\s''’]*(?:old|ago|of\s+(?:history|growth|service|operation|excellence)|in\s+business|vesting|vest|warranty|anniversary|running|straight|in\s+a\s+row)', 'i')
             AND NOT regexp_matches(before, '(founded|established|since|after|every|in\s+business|been\s+around|serving|operating|history\s+of|for\s+over|over\s+the\s+(?:last|past))\s*$', 'i')),
    years AS (
        SELECT id, key, j, floor(years)::INT AS years, regexp_matches(after, '^[\s''’]*(?:of\s+)?(?:\w+[\s,/-]+){{0,6}}?(?:experience|exp\b|professional|industry|working|hands-on|developing|building|programming|engineering|in\s+(?:a|an)\s)', 'i') AS in_context
        FROM valued WHERE years BETWEEN 0 AND 30)"""


@_query(f"""
    WITH {POSTINGS_SQL}, source AS (SELECT o AS id, '' AS key, text FROM texts), {_YEARS_SQL}
    SELECT o AS o_orderkey, coalesce((SELECT string_agg(years, ',' ORDER BY j) FROM years WHERE id = o), '') AS years,
           coalesce((SELECT string_agg(years, ',' ORDER BY j) FROM years WHERE id = o AND in_context), '') AS in_context FROM texts""")
def txt10_years_mentions(t):
    def listed(with_context: bool) -> Column:
        return F.array_join(F.transform(rules.years_mentions(F.col("text"), with_context), lambda n: n.cast("string")), ",")

    return postings(t("orders")).select("o_orderkey", listed(False).alias("years"), listed(True).alias("in_context"))


_LEAST_SQL = f"""
    source AS (SELECT o AS id, key, text FROM sections), {_YEARS_SQL},
    least AS (SELECT id, coalesce(min(years) FILTER (key = 'required'), min(years) FILTER (key <> 'nice' AND in_context)) AS min_years FROM years GROUP BY id)"""


@_query(f"WITH RECURSIVE {SECTIONS_SQL}, {_LEAST_SQL} SELECT o AS o_orderkey, min_years FROM texts LEFT JOIN least ON id = o")
def agg18_least_years(t):
    return _found(t).select("o_orderkey", rules.least_years(F.col("sections")).alias("min_years"))


@_query(f"""
    WITH RECURSIVE {SECTIONS_SQL}, {_LEAST_SQL}, {LEVELS_SQL},
    users AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'intern' WHEN 'MACHINERY' THEN 'entry' WHEN 'FURNITURE' THEN 'mid' WHEN 'AUTOMOBILE' THEN 'staff' END AS own FROM customer),
    compared AS (
        SELECT o_orderkey, min_years, list_position(['intern', 'entry', 'mid', 'senior', 'staff'], level) - list_position(['intern', 'entry', 'mid', 'senior', 'staff'], own) AS above,
               CASE own WHEN 'intern' THEN 0 WHEN 'entry' THEN 2 WHEN 'mid' THEN 5 WHEN 'senior' THEN 9 END AS most
        FROM levels JOIN users ON o_custkey = c_custkey LEFT JOIN least ON id = o_orderkey),
    judged AS (SELECT *, coalesce(above >= 2, false) OR coalesce(min_years >= most + 3, false) AS hidden FROM compared)
    SELECT o_orderkey, above AS levels_above, hidden OR coalesce(above, 0) > 0 AS stretch, hidden, round(pow(0.85, greatest(coalesce(above, 0), 0)), 6) AS multiplier FROM judged""")
def scr4_eligibility_of_postings(t):
    jobs = postings(t("orders")).select("o_orderkey", "o_custkey", rules.level_from_title(F.col("title")).alias("level"), rules.least_years(rules.sections(F.col("text"))).alias("min_years"))
    segment, own = F.col("c_mktsegment"), F.lit(None).cast("string")
    for name, level in (("BUILDING", "intern"), ("MACHINERY", "entry"), ("FURNITURE", "mid"), ("AUTOMOBILE", "staff")):
        own = F.when(segment == name, level).otherwise(own)
    rows = jobs.join(t("customer").select("c_custkey", own.alias("own")), F.col("o_custkey") == F.col("c_custkey"))
    e = scoring.eligibility(rules.level_place(F.col("level")), rules.level_place(F.col("own")), F.col("min_years"), rules.level_most_years(F.col("own")))
    return rows.select("o_orderkey", *(e[c].alias(c) for c in ("levels_above", "stretch", "hidden")), F.round(e["multiplier"], 6).alias("multiplier"))
