"""Registered queries on the text of résumés, and the same in DuckDB SQL.

Each line item stands for a bullet and each order for a résumé: keys pick their words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitforge.functions import resumes as rules
from fitforge.functions.postings import words_in
from fitforge.plans.postings import _list, _pick, _picked, _quoted
from fitforge.plans.queries import _query, spread

OPENINGS = [
    "Built", "Responsible for", "Helped", "Successfully led", "Quickly and", "JobFit: designed", "Planned", "Worked on", "Co-developed", "Team lead", "Reports", "Carried", "Capstone project — wrote", "Managed", "In charge of", "Mostly fairly led", "• Running", "2019 built", "Assist with", "Help", "Manager of", "Hosted", "Copied",
]
OBJECTS = [
    "a service with Python 3", "12 people", "costs by 30%", "a 3x faster build", "in 2019", "over 10,000 users", "5k requests", "on EC2 and S3", "HTML5 pages", "release v2.1", "a budget of $5,000", "many things", "with Windows 10 and Excel", "2 teams in 2020", "COVID-19 research", "4.5 stars", "for 1999 to 2001", "nothing", "5 kB files", "100+ tickets",
]
VERBS = ["build", "built", "lead", "led", "plan", "design", "develop", "write", "wrote", "manage", "run", "report", "carry", "host", "copy", "# no verb", " organize "]
CONTACTS = [
    "jane@mail.example.com +1 (555) 123-4567", "jane@mail.example.com", "call (030) 1234 5678 90", "Jan 2019 - Mar 2020", "2019-2020 1234567890", "05/2019 to present", "555-1234", "jane@mail", "+49 151 1234 5678, a.b+c@x-y.de", "Summer 2018 – current", "no contact", "1234 5678 9012 3456 78", "'19 until now", "March 2020",
]
HEADS = ["EXPERIENCE", "Work & Research", "E D U C A T I O N", "Academic Projects", "LEADERSHIP EXPERIENCE:", "★ Skills |", "Tech Stack", "About me", "S K I L L S", "Hobbies", "Nothing here", "Honors/Awards", "Programming Languages", "Paper planes", "W O R K", "References —", "• Toolkit", "Coursework."]


def bullets(t) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    keys = spread(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")
    return keys.select("l_orderkey", "l_linenumber", F.concat_ws(" ", _pick(OPENINGS, p + s), _pick(OBJECTS, p * 3 + F.col("l_linenumber"))).alias("bullet"))


BULLETS_SQL = f"bullets AS (SELECT l_orderkey, l_linenumber, {_picked(OPENINGS, 'l_partkey + l_suppkey')} || ' ' || {_picked(OBJECTS, 'l_partkey * 3 + l_linenumber')} AS bullet FROM lineitem)"
_FORMS_SQL = rf"""
    verbs AS (SELECT lower(trim(unnest({_list(VERBS)}))) AS v),
    forms AS (
        SELECT DISTINCT form FROM (
            SELECT unnest([v, v || 's', v || 'es', v || 'ed', v || 'd', v || 'ing'] || CASE WHEN v LIKE '%e' THEN [v[:-2] || 'ing'] ELSE [] END
                || CASE WHEN regexp_matches(v, '..[^aeiou]y$|^.[^aeiou]y$') THEN [v[:-2] || 'ied', v[:-2] || 'ies'] ELSE [] END
                || CASE WHEN regexp_matches(v, '[^aeiou][aeiou][^aeiouwxy]$') THEN [v || v[-1] || 'ed', v || v[-1] || 'ing'] ELSE [] END) AS form
            FROM verbs WHERE NOT v LIKE '#%'))"""


def verb_forms(t) -> list[str]:
    spark = t("region").sparkSession
    return [r["form"] for r in rules.verb_forms(spark.createDataFrame([(v,) for v in VERBS], "verb string")).collect()]


# over a table bullets (l_orderkey, l_linenumber, bullet)
RULES_SQL = rf"""{_FORMS_SQL},
    openers AS (SELECT unnest({_list(rules.WEAK_OPENERS)}) AS opener, generate_subscripts({_list(rules.WEAK_OPENERS)}, 1) AS place),
    weak AS (SELECT bullet, arg_min(opener, place) AS opener FROM (SELECT DISTINCT bullet FROM bullets) JOIN openers ON starts_with(lower(bullet), opener) GROUP BY bullet),
    bare AS (SELECT DISTINCT bullet, regexp_replace(bullet, '^[^A-Za-z]+', '') AS b FROM bullets),
    words AS (SELECT bullet, regexp_extract_all(lower(b), '[a-z][a-z''-]*') AS w, lower(regexp_extract(b, '^(?:\S+\s+){{0,4}}?\S*?\s*[:—–]\s+([A-Za-z][\w''-]*)', 1)) AS titled FROM bare),
    firsts AS (SELECT bullet, titled, w[1 + CASE WHEN len(w) > 2 AND w[1] LIKE '%ly' AND w[2] LIKE '%ly' THEN 2 WHEN len(w) > 1 AND w[1] LIKE '%ly' THEN 1 ELSE 0 END] AS f FROM words),
    tokens AS (SELECT bullet, unnest(string_split(bullet, ' ')) AS x, unnest(list_prepend('', string_split(bullet, ' '))[1:len(string_split(bullet, ' '))]) AS before, generate_subscripts(string_split(bullet, ' '), 1) AS i FROM bare),
    numbered AS (SELECT DISTINCT bullet FROM tokens WHERE regexp_matches(x, '^\d+(\.\d+)?\+?$') AND NOT regexp_matches(x, '^(19|20)\d\d$') AND NOT (i > 2 AND regexp_matches(before, '^[A-Z]'))),
    ruled AS (
        SELECT l_orderkey, l_linenumber, bullet, opener,
               opener IS NULL AND (f IN (FROM forms) OR regexp_extract(f, '[^-]*$') IN (FROM forms) OR titled IN (FROM forms) OR regexp_extract(titled, '[^-]*$') IN (FROM forms)) AS verb,
               bullet IN (FROM numbered) OR regexp_matches(bullet, '\d%|\$\d|\b\d+x\b|\d,\d\d\d\b|\b\d+k\b') AS measured
        FROM (SELECT l_orderkey, l_linenumber, bullet, left(bullet, length(rtrim(opener))) AS opener FROM bullets LEFT JOIN weak USING (bullet)) JOIN firsts USING (bullet))"""


_RULES_SQL = f"{BULLETS_SQL}, {RULES_SQL}"


@_query(f"WITH {_RULES_SQL} SELECT l_orderkey, l_linenumber, opener, verb, measured FROM ruled")
def txt14_bullet_rules(t):
    b = F.col("bullet")
    return bullets(t).select("l_orderkey", "l_linenumber", rules.weak_opener(b).alias("opener"), rules.opens_with_verb(b, verb_forms(t)).alias("verb"), rules.is_measured(b).alias("measured"))


@_query(f"WITH {_FORMS_SQL} SELECT p_partkey, p_size, form FROM part JOIN (SELECT form, row_number() OVER (ORDER BY form) - 1 AS i FROM forms) f ON p_partkey % (SELECT count(*) FROM forms) = i")
def txt13_verb_forms(t):
    forms = sorted(verb_forms(t))
    return t("part").select("p_partkey", "p_size", _pick(forms, F.col("p_partkey")).alias("form"))


_CONTACT_SQL = rf"""
    contacts AS (SELECT o_orderkey, {_picked(CONTACTS, 'o_orderkey')} AS contact FROM orders),
    once AS (SELECT DISTINCT contact FROM contacts),
    ranges AS (SELECT contact, regexp_matches(contact, '(?i)((jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*|summer\s+)?((19|20)\d\d|''\d\d|\d\d?/\d\d\d\d)\s*(-|–|—|to|until)\s*(((jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* )?(19|20)\d\d|present|current|now)') AS has_range FROM once),
    found AS (SELECT contact, unnest(regexp_extract_all(contact, '\+?\(?\d[\d\s().-]{{8,20}}\d')) AS x FROM once),
    phones AS (SELECT DISTINCT contact FROM found WHERE length(regexp_replace(x, '\D', '', 'g')) BETWEEN 10 AND 15 AND NOT regexp_matches(x, '(19|20)\d\d\s*-\s*(19|20)\d\d'))"""


@_query(f"""
    WITH {_CONTACT_SQL}
    SELECT o_orderkey, regexp_matches(contact, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+') AS has_email, contact IN (FROM phones) AS has_phone, has_range FROM contacts JOIN ranges USING (contact)""")
def txt17_contacts_and_dates(t):
    c = _pick(CONTACTS, F.col("o_orderkey"))
    return t("orders").select("o_orderkey", rules.has_email(c).alias("has_email"), rules.has_phone(c).alias("has_phone"), rules.has_date_range(c).alias("has_range"))


_KEYS_SQL = ", ".join(f"({i}, '{k}', {_quoted(w)})" for i, k in enumerate(rules.HEADINGS) for w in rules.HEADINGS[k])
_HEADS_SQL = rf"""
    heads AS (SELECT DISTINCT h, regexp_replace(regexp_replace(h, '^[^A-Za-z0-9_]+', ''), '[\s:|•–—.-]+$', '') AS b FROM (SELECT unnest({_list(HEADS)}) AS h)),
    norms AS (SELECT h, regexp_matches(b, '^\S( \S){{3,}}$') AS spaced, lower(trim(regexp_replace(replace(replace(CASE WHEN regexp_matches(b, '^\S( \S){{3,}}$') THEN replace(b, ' ', '') ELSE b END, '&', ' and '), '/', ' '), '\s+', ' ', 'g'))) AS norm FROM heads),
    keyed AS (SELECT h, arg_min(key, place) AS key FROM norms JOIN (VALUES {_KEYS_SQL}) AS k(place, key, word) ON CASE WHEN spaced THEN contains(norm, replace(word, ' ', '')) ELSE regexp_matches(norm, '\b' || word || '\b') END GROUP BY h)"""


@_query(f"WITH {_HEADS_SQL} SELECT l_orderkey, l_linenumber, norm, key FROM (SELECT l_orderkey, l_linenumber, {_picked(HEADS, 'l_partkey + l_linenumber')} AS h FROM lineitem) JOIN norms USING (h) LEFT JOIN keyed USING (h)")
def txt12_resume_headings(t):
    h = _pick(HEADS, F.col("l_partkey") + F.col("l_linenumber"))
    return t("lineitem").select("l_orderkey", "l_linenumber", rules.heading(h).alias("h")).select("l_orderkey", "l_linenumber", "h.norm", "h.key")


_ODD = ["ﬁne​tuned", "soft­hyphen\ttab", "①②Ⅳ", "Ｆｕｌｌ", "plain﻿"]


@_query(rf"""
    SELECT doc_id, replace(regexp_replace(replace(replace(replace(replace(replace(replace(text || ' ' || {_picked(_ODD, 'doc_id')}, 'ﬁ', 'fi'), '①', '1'), '②', '2'), 'Ⅳ', 'IV'), 'Ｆｕｌｌ', 'Full'), '…', '...'), '[\x{{00ad}}\x{{200b}}\x{{200c}}\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g'), chr(9), ' ') AS text
    FROM documents""")
def txt22_cleaned_text(t):
    return t("documents").select("doc_id", rules.cleaned(F.concat_ws(" ", "text", _pick(_ODD, F.col("doc_id")))).alias("text"))


@_query(r"""
    SELECT doc_id, length(bare) >= 200 AND length(regexp_replace(solid, '[^\x{FFFD}\p{Co}]', '', 'g')) <= 0.05 * length(solid) AND length(regexp_replace(solid, '[^\p{L}]', '', 'g')) >= 0.5 * length(solid) AS readable
    FROM (SELECT *, regexp_replace(bare, '\s', '', 'g') AS solid FROM (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 5 = 0 THEN regexp_replace(text, '[aeiou]', chr(65533), 'g') WHEN doc_id % 5 = 1 THEN regexp_replace(text, '[aei]', '#', 'g') ELSE text END, '^\s+|\s+$', '', 'g') AS bare FROM documents))""")
def flt12_readable_text(t):
    d, text = F.col("doc_id") % 5, F.col("text")
    spoilt = F.when(d == 0, F.regexp_replace(text, "[aeiou]", "�")).when(d == 1, F.regexp_replace(text, "[aei]", "#")).otherwise(text)
    return t("documents").select("doc_id", rules.is_readable(spoilt).alias("readable"))


def _statistics(t) -> DataFrame:
    return rules.bullet_statistics(bullets(t), "l_orderkey", "bullet", verb_forms(t))


_SECTION_KEYS = ["experience", "education", "skills", "projects", "summary"]
_STATS_SQL = rf"""
    {_RULES_SQL}, {_CONTACT_SQL.replace("once", "spoken")},
    counted AS (SELECT l_orderkey, opener, count(*) AS n, count(*) FILTER (verb) AS v, count(*) FILTER (measured) AS m FROM ruled WHERE len(regexp_extract_all(bullet, '\S+')) >= 3 GROUP BY ALL),
    top AS (SELECT l_orderkey, string_agg('"' || opener || '" (' || n || '×)', ', ' ORDER BY r) AS weak FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, opener) AS r FROM counted WHERE opener IS NOT NULL) WHERE r <= 2 GROUP BY l_orderkey),
    stats AS (SELECT l_orderkey, sum(n)::BIGINT AS n_bullets, sum(v)::BIGINT AS n_verbs, sum(m)::BIGINT AS n_measured FROM counted GROUP BY l_orderkey)"""


@_query(f"WITH {_STATS_SQL} SELECT l_orderkey, n_bullets, n_verbs, n_measured, coalesce(weak, '') AS weak FROM stats LEFT JOIN top USING (l_orderkey)")
def agg14_bullet_statistics(t):
    return _statistics(t)


def _checked(t) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t("orders").select("o_orderkey", _pick(CONTACTS, k).alias("contact"), F.slice(F.array(*map(F.lit, _SECTION_KEYS)), (k % 3).cast("int") + 1, (k % 4).cast("int")).alias("keys"))
    rows = rows.join(_statistics(t).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("n_bullets", "n_verbs", "n_measured")}
    c = F.col("contact")
    passed = rules.structure_checks(rules.has_email(c), rules.has_phone(c), F.col("keys"), n["n_bullets"], n["n_verbs"], n["n_measured"], k % 4, k % 7 == 0, (k % 10) / 20)
    return rows.select("o_orderkey", rules.checks(passed).alias("checks"))


_CHECKS_SQL = f"""
    {_STATS_SQL},
    resumes AS (
        SELECT o_orderkey, contact, {_list(_SECTION_KEYS)}[1 + o_orderkey % 3 : o_orderkey % 3 + o_orderkey % 4] AS keys, coalesce(n_bullets, 0) AS n, coalesce(n_verbs, 0) AS v, coalesce(n_measured, 0) AS m
        FROM contacts LEFT JOIN stats ON l_orderkey = o_orderkey),
    passed AS (
        SELECT o_orderkey, unnest([regexp_matches(contact, '@[A-Za-z0-9_-]+[.]') AND contact IN (FROM phones), list_contains(keys, 'experience'), list_contains(keys, 'education'), list_contains(keys, 'skills'),
               n >= 3 AND v >= 0.7 * n, m >= 3, o_orderkey % 4 IN (1, 2), o_orderkey % 7 <> 0 AND o_orderkey % 10 < 5]) AS passed,
               unnest({_list([c[0] for c in rules.CHECKS])}) AS id, unnest([10, 15, 10, 10, 20, 20, 10, 5]) AS max_points FROM resumes)"""


@_query(f"""
    WITH {_CHECKS_SQL}
    SELECT o_orderkey, sum(CASE WHEN passed THEN max_points ELSE 0 END) / 100 AS score, count(*) FILTER (passed) AS n_passed,
           count(*) FILTER (NOT passed AND max_points >= 15) AS n_high, count(*) FILTER (NOT passed AND max_points = 10) AS n_medium, count(*) FILTER (NOT passed AND max_points = 5) AS n_low
    FROM passed GROUP BY o_orderkey""")
def scr8_structure_scores(t):
    failed = F.filter("checks", lambda c: ~c["passed"])

    def n(level: str):
        return F.size(F.filter(failed, lambda c: rules.severity(c["max_points"]) == level)).cast("long").alias(f"n_{level}")

    return _checked(t).select("o_orderkey", rules.structure_score(F.col("checks")).alias("score"), F.size(F.filter("checks", lambda c: c["passed"])).cast("long").alias("n_passed"), n("high"), n("medium"), n("low"))


@_query(f"""
    WITH {_CHECKS_SQL}
    SELECT id, CASE WHEN max_points >= 15 THEN 'high' WHEN max_points >= 10 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN max_points >= 15 THEN 0 WHEN max_points >= 10 THEN 1 ELSE 2 END AS place, count(*) AS n
    FROM passed WHERE NOT passed GROUP BY ALL""")
def agg21_feedback_by_severity(t):
    failed = _checked(t).select(F.explode(F.filter("checks", lambda c: ~c["passed"])).alias("c")).select("c.id", rules.severity(F.col("c.max_points")).alias("severity"))
    place = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return failed.groupBy("id", "severity", place.alias("place")).agg(F.count("*").alias("n"))


_NAMES = ["Python", "SQL", "Go", "React", "Docker", "Excel", "Spark"]
_WEIGHTS = [3.0, 0.5, 2.0, 1.0, 3.0]


def _skills(n: str, shift: int):
    k = F.col("o_orderkey")
    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(6)), F.lit(1), F.expr(n).cast("int")), lambda i: F.struct(_pick(_NAMES, k + i + shift).alias("skill"), _pick_double(k * 3 + i * (shift + 1)).alias("weight")))


def _pick_double(place):
    return F.get(F.array(*map(F.lit, _WEIGHTS)), F.pmod(place, F.lit(len(_WEIGHTS))).cast("int"))


def _skills_sql(n: str, shift: int) -> str:
    return f"SELECT o_orderkey, i, {_list(_NAMES)}[1 + (o_orderkey + i + {shift}) % 7] AS skill, {_WEIGHTS}[1 + (o_orderkey * 3 + i * {shift + 1}) % 5]::DOUBLE AS weight FROM orders, range(7) r(i) WHERE i < {n}"


@_query(rf"""
    WITH matched AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY weight DESC, i) AS r FROM ({_skills_sql('o_orderkey % 4', 0)})),
    missing AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, weight >= 3 ORDER BY weight DESC, i) AS r FROM ({_skills_sql('o_orderkey % 7', 2)})),
    others AS (SELECT o_orderkey, list(skill ORDER BY r) AS names, max(weight) AS most FROM missing WHERE weight < 3 AND r <= 3 GROUP BY ALL),
    shown AS (SELECT o_orderkey, list(skill ORDER BY r) AS names, max(weight) AS most FROM matched WHERE r <= 3 GROUP BY ALL),
    items AS (
        SELECT o_orderkey, 0 AS part, r AS nth, 'missing_skill' AS type, 'high' AS severity, 'The posting asks for ' || skill || ', which was not found. Name it, with the work it served, if it is part of what you do.' AS message FROM missing WHERE weight >= 3 AND r <= 3
        UNION ALL SELECT o_orderkey, 1, 1, 'missing_skill', CASE WHEN most >= 2 THEN 'medium' ELSE 'low' END, 'Less important, but named as well: ' || CASE WHEN len(names) = 1 THEN names[1] ELSE array_to_string(names[:-2], ', ') || ' and ' || names[-1] END || '. Any of them that you know belongs in your list.' FROM others
        UNION ALL SELECT o_orderkey, 2, i, 'weak_requirement', CASE WHEN (o_orderkey + i) % 2 = 0 THEN 'high' ELSE 'medium' END, 'Little was found on "' || o_orderpriority || ' ' || i || '". A bullet on work of that kind, and on what came of it, would show it.' FROM orders, range(1, 3) r(i) WHERE i <= o_orderkey % 4
        UNION ALL SELECT o_orderkey, 3, i, 'structure', 'medium', 'Open point: ' || {_list([c[1] for c in rules.CHECKS])}[i] || ' (Detail ' || i || ')' FROM orders, range(1, 3) r(i) WHERE i <= o_orderkey % 5),
    kept AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY part, nth) AS place FROM items QUALIFY place <= 7),
    strengths AS (
        SELECT o_orderkey, 'strength' AS type, 'low' AS severity, CASE WHEN names IS NULL THEN 'The text is well laid out and quick to read.'
               ELSE 'Found and wanted: ' || CASE WHEN len(names) = 1 THEN names[1] ELSE array_to_string(names[:-2], ', ') || ' and ' || names[-1] END || '; ' || CASE WHEN most >= 3 THEN 'the posting asks for' ELSE 'the posting names' END || ' them.' END AS message
        FROM orders LEFT JOIN shown USING (o_orderkey))
    SELECT o_orderkey, place, type, severity, message FROM kept
    UNION ALL SELECT o_orderkey, 1 + coalesce((SELECT max(place) FROM kept k WHERE k.o_orderkey = s.o_orderkey), 0), type, severity, message FROM strengths s""")
def scr10_template_feedback(t):
    k = F.col("o_orderkey")
    two = F.sequence(F.lit(1), F.lit(2))
    weak = F.transform(F.filter(two, lambda i: i <= k % 4), lambda i: F.struct(F.when((k + i) % 2 == 0, "required").otherwise("nice").alias("section"), F.concat_ws(" ", "o_orderpriority", i.cast("string")).alias("text")))
    failed = F.transform(F.filter(two, lambda i: i <= k % 5), lambda i: F.struct(_pick([c[1] for c in rules.CHECKS], i - 1).alias("label"), F.concat(F.lit("Detail "), i.cast("string")).alias("detail")))
    items = rules.template_feedback(_skills("o_orderkey % 4", 0), _skills("o_orderkey % 7", 2), weak, failed)
    each = t("orders").select("o_orderkey", F.posexplode(items).alias("place", "i"))
    return each.select("o_orderkey", (F.col("place") + 1).cast("long").alias("place"), "i.type", "i.severity", "i.message")
