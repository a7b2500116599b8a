"""Registered queries on mentions of skills, and the same in DuckDB SQL.

Each line item stands for a section of a posting (its order) and of a person (its supplier):
its keys pick the section and the sentences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitforge.operators import skills
from fitforge.plans.postings import _pick, _picked, _quoted
from fitforge.plans.queries import _query, spread

SECTIONS = ["required", "nice", "skills", "experience", "about", "summary", "responsibilities", "benefits"]
PARTS = [
    "Python", "we use Go", "a Go service", "Go to market plans", "Go-getter", "Excel at work", "Excel spreadsheets", "Spring Boot", "Spring 2023", "the Spring term", "American Express card", "Express my interest", "Express APIs", "cross-functional Teams", "Teams, Slack",
    "c++ and C#", "written in C", "C, R, SQL", "React dashboard", "React to change", "react native", "communication", "Leadership", "SQL Server", "sql", "machine learning models", "nothing to see in this long sentence of forty and more letters", "GO", "microsoft excel", "Rust never sleeps",
    "node.js", "Objective-C", "R", "excelled in all", "python 3",
]
TAXONOMY = [
    ("python", "Python", "language", False, False), ("python 3", "Python", "language", False, False), ("Go", "Go", "language", True, True), ("golang", "Go", "language", True, True), ("Excel", "Microsoft Excel", "tool", True, True), ("microsoft excel", "Microsoft Excel", "tool", True, True),
    ("Spring", "Spring", "framework", True, True), ("spring boot", "Spring Boot", "framework", False, False), ("Express", "Express", "framework", True, True), ("Teams", "Microsoft Teams", "tool", True, True), ("slack", "Slack", "tool", False, False), ("c++", "C++", "language", False, False),
    ("c#", "C#", "language", False, False), ("C", "C", "language", True, True), ("R", "R", "language", True, True), ("sql", "SQL", "language", False, False), ("sql server", "SQL Server", "database", False, False), ("React", "React", "framework", True, True), ("react native", "React Native", "framework", False, False),
    ("communication", "Communication", "soft", False, False), ("leadership", "Leadership", "soft", False, False), ("machine learning", "Machine Learning", "field", False, False), ("node.js", "Node.js", "framework", False, False), ("objective-c", "Objective-C", "language", False, False), ("Rust", "Rust", "language", True, True),
]
_JOINTS = [" ", ". ", ", ", " and then over a long way of words that lead to "]


def sections(t) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    text = F.concat(_pick(PARTS, p), _pick(_JOINTS, s), _pick(PARTS, p * 3 + s), _pick(_JOINTS, p), _pick(PARTS, s * 5 + n))
    keys = spread(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")
    return keys.select("l_orderkey", "l_linenumber", "l_suppkey", _pick(SECTIONS, p + n).alias("section"), text.alias("text"))


def _mentions(t) -> DataFrame:
    rows = sections(t)
    taxonomy = rows.sparkSession.createDataFrame(TAXONOMY, "alias string, canonical string, category string, case_sensitive boolean, ambiguous boolean")
    return skills.skill_mentions(rows, taxonomy, ["l_orderkey", "l_linenumber", "l_suppkey"])


def _tokens(alias: str) -> str:
    return " ".join(skills._TOKEN.findall(alias))


_VALUES = ", ".join(
    f"({_quoted(_tokens(a if cs and a != a.lower() else a.lower()))}, {_quoted(c)}, '{k}', {cs and a != a.lower()}, {amb and cs and a != a.lower() and ' ' not in _tokens(a)})" for a, c, k, cs, amb in TAXONOMY
)
MENTIONS_SQL = rf"""
    texts AS (SELECT l_orderkey, l_linenumber, l_suppkey, {_picked(SECTIONS, 'l_partkey + l_linenumber')} AS section,
              {_picked(PARTS, 'l_partkey')} || {_picked(_JOINTS, 'l_suppkey')} || {_picked(PARTS, 'l_partkey * 3 + l_suppkey')} || {_picked(_JOINTS, 'l_partkey')} || {_picked(PARTS, 'l_suppkey * 5 + l_linenumber')} AS text FROM lineitem),
    once AS (SELECT text, regexp_extract_all(text, '\w+|[^\w\s]') AS w, string_split_regex(text, '\w+|[^\w\s]') AS gaps FROM (SELECT DISTINCT text FROM texts)),
    tokens AS (SELECT text, w, gaps, unnest(range(1, len(w) + 1)) AS i FROM once),
    placed AS (SELECT text, i, w, list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in w[1:i-1]]), 0) AS start FROM tokens),
    grams AS (SELECT a.text, a.i, a.i + m - 1 AS j, array_to_string(a.w[a.i:a.i+m-1], ' ') AS gram, a.start::BIGINT AS start, (b.start + length(b.w[b.i]))::BIGINT AS stop
              FROM placed a, (VALUES (1), (2), (3)) AS width(m), placed b WHERE b.text = a.text AND b.i = a.i + m - 1),
    taxonomy(alias, canonical, category, exact, needs) AS (VALUES {_VALUES}),
    hits AS (SELECT text, i, j, start, stop, canonical, category, needs FROM grams JOIN taxonomy ON CASE WHEN exact THEN gram ELSE lower(gram) END = alias),
    kept AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits l WHERE l.text = h.text AND l.j - l.i > h.j - h.i AND l.i <= h.j AND h.i <= l.j)),
    judged AS (
        SELECT k.*, regexp_extract(trim(substr(k.text, 1, start)), '.$') AS b, substr(ltrim(substr(k.text, stop + 1)), 1, 1) AS a,
               regexp_matches(substr(k.text, stop + 1, 30), {_quoted(skills.TECHNICAL)}, 'i') AS technical,
               EXISTS (SELECT 1 FROM kept o WHERE o.text = k.text AND NOT o.needs AND greatest(o.start - k.stop, k.start - o.stop) <= 40) AS vouched,
               CASE canonical
                   WHEN 'Spring' THEN regexp_matches(substr(k.text, start + 1, 40), '^Spring\s*(\d\d|semester|break|term)', 'i')
                   WHEN 'Go' THEN regexp_matches(substr(k.text, start + 1, 40), '^Go\s*-|^Go\s+(to|out|through|beyond|above)\b')
                   WHEN 'Microsoft Excel' THEN regexp_matches(substr(k.text, start + 1, 40), '^Excel\s+(at|in)\b')
                   WHEN 'Express' THEN regexp_matches(substr(k.text, start + 1, 40), '^Express\s+(my|our|interest|concern)') OR regexp_matches(substr(k.text, 1, start), 'American\s+$')
                   WHEN 'Microsoft Teams' THEN regexp_matches(substr(k.text, 1, start), 'cross[- ]functional\s+$', 'i')
                   ELSE false END AS excluded FROM kept k),
    mentions AS (
        SELECT l_orderkey, l_linenumber, l_suppkey, section, canonical, category, start, stop FROM texts JOIN judged USING (text)
        WHERE NOT excluded AND (category <> 'soft' OR section IN ('skills', 'summary', 'header'))
              AND (NOT needs OR section = 'skills' OR technical OR vouched OR (a <> '' AND contains(',/|;()•·', a)) OR (b <> '' AND contains(',/|;()•·', b))))"""


@_query(f"WITH {MENTIONS_SQL} SELECT l_orderkey, l_linenumber, section, canonical, category, start, stop FROM mentions")
def txt19_skill_mentions(t):
    return _mentions(t).select("l_orderkey", "l_linenumber", "section", "canonical", "category", "start", "stop")


POSTING_SKILLS_SQL = f"""{MENTIONS_SQL},
    skills AS (
        SELECT l_orderkey, canonical, category, count(*) AS n, list_sort(list(DISTINCT section)) AS sections FROM mentions
        WHERE category <> 'soft' AND section NOT IN ('about', 'benefits') GROUP BY ALL),
    weighed AS (SELECT *, CASE WHEN list_contains(sections, 'required') THEN 3.0 WHEN sections = ['nice'] THEN 0.5 WHEN n >= 2 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM skills)"""


@_query(f"""
    WITH {POSTING_SKILLS_SQL}
    SELECT l_orderkey, canonical, n, array_to_string(sections, ',') AS sections, weight, row_number() OVER (PARTITION BY l_orderkey ORDER BY weight DESC, n DESC, lower(canonical))::INT AS place FROM weighed""")
def agg7_posting_skills(t):
    found = skills.posting_skills(_mentions(t), "l_orderkey")
    return found.select("l_orderkey", "canonical", "n", F.array_join("sections", ",").alias("sections"), "weight", "place")


@_query(f"""
    WITH {MENTIONS_SQL}
    SELECT l_suppkey, canonical, count(*) AS n, bool_or(section = 'skills') AS in_skills, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, lower(canonical))::INT AS place
    FROM mentions GROUP BY l_suppkey, canonical""")
def agg8_own_skills(t):
    return skills.own_skills(_mentions(t), "l_suppkey").select("l_suppkey", "canonical", "n", "in_skills", "place")


_OWNED_SQL = f"{POSTING_SKILLS_SQL}, owned AS (SELECT DISTINCT l_orderkey % 10 AS person, canonical FROM mentions WHERE l_linenumber = 1 AND l_orderkey < 100)"


@_query(f"""
    WITH {_OWNED_SQL},
    sides AS (
        SELECT l_orderkey, w.canonical, w.weight, o.canonical IS NOT NULL AS has,
               row_number() OVER (PARTITION BY l_orderkey, o.canonical IS NOT NULL ORDER BY weight DESC, n DESC, lower(w.canonical)) AS r
        FROM weighed w LEFT JOIN owned o ON o.person = l_orderkey % 10 AND o.canonical = w.canonical)
    SELECT l_orderkey, coalesce(string_agg(canonical, ',' ORDER BY r) FILTER (has AND r <= 3), '') AS matched, coalesce(string_agg(canonical, ',' ORDER BY r) FILTER (NOT has AND r <= 3), '') AS missing,
           count(*) FILTER (has) AS n_matched, count(*) FILTER (NOT has) AS n_missing FROM sides GROUP BY l_orderkey""")
def prj7_matched_and_missing(t):
    mentions = _mentions(t)
    needed = skills.posting_skills(mentions, "l_orderkey").withColumn("person", F.col("l_orderkey") % 10)
    owned = mentions.where("l_linenumber = 1 and l_orderkey < 100").select((F.col("l_orderkey") % 10).alias("person"), "canonical").distinct().withColumn("has", F.lit(True))
    sides = needed.join(owned, ["person", "canonical"], "left").withColumn("has", F.coalesce("has", F.lit(False)))
    r = F.row_number().over(Window.partitionBy("l_orderkey", "has").orderBy("place"))

    def top(has: bool):
        first = F.collect_list(F.when((F.col("has") == has) & (F.col("r") <= 3), F.struct("r", "canonical")))
        return F.array_join(F.transform(F.array_sort(first), lambda x: x["canonical"]), ",")

    return sides.withColumn("r", r).groupBy("l_orderkey").agg(top(True).alias("matched"), top(False).alias("missing"), F.count_if("has").alias("n_matched"), F.count_if(~F.col("has")).alias("n_missing"))
