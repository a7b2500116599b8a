"""Registered queries on the shapes in which things are read, stored and shown, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitforge.functions import postings as rules
from fitforge.operators import skills
from fitforge.plans.postings import _LEAST_SQL, _LEVEL_SQL, _UNITS_SQL, LEVELS_SQL, SECTIONS_SQL, _picked, postings
from fitforge.plans.queries import _query
from fitforge.plans.resumes import _CHECKS_SQL, _checked
from fitforge.plans.skills import POSTING_SKILLS_SQL, _mentions
from fitforge.sources import boards, dimensions


@_query("""
    WITH e AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS category, CASE p_partkey % 3 WHEN 0 THEN [p_name, p_name, lower(p_name)] WHEN 1 THEN [p_name] ELSE [] END AS aliases, p_partkey % 2 = 0 AS cs FROM part WHERE p_partkey % 11 <> 0)
    SELECT DISTINCT p_partkey::VARCHAR AS canonical, category, unnest(aliases) AS alias, cs AS case_sensitive, false AS ambiguous FROM e WHERE category IS NOT NULL""")
def src5_taxonomy_aliases(t):
    k = F.col("p_partkey")
    aliases = F.when(k % 3 == 0, F.array("p_name", "p_name", F.lower("p_name"))).when(k % 3 == 1, F.array("p_name")).otherwise(F.array().cast("array<string>"))
    entry = F.to_json(F.struct(k.cast("string").alias("canonical"), F.when(F.col("p_size") % 7 != 0, F.col("p_type")).alias("category"), aliases.alias("aliases"), (k % 2 == 0).alias("case_sensitive")))
    texts = t("part").select(F.when(k % 11 == 0, F.lit('{"canonical": ')).otherwise(entry).alias("text"))
    found, _ = dimensions.taxonomy_aliases(boards.parsed_payloads(texts, "text", dimensions.TAXONOMY))
    return found.select("canonical", "category", "alias", "case_sensitive", "ambiguous")


@_query(f"WITH {LEVELS_SQL} SELECT o_orderkey, o_custkey, title FROM levels JOIN orders USING (o_orderkey, o_custkey) WHERE o_orderstatus = 'O'")
def src9_open_postings(t):
    return postings(t("orders").where("o_orderstatus = 'O'")).select("o_orderkey", "o_custkey", "title")


@_query("""
    SELECT o_orderkey AS id, c_name AS company, n_name AS location, o_orderstatus = 'O' AS is_open, strftime(o_orderdate, '%Y-%m-%d') AS posted, r_name AS region
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def prj8_posting_details(t):
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    companies = t("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # as many places as there are nations
    rows = t("orders").join(companies, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("company"), F.col("n_name").alias("location"), (F.col("o_orderstatus") == "O").alias("is_open"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted"), F.col("r_name").alias("region"))


@_query(f"""
    WITH {_CHECKS_SQL}, placed AS (SELECT *, list_position(['contact', 'experience_section', 'education_section', 'skills_section', 'action_verbs', 'quantified', 'length', 'parseable'], id) AS i FROM passed)
    SELECT o_orderkey, coalesce(string_agg(id, ',' ORDER BY i) FILTER (NOT passed), '') AS failed, sum(CASE WHEN passed THEN max_points ELSE 0 END) / 100 AS structure FROM placed GROUP BY o_orderkey""")
def prj10_feedback_contexts(t):
    failed = F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["id"])
    points = F.aggregate("checks", F.lit(0), lambda s, c: s + c["points"])
    return _checked(t).select("o_orderkey", F.array_join(failed, ",").alias("failed"), (points / F.lit(100.0)).alias("structure"))


@_query(f"""
    WITH {POSTING_SKILLS_SQL}
    SELECT l_orderkey, '[' || string_agg('{{"skill":"' || canonical || '","category":"' || category || '","weight":' || weight || ',"n":' || n || ',"sections":["' || array_to_string(sections, '","') || '"]}}', ',' ORDER BY weight DESC, n DESC, lower(canonical)) || ']' AS skills
    FROM weighed GROUP BY l_orderkey""")
def prj11_stored_skills(t):
    return skills.stored_skills(skills.posting_skills(_mentions(t), "l_orderkey"), "l_orderkey").select("l_orderkey", F.to_json("skills").alias("skills"))


@_query(rf"""
    WITH RECURSIVE {SECTIONS_SQL}, {_UNITS_SQL}, {_LEAST_SQL},
    first AS (SELECT o, arg_min(key, n) AS key, trim(regexp_extract(arg_min(text, n), '^\s*([^\n]+)', 1)) AS line FROM sections GROUP BY o),
    titled AS (
        SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN {_picked(['Staff Nurse', ' Junior Cook ', 'Cook'], 'o_orderkey')}
               WHEN key = 'intro' AND len(regexp_extract_all(line, '\S+')) <= 10 AND NOT regexp_matches(line, '[.!?:]$') THEN nullif(line, '') END AS t FROM orders LEFT JOIN first ON o = o_orderkey),
    numerals AS (SELECT o_orderkey, trim(t) AS title, NULL::VARCHAR AS numeral FROM titled)
    SELECT o_orderkey, title, {_LEVEL_SQL} AS level, (SELECT count(*) FROM sections WHERE o = o_orderkey) AS n_sections, (SELECT count(*) FROM requirements WHERE o = o_orderkey) AS n_requirements, min_years
    FROM numerals LEFT JOIN least ON id = o_orderkey""")
def prj13_parsed_postings(t):
    k = F.col("o_orderkey")
    title = F.when(k % 2 == 0, F.get(F.array(*map(F.lit, ["Staff Nurse", " Junior Cook ", "Cook"])), (k % 3).cast("int"))).otherwise(F.lit(" "))
    found = postings(t("orders")).select("o_orderkey", rules.parsed_posting(title, F.col("text")).alias("p"))
    return found.select("o_orderkey", "p.title", "p.level", F.size("p.sections").cast("long").alias("n_sections"), F.size("p.requirements").cast("long").alias("n_requirements"), "p.min_years")
