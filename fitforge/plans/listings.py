"""Registered queries on listings, filters, projections and writes, and the same in DuckDB SQL.

Orders stand for postings and applications, customers for companies and users, line items
for requirements and skills, events for a log of runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitforge.functions import filters
from fitforge.functions import postings as rules
from fitforge.operators import activity, layout, maintenance, scoring, snapshots
from fitforge.plans.postings import LEVELS_SQL, SECTIONS_SQL, _found, _list, _pick, _picked, postings
from fitforge.plans.queries import _query
from fitforge.sources import boards

PLACES = ["Berlin (DE)", "100% remote", "under_score city", "back\\slash", "berlin", "Paris", "Remote - US", "a%b_c"]
WANTED = ["%", "_", "BERLIN", "\\", "remote", "%b_"]
_AS_OF = "1998-01-01"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- filters


@_query("""
    WITH j AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS remote FROM orders)
    SELECT 'any' AS wanted, o_orderkey FROM j UNION ALL SELECT 'yes', o_orderkey FROM j WHERE remote IS TRUE UNION ALL SELECT 'no', o_orderkey FROM j WHERE remote IS FALSE""")
def flt2_remote_filter(t):
    jobs = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 2 == 0).alias("remote"))
    return _union([jobs.where(filters.is_remote(F.col("remote"), w)).select(F.lit(name).alias("wanted"), "o_orderkey") for name, w in (("any", None), ("yes", True), ("no", False))])


@_query(" UNION ALL ".join(f"SELECT '{w}' AS wanted, o_orderkey FROM orders WHERE position(lower('{w}') IN lower({_picked(PLACES, 'o_orderkey')})) > 0" for w in WANTED))
def flt3_location_text(t):
    jobs = t("orders").select("o_orderkey", _pick(PLACES, F.col("o_orderkey")).alias("location"))
    return _union([jobs.where(filters.contains_text(F.col("location"), w)).select(F.lit(w).alias("wanted"), "o_orderkey") for w in WANTED])


@_query(f"WITH {LEVELS_SQL} SELECT w AS wanted, o_orderkey FROM levels, (VALUES ('senior'), ('staff'), ('intern')) v(w) WHERE level = w")
def flt4_level_equals(t):
    jobs = postings(t("orders")).select("o_orderkey", rules.level_from_title(F.col("title")).alias("level"))
    return _union([jobs.where(filters.equals(F.col("level"), w)).select(F.lit(w).alias("wanted"), "o_orderkey") for w in ("senior", "staff", "intern")])


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def flt5_own_rows(t):
    owners = t("customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return t("orders").join(owners, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) AND o_orderstatus <> 'P'")
def flt6_key_list(t):
    keys = t("lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").where("o_orderstatus <> 'P'").join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@_query("SELECT vec_id, o_orderstatus FROM embeddings JOIN orders ON o_orderkey = vec_id WHERE o_orderstatus = 'O' AND vec_id % 3 <> 0")
def flt1_open_with_embedding(t):
    vectors = t("embeddings").withColumn("embedding", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")))
    jobs = t("orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("vec_id"), "o_orderstatus")
    return jobs.join(vectors.where("embedding is not null").select("vec_id"), "vec_id").select("vec_id", "o_orderstatus")


_ROLE_WORDS = {"AUTOMOBILE": "engineer", "BUILDING": "manager", "FURNITURE": "nurse", "HOUSEHOLD": "architect", "MACHINERY": "recruiter"}


@_query(f"""
    WITH {LEVELS_SQL},
    w AS (SELECT c_mktsegment, l_partkey % 40 AS skill, sum(l_quantity) AS weight FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey JOIN customer ON o.o_custkey = c_custkey WHERE l_linenumber = 1 GROUP BY ALL),
    total AS (SELECT c_mktsegment, sum(weight) AS total FROM w GROUP BY ALL),
    owned AS (SELECT DISTINCT l_orderkey, l_partkey % 40 AS skill FROM lineitem),
    covered AS (SELECT l_orderkey, c_mktsegment, sum(weight) / any_value(total) AS covered FROM owned JOIN w USING (skill) JOIN total USING (c_mktsegment) GROUP BY ALL),
    keywords(c_mktsegment, word) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _ROLE_WORDS.items())}),
    scored AS (
        SELECT o_orderkey, k.c_mktsegment, coalesce(covered, 0) + CASE WHEN regexp_matches(lower(title), '\\b' || word || '\\b') THEN 0.25 ELSE 0 END AS score
        FROM levels CROSS JOIN keywords k LEFT JOIN covered c ON l_orderkey = o_orderkey AND c.c_mktsegment = k.c_mktsegment)
    SELECT o_orderkey, c_mktsegment, round(score, 6) AS score FROM scored WHERE round(score, 9) >= 0.25
    QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY round(score, 9) DESC, c_mktsegment) <= 3""")
def scr6_roles_with_title_bonus(t):
    skill = (F.col("l_partkey") % 40).alias("skill")
    first = t("lineitem").where("l_linenumber = 1").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    roles = first.groupBy("c_mktsegment", skill).agg(F.sum("l_quantity").alias("weight"))
    # a row for each role
    words = t("region").sparkSession.createDataFrame(list(_ROLE_WORDS.items()), "c_mktsegment string, word string")
    people = postings(t("orders")).select("o_orderkey", F.lower("title").alias("titles"))
    owned = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), skill).distinct()
    scored = scoring.role_scores(people, owned, roles, words, "o_orderkey", "c_mktsegment")
    place = F.row_number().over(Window.partitionBy("o_orderkey").orderBy(F.round("score", 9).desc(), "c_mktsegment"))
    return scored.where(F.round("score", 9) >= 0.25).withColumn("n", place).where("n <= 3").select("o_orderkey", "c_mktsegment", F.round("score", 6).alias("score"))


_WORDS = ["sales", "data", "nurse", "cloud", "retail"]


@_query(f"""
    WITH j AS (SELECT o_orderkey, o_custkey % 5 AS p, o_orderkey % 3 = 0 AS technical, [{_picked(_WORDS, 'o_orderkey')}, {_picked(_WORDS, 'o_orderkey // 5')}] AS words, [o_orderkey % 11, o_custkey % 11] AS skills FROM orders)
    SELECT o_orderkey FROM j WHERE technical <> (p % 2 = 0) AND NOT list_has_any(words, [{_picked(_WORDS, 'p')}]) AND NOT list_has_any(skills, [p, p + 3])""")
def flt11_unrelated_postings(t):
    k, p = F.col("o_orderkey"), F.col("o_custkey") % 5
    words, own = F.array(_pick(_WORDS, k), _pick(_WORDS, F.floor(k / 5))), F.array(_pick(_WORDS, p))
    return t("orders").where(filters.unrelated(k % 3 == 0, p % 2 == 0, F.array(k % 11, F.col("o_custkey") % 11), F.array(p, p + 3), words, own)).select("o_orderkey")


@_query("""
    SELECT l_orderkey, l_linenumber, o_orderkey IS NOT NULL AS found, o_orderstatus FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_custkey = l_suppkey""")
def flt17_owned_lookup(t):
    asked = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("o_custkey"))
    own = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(True).alias("found"))
    return asked.join(own, ["o_orderkey", "o_custkey"], "left").select("l_orderkey", "l_linenumber", F.coalesce("found", F.lit(False)).alias("found"), "o_orderstatus")


_GENERIC = ["years", "of", "the", "with", "and", "experience", "one", "own", "team", "all", "it"]


@_query(rf"""
    WITH RECURSIVE {SECTIONS_SQL},
    terms AS (SELECT DISTINCT o, unnest(regexp_extract_all(lower(text), '[a-z]+-?[a-z]+')) AS term FROM sections WHERE key IN ('required', 'nice'))
    SELECT term, count(DISTINCT o_custkey) AS n_groups, count(*) AS n_docs FROM terms JOIN orders ON o = o_orderkey
    WHERE NOT list_has_all({_list(_GENERIC)}, string_split(replace(term, '-', ' '), ' ')) GROUP BY term HAVING count(DISTINCT o_custkey) >= 3 ORDER BY n_groups DESC, n_docs DESC, term LIMIT 50""")
def agg9_vocabulary(t):
    found = _found(t).join(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    needed = F.filter("sections", lambda s: s["key"].isin("required", "nice"))
    text = F.array_join(F.transform(needed, lambda s: s["text"]), "\n")
    terms = found.select("o_orderkey", "o_custkey", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+-?[a-z]+)"), F.lit(1)))).alias("term"))
    terms = terms.where(~filters.only_generic(F.col("term"), _GENERIC))
    per_group = terms.groupBy("term", "o_custkey").agg(F.count("*").alias("n"))
    report = per_group.groupBy("term").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_docs"))
    return report.where("n_groups >= 3").orderBy(F.desc("n_groups"), F.desc("n_docs"), "term").limit(50)


# ---------------------------------------------------------------- sources and projections


@_query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 60")
def src8_active_companies(t):
    return t("customer").where("c_acctbal > 0").orderBy("c_custkey").limit(60).select("c_custkey", "c_name")


_BOARD_PLACES = ["Remote, US", "  Paris ", "", "   ", "not remotely near", "Rome"]
_FIRST = ["2023-05-06T07:08:09+02:00", "bad", "", "2024-01-01T00:00:00Z"]


@_query(f"""
    WITH j AS (SELECT o_orderkey, o_orderpriority, trim({_picked(_BOARD_PLACES, 'o_orderkey')}) AS place, o_orderkey % 4 AS w FROM orders WHERE o_orderkey % 17 <> 0)
    SELECT o_orderkey::VARCHAR AS external_id, o_orderpriority AS title, nullif(place, '') AS location, contains(lower(place), 'remote') AS is_remote,
           CASE w WHEN 0 THEN epoch(TIMESTAMP '2023-05-06 05:08:09') WHEN 2 THEN epoch(TIMESTAMP '2024-03-04 00:00:00') WHEN 3 THEN epoch(TIMESTAMP '2024-01-01 00:00:00') END::BIGINT AS posted FROM j""")
def src2_board_a_postings(t):
    k = F.col("o_orderkey")
    job = F.concat(F.lit('{"jobs": [{"id": '), k.cast("string"), F.lit(', "title": " '), F.col("o_orderpriority"), F.lit(' ", "absolute_url": "u", "location": {"name": "'), _pick(_BOARD_PLACES, k), F.lit('"}, "content": "c", "first_published": "'), _pick(_FIRST, k), F.lit('", "updated_at": "2024-03-04T00:00:00Z"}]}'))
    texts = t("orders").select(F.when(k % 17 == 0, F.lit('{"jobs": [')).otherwise(job).alias("text"))
    rows = boards.normalise_a(boards.parsed_payloads(texts, "text", boards.BOARD_A))
    return rows.select("external_id", "title", "location", "is_remote", F.unix_seconds("posted_at").alias("posted"))


@_query(f"""
    WITH j AS (SELECT o_orderkey, trim({_picked(_BOARD_PLACES, 'o_orderkey')}) AS place FROM orders)
    SELECT 'id-' || o_orderkey AS external_id, nullif(place, '') AS location, o_orderkey % 3 = 0 OR contains(lower(place), 'remote') AS is_remote,
           CASE WHEN o_orderkey % 2 = 0 THEN '<p>in</p>' || chr(10) ELSE '' END || '<h3>A &amp; &lt;B&gt;</h3><ul><li>' || o_orderkey || '</li></ul>' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE chr(10) || 'end' END AS description,
           CASE WHEN o_orderkey % 4 <> 0 THEN 1700000000 + o_orderkey END AS posted FROM j""")
def src3_board_b_postings(t):
    k = F.col("o_orderkey")
    posting = F.to_json(
        F.struct(
            F.concat(F.lit("id-"), k).alias("id"), F.lit("T").alias("text"), F.lit("u").alias("hostedUrl"), F.struct(_pick(_BOARD_PLACES, k).alias("location")).alias("categories"), F.when(k % 3 == 0, "remote").otherwise("hybrid").alias("workplaceType"),
            F.when(k % 4 == 0, 0).otherwise((1700000000 + k) * 1000 + 7).alias("createdAt"), F.when(k % 2 == 0, "<p>in</p>").otherwise("").alias("description"),
            F.array(F.struct(F.lit(" A & <B> ").alias("text"), F.concat(F.lit("<li>"), k, F.lit("</li>")).alias("content"))).alias("lists"), F.when(k % 5 == 0, "").otherwise("end").alias("additional"),
        )
    )
    rows = boards.normalise_b(boards.parsed_payloads(t("orders").select(posting.alias("text")), "text", boards.BOARD_B))
    return rows.select("external_id", "location", "is_remote", "description", F.unix_seconds("posted_at").alias("posted"))


@_query("SELECT l_orderkey, array_to_string(list(l_returnflag || l_partkey ORDER BY l_linenumber, l_partkey, l_returnflag), ',') AS requirements, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY l_orderkey")
def src10_requirements_by_posting(t):
    lines = t("lineitem").join(t("orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    return lines.groupBy("l_orderkey").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["l_returnflag"], x["l_partkey"].cast("string"))), ",").alias("requirements"), F.count("*").alias("n"))


@_query(rf"""
    WITH {LEVELS_SQL}
    SELECT 'document' AS kind, doc_id AS id, substr({_picked(PLACES, 'doc_id')} || chr(10) || chr(10) || text, 1, 8000) AS input FROM documents
    UNION ALL SELECT 'query', conv_id * 1000 + turn, CASE WHEN turn % 3 = 0 THEN text ELSE 'Target roles: ' || CASE WHEN turn % 3 = 1 THEN 'Nurse' ELSE 'Nurse, Data Engineer' END || chr(10) || chr(10) || text END FROM conversations""")
def src11_embedding_inputs(t):
    documents = t("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), filters.embedding_text(_pick(PLACES, F.col("doc_id")), F.col("text")).alias("input"))
    roles = F.slice(F.array(F.lit("Nurse"), F.lit("Data Engineer")), 1, (F.col("turn") % 3).cast("int"))
    turns = t("conversations").select(F.lit("query").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), filters.with_roles(roles, F.col("text")).alias("input"))
    return documents.unionByName(turns)


_PATHS = ["/home/a/cv.pdf", "C:\\docs\\My CV.pdf", "", "dir/", "  spaced.pdf ", "tab\there.pdf", "x" * 250 + ".pdf", "mixed\\path/to/final.docx"]


@_query(f"SELECT p_partkey, coalesce(nullif(substr(trim(regexp_replace(string_split_regex({_picked(_PATHS, 'p_partkey')}, '[/\\\\]')[-1], '[[:cntrl:]]', '', 'g')), 1, 200), ''), 'resume.pdf') AS name FROM part".replace("\t", "' || chr(9) || '"))
def prj6_file_names(t):
    return t("part").select("p_partkey", filters.file_name(_pick(_PATHS, F.col("p_partkey"))).alias("name"))


@_query("SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def prj1_list_view(t):
    return t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey")


@_query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'required' ELSE l_returnflag END AS section, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 2 END AS n_skills, o_orderpriority AS title
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def prj3_stored_postings(t):
    section = F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit("required"))
    stored = F.when(F.col("l_linenumber") % 2 != 0, F.array(F.struct(F.col("l_partkey").alias("skill"), F.lit(3.0).alias("weight")), F.struct(F.col("l_suppkey").alias("skill"), F.lit(1.0).alias("weight"))))
    skills = F.coalesce(stored, F.array().cast("array<struct<skill:bigint,weight:double>>"))
    return t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber", section.alias("section"), F.size(skills).alias("n_skills"), F.col("o_orderpriority").alias("title"))


@_query(f"WITH RECURSIVE {SECTIONS_SQL} SELECT o AS o_orderkey, row_number() OVER (PARTITION BY o ORDER BY n) - 1 AS place, key, heading FROM sections WHERE heading IS NOT NULL")
def prj9_headed_sections(t):
    each = _found(t).select("o_orderkey", F.posexplode(F.filter("sections", lambda s: s["heading"].isNotNull())).alias("place", "s"))
    return each.select("o_orderkey", F.col("place").cast("long").alias("place"), "s.key", "s.heading")


@_query("""
    SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS skills, count(*) FILTER (l_linenumber % 3 <> 0) AS n_vectors, coalesce(max(CASE WHEN l_linenumber > 3 THEN l_tax END), 0) AS score
    FROM lineitem GROUP BY l_orderkey""")
def prj12_scoring_inputs(t):
    vectors = F.count(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")))
    skills = F.array_join(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda x: x.cast("string")), ",")
    return t("lineitem").groupBy("l_orderkey").agg(skills.alias("skills"), vectors.alias("n_vectors"), F.coalesce(F.max(F.when(F.col("l_linenumber") > 3, F.col("l_tax"))), F.lit(0.0)).alias("score"))


@_query("""
    SELECT o_orderkey, c_name, n_name, o_orderstatus, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') THEN true ELSE false END AS saved
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def jn13_saved_flags(t):
    saved = t("lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("saved", F.lit(True))
    jobs = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return jobs.join(saved, "o_orderkey", "left").select("o_orderkey", "c_name", "n_name", "o_orderstatus", F.coalesce("saved", F.lit(False)).alias("saved"))


# ---------------------------------------------------------------- counts, order, samples


@_query("SELECT o_custkey, count(*) AS n, count(*) >= 10 AS at_cap FROM orders GROUP BY o_custkey")
def agg1_rows_and_cap(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), (F.count("*") >= 10).alias("at_cap"))


@_query("SELECT user_id, count(*) AS n, min(ts) AS oldest FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 3600 SECONDS * 24 AND ts <= TIMESTAMP '2024-01-20' GROUP BY user_id")
def agg2_recent_counts(t):
    return activity.counts_since(t("events"), "user_id", "ts", F.lit("2024-01-20").cast("timestamp_ntz"), 24 * 3600)


@_query("SELECT count(*) FILTER (o_orderstatus = 'O') AS n_open, greatest(count(*) FILTER (o_orderstatus = 'O') - 1000, 0) AS excess FROM orders")
def agg3_open_count(t):
    n = F.count_if(F.col("o_orderstatus") == "O")
    return t("orders").agg(n.alias("n_open"), F.greatest(n - 1000, F.lit(0)).cast("long").alias("excess"))


@_query("""
    SELECT l_suppkey, size, bold FROM (SELECT l_suppkey, floor(l_quantity / 10)::BIGINT AS size, l_returnflag = 'R' AS bold, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, first) = 1""")
def agg12_dominant_style(t):
    rows = t("lineitem").select("l_suppkey", F.floor(F.col("l_quantity") / 10).cast("long").alias("size"), (F.col("l_returnflag") == "R").alias("bold"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return layout.first_mode(rows, "l_suppkey", ["size", "bold"], "place").select("l_suppkey", "size", "bold")


@_query("""
    SELECT l_suppkey, first, length FROM (
        SELECT l_suppkey, first, length, row_number() OVER (PARTITION BY l_suppkey ORDER BY length DESC, first) AS r FROM (
            SELECT l_suppkey, x + 1 AS first, lead(x) OVER (PARTITION BY l_suppkey ORDER BY x) - x - 1 AS length FROM (
                SELECT DISTINCT l_suppkey, l_partkey % 500 AS x FROM lineitem WHERE l_partkey % 500 BETWEEN 75 AND 425 UNION SELECT DISTINCT l_suppkey, unnest([74, 426]) FROM lineitem))
        WHERE length >= 8) WHERE r = 1""")
def win8_longest_clear_run(t):
    taken = t("lineitem").select("l_suppkey", (F.col("l_partkey") % 500).alias("x"))
    return activity.longest_clear_run(taken, "l_suppkey", "x", 75, 425, 8)


@_query("""
    SELECT user_id, arg_max(failures, (ts, event_id))::BIGINT AS failures, max(failures) < 3 AS active FROM (
        SELECT user_id, ts, event_id, sum(f) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures
        FROM (SELECT *, (event_type <> 'view')::INT AS f, sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events))
    GROUP BY user_id""")
def win6_deactivations(t):
    return activity.deactivations(t("events"), "user_id", ["ts", "event_id"], F.col("event_type") != "view")


@_query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS place FROM orders")
def top9_history(t):
    return t("orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("place"))


@_query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY md5(l_orderkey || '/' || l_linenumber || '/7'), l_orderkey, l_linenumber) <= 50")
def top11_seeded_samples(t):
    key = F.md5(F.concat_ws("/", "l_orderkey", "l_linenumber", F.lit("7")))
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(key, "l_orderkey", "l_linenumber"))
    return t("lineitem").withColumn("n", place).where("n <= 50").select("l_suppkey", "l_orderkey", "l_linenumber")


@_query("SELECT DISTINCT l_suppkey, round(l_extendedprice / 1000)::BIGINT AS x, round(l_quantity / 4)::BIGINT AS y FROM lineitem WHERE l_quantity <> 2 AND l_quantity % 4 <> 2")
def set6_distinct_boxes(t):
    boxes = t("lineitem").where("l_quantity <> 2 and l_quantity % 4 <> 2").select("l_suppkey", F.round(F.col("l_extendedprice") / 1000).cast("long").alias("x"), F.round(F.col("l_quantity") / 4).cast("long").alias("y"))
    return boxes.dropDuplicates()


# ---------------------------------------------------------------- writes


def _snapshots(t) -> tuple[DataFrame, DataFrame]:
    o = t("orders")
    title = F.concat_ws(" ", "o_orderpriority", F.lit("post"))
    fetched = F.col("o_custkey") % 11 != 0
    stored = o.where("o_orderdate < timestamp_ntz'1998-01-01'").select(
        "o_orderkey", "o_custkey", snapshots.content_hash(title, F.col("o_orderstatus")).alias("content"), title.alias("title"), "o_totalprice",
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen"),
    )
    text = F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("o_orderstatus"))
    listed = o.where("o_orderdate >= timestamp_ntz'1993-01-01'").where(fetched).select("o_orderkey", "o_custkey", snapshots.content_hash(title, text).alias("content"), F.upper(title).alias("title"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return stored, listed


_APPLIED_SQL = f"""
    stored AS (SELECT o_orderkey, o_custkey, sha256(o_orderpriority || ' post' || chr(10) || o_orderstatus) AS content, o_orderpriority || ' post' AS title, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status, o_orderdate AS seen
               FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
    listed AS (SELECT o_orderkey, o_custkey, sha256(o_orderpriority || ' post' || chr(10) || CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END) AS content, upper(o_orderpriority || ' post') AS title, o_totalprice * 2 AS o_totalprice
               FROM orders WHERE o_orderdate >= TIMESTAMP '1993-01-01' AND o_custkey % 11 <> 0),
    applied AS (
        SELECT coalesce(l.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN s.content = l.content THEN s.title ELSE coalesce(l.title, s.title) END AS title, CASE WHEN s.content = l.content THEN s.o_totalprice ELSE coalesce(l.o_totalprice, s.o_totalprice) END AS price,
               CASE WHEN l.o_orderkey IS NOT NULL THEN 'open' WHEN s.o_custkey % 11 <> 0 THEN 'closed' ELSE s.status END AS status,
               coalesce(s.seen, TIMESTAMP '{_AS_OF}') AS first_seen, CASE WHEN l.o_orderkey IS NOT NULL THEN TIMESTAMP '{_AS_OF}' ELSE s.seen END AS last_seen,
               CASE WHEN s.o_custkey % 11 = 0 AND l.o_orderkey IS NULL THEN 'not fetched' WHEN l.o_orderkey IS NULL THEN CASE WHEN s.status = 'open' THEN 'closed' ELSE 'absent' END WHEN s.o_orderkey IS NULL THEN 'new' WHEN s.content <> l.content THEN 'updated' WHEN s.status = 'open' THEN 'unchanged' ELSE 'reopened' END AS action
        FROM stored s FULL JOIN listed l ON s.o_orderkey = l.o_orderkey)"""


def _applied(t) -> DataFrame:
    stored, listed = _snapshots(t)
    fetched = F.col("o_custkey") % 11 != 0
    done = snapshots.apply_snapshot(stored.where(fetched), listed, "o_orderkey", "content", ["title", "o_totalprice"], F.lit(_AS_OF).cast("timestamp_ntz"))
    # boards that were not fetched stay as they are
    rest = stored.where(~fetched).select("o_orderkey", "content", "title", "o_totalprice", "status", "first_seen", "last_seen", F.lit("not fetched").alias("action"))
    return done.unionByName(rest)


@_query(f"WITH {_APPLIED_SQL} SELECT o_orderkey, title, price, status, first_seen, last_seen, action FROM applied")
def dml2_applied_snapshot(t):
    return _applied(t).select("o_orderkey", "title", F.col("o_totalprice").alias("price"), "status", "first_seen", "last_seen", "action")


@_query(f"""
    WITH {_APPLIED_SQL}, renewed AS (SELECT o_orderkey FROM applied WHERE action IN ('new', 'updated'))
    SELECT l_orderkey, l_linenumber, 'old' AS version FROM lineitem WHERE l_orderkey NOT IN (FROM renewed) AND l_shipdate < TIMESTAMP '1998-01-01'
    UNION ALL SELECT l_orderkey, l_linenumber, 'new' FROM lineitem WHERE l_orderkey IN (FROM renewed) AND l_quantity > 10""")
def dml3_replaced_children(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity", "l_shipdate")
    old, new = (lines.where(c).select("o_orderkey", "l_linenumber", F.lit(v).alias("version")) for c, v in (("l_shipdate < timestamp_ntz'1998-01-01'", "old"), ("l_quantity > 10", "new")))
    return snapshots.replace_children(old, new, _applied(t), "o_orderkey").withColumnRenamed("o_orderkey", "l_orderkey")


@_query("""
    WITH was AS (SELECT l_orderkey, list((l_returnflag, l_partkey) ORDER BY l_linenumber, l_partkey) AS v FROM lineitem WHERE l_linenumber <> 5 GROUP BY ALL),
    now AS (SELECT l_orderkey, list((CASE WHEN l_quantity > 49 THEN 'X' ELSE l_returnflag END, l_partkey) ORDER BY l_linenumber, l_partkey) AS v FROM lineitem WHERE l_linenumber <> 6 GROUP BY ALL)
    SELECT coalesce(was.l_orderkey, now.l_orderkey) AS l_orderkey, was.v IS DISTINCT FROM now.v AS differs FROM was FULL JOIN now ON was.l_orderkey = now.l_orderkey""")
def dml4_reparsed_lists(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    was = lines.where("l_linenumber <> 5")
    now = lines.where("l_linenumber <> 6").withColumn("l_returnflag", F.when(F.col("l_quantity") > 49, "X").otherwise(F.col("l_returnflag")))
    return snapshots.lists_differ(was, now, "l_orderkey", ["l_linenumber", "l_partkey"], ["l_returnflag", "l_partkey"])


@_query("SELECT c_custkey, coalesce(s_name, c_name) AS c_name, CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal END AS c_acctbal FROM customer FULL JOIN supplier ON c_custkey = s_suppkey WHERE c_custkey IS NOT NULL UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def dml8_replaced_profiles(t):
    sent = t("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return maintenance.replace_rows(t("customer").select("c_custkey", "c_name", "c_acctbal"), sent, "c_custkey")


@_query("""
    WITH p AS (SELECT l_orderkey, l_suppkey, l_quantity > 25 AS has_status, CASE WHEN l_tax > 0.04 THEN l_returnflag END AS status, l_discount > 0.05 AS has_note, l_linestatus AS note FROM lineitem WHERE l_linenumber = 1)
    SELECT o_orderkey, CASE WHEN has_status THEN status ELSE o_orderstatus END AS o_orderstatus, CASE WHEN has_note THEN note ELSE o_orderpriority END AS o_orderpriority
    FROM orders LEFT JOIN p ON l_orderkey = o_orderkey AND l_suppkey % 10 = o_custkey % 10""")
def dml8_patched_applications(t):
    sent = t("lineitem").where("l_linenumber = 1").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 10).alias("owner"), (F.col("l_quantity") > 25).alias("has_o_orderstatus"), F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")).alias("o_orderstatus"),
        (F.col("l_discount") > 0.05).alias("has_o_orderpriority"), F.col("l_linestatus").alias("o_orderpriority"),
    )
    stored = t("orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("owner"), "o_orderstatus", "o_orderpriority")
    return maintenance.patch_rows(stored, sent, "owner", "o_orderkey", ["o_orderstatus", "o_orderpriority"]).drop("owner")


@_query("SELECT o_custkey, o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 20)::INT AS chunk FROM orders WHERE o_orderstatus <> 'F'")
def snk1_insert_chunks(t):
    return snapshots.chunks(t("orders").where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 20)


@_query("""
    SELECT o_orderkey, o_custkey, o_orderstatus = 'O' AND o_custkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 7) AS active FROM orders
    UNION ALL SELECT -min(l_orderkey), l_suppkey, true FROM lineitem WHERE l_linenumber = 7 GROUP BY l_suppkey""")
def snk2_inserted_active(t):
    stored = t("orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "O").alias("active"))
    new = t("lineitem").where("l_linenumber = 7").groupBy(F.col("l_suppkey").alias("o_custkey")).agg((-F.min("l_orderkey")).alias("o_orderkey"))
    return maintenance.insert_active(stored, new, "o_custkey", "active")


@_query(f"""
    WITH {_APPLIED_SQL}
    SELECT 'fetched' AS counter, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1993-01-01' AND o_custkey % 11 <> 0
    UNION ALL SELECT 'companies failed', count(*) FROM customer WHERE c_custkey % 11 = 0 UNION ALL SELECT 'companies ok', count(*) FROM customer WHERE c_custkey % 11 <> 0
    UNION ALL SELECT action, count(*) FROM applied WHERE action <> 'not fetched' GROUP BY action
    UNION ALL SELECT 'pruned', count(*) FROM applied a WHERE status = 'closed' AND last_seen < TIMESTAMP '1997-12-02' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = a.o_orderkey AND l_returnflag = 'R')
    UNION ALL SELECT 'over corpus cap', greatest(count(*) - 1000, 0) FROM applied WHERE status = 'open'""")
def snk4_run_report(t):
    applied = _applied(t)
    _, listed = _snapshots(t)
    failed = F.col("c_custkey") % 11 == 0
    kept = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    # now minus 30 days, as the run's own time tells
    expired = (F.col("status") == "closed") & (F.col("last_seen") < F.lit(_AS_OF).cast("timestamp_ntz") - F.expr("interval 30 days"))

    def one(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")

    return _union(
        [
            one("fetched", listed),
            one("companies failed", t("customer").where(failed)),
            one("companies ok", t("customer").where(~failed)),
            applied.where("action <> 'not fetched'").groupBy(F.col("action").alias("counter")).agg(F.count("*").alias("n")),
            one("pruned", applied.where(expired).join(kept, "o_orderkey", "left_anti")),
            applied.where("status = 'open'").agg(F.greatest(F.count("*") - 1000, F.lit(0)).cast("long").alias("n")).select(F.lit("over corpus cap").alias("counter"), "n"),
        ]
    )
