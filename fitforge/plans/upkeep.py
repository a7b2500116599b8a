"""Registered queries of upkeep and layout over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitforge.operators import layout, maintenance
from fitforge.plans.queries import _query


@_query("""
    SELECT coalesce(c_custkey, s_suppkey) AS c_custkey, coalesce(s_name, c_name) AS c_name, CASE WHEN c_custkey IS NULL THEN true ELSE c_acctbal > 0 END AS active
    FROM customer FULL JOIN (SELECT s_suppkey + 100 AS s_suppkey, s_name FROM supplier) ON c_custkey = s_suppkey""")
def dml1_upserted_companies(t):
    stored = t("customer").withColumn("active", F.col("c_acctbal") > 0)
    incoming = t("supplier").select((F.col("s_suppkey") + 100).alias("c_custkey"), F.col("s_name").alias("c_name"))
    return maintenance.upsert_names(stored, incoming, "c_custkey", "c_name", "active")


@_query("""
    SELECT o_orderkey, CASE WHEN target IS NULL THEN o_orderstatus = 'O' ELSE o_orderkey = target END AS active
    FROM orders LEFT JOIN (SELECT o_custkey AS c, max(o_orderkey) AS target FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL) ON o_custkey = c""")
def dml7_exclusive_active(t):
    rows = t("orders").withColumn("active", F.col("o_orderstatus") == "O")
    targets = rows.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return maintenance.activate(rows, targets, "o_custkey", "o_orderkey", "active").select("o_orderkey", "active")


@_query("""
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS active FROM orders),
    lost AS (SELECT o_custkey FROM s WHERE active AND o_orderstatus = 'F')
    SELECT o_orderkey, active OR (o_custkey IN (FROM lost) AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) AS active FROM s WHERE o_orderstatus <> 'F'""")
def win5_promoted_postings(t):
    newest = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    rows = t("orders").withColumn("active", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*newest)) == 1)
    return maintenance.delete_and_promote(rows, F.col("o_orderstatus") == "F", "o_custkey", "active", newest).select("o_orderkey", "active")


@_query("""
    SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) = 1
           AND NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_linenumber = 1 AND s.l_suppkey = i.l_suppkey AND s.l_partkey = i.l_partkey) AS inserted
    FROM lineitem i WHERE l_linenumber > 1""")
def dml9_unique_inserts(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    stored, incoming = rows.where("l_linenumber = 1"), rows.where("l_linenumber > 1")
    return maintenance.insert_unique(stored, incoming, ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "inserted")


@_query("""
    SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE NOT c_acctbal < 0""")
def dml10_cascading_delete(t):
    customers = t("customer").where("NOT c_acctbal < 0")
    orders = maintenance.cascade(t("orders"), customers, "o_custkey", "c_custkey")
    return maintenance.cascade(t("lineitem"), orders, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@_query("""
    SELECT l_orderkey, l_linenumber, o_orderkey IS NOT NULL AS deleted
    FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_custkey = l_partkey % 150""")
def dml11_owner_deletes(t):
    requests = t("lineitem").select("l_linenumber", F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 150).alias("o_custkey"))
    _, answers = maintenance.delete_own(t("orders"), requests, "o_custkey", "o_orderkey")
    return answers.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "deleted")


@_query("SELECT user_id, event_type, arg_min(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def win2_first_occurrences(t):
    return maintenance.first_values(t("events"), ["user_id", "event_type"], "event_id", "value")


@_query("""
    SELECT l_orderkey, l_linenumber, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_returnflag = 'R' AND contains(lower(c_name), lower('R#00000'))""")
def jn2_tracked_applications(t):
    lines = t("lineitem").where("l_returnflag = 'R'").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = t("customer").where(F.contains(F.lower("c_name"), F.lower(F.lit("R#00000")))).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return lines.join(found, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "c_name", "n_name")


@_query("""
    WITH i AS (SELECT l_suppkey, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS a, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity::INT - 1 AS b FROM lineitem)
    SELECT l_suppkey, x::BIGINT AS x, count(*) AS covered FROM (SELECT l_suppkey, unnest(range(a, b + 1)) AS x FROM i) GROUP BY ALL""")
def agg17_coverage_histogram(t):
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long")
    rows = t("lineitem").select("l_suppkey", day.alias("a"), (day + F.col("l_quantity").cast("int") - 1).alias("b"))
    return layout.coverage_histogram(rows, "l_suppkey", "a", "b")


@_query("""
    SELECT source, line, count(DISTINCT doc_id) AS n_pages FROM (
        SELECT source, doc_id, regexp_replace(lower(trim(line, ' ')), '[0-9]', '#', 'g') AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
    WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT doc_id) >= 2""")
def agg13_repeated_lines(t):
    return layout.repeated_lines(t("documents"), "source", "doc_id", "text")


@_query("""
    SELECT source, lang, weight FROM (SELECT source, lang, sum(n_chars)::BIGINT AS weight, row_number() OVER (PARTITION BY source ORDER BY sum(n_chars) DESC, lang) AS n FROM documents GROUP BY source, lang) WHERE n = 1""")
def agg11_main_language(t):
    return layout.weighted_mode(t("documents"), "source", "lang", F.col("n_chars"))


@_query("SELECT source, median(n_chars) AS middle FROM documents GROUP BY source")
def agg16_median_length(t):
    return t("documents").groupBy("source").agg(F.median("n_chars").alias("middle"))


@_query("""
    SELECT l_orderkey, coalesce(min(l_quantity) FILTER (l_returnflag = 'R'), min(l_quantity) FILTER (l_returnflag <> 'N')) AS least FROM lineitem GROUP BY l_orderkey""")
def agg18_preferred_minimum(t):
    least = F.coalesce(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), F.min(F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))))
    return t("lineitem").groupBy("l_orderkey").agg(least.alias("least"))


@_query("""
    SELECT l_partkey, count(*) AS n, CASE WHEN bool_or(l_returnflag = 'R') THEN 3.0 WHEN bool_and(l_returnflag = 'N') THEN 0.5 WHEN count(*) >= 2 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
    FROM lineitem GROUP BY l_partkey""")
def scr11_skill_weights(t):
    required, nice, n = F.bool_or(F.col("l_returnflag") == "R"), F.bool_and(F.col("l_returnflag") == "N"), F.count("*")
    weight = F.when(required, 3.0).when(nice, 0.5).when(n >= 2, 2.0).otherwise(1.0)
    return t("lineitem").groupBy("l_partkey").agg(n.alias("n"), weight.alias("weight"))


@_query("""
    SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS under
    FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL)""")
def win7_heading_above(t):
    turns: DataFrame = t("conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    heading = F.when(F.col("role") == "user", F.col("turn"))
    return turns.select("conv_id", "turn", layout.heading_above(turns, "conv_id", "turn", heading).alias("under"))


@_query("""
    SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_quantity DESC, l_partkey)[1:3], ',') AS top FROM lineitem GROUP BY l_orderkey""")
def prj7_top_three(t):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_partkey"))
    first = t("lineitem").select("l_orderkey", "l_partkey", place.alias("n")).where("n <= 3")
    listed = F.array_sort(F.collect_list(F.struct("n", "l_partkey")))
    return first.groupBy("l_orderkey").agg(F.array_join(F.transform(listed, lambda x: x["l_partkey"].cast("string")), ",").alias("top"))
