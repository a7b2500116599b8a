"""Kernels on the text of postings: equal texts are read once, and years as the SQL has them."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from fitforge.functions import postings, postingtext
from fitforge.plans.postings import _YEARS_SQL


def test_equal_texts_of_a_batch_are_read_once():
    seen = []
    column = pa.array(["a", None, "b", "a", "a", "b"])
    found = postingtext.by_value(column, lambda x: seen.append(x) or [x + x], pa.list_(pa.string()))
    assert found.to_pylist() == [["aa"], None, ["bb"], ["aa"], ["aa"], ["bb"]] and sorted(seen) == ["a", "b"]
    assert postingtext.by_value(column.slice(1, 2), len, pa.int32()).to_pylist() == [None, 1]


def test_least_years_of_a_column_are_those_of_each_row():
    Section = postingtext.Section
    rows = [
        [Section("required", None, "3 years of experience"), Section("required", None, "2 years"), Section("intro", None, "1 year of experience")],
        [Section("required", None, "none"), Section("about", None, "7 years old, 6 yrs of growth"), Section("intro", "Years", "5 years in industry")],
        [Section("nice", None, "1 year of experience")],
        [],
        None,
        [Section("required", None, "0 years of experience"), Section("nice", None, "")],
    ]
    column = pa.array([x if x is None else [s._asdict() for s in x] for x in rows], pa.list_(pa.struct([("key", pa.string()), ("heading", pa.string()), ("text", pa.string())])))
    assert postingtext.least_years_of(column).to_pylist() == [2, 5, None, None, None, 0]
    assert postingtext.least_years_of(column.slice(1, 4)).to_pylist() == [5, None, None, None]
    assert [x if x is None else postingtext.least_years(x) for x in rows] == [2, 5, None, None, None, 0]


YEARS = ["12years of experience", "asks for 12years", "Five(5)yrs working", "3 YEARS\nof experience", "at least 4\nyears", "2years old", "light years", "over the last 5years"]


def test_years_right_behind_a_number_are_mentions(spark):
    expected = duckdb.sql(f"WITH source AS (SELECT i AS id, '' AS key, text FROM (VALUES {', '.join(f'({i}, {chr(39)}{x}{chr(39)})' for i, x in enumerate(YEARS))}) v(i, text)), {_YEARS_SQL} SELECT id, years, in_context FROM years ORDER BY ALL").fetchall()
    rows = spark.createDataFrame(list(enumerate(YEARS)), "i int, v string").orderBy("i").select("i", postings.years_mentions(F.col("v"), False), postings.years_mentions(F.col("v"), True)).collect()
    assert {i: a for i, a, _ in rows} == {i: [n for j, n, _ in expected if j == i] for i in range(len(YEARS))}
    assert {i: b for i, _, b in rows} == {i: [n for j, n, within in expected if j == i and within] for i in range(len(YEARS))}
    assert rows[0][1] == [12] and rows[3][1] == [3]


def test_a_parsed_posting_has_what_its_parts_have(spark):
    texts = ["Cook II\n\nRequirements:\n- Two (2)years of experience here\n- Cook all of it well", "", None, "We cook. You eat all of it! So it is.", "Cook II\n\nRequirements:\n- Two (2)years of experience here\n- Cook all of it well"]
    rows = spark.createDataFrame([(i, x, "Staff Nurse " if i == 4 else " ") for i, x in enumerate(texts)], "i int, text string, title string")
    parts = rows.withColumn("s", postings.sections(F.col("text")))
    parts = parts.select("i", F.coalesce(F.nullif(F.trim("title"), F.lit("")), postings.inferred_title(F.col("s"))).alias("title"), F.col("s").alias("sections"), postings.requirements(F.col("s")).alias("requirements"), postings.least_years(F.col("s")).alias("min_years"))
    whole = rows.select("i", postings.parsed_posting(F.col("title"), F.col("text")).alias("p")).select("i", "p.*")
    assert whole.drop("level").orderBy("i").collect() == parts.orderBy("i").collect()
    assert [(r["title"], r["level"], r["min_years"], None if r["requirements"] is None else len(r["requirements"])) for r in whole.orderBy("i").collect()] == [("Cook II", "mid", 2, 2), (None, None, None, 0), (None, None, None, None), (None, None, None, 2), ("Staff Nurse", "staff", 2, 2)]


def test_first_characters_hide_no_boilerplate():
    lines = {
        "benefits": ["The base salary is high", "BASE PAY", "salary range", "a pay range", "compensation range", "annual salary", "pay transparency", "on-target earnings", "Hourly rate", "salary of this", "medical, dental", "401(k) match", "paid parental leave"],
        "about": ["equal opportunity", "Equal Employment Opportunities", "without regard to", "sexual orientation", "veteran status", "protected characteristic", "reasonable accommodation", "e-verify", "applicants with criminal", "fair chance", "privacy policy", "#LI-x"],
        None: ["database salary", "pay", "see #LI-x", "", "401 k match"],
    }
    assert {key: [postingtext.line(x).boilerplate for x in of] for key, of in lines.items()} == {key: [key] * len(of) for key, of in lines.items()}
