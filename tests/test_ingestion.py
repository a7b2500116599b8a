"""Answers of a model, addresses, payloads and character references by literal cases."""

import html.entities
import json

import duckdb
from pyspark.sql import functions as F

from fitforge.functions import answers, text, urls
from fitforge.plans import queries
from fitforge.sources import boards


def _each(spark, values, rule):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(rule(F.col("v"))).collect()]


def _items(n, **change):
    made = [{"type": "strength" if i == 0 else "structure", "severity": "low", "message": f"A message of item {i}."} for i in range(n)]
    for i, fields in change.items():
        made[int(i[1:])] |= fields
    return json.dumps({"items": made, "note": 1})


def test_errors_of_answers(spark):
    good = _items(5)
    cases = {
        good: [], _items(8): [], " " + good + "\n": [], _items(4): ["4 items"], _items(9): ["9 items"], "": ["no JSON"], good + " thanks": ["no JSON"], good + "]": ["no JSON"], good[:-1]: ["no JSON"], "{}": ["no items"], "[]": ["no items"], "5": ["no items"], "null": ["no items"],
        '{"items": 5}': ["no items"], '{"items": []}': ["0 items", "no strength"], _items(5, _0={"type": "weak_requirement"}): ["no strength"], _items(5, _1={"type": "praise"}): ["1: type"], _items(5, _2={"severity": None}): ["2: severity"],
        _items(5, _3={"message": "short"}): ["3: message"], _items(5, _3={"message": "x" * 501}): ["3: message"], _items(5, _3={"message": "é" * 500}): [], _items(5, _4={"message": 12345678901}): ["4: message"], '{"items": [1, null, "a", {}, []]}': ["no strength", *(f"{i}: {x}" for i in range(5) for x in ("type", "severity", "message"))],
    }
    assert _each(spark, list(cases), answers.answer_errors) == list(cases.values())
    assert _each(spark, [None], answers.answer_errors) == [["no JSON"]]


def test_templates_stand_in_row_by_row(spark):
    templates = F.array(F.struct(F.lit("strength").alias("type"), F.lit("low").alias("severity"), F.lit("Well laid out.").alias("message")))
    found = _each(spark, [_items(6), _items(2), None], lambda c: answers.chosen_feedback(c, templates))
    assert [(r["source"], len(r["items"]), r["items"][0]["message"]) for r in found] == [("llm", 6, "A message of item 0."), ("template", 1, "Well laid out."), ("template", 1, "Well laid out.")]


def test_addresses_of_postings(spark):
    known = [urls.Board("a", r"jobs\.example\.com", r"/([\w-]{1,100})/jobs/(\d{1,20})/?"), urls.Board("b", r"hire\.example\.com", r"/([\w.-]{1,100})/([0-9a-fA-F]{8})(?:/apply)?/?", lower_id=True)]
    cases = {
        "https://jobs.example.com/Acme/jobs/12": ("a", "acme", "12"), " http://JOBS.example.com/acme/jobs/12/?x=1#y ": ("a", "acme", "12"), "https://hire.example.com/a.b/00AAbb11/apply": ("b", "a.b", "00aabb11"),
        "https://user@jobs.example.com/acme/jobs/12": None, "https://u:p@jobs.example.com/acme/jobs/12": None, "https://jobs.example.com:443/acme/jobs/12": None, "ftp://jobs.example.com/acme/jobs/12": None, "jobs.example.com/acme/jobs/12": None,
        "https://jobs.example.com.evil.test/acme/jobs/12": None, "https://evil.test/jobs.example.com/acme/jobs/12": None, "https://evil.test\\@jobs.example.com/acme/jobs/12": None, "https://jobs.example.com/acme/jobs/12/more": None, "https://jobs.example.com/acme/jobs/x": None,
        "https://jobs.example.com/acme/../jobs/12": None, "https://xjobs.example.com/acme/jobs/12": None, "javascript://jobs.example.com/acme/jobs/12": None, "": None, "https://": None, "https://jobs.example.com": None, "https://jobs.example.com/a b/jobs/1": None,
    }
    found = _each(spark, list(cases), lambda c: urls.posting_reference(c, known))
    assert [None if r is None else tuple(r) for r in found] == list(cases.values())
    assert _each(spark, [None], lambda c: urls.posting_reference(c, known)) == [None]


def test_each_payload_is_accepted_or_rejected(spark):
    texts = ['{"id": 1, "title": "a"}', '{"id": 2}', '{"id": "x", "title": "a"}', "{", "", None, "[]", '{"id": 3, "title": null}', '{"id": 4, "title": "b", "more": 1}']
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, p string")
    accepted, rejected = boards.judged_payloads(rows, "k", "p", "id bigint, title string", ["id", "title"])
    assert [tuple(r) for r in accepted.orderBy("k").collect()] == [(0, 1, "a"), (8, 4, "b")]
    reasons = {r["k"]: r["reason"] for r in rejected.collect()}
    assert {k: reasons[k] for k in (1, 2, 3, 4, 5, 7)} == {1: "without title", 2: "malformed", 3: "malformed", 4: "missing", 5: "missing", 7: "without title"}
    assert set(reasons) == {1, 2, 3, 4, 5, 6, 7}


def test_all_character_references(spark):
    names = [f"a &{n} b" for n in html.entities.html5 if n.endswith(";")]
    assert _each(spark, names, text.unescaped) == [f"a {html.entities.html5[n]} b" for n in html.entities.html5 if n.endswith(";")]
    assert _each(spark, ["&#233;&#xE9;&#8230;&#X41;", "&amp;lt;", "AT&T &c. &; & &nosuch;", "&eacute&euro;", None], text.unescaped) == ["éé…A", "&lt;", "AT&T &c. &; & &nosuch;", "é€", None]
    assert _each(spark, ["<p>caf&eacute; &#8230; 5&nbsp;&euro;</p>", "&lt;p&gt;R&amp;D&lt;/p&gt;"], text.html_to_text) == ["café … 5 €", "R&D"]


def test_references_that_a_page_cuts_off_are_text(spark):
    texts = ["<p>x &amp</p>y", "<p>x &a</p>", "<p>a&amp;b &copy c &copy;</p>", "<li>&</li>&quot", "<p>&amp;amp; &amp;copy</p>"]
    rows = [(i * 4 + way, x) for i, x in enumerate(texts) for way in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    db = duckdb.connect()
    db.sql("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    found = queries.txt1_html_to_text(lambda _: pages)
    assert sorted(map(tuple, found.collect())) == sorted(db.sql(queries.SQL["txt1_html_to_text"]).fetchall())
