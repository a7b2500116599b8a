"""Rules on texts and vectors by literal cases."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitforge.functions import filters, postings, resumes
from fitforge.operators import skills, snapshots, terms, vectors
from fitforge.plans import skills as skill_plans


def _each(spark, values, rule, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(rule(F.col("v"))).collect()]


LEVELS = {
    "Marketing Internship (Summer)": "intern", "Software Co-op": "intern", "Apprenticeship, Welding": "intern", "Staff Nurse": "staff", "SVP of Finance": "staff", "Head of People": "staff", "Assistant Director": "staff",
    "Sr. Associate": "senior", "Associate Consultant": "entry", "Graduate Chemist": "entry", "Early Career Analyst": "entry", "Lead Chemist": "staff", "Store Manager": "staff", "Program Manager": None, "Senior Program Manager": "senior",
    "Cloud Architect": None, "Architect, Cloud": "staff", "Chemist I": "entry", "Chemist II": "mid", "Chemist III": "senior", "Chemist IV": "senior", "Chemist V": "staff", "Chemist I / II": "mid", "Type-II Chemist": None, "chemist ii": None,
    "Midlevel Chemist": "mid", "Chemist": None, "": None, "Leadership Coach": None, "Internal Auditor": None,
}


def test_levels_of_titles(spark):
    assert dict(zip(LEVELS, _each(spark, LEVELS, postings.level_from_title), strict=True)) == LEVELS


def test_years_of_experience(spark):
    cases = {
        "at least 4 years of lab experience": ([4], [4]), "4-6 yrs in industry": ([4], [4]), "four (4) years of hands-on work": ([4], [4]), "10+ years working with plants": ([10], [10]), "2.5 years experience": ([2], [2]), "we turned 12 years old": ([], []),
        "founded 9 years ago": ([], []), "vests over the last 4 years": ([], []), "5 years of growth": ([], []), "45 years experience": ([], []), "one to three years of experience, 7 years of training": ([1, 7], [1]), "no numbers": ([], []),
    }
    found = zip(*(_each(spark, cases, lambda c, w=with_context: postings.years_mentions(c, w)) for with_context in (False, True)), strict=True)
    assert dict(zip(cases, found, strict=True)) == cases


def test_headings_of_postings(spark):
    cases = {
        "Requirements": "required", "Preferred Requirements": "nice", "What you'll do:": "responsibilities", "WHO WE ARE": "about", "Salary": "benefits", "Experience with plants": None, "## Our experience with many kinds of plants": "required",
        "- Requirements": None, "Requirements.": None, "About you": "required", "What we offer & more": "benefits", "": None, "Why": "about", "Payroll": None,
    }
    assert dict(zip(cases, _each(spark, cases, postings.heading_key), strict=True)) == cases


def test_postings_are_parsed(spark):
    text = "Plant Doctor\n\nResponsibilities\n• Water all of the plants\n• Talk to them\nSalary range: plenty\n\nEach day you will\n• Sing to every plant here\nNice to have:\n• A green thumb or two\nabout us\nWe love plants very much."
    found = spark.createDataFrame([(text,), ("",), (None,), ("Care for plants. They grow! So do we all.",)], "t string").select(postings.sections(F.col("t")).alias("s"))
    rows = found.select("s", postings.requirements(F.col("s")), postings.inferred_title(F.col("s"))).collect()
    assert [(x["key"], x["heading"]) for x in rows[0][0]] == [("intro", None), ("responsibilities", "Responsibilities"), ("benefits", None), ("responsibilities", "Each day you will"), ("nice", "Nice to have"), ("about", "about us")]
    assert [tuple(x) for x in rows[0][1]] == [("responsibilities", "Water all of the plants"), ("responsibilities", "Talk to them"), ("responsibilities", "Sing to every plant here"), ("nice", "A green thumb or two")]
    assert [r[2] for r in rows] == ["Plant Doctor", None, None, None]
    assert rows[1][0] == [] and rows[2][0] is None
    assert [tuple(x) for x in rows[3][1]] == [("required", "Care for plants."), ("required", "So do we all.")]


def test_bullets_and_contacts_of_resumes(spark):
    forms = [r[0] for r in resumes.verb_forms(spark.createDataFrame([("build",), ("plan",), ("carry",), ("write",), ("# x",)], "verb string")).collect()]
    assert {"builds", "planned", "planning", "carried", "carries", "writing"} <= set(forms) and "x" not in forms
    verbs = {"Planned trips": True, "Quickly planned trips": True, "Helped plan": False, "Garden app: carried pots": True, "Co-writing songs": True, "The plan": False, "": False, "• 2020 builds": True}
    assert dict(zip(verbs, _each(spark, verbs, lambda c: resumes.opens_with_verb(c, forms)), strict=True)) == verbs
    measured = {"grew 30 %": True, "saved $ 5": True, "2x more": True, "1,500 pots": True, "9k pots": True, "12 pots": True, "in 2019": False, "with Java 17": False, "Java 17": True, "HTML5, v2.1, COVID-19": False, "none": False}
    assert dict(zip(measured, _each(spark, measured, resumes.is_measured), strict=True)) == measured
    phones = {"(020) 1234 56789": True, "2019-2021 2022 - 2023": False, "12345": False, "+1 555 123 4567": True}
    assert dict(zip(phones, _each(spark, phones, resumes.has_phone), strict=True)) == phones
    heads = {"S K I L L S": "skills", "Academic Projects": "projects", "Leadership Experience": "activities", "★ Work & Life:": "experience", "Gardening": None}
    assert dict(zip(heads, _each(spark, heads, resumes.heading_key), strict=True)) == heads


def test_feedback_has_a_strength_and_no_more_than_eight_items(spark):
    kind = "matched array<struct<skill:string,weight:double>>, missing array<struct<skill:string,weight:double>>, weak array<struct<section:string,text:string>>, failed array<struct<label:string,detail:string>>"
    many = [(f"s{i}", 3.0) for i in range(5)] + [(f"t{i}", 2.0 - i / 2) for i in range(5)]
    rows = [([("A", 1.0), ("B", 3.0)], many, [("required", "x"), ("nice", "y"), ("nice", "z")], [("L", "D."), ("M", "E."), ("N", "F.")]), ([], [], [], [])]
    found = [r[0] for r in spark.createDataFrame(rows, kind).select(resumes.template_feedback(*map(F.col, ("matched", "missing", "weak", "failed")))).collect()]
    assert [len(x) for x in found] == [8, 1] and [x[-1]["type"] for x in found] == ["strength", "strength"]
    assert [x["severity"] for x in found[0]] == ["high", "high", "high", "medium", "high", "medium", "medium", "low"]
    assert "B and A; the posting asks for" in found[0][-1]["message"] and "t0, t1 and t2" in found[0][3]["message"]


def test_skill_mentions(spark):
    texts = [("experience", "I go to Go conferences, Go-karts and wrote a Go service in C++ and C."), ("skills", "Excel, Teams"), ("experience", "They excel. Excel at work, cross-functional Teams"), ("experience", "communication"), ("summary", "communication"), ("skills", None)]
    rows = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(texts)], "i int, section string, text string")
    taxonomy = spark.createDataFrame(skill_plans.TAXONOMY, "alias string, canonical string, category string, case_sensitive boolean, ambiguous boolean")
    found = [(r["i"], r["canonical"], texts[r["i"]][1][r["start"] : r["stop"]]) for r in skills.skill_mentions(rows, taxonomy, ["i"]).orderBy("i", "start").collect()]
    assert found == [(0, "Go", "Go"), (0, "C++", "C++"), (0, "C", "C"), (1, "Microsoft Excel", "Excel"), (1, "Microsoft Teams", "Teams"), (4, "Communication", "communication")]


def test_phrases_by_either_way(spark):
    docs = spark.createDataFrame([(1, "a b c a b d"), (1, "b"), (2, None)], "k int, text string")
    phrases = spark.createDataFrame([("a b",), ("b",), ("a b c",), ("c a",)], "phrase string")
    wanted = {(1, "a b c", 1), (1, "c a", 1), (1, "a b", 1), (1, "b", 1)}
    assert {tuple(r) for r in terms.phrase_mentions(docs, phrases, "k").collect()} == wanted


def test_nearest_ignores_what_is_no_vector(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 1, [0.0, 0.0]), (3, 1, None), (4, 1, [float("nan"), 1.0]), (5, 1, [0.6, 0.8]), (6, 1, [0.6, 0.8]), (7, 1, [3.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert [(r["vec_id"], round(r["similarity"], 6)) for r in vectors.nearest(v, v.where("vec_id = 1"), 3, "vec_id", F.col("label") == 1).collect()] == [(7, 1.0), (5, 0.6), (6, 0.6)]
    each = vectors.nearest_of_each(v, v.where("vec_id in (1, 5)"), 2, "vec_id", other="label", block=2)
    assert {(r["query_vec_id"], r["vec_id"]) for r in each.collect()} == {(1, 7), (1, 5), (5, 1)}
    with pytest.raises(ValueError, match="one query row"):
        vectors.nearest(v, v.where("vec_id < 3"), 1, "vec_id")
    whole = vectors.best_match(v, v.limit(0), ["vec_id"], "vec_id", whole=v.where("vec_id = 1"))
    assert {r["vec_id"]: r["best"] for r in whole.collect()} == pytest.approx({1: 1.0, 2: 0.0, 3: None, 4: None, 5: 0.6, 6: 0.6, 7: 1.0})
    assert np.isclose(vectors._matrices([[3.0, 4.0]])[2], [[0.6, 0.8]]).all()


def test_a_second_run_over_the_same_snapshot_changes_nothing(spark):
    stored = spark.createDataFrame([(1, "a", "t", "closed", 0, 0), (2, "b", "t", "open", 0, 0)], "k int, content string, title string, status string, first_seen int, last_seen int")
    listed = spark.createDataFrame([(1, "a", "n"), (2, "x", "n"), (3, "c", "n")], "k int, content string, title string")
    once = snapshots.apply_snapshot(stored, listed, "k", "content", ["title"], F.lit(1))
    assert {(r["k"], r["title"], r["status"], r["first_seen"], r["action"]) for r in once.collect()} == {(1, "t", "open", 0, "reopened"), (2, "n", "open", 0, "updated"), (3, "n", "open", 1, "new")}
    twice = snapshots.apply_snapshot(once.drop("action"), listed, "k", "content", ["title"], F.lit(2))
    assert {(r["action"], r["last_seen"]) for r in twice.collect()} == {("unchanged", 2)}


def test_filters(spark):
    flags = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert [flags.where(filters.is_remote(F.col("f"), w)).count() for w in (None, True, False)] == [3, 1, 1]
    places = ["50% off_site", "Bonn", None]
    assert _each(spark, places, lambda c: F.coalesce(filters.contains_text(c, "% OFF_"), F.lit(False))) == [True, False, False]
    assert _each(spark, ["a/b\\c.pdf", None, "/"], lambda c: filters.file_name(c)) == ["c.pdf", "resume.pdf", "resume.pdf"]


def test_rows_of_a_page(spark):
    from fitforge.operators import pages

    # a raised bullet, a date on the right, two lines close together, and a second region
    box = [("•", 30, 98, 34, 108, False), ("Led a", 40, 100, 65, 112, True), ("team", 70, 100, 90, 112, True), ("2020", 500, 101, 520, 113, False), ("NEXT LINE", 40, 115, 85, 127, False), ("co", 40, 130, 50, 142, False), ("op", 50.5, 130, 60, 142, False)]
    rows = [(1, i, t, float(x0), float(y0), float(x1), float(y1), 10.0, b, False, 0) for i, (t, x0, y0, x1, y1, b) in enumerate(box)] + [(1, 9, "other side", 330.0, 90.0, 380.0, 102.0, 10.0, False, False, 2)]
    frame = spark.createDataFrame(rows, "page long, span long, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, italic boolean, region int")
    found = pages.text_rows(frame).orderBy("place").collect()
    assert [(r["text"], r["bold"], r["starts_bold"], r["all_caps"]) for r in found] == [("• Led a team 2020", True, True, False), ("NEXT LINE", False, False, True), ("coop", False, False, False), ("other side", False, False, False)]
    assert (found[0]["x0"], found[0]["y0"], found[0]["x1"], found[0]["y1"]) == (30.0, 98.0, 520.0, 113.0)


def _plain_page(spans, width, height):
    """Rows of a page, written from the rules alone: a list of (region, spans from left to right)."""

    def common(a, b):
        return max(min(a[3], b[3]) - max(a[1], b[1]), 0) / (min(a[3] - a[1], b[3] - b[1]) or 0.1)

    def box(s):
        return s["x0"], s["y0"], s["x1"], s["y1"]

    def built(some):
        rows = []
        for s in sorted(some, key=lambda s: ((s["y0"] + s["y1"]) / 2, s["x0"])):
            for row in rows[:-5:-1]:
                if common(box(s), (0, min(x["y0"] for x in row), 0, max(x["y1"] for x in row))) >= 0.5:
                    row.append(s)
                    break
            else:
                rows.append([s])
        rows = [sorted(r, key=lambda s: s["x0"]) for r in rows]
        return sorted(rows, key=lambda r: (min(s["y0"] for s in r), r[0]["x0"]))

    def gutter():
        body = [s for s in spans if s["y0"] > 0.12 * height]
        if len(body) < 10:
            return None
        best, run = (0, 0), 0
        for x in range(int(0.15 * width), int(0.85 * width) + 1):
            crossing = sum(max(int(s["x0"]), 0) <= x <= min(math.ceil(s["x1"]), int(width)) for s in body)
            run = run + 1 if crossing <= max(1, int(0.03 * len(body))) else 0
            if run > best[0]:
                best = (run, x - run + 1)
        if best[0] < 8:
            return None
        g = best[1] + best[0] / 2
        left, right = [s for s in body if s["x1"] <= g], [s for s in body if s["x0"] >= g]
        chars = lambda some: sum(len(s["text"]) for s in some)
        if min(chars(left), chars(right)) < 0.15 * chars(body):
            return None
        beside = chars([r for r in right if any(common(box(r), box(x)) >= 0.5 for x in left)])
        return None if beside / chars(right) >= 0.4 and statistics.median(len(s["text"]) for s in right) < 25 else g

    g = gutter()
    if g is None:
        return [(0, r) for r in built(spans)]
    top = min((s["y0"] for s in spans if s["y0"] > 0.12 * height and (s["x1"] <= g or s["x0"] >= g)), default=0)
    rest = [s for s in spans if s["y1"] > top]
    parts = [s for s in spans if s["y1"] <= top], [s for s in rest if s["x0"] < g], [s for s in rest if s["x0"] >= g]
    return [(k, r) for k, part in enumerate(parts) for r in built(part)]


def _plain_row(region, spans):
    text = "".join((" " if i and s["x0"] - spans[i - 1]["x1"] > 0.15 * s["size"] else "") + s["text"] for i, s in enumerate(spans))
    text = " ".join(text.split())
    lettered = [s for s in spans if any(c.isalpha() for c in s["text"])]
    letters = "".join(c for c in text if c.isalpha())
    caps = len(letters) > 1 and all(c.isupper() for c in letters)
    bold, italic = (bool(lettered) and all(s[c] for s in lettered) for c in ("bold", "italic"))
    return region, text, spans[0]["x0"], min(s["y0"] for s in spans), max(s["x1"] for s in spans), max(s["y1"] for s in spans), max(s["size"] for s in spans), bold, italic, caps, bool(lettered) and lettered[0]["bold"]


def test_rows_of_all_pages_against_brute_force(spark):
    from fitforge.operators import pages
    from fitforge.plans import pages as page_plans

    tables = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    width, height = page_plans.WIDTH, page_plans.HEIGHT
    # lines of one page as well as of two columns, blanks within, signs without letters, letters without case
    odd = F.when(F.col("span") % 7 == 0, "two  blanks\there").when(F.col("span") % 7 == 1, "2019").when(F.col("span") % 7 == 2, "東京").when(F.col("span") % 7 == 3, "ALL CAPS").otherwise(F.col("text"))
    visible = pages.visible_boxes(page_plans.spans(tables).withColumn("text", odd)).cache()
    by_page: dict = {}
    for s in visible.orderBy("span").collect():
        by_page.setdefault(s["page"], []).append(s)
    wanted, regions = [], set()
    for page, spans in by_page.items():
        rows = _plain_page(spans, width, height)
        wanted += [(page, k, *_plain_row(region, r)) for k, (region, r) in enumerate(rows)]
        regions |= {(page, s["span"], region) for region, r in rows for s in r}
    columns = ["page", "place", "region", "text", "x0", "y0", "x1", "y1", "size", "bold", "italic", "all_caps", "starts_bold"]
    assert {r["region"] for r in pages.page_rows(visible, width, height).collect()} == {0, 1, 2}
    assert sorted(map(tuple, pages.page_rows(visible, width, height).select(*columns).collect())) == sorted(wanted)
    found = pages.page_regions(visible, width, height)
    assert {(r["page"], r["span"], r["region"]) for r in found.collect()} == regions
    assert sorted(map(tuple, pages.text_rows(found).select(*columns).collect())) == sorted(wanted)


def test_letters_alone_decide_the_style_of_a_row(spark):
    from fitforge.operators import pages

    spans = [(1, 1, "Team", 0.0, 0.0, 40.0, 10.0, 10.0, True, True), (1, 2, "2019", 50.0, 0.0, 70.0, 10.0, 10.0, False, False), (2, 1, "東京", 0.0, 0.0, 40.0, 10.0, 10.0, False, False), (3, 1, "a  b", 0.0, 0.0, 40.0, 10.0, 10.0, False, False)]
    frame = spark.createDataFrame(spans, "page long, span long, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, italic boolean")
    found = {r["page"]: r for r in pages.page_rows(frame, 600, 800).collect()}
    assert (found[1]["bold"], found[1]["italic"], found[1]["starts_bold"]) == (True, True, True)
    assert not found[2]["all_caps"] and found[3]["text"] == "a b"
    assert (found[1]["first_text"], found[1]["second_x0"], found[2]["second_x0"]) == ("Team", 50.0, None)


def test_a_bonus_for_a_title_counts_once(spark):
    from fitforge.operators import scoring

    people = spark.createDataFrame([(1, "data engineer and analyst | c++ lead"), (2, "engineering lead"), (3, None)], "person long, titles string")
    owned = spark.createDataFrame([(1, "sql"), (3, "sql")], "person long, skill string")
    roles = spark.createDataFrame([("data", "sql", 1.0), ("data", "spark", 1.0), ("go", "go", 1.0)], "role string, skill string, weight double")
    words = spark.createDataFrame([("data", "data engineer"), ("data", "analyst"), ("data", "data"), ("go", "engineer")], "role string, word string")
    found = {(r["person"], r["role"]): r["score"] for r in scoring.role_scores(people, owned, roles, words, "person", "role").collect()}
    assert found == {(1, "data"): 0.75, (1, "go"): 0.25, (3, "data"): 0.5}


def test_the_first_of_images_that_round_alike(spark):
    from fitforge.operators import pages

    images = spark.createDataFrame([(1, 1, 0.5, 0.0, 400.2, 500.0), (1, 2, 0.4, 0.3, 400.0, 499.9), (1, 3, 0.0, 0.0, 10.0, 10.0)], "page long, image long, x0 double, y0 double, x1 double, y1 double")
    spans = spark.createDataFrame([(1, 1, "abc", 10.0, 10.0, 20.0, 20.0)], "page long, span long, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r["share"], r["chars"]) for r in pages.big_images(images, spans, 600, 800).collect()] == [((400.2 - 0.5) * 500.0 / 480_000, 3)]


def test_similarity_of_vectors_of_several_lengths(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 1, [0.6, 0.8]), (3, 1, [1.0, 0.0, 0.0]), (4, 1, [0.0, 1.0, 0.0]), (5, 1, [1.0, 0.0]), (6, 1, [])]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        for partitions in (1, 3):
            v = spark.createDataFrame(order, "vec_id long, label int, embedding array<double>").repartition(partitions)
            found = vectors.nearest(v, v.where("vec_id = 1"), 9, "vec_id", F.col("label") == 1).collect()
            assert [(r["vec_id"], r["similarity"]) for r in found] == [(5, 1.0), (2, 0.6)]
            each = vectors.nearest_of_each(v, v.where("label = 0"), 9, "vec_id", other="label").collect()
            assert {(r["vec_id"], r["similarity"]) for r in each} == {(5, 1.0), (2, 0.6)}


def test_a_resume_from_its_rows_to_its_score(spark):
    from fitforge.operators import analysis, bullets, pages

    def line(text, size=11.0, bold=False, x0=36.0, glyph=False, gap=2.0):
        nonlocal y
        spans.append((1, len(spans), "•", x0, y - 1, x0 + 4, y - 1 + size * 1.15, size, False, False)) if glyph else None
        at = x0 + 18 if glyph else x0
        spans.append((1, len(spans), text, at, y, at + len(text) * size * 0.5, y + size * 1.15, size, bold, False))
        y += size * 1.15 + gap

    spans, y = [], 50.0
    line("Jane Doe", 14.0, True)
    line("jane@mail.example.com, (030) 1234 5678 90")
    for heading, rows in {
        "EXPERIENCE": [("Acme Corp, May 2020 - Present", {"bold": True}), ("Built a pipeline that", {"glyph": True, "x0": 54.0}), ("handles 10,000 users a day", {"x0": 72.0}), ("Led a team and cut costs by 30%", {"glyph": True, "x0": 54.0}), ("Helped with many things", {"glyph": True, "x0": 54.0}), ("two words", {"glyph": True, "x0": 54.0})],
        "EDUCATION": [("State University of Somewhere", {})],
        "SKILLS": [("Python, Go", {})],
        "PROJECTS": [("Designed a thing. ", {}), ("Wrote $5,000 worth of code", {}), ("and more of it", {})],
    }.items():
        line(heading, 12.0, True, gap=4.0)
        for text, how in rows:
            line(text, **how)
    frame = spark.createDataFrame(spans, "page long, span long, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, italic boolean")
    rows = pages.headed_rows(pages.page_rows(frame, 612, 792).withColumn("document", F.lit(7)), "document", "place").withColumn("page", F.lit(0))
    found = [(r["section"], r["nth"], r["text"]) for r in bullets.assembled(rows, "document", "place").orderBy("nth").collect()]
    assert found == [("experience", 1, "Built a pipeline that handles 10,000 users a day"), ("experience", 2, "Led a team and cut costs by 30%"), ("experience", 3, "Helped with many things"), ("projects", 4, "Designed a thing."), ("projects", 5, "Wrote $5,000 worth of code and more of it")]
    assert [r["text"] for r in bullets.job_titles(rows, "document", "place").collect()] == ["Acme Corp, May 2020 - Present"]
    r = analysis.analysed_resumes(rows, "document", "place", ["built", "led", "designed", "wrote"]).first()
    assert (r["n_bullets"], r["n_verbs"], r["n_measured"], r["weak"], r["n_pages"]) == (5, 4, 3, '"Helped" (1×)', 1)
    assert all(c["passed"] for c in r["checks"]) and r["score"] == 1.0
    facts = spark.createDataFrame([(7, True, 0.5)], "document int, trapped boolean, table_share double")
    assert analysis.analysed_resumes(rows, "document", "place", ["built"], facts).first()["score"] == 0.75


def test_running_lines_go(spark):
    from fitforge.operators import layout

    rows = [(1, 0, 10.0, "Jane Doe 1"), (1, 1, 10.0, "JANE DOE 22"), (1, 0, 400.0, "Jane Doe 1"), (1, 0, 780.0, "Page 1 of 2"), (1, 1, 300.0, "12/13"), (1, 1, 300.0, "1234"), (1, 0, 780.0, "only here"), (2, 0, 10.0, "Jane Doe 1"), (2, 0, 20.0, "Jane Doe 1")]
    frame = spark.createDataFrame([(d, p, y, y + 10, t) for d, p, y, t in rows], "document long, page int, y0 double, y1 double, text string")
    found = sorted((r["document"], r["y0"], r["text"]) for r in layout.without_running_lines(frame, "document", "page", 800).collect())
    assert found == [(1, 300.0, "1234"), (1, 400.0, "Jane Doe 1"), (1, 780.0, "only here"), (2, 10.0, "Jane Doe 1"), (2, 20.0, "Jane Doe 1")]
